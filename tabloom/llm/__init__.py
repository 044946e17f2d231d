"""Corpus operators for training data; importing the package registers their queries."""

from tabloom.llm import exact_dedup, language_id, mixing, packing, phrases, quality, resampling, sentencepiece_scan, simhash, toxicity, url_filter, variants, warc  # noqa: F401
from tabloom.llm.support import ORACLES, QUERIES  # noqa: F401
