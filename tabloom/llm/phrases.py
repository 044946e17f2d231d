"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases into longer phrases, and so on. On each level:

* Runs of one symbol become one symbol named by (symbol, length).
* Deterministic coin tossing gives every symbol a short label: twice the lowest bit in which it
  differs from its left neighbour, plus its own value of that bit. Repeated TOSSES times, labels come
  from a handful of values, and neighbours still differ.
* A phrase starts at every local maximum of the labels. Phrases have two to some dozen symbols,
  about three on average, and a phrase's end depends on a few symbols around it only.
* A phrase is named by a hash of its symbols, so equal phrases have equal names everywhere.

Equal substrings are therefore parsed alike but for a few symbols at their ends, wherever they
stand. The signature of a text is the set of its phrase names from level LEVEL on (the last
name, if it is parsed into one before that). The fingerprint holds the WIDTH smallest hashes of
the signature, 8 hex digits each, and the likeness of two fingerprints estimates the Jaccard
similarity of the signatures.

Defined results: a null text counts as empty; an empty text has the empty fingerprint; two empty
fingerprints have likeness 1, an empty and another one 0. Of rows with equal ids the order is that
of a hash of their texts; rows with a null id come last. A single row is its own next one. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.support import load, query, shuffle_parts, text_of

LEVEL = 2
WIDTH = 64
TOSSES = 3
BLOCK = 1 << 20
RANGES = 4096

_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64 bits."""
    x = x + _MIX[0]
    x = (x ^ (x >> _U(30))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(31))


def _toss(left: np.ndarray, x: np.ndarray) -> np.ndarray:
    """2 * lowest differing bit + own bit there."""
    diff = left ^ x
    low = np.bitwise_count((diff & (~diff + x.dtype.type(1))) - x.dtype.type(1)).astype(np.uint8)
    own = ((x >> low.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)
    return 2 * low + own


def _byte_table(bits: int) -> np.ndarray:
    x = np.arange(1 << bits, dtype=np.uint8)
    return _toss(x[:, None], x[None, :])


_TOSS_BYTE = _byte_table(8).ravel()
_PLACE = mix(np.arange(64, dtype=np.uint64))
_BYTE_AT = mix(np.arange(256, dtype=np.uint64)[None, :] ^ _PLACE[:, None]).ravel()


def _run_starts(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    begins = np.empty(len(x), dtype=bool)
    begins[0] = True
    np.not_equal(x[1:], x[:-1], out=begins[1:])
    begins |= first
    return begins


def _left(x: np.ndarray, first: np.ndarray, other) -> np.ndarray:
    """Left neighbours; a text's first symbol has one that differs in bit 0."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = other(x[first])
    return left


def parse_level(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of adjacent texts, whose first symbols are marked, and the new marks.

    Bytes and names take the same steps; bytes look their hashes up, runs of a byte excepted.
    """
    plain = x.dtype == np.uint8
    begins = _run_starts(x, first)
    at = np.flatnonzero(begins)
    length = np.diff(np.append(at, len(x)))
    x, first = x[at], first[at]
    runs = np.flatnonzero(length > 1)
    run_name = mix(x[runs].astype(np.uint64) * _U(31) + mix(length[runs].astype(np.uint64)))
    if plain:
        left = _left(x, first, np.invert)
        label = _TOSS_BYTE[left.astype(np.uint16) << 8 | x]
        # Runs and the symbols after them differ from the table's bytes.
        odd = np.unique(np.concatenate([runs, runs[runs + 1 < len(x)] + 1]))
        name = x[odd].astype(np.uint64)
        name[np.searchsorted(odd, runs)] = run_name
        before = left[odd].astype(np.uint64)
        after = np.flatnonzero(np.isin(odd - 1, runs, assume_unique=True) & ~first[odd])
        before[after] = run_name[np.searchsorted(runs, odd[after] - 1)]
        new = np.flatnonzero(first[odd])
        before[new] = ~name[new]
        label[odd] = _toss(before, name)
    else:
        x[runs] = run_name
        label = _toss(_left(x, first, np.invert), x)
    for _ in range(TOSSES - 1):
        left = _left(label, first, lambda v: v ^ np.uint8(1))
        label = _TOSS_BYTE[left.astype(np.uint16) << 8 | label]
    # Neighbours differ, so maxima are strict; a text's ends count as lower.
    rises = np.append(True, label[1:] > label[:-1]) | first
    falls = np.append(label[:-1] > label[1:], True) | np.append(first[1:], True)
    start = np.flatnonzero((rises & falls) | first)
    size = np.diff(np.append(start, len(x)))
    place = np.arange(len(x), dtype=np.int32) - np.repeat(start, size).astype(np.int32)
    # A sum of hashes of (symbol, place) names the sequence. Labels have few values, so phrases are short.
    if plain:
        part = _BYTE_AT[place << 8 | x]
        part[runs] = mix(run_name ^ _PLACE[place[runs]])
    else:
        part = mix(x ^ _PLACE[place])
    return mix(np.add.reduceat(part, start) + size.astype(np.uint64)), first[start]


def signatures(texts: list[bytes], level: int = LEVEL, width: int = WIDTH) -> list[np.ndarray]:
    """The ``width`` smallest 32-bit hashes of each text's phrase names, ascending."""
    out = [np.zeros(0, dtype=np.uint32)] * len(texts)
    filled = [i for i, t in enumerate(texts) if t]
    if not filled:
        return out
    x = np.frombuffer(b"".join([texts[i] for i in filled]), dtype=np.uint8)
    sizes = np.array([len(texts[i]) for i in filled])
    first = np.zeros(len(x), dtype=bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    owner = np.array(filled)
    names, owners = [], []
    at = 0
    while True:
        x, first = parse_level(x, first)
        at += 1
        of = owner[np.cumsum(first) - 1]
        single = first & np.append(first[1:], True)
        taken = single if at < level else np.ones(len(x), dtype=bool)
        names.append(x[taken])
        owners.append(of[taken])
        # Texts of one phrase are done.
        x, first, owner = x[~single], first[~single], owner[~single[first]]
        if not len(x):
            break
    hashed = (mix(np.concatenate(names)) >> _U(32)).astype(np.uint64) | np.concatenate(owners).astype(np.uint64) << _U(32)
    hashed.sort()
    hashed = hashed[np.append(True, hashed[1:] != hashed[:-1])]
    of = (hashed >> _U(32)).astype(np.int64)
    starts = np.searchsorted(of, filled)
    ends = np.searchsorted(of, filled, side="right")
    for i, s, e in zip(filled, starts.tolist(), ends.tolist(), strict=True):
        out[i] = hashed[s : min(e, s + width)].astype(np.uint32)
    return out


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, width: int = WIDTH) -> float:
    """Estimated Jaccard similarity: the common part of the smallest hashes of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:width]
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum() / len(union))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first characters of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(
            batch.column("bucket").to_pylist(), batch.column("ahead").to_pylist(), batch.column("doc_id").to_pylist(),
            (t.as_py() for t in batch.column("t")), strict=True,
        )


def _fingerprint_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of bucket and id; a bucket ends with the first row of the next one."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def finish(held: list[tuple]) -> pa.RecordBatch:
        """All held rows but the last have their next row behind them."""
        texts = [r[3] for r in held]
        pairs = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
        changed = [edited(texts[i], texts[i + 1]) for i in pairs]
        raw = [t.encode("utf-8", "surrogatepass") for t in changed]
        found = signatures([t.encode("utf-8", "surrogatepass") for t in texts] + raw)
        own, new = found[: len(texts)], found[len(texts) :]
        rows = [
            (
                held[i][2], len(texts[i]), hashlib.sha256(raw[k]).hexdigest(), to_hex(own[i]), to_hex(new[k]),
                likeness(own[i], new[k]), likeness(own[i], own[i + 1]),
            )
            for k, i in enumerate(pairs)
        ]
        columns = [pa.array([r[c] for r in rows], kinds[c]) for c in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    held: list[tuple] = []
    size = 0
    for row in _rows(batches):
        held.append(row)
        size += len(row[3])
        if size >= BLOCK and len(held) > 1:
            yield finish(held)
            held, size = [row], len(row[3])
    if len(held) > 1:
        yield finish(held)


def _literals(values: list[int]):
    return F.array(*[F.lit(v).cast("bigint") for v in values]) if values else F.array().cast("array<bigint>")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and their edited texts, with their likenesses.

    Rows are dealt to ranges of ids. A range also gets the first row of the next one, the only
    row that it needs from elsewhere; the last range gets the first row of all.
    """
    spark = df.sparkSession
    text = text_of(text_col)
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("t"))
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    ranges = min(RANGES, 2 * shuffle_parts(spark))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx(order, steps, 100 * ranges).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    # The number of cuts at or below the id: first among every step-th cut, then in one step.
    step = max(1, round(len(cuts) ** 0.5))
    coarse, table = _literals(cuts[step - 1 :: step]), _literals(cuts)
    steps_below = F.size(F.filter(coarse, lambda c: c <= order))
    bucket = steps_below * step + F.size(F.filter(F.slice(table, steps_below * step + 1, step), lambda c: c <= order))
    rows = rows.withColumns({"tie": F.xxhash64("t"), "bucket": bucket}).withColumn("ahead", F.lit(False))

    first = rows.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "tie")).alias("k"))
    heads = first.orderBy("bucket").collect()  # at most RANGES rows
    present = [r["bucket"] for r in heads]
    before = [(b, present[i - 1], r["k"]["o"], r["k"]["tie"]) for i, (b, r) in enumerate(zip(present, heads, strict=True))]
    if not before:
        return spark.createDataFrame([], _SCHEMA)
    before = spark.createDataFrame(before, "b int, earlier int, o bigint, k bigint")
    match = (F.col("bucket") == F.col("b")) & (order == F.col("o")) & (F.col("tie") == F.col("k"))
    ahead = rows.join(F.broadcast(before), match).dropDuplicates(["bucket"])
    ahead = ahead.select("doc_id", "t", "tie", F.col("earlier").alias("bucket"), F.lit(True).alias("ahead"))
    dealt = rows.unionByName(ahead).repartition(ranges, "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_last(), "tie")
    return dealt.select("bucket", "ahead", "doc_id", "t").mapInArrow(_fingerprint_ranges, _SCHEMA)


_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


@query("op3_document_fingerprint")
def op3_document_fingerprint(spark, sf_dir):
    return fingerprint_documents(load(spark, sf_dir, "documents"))
