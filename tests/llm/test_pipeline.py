"""Every stage against a plain computation on its own input, and on awkward and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece

import corpus_pipeline
from tabloom.llm import mixing, quality, sentencepiece_scan
from tabloom.llm.support import load, stage_table
from tests.llm.fixtures import DOC_SCHEMA, awkward_rows, empty
from tests.llm.test_dedup import _brute_components, _brute_fingerprint
from tests.llm.test_quality import _Plain

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


def _rows():
    """Ordinary texts of two languages, junk, exact and near copies, nulls, empties, repeated and missing ids."""
    rnd = random.Random(11)
    words = "river stone the and of walks green light tree house".split()
    rows = []
    for i in range(120):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(15, 60)))
        rows.append((i, text, "en" if i % 2 else None, rnd.choice(["a", "b", None])))
    rows += [(200 + i, rows[i][1], "en", "a") for i in range(0, 20, 2)]
    rows += [(300 + i, rows[i][1] + " ending", rows[i][2], "b") for i in range(10)]
    rows += [(400 + i, "@@##%%^^&&**((((" * 9 + str(i), "en", "a") for i in range(5)]
    rows += [(500, None, "en", "a"), (501, "", None, None), (None, rows[3][1], "en", "a"), (None, "green " * 30, None, "c"), (3, rows[3][1], "en", "b")]
    return [(i, t, lang, s, None if t is None else len(t), 7, "x", 0) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(_rows(), DOC_SCHEMA).repartition(5).write.parquet(f"{base}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in [*range(0, 120, 2), *range(400, 403)]] + [(None, 1, None), (1, None, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


@pytest.fixture(scope="module")
def inputs(spark, small):
    """What every stage takes in and gives back, as plain tuples."""
    docs, seen = load(spark, small, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage_table(stage(spark, docs, small), name)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        seen[name] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()])
        docs = out
    return seen


def _sorted(rows):
    return sorted(rows, key=repr)


def test_quality_stage(inputs):
    taken, kept = inputs["quality"]
    trusted = {r[0] for r in _rows() if r[0] is not None and r[0] < 120 and r[0] % 2 == 0}
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % quality.FOLDS
    want = []
    for lang in {r[2] for r in taken}:
        own = [r for r in taken if r[2] == lang]
        model_texts = [r[1] for r in own if r[0] in trusted and fold(r[0]) and r[1]]
        plain = _Plain(model_texts) if model_texts else None
        bits = {r: math.log2(plain.perplexity(r[1])) for r in own if r[1]} if plain else {}
        cells = sorted(math.ceil(bits[r] * quality.BINS_PER_DOUBLING) for r in own if r[0] in trusted and not fold(r[0]) and r in bits)
        bar = None
        if cells:
            at = next(n for n in range(1, len(cells) + 1) if n >= quality.QUANTILE * len(cells))
            bar = cells[at - 1] / quality.BINS_PER_DOUBLING + math.log2(quality.MARGIN)
        for r in own:
            if r[1] and (bar is None or r not in bits or (bits[r] - bar) * len(quality.code_bytes(r[1])) <= quality.EVIDENCE_BITS):
                want.append(r)
    assert _sorted(kept) == _sorted(want)
    assert len(kept) < len(taken)


def test_exact_dedup_stage(inputs):
    taken, kept = inputs["exact_dedup"]
    best = {}
    for r in taken:
        key = r[1] or ""
        if key not in best or (-1 if r[0] is None else r[0]) > best[key]:
            best[key] = -1 if r[0] is None else r[0]
    assert sorted((r[1] or "", -1 if r[0] is None else r[0]) for r in kept) == sorted(best.items())
    assert set(kept) <= set(taken) and len(kept) < len(taken)


def test_near_dedup_stage(inputs):
    taken, kept = inputs["near_dedup"]
    known = [r for r in taken if r[0] is not None]
    groups = defaultdict(list)
    for r, root in zip(known, _brute_components([_brute_fingerprint(r[1]) for r in known])):
        groups[root].append(r)
    want = [r for g in groups.values() for r in g if r[0] == min(x[0] for x in g)] + [r for r in taken if r[0] is None]
    assert _sorted(kept) == _sorted(want)


def test_mixing_stage(inputs):
    taken, mixed = inputs["mixing"]
    size = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))
    assert set(mixed) <= set(taken)
    held, room = Counter(mixed), Counter(taken)
    assert all(n <= 3 * room[r] for r, n in held.items())
    sizes = defaultdict(int)
    for r in taken:
        sizes[r[3]] += size(r)
    targets = mixing.share_targets(dict(sizes), mixing.cyclic_weights(list(sizes)))
    for source, target in targets.items():
        got = sum(size(r) for r in mixed if r[3] == source)
        gap = min((size(r) for r in taken if r[3] == source and size(r)), default=0)
        assert got <= target + 1 and (target - got <= max(gap, 0.05 * target) or target == 0)


def test_sentencepiece_stage(inputs):
    taken, encoded = inputs["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.default_model())
    want = [(r[0], r[2], r[3], library.encode(r[1] or "")) for r in taken]
    assert _sorted((r[0], r[1], r[2], list(r[4])) for r in encoded) == _sorted(want)
    assert all(r[3] == len(r[4]) for r in encoded)


@pytest.mark.parametrize("name", list(STAGES))
def test_awkward_and_empty_tables(spark, small, name):
    docs = spark.createDataFrame(awkward_rows(), DOC_SCHEMA)
    out = STAGES[name](spark, docs, small)
    if name != "sentencepiece":
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
    assert out.count() > 0
    assert STAGES[name](spark, empty(spark), small).count() == 0


def test_clean_documents_stay(spark):
    """On the given tables: nothing that is trusted goes for its quality, and equal texts leave one row."""
    docs = load(spark, SF, "documents")
    kept = stage_table(STAGES["quality"](spark, docs, SF), "quality")
    good = load(spark, SF, "labels").filter("quality = 1").select("doc_id").distinct().join(docs, "doc_id", "left_semi")
    lost = good.join(kept.select("doc_id"), "doc_id", "left_anti").count()
    assert lost <= 0.01 * good.count()
    once = stage_table(STAGES["exact_dedup"](spark, kept, SF), "exact")
    assert once.count() == kept.select("text").distinct().count()


def test_run_is_repeatable(spark):
    sf = "/root/testdata/sf0.001"
    one, two = [sorted(corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens").collect()) for _ in range(2)]
    assert one and one == two
