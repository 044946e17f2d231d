import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.llm import resampling as R
from tests.llm.fixtures import awkward, awkward_rows, empty


def _lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def _features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
    return len(words), [zlib.crc32(f.encode()) % R.BUCKETS for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def _brute(docs, target):
    s, t = [0] * R.BUCKETS, [0] * R.BUCKETS
    for text in docs:
        for b in _features(text[1])[1]:
            s[b] += 1
    for text in target:
        for b in _features(text)[1]:
            t[b] += 1
    big_s, big_t = sum(s), sum(t)
    out, fit = [], []
    for i, (doc_id, text) in enumerate(docs):
        n, found = _features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
        if n >= 20:
            fit.append(i)
    fit.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0, out[i][1], out[i][2]))
    for place, i in enumerate(fit[: 25 * len(fit) // 100], 1):
        out[i][4] = place
    return out


def _order(rows):
    return sorted(map(tuple, rows), key=repr)


def _random_docs(n):
    rnd = random.Random(5)
    words = ["river", "Stone", "the", "and", "of", "walks", "green", "42", "é", "naïve", "x" * 90]
    return [(i // 2, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_features_in_blocks_of_any_size(block):
    texts = [t for _, t in _random_docs(40)] + ["", "a", "-- a -- b", "A1 b2\nC3", "é ☃ \U0001f600", "y" * 300 + " z"]
    column = pa.array([None if not t else t.encode() for t in texts], pa.binary()).slice(3)
    got, words = [[] for _ in column], [0] * len(column)
    for word_row, row, bucket in R.features(column, R.BUCKETS, block):
        for r in word_row:
            words[r] += 1
        for r, b in zip(row.tolist(), bucket.tolist()):
            got[r].append(b)
    for text, n, found in zip(texts[3:], words, got):
        assert (n, sorted(found)) == (_features(text)[0], sorted(_features(text)[1]))


def test_every_row_against_the_definition(spark):
    docs = [(i, t) for i, t, *_ in awkward_rows()] + _random_docs(400)
    target = ["the river walks", None, "", "green stone green", "é of é"]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("x")).withColumn("a.b", F.lit(1))
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(df.repartition(7), bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert _order(got.collect()) == _order(_brute(docs, target))
    drawn = R.drawn_rows(df, bench)
    assert drawn.columns == df.columns
    assert {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in got.filter("rank IS NOT NULL AND doc_id IS NOT NULL").collect()}


def test_without_rows_or_target(spark):
    assert R.resample(empty(spark), awkward(spark)).count() == 0
    docs = [(i, t) for i, t, *_ in awkward_rows()]
    assert _order(R.resample(awkward(spark), empty(spark)).collect()) == _order(_brute(docs, []))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_ranks_with_ties_and_a_hot_row(spark, parts):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(50)]), rnd.randint(0, 9), rnd.randint(-3, 3), rnd.randint(-5, 5)) for _ in range(3000)]
    rows += [(7, 1, 1, 4)] * 1500
    df = spark.createDataFrame(rows, "doc_id bigint, n_features bigint, weight bigint, score bigint").repartition(11)
    got = R.draw(df, 25, parts).collect()
    want = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(rows) // 4 + 1))
    assert [tuple(r)[:4] for r in ranked] == [(r[0], r[1], r[2], r[3]) for r in want[: len(ranked)]]
    assert _order(tuple(r)[:4] for r in got) == _order(rows)


def test_segments_hold_about_their_share(spark):
    df = spark.range(20000).select(F.lit(3).cast("bigint").alias("score"), F.lit(1).cast("bigint").alias("doc_id"),
                                   F.lit(1).cast("bigint").alias("n_features"), F.lit(1).cast("bigint").alias("weight"))
    batch = df.withColumn("at", F.monotonically_increasing_id()).toArrow()
    keys = np.sort(R.sort_keys(batch))
    assert len(np.unique(keys)) == 20000  # equal rows differ by their place, so a hot one is split
