import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.llm import variants as V
from tests.llm.fixtures import awkward, awkward_rows, empty


def _words(rows, thin, least_points=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if thin and h % thin == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_points and n >= least_count}


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute(counts, factor=5):
    out = {}
    for w, n in counts.items():
        near = sorted(((-m, v) for v, m in counts.items() if _near(w, v)))
        form = near[0][1] if near and -near[0][0] >= factor * n else None
        out[w] = [form, None, n, len(near), None if form is None else counts[form]]
    for w in out:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w][1] = end
    return {(w, *v) for w, v in out.items()}


def _rows(seed, docs=120):
    rnd = random.Random(seed)
    base = ["aaabbb", "abcabc", "möwenei", "riverbank", "aaaaaa", "lighthouse"]
    words = []
    for w in base:
        for _ in range(12):
            v = w
            for _ in range(rnd.randint(0, 3)):
                i, c = rnd.randrange(len(v)), rnd.choice("abcé÷")
                v = rnd.choice([v[:i] + v[i + 1 :], v[:i] + c + v[i:], v[:i] + c + v[i + 1 :]])
            words.append(v)
    weights = [5 ** rnd.randint(0, 5) for _ in words]
    return [(rnd.choice([None, i]), rnd.choice([" ", "-", "\n"]).join(rnd.choices(words, weights, k=rnd.randint(0, 80))).title()) for i in range(docs)]


@pytest.mark.parametrize("seed, thin", [(1, 199), (2, 3), (3, 0)])
def test_against_brute_force(spark, seed, thin):
    rows = _rows(seed) + [(i, t) for i, t, *_ in awkward_rows()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("x")).withColumn("a.b", F.lit(1))
    got = V.variants(df.repartition(6), thin=thin)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == _brute(_words(rows, thin))


def test_long_chain_of_forms(spark):
    chain = [("a" * i + "bbbbbbbb"[: 8], 5 ** (i + 1)) for i in range(12)]
    df = spark.createDataFrame(chain, "word string, n bigint")
    links = V.neighbours(df).join(df, "word").filter("best_n >= 5 * n").select("word", F.col("best").alias("form"))
    assert {r["root"] for r in V.roots(links).collect()} == {chain[-1][0]}


def test_every_letter_in_one_range(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    counts = {f"abc{c}def": 5 + i % 7 for i, c in enumerate(letters)} | {"abcdef": 40}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(5)
    got = {r["word"]: (r["n_near"], r["best"]) for r in V.neighbours(df).collect()}
    want = {w: (k, f) for w, _, _, _, k, _ in _brute(counts) for f in [min(((-m, v) for v, m in counts.items() if _near(w, v)))[1]]}
    assert got == want


def test_parts_of_long_texts(monkeypatch):
    text = "one two-three " * 50 + "x" * 300 + " end"
    whole = list(V._runs(text))
    monkeypatch.setattr(V, "PART", 7)
    assert sum(V._runs(text), Counter()) == whole[0] and len(whole) == 1


def test_empty(spark):
    assert V.variants(empty(spark)).count() == 0
    assert V.variants(awkward(spark), least_count=10**6).count() == 0
