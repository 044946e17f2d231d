import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tabloom.llm import quality
from tests.llm.fixtures import DOC_SCHEMA, awkward, awkward_rows, empty


class _Plain:
    """Interpolated modified Kneser-Ney with dictionaries."""

    def __init__(self, texts):
        raw = defaultdict(int)
        for t in texts:
            data = bytes(3) + quality.code_bytes(t)
            for i in range(3, len(data)):
                raw[data[i - 3 : i + 1]] += 1
        self.n = [None] * 5
        self.n[4] = dict(raw)
        for k in (3, 2, 1):
            low = defaultdict(int)
            for g in self.n[k + 1]:
                low[g[1:]] += 1
            self.n[k] = dict(low)
        self.d = [None] + [self._discounts(self.n[k]) for k in (1, 2, 3, 4)]

    @staticmethod
    def _discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        out = []
        for k in (1, 2, 3):
            v = k - (k + 1) * y * n[k + 1] / n[k] if y is not None and n[k] else k * 0.5
            out.append(max(0.1, min(k - 0.1, v)))
        return out

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / 256
        seen = {g: c for g, c in self.n[k].items() if g[:-1] == gram[:-1]}
        low = self.p(gram[1:])
        if not seen:
            return low
        total = sum(seen.values())
        cut = {g: min(c, self.d[k][min(c, 3) - 1]) for g, c in seen.items()}
        return (seen.get(gram, 0) - cut.get(gram, 0)) / total + sum(cut.values()) / total * low

    def perplexity(self, text):
        data = bytes(3) + quality.code_bytes(text)
        bits = [-math.log2(self.p(data[i - 3 : i + 1])) for i in range(3, len(data))]
        return 2 ** (sum(bits) / len(bits))


def _docs():
    rnd = random.Random(1)
    words = ["river", "stone", "the", "and", "of", "walks", "green", "light", "é"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(30)), "en" if i % 2 else None, "s", 0, 1, "x", 2) for i in range(60)]
    return rows + [(60, "@@##$$%%^^&&**(((((" * 5, "en", "s", 0, 1, "x", 2), (61, "river zq", "xx", "s", 0, 1, "x", 2)]


def test_perplexity_matches_the_definition(spark):
    rows = _docs()
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    ids = spark.createDataFrame([(i,) for i in range(40)], "doc_id bigint")
    got = {r["doc_id"]: r for r in quality.judged(df, ids, ["doc_id"]).select("__in.doc_id", "perplexity", "kept").collect()}
    folds = {r["doc_id"]: r["f"] for r in df.select("doc_id", quality.fold(F.col("doc_id"), quality.FOLDS).alias("f")).collect()}
    for lang in ("en", None):
        plain = _Plain([r[1] for r in rows if r[2] == lang and r[0] < 40 and folds[r[0]]])
        for r in rows:
            if r[2] == lang:
                assert math.isclose(got[r[0]]["perplexity"], plain.perplexity(r[1]), rel_tol=1e-5), r
    assert got[61]["perplexity"] is None and got[61]["kept"]
    assert not got[60]["kept"]
    assert sum(not got[i]["kept"] for i in range(60)) == 0


def test_labelled_junk_is_found(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    found = {(r["quality"], r["kept"]): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert found.get((1, False), 0) <= 0.01 * found[1, True]
    assert found[0, False] > found.get((0, True), 0)


def test_awkward_rows(spark):
    df = awkward(spark)
    ids = spark.createDataFrame([(1,), (2,), (3,), (3,), (15,), (None,)], "doc_id bigint")
    got = quality.judged(df, ids, ["doc_id", "text"]).select("__in.*", "perplexity", "kept").collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        if not r["text"]:
            assert r["perplexity"] is None and not r["kept"]
    kept = quality.kept_rows(df, ids)
    assert kept.columns == df.columns
    none = quality.kept_rows(df, ids.filter("doc_id < 0"))
    assert none.count() == sum(bool(r[1]) for r in awkward_rows())
    assert quality.kept_rows(empty(spark), ids).count() == 0
