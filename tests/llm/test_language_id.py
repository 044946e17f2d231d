import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import language_id as L
from tests.llm.fixtures import awkward, awkward_rows, empty


def _counts(texts_by_lang):
    found = {}
    for k, texts in enumerate(texts_by_lang.values()):
        for t in texts:
            for g in L.grams(L.code_bytes(t)).tolist():
                found.setdefault(g, [0] * len(texts_by_lang))[k] += 1
    gram = np.array(sorted(found))
    return gram, np.array([found[g] for g in gram.tolist()])


class _Plain:
    """The definition: dictionaries and recursion."""

    def __init__(self, texts):
        self.n = [{} for _ in range(4)]
        for t in texts:
            data = L.PAD + L.code_bytes(t)
            for i in range(3, len(data)):
                for k in range(4):
                    node = self.n[k].setdefault(data[i - k : i], {})
                    node[data[i]] = node.get(data[i], 0) + 1

    def p(self, context, byte):
        low = self.p(context[1:], byte) if context else 1 / 256
        node = self.n[len(context)].get(context)
        if not node:
            return low
        n, q = sum(node.values()), len(node)
        if byte in node:
            return node[byte] / (n + q)
        below = sum(self.p(context[1:], b) if context else 1 / 256 for b in node)
        return q / (n + q) / max(1 - below, 1e-9) * low

    def bits(self, text):
        data = L.PAD + L.code_bytes(text)
        return sum(-math.log2(self.p(data[i - 3 : i], data[i])) for i in range(3, len(data)))


TEXTS = {
    "de": ["der hund und die katze sind im haus", "das ist ein kleines haus und der garten ist schön"],
    "en": ["the dog and the cat are in the house", "this is a small house and the garden is nice"],
}


@pytest.fixture(scope="module")
def trees():
    trees = L.Trees(sorted(TEXTS), *_counts(TEXTS))
    trees.open()
    return trees


def test_code_lengths_match_the_definition(trees):
    samples = ["the house", "der garten", "zzz", "é☃", "a", "the dog " * 40]
    got = trees.code_lengths([L.code_bytes(t) for t in samples])
    for k, lang in enumerate(trees.langs):
        plain = _Plain(TEXTS[lang])
        assert np.allclose(got[:, k], [plain.bits(t) for t in samples], rtol=1e-4)


def test_code_is_complete(trees):
    """All bytes after a context have probability 1 together."""
    for context in ("the", "xyz", "hau"):
        total = 0
        for b in range(256):
            data = context.encode() + bytes([b])
            total += 2.0 ** -(trees.code_lengths([data])[0] - trees.code_lengths([context.encode()])[0])
        assert np.allclose(total, 1, atol=1e-3)


def test_blocks_do_not_change_the_length(trees, monkeypatch):
    text = L.code_bytes("the dog and der hund " * 50)
    whole = trees.code_lengths([text, b"", b"x"])
    monkeypatch.setattr(L, "BLOCK", 100)
    assert np.allclose(trees.code_lengths([text, b"", b"x"]), whole)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.op2_language_id(spark, "/root/testdata/sf0.01").cache()
    found = rows.join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert found > 0.97
    assert rows.count() == docs.count()


def test_awkward_rows(spark):
    df = awkward(spark)
    trees = L.fit(df, F.lit(True))
    got = L.predict(df, trees).collect()
    assert len(got) == len(awkward_rows())
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {4, 5, 6, 7, 13} <= und and 1 not in und
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") and 0 <= r["score"] <= 1 for r in got)
    assert L.fit(empty(spark), F.lit(True)) is None
    assert {r["lang_pred"] for r in L.predict(df, None).collect()} == {"und"}
    assert L.predict(empty(spark), trees).count() == 0
