"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes, counted once on a sample of labelled
texts and then frozen. A byte seen c times after a context with n bytes of q kinds has
probability c / (n + q); the escape q / (n + q) goes to the shorter context, whose bytes that
the longer one already predicts are excluded by renormalising. Below the empty context all bytes
are alike. So each language states an exact code length for each text, and the shortest wins.

The trees of all languages share their node numbers: one lookup of a position's last four bytes
gives the finished costs for all languages; positions with an unseen path add the escape costs of
the contexts they fall through. All texts are read whole, in blocks of bounded size.

Sample (the bound of the fit): per language the SAMPLE_TEXTS labelled texts with the smallest
hash among those of at most SAMPLE_CHARS characters; at most MAX_LANGUAGES languages (more raise
an error); four-byte paths over the PAIRS most frequent byte pairs. The model has a few MB.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Equal lengths go to
the first language by code point. Without labelled texts everything is ``und``. Repeated rows are
scored one by one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.support import fold, load, query

SAMPLE_TEXTS, SAMPLE_CHARS = 500, 20_000
MAX_LANGUAGES = 256
PAIRS = 4096
BLOCK = 1 << 20
PAD = bytes(3)


def code_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def grams(data: bytes) -> np.ndarray:
    """The last four bytes at every position, as one number; PAD stands before the text."""
    x = np.frombuffer(PAD + data, dtype=np.uint8).astype(np.int64)
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by.setdefault(lang, []).append(grams(code_bytes(text.as_py())))
        for lang, found in by.items():
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            columns = [pa.array([lang] * len(gram)), pa.array(gram), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.ones_like(a), where=b > 0)


class Trees:
    """Frozen costs in bits per node and language."""

    def __init__(self, langs: list[str], gram: np.ndarray, counts: np.ndarray):
        self.langs = langs
        size = len(langs)
        pair_n = np.bincount(np.concatenate([gram >> 16, gram & 0xFFFF]), np.tile(counts.sum(1), 2), 1 << 16)
        common = np.sort(np.argsort(-pair_n, kind="stable")[: min(PAIRS - 1, int((pair_n > 0).sum()))])
        pair_id = np.zeros(1 << 16, dtype=np.int32)
        pair_id[common] = np.arange(1, len(common) + 1)
        known = (pair_id[gram >> 16] > 0) & (pair_id[gram & 0xFFFF] > 0)
        gram, counts = gram[known], counts[known].astype(np.float64)

        def totals(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
            return np.stack([np.bincount(index, values[:, k], n) for k in range(size)], axis=1)

        def order(ctx, count, low, contexts):
            """Probabilities of the nodes of one order and the escape factor of every context."""
            n, q = totals(ctx, count, contexts), totals(ctx, (count > 0).astype(float), contexts)
            excluded = totals(ctx, np.where(count > 0, low, 0), contexts)
            escape = np.where(n > 0, _ratio(q, n + q) / np.maximum(1 - excluded, 1e-9), 1.0)
            p = np.where(count > 0, _ratio(count, (n + q)[ctx]), escape[ctx] * low)
            return p, escape

        single = totals(gram & 0xFF, counts, 256)
        flat = np.full((256, size), 1 / 256)
        p0, _ = order(np.zeros(256, dtype=np.int64), single, flat, 1)
        every = np.arange(1 << 16)
        p1, _ = order(every >> 8, totals(gram & 0xFFFF, counts, 1 << 16), p0[every & 0xFF], 256)
        third = np.unique(np.concatenate([gram & 0xFFFFFF, gram >> 8]))
        at3 = np.searchsorted(third, gram & 0xFFFFFF)
        p2, escape2 = order(third >> 8, totals(at3, counts, len(third)), p1[third & 0xFFFF], 1 << 16)
        p3, escape3 = order(np.searchsorted(third, gram >> 8), counts, p2[at3], len(third))

        def bits(p):
            return (-np.log2(p)).astype(np.float32)

        self.cost1, self.cost2, self.cost3 = bits(p1), bits(p2), bits(p3)
        self.escape2, self.escape3 = bits(escape2), np.vstack([bits(escape3), np.zeros((1, size), np.float32)])
        self.pair_id, self.pairs = pair_id, len(common) + 1
        self.gram, self.third = gram, third

    def open(self) -> None:
        """Direct lookup tables, built where they are used. 0 is a pair that no path has."""
        self.at3 = np.full((1 << 16) * 256, -1, dtype=np.int32)
        self.at3[self.third] = np.arange(len(self.third))
        self.at4 = np.full(self.pairs * self.pairs, -1, dtype=np.int32)
        self.at4[self.pair_id[self.gram >> 16] * self.pairs + self.pair_id[self.gram & 0xFFFF]] = np.arange(len(self.gram))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        total = np.zeros((len(texts), len(self.langs)))
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= BLOCK):
                size += len(texts[last])
                last += 1
            if size > 2 * BLOCK:  # one giant text, in blocks that overlap by the context
                for s in range(0, size, BLOCK):
                    head = texts[first][max(0, s - 3) : s]
                    context = (PAD + head)[-3:]
                    total[first] += self._bits([texts[first][s : s + BLOCK]], [context])[0]
            else:
                total[first:last] = self._bits(texts[first:last], [PAD] * (last - first))
            first = last
        return total

    def _bits(self, texts: list[bytes], contexts: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join([c + t for c, t in zip(contexts, texts, strict=True)]), dtype=np.uint8).astype(np.int32)
        sizes = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.langs)))
        if not sizes.sum():
            return out
        starts = np.concatenate([[0], np.cumsum(sizes + 3)[:-1]])
        real = np.ones(len(x), dtype=bool)
        for k in range(3):
            real[starts + k] = False
        at = np.flatnonzero(real)
        pair = x[:-1] << 8 | x[1:]  # pair[i] ends at i + 1
        ids = self.pair_id[pair]
        node = self.at4[ids[at - 3] * self.pairs + ids[at - 1]]
        cost = self.cost3[np.maximum(node, 0)] if len(self.cost3) else np.zeros((len(at), len(self.langs)), np.float32)
        miss = np.flatnonzero(node < 0)
        if len(miss):
            end = at[miss]
            low = self.at3[pair[end - 2] << 8 | x[end]]
            part = self.cost2[low]
            deep = np.flatnonzero(low < 0)
            part[deep] = self.escape2[pair[end[deep] - 2]] + self.cost1[pair[end[deep] - 1]]
            context = self.at3[pair[end - 3] << 8 | x[end - 1]]
            cost[miss] = part + self.escape3[context]  # -1 is the last row: no such context, no escape
        filled = np.flatnonzero(sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)[:-1]])[filled]
        out[filled] = np.add.reduceat(cost, ends, axis=0, dtype=np.float64)
        return out


def fit(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Trees | None:
    """Trees from the sampled rows that are ``usable``; null if there are none."""
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), usable.alias("u"))
    rows = rows.filter(F.col("u") & F.col("l").isNotNull() & (F.length("t") <= SAMPLE_CHARS) & (F.length("t") > 0)).drop("u")
    langs = [r["l"] for r in rows.select("l").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = rows.withColumn("h", F.xxhash64("i", F.xxhash64("t")))
    w = Window.partitionBy("l").orderBy("h")
    chosen = rows.select("l", "h").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SAMPLE_TEXTS)
    chosen = F.broadcast(chosen.select("l", "h").distinct())  # at most SAMPLE_TEXTS * MAX_LANGUAGES rows
    counted = rows.join(chosen, ["l", "h"]).select("l", "t").mapInArrow(_count_grams, "lang string, gram bigint, n bigint")
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        return None
    langs = sorted(set(found["lang"]))
    gram, at = np.unique(found["gram"].to_numpy(), return_inverse=True)
    counts = np.zeros((len(gram), len(langs)))
    counts[at, found["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy()] = found["n"].to_numpy()
    return Trees(langs, gram, counts)


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees = shared.value
        if trees is not None:
            trees.open()
        for batch in batches:
            for part in (batch.slice(s, 256) for s in range(0, batch.num_rows, 256)):
                texts = part.column(1).to_pylist()
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                spoken = [i for i, t in enumerate(texts) if trees is not None and t and any(map(str.isalpha, t))]
                if spoken:
                    bits = trees.code_lengths([code_bytes(texts[i]) for i in spoken])
                    best = bits.argmin(axis=1)
                    weight = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                    for i, k, p in zip(spoken, best.tolist(), weight.tolist(), strict=True):
                        lang[i], score[i] = trees.langs[k], p
                columns = [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return run


def predict(df: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (share of the best language in 2 ** -bits) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(trees)  # a few MB by the bounds of the sample
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))
    return slim.mapInArrow(_predictor(shared), "doc_id bigint, lang_pred string, score double")


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    trees = fit(docs, ~held_out)
    return predict(docs, trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
