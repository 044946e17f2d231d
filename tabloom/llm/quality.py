"""Document quality by an interpolated modified Kneser-Ney model of trusted text.

Per language, sequences of ORDER = 4 bytes are counted over all trusted documents (those that the
caller marks, a calibration fold excepted). Lower orders count the different bytes seen before a
sequence. Three discounts per order come from the counts of counts. All tables are Spark
tables keyed by (language, sequence); they grow with the trusted text and are never collected.

Scoring joins sharded tables: documents travel once, in compressed packs, to blocks of one language
and at most about BLOCK_BYTES of text. A block states the distinct sequences it holds; the
distinct sequences of all blocks are joined with the shards of counts, highest order first, then
the next lower one times the escape weight of the context; every block gets its costs back and
sums them over its documents. The perplexity is 2 ** (mean bits per byte).

Trusted ids are broadcast if they number at most BROADCAST_IDS, else joined by a shuffle.

A language's threshold is the QUANTILE of the perplexities of its calibration documents (trusted,
but not counted), times MARGIN, so that clean text stays. A document is rejected if its code is
EVIDENCE_BITS longer than at the threshold: a few odd words are no evidence.

Defined results: a null or empty text has null perplexity and is rejected. A null language is a
language of its own. Without trusted text in a language the perplexity is null and documents
with text stay; without calibration documents they stay as well. Repeated rows are scored one by
one. An empty table gives no rows. ``kept_rows`` returns the columns of the input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.language_id import code_bytes, grams
from tabloom.llm.support import fold, load, query, stage_table

ORDER = 4
BLOCK_BYTES = 8 << 20
PART_BYTES = 1 << 20
HELD_BYTES = 8 << 20
BROADCAST_IDS = 2_000_000
QUANTILE, MARGIN = 0.975, 1.35
EVIDENCE_BITS = 32.0
FOLDS = 5
BINS_PER_DOUBLING = 1000


def _language(lang: Column) -> Column:
    """A number for the language; null has its own."""
    return F.xxhash64(F.coalesce(lang, F.lit("\x00")))


def _parts(texts: pa.ChunkedArray | pa.Array):
    """Texts as code bytes in lists of about PART_BYTES, with the position of the first."""
    held, size, start = [], 0, 0
    for i, t in enumerate(texts):
        held.append(code_bytes(t.as_py() or ""))
        size += len(held[-1])
        if size >= PART_BYTES:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def _distinct(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences and their counts; the running list stays as small as the distinct ones."""
    gram, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, part in _parts(texts):
        new, m = np.unique(np.concatenate([grams(t) for t in part]), return_counts=True)
        both, at = np.unique(np.concatenate([gram, new]), return_inverse=True)
        gram, n = both, np.bincount(at, np.concatenate([n, m])).astype(np.int64)
    return gram, n


def _count_batches(batches):
    for batch in batches:
        lang = batch.column(0).to_numpy()
        for key in np.unique(lang):
            gram, n = _distinct(batch.column(1).filter(pa.array(lang == key)))
            columns = [pa.array(np.full(len(gram), key)), pa.array(gram), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])


def _discounts(counts: DataFrame, order: int) -> DataFrame:
    """lang and the discounts d1, d2, d3 of one order (Chen and Goodman)."""
    n = [F.sum(F.when(F.col("n") == k, 1.0).otherwise(0.0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    c = counts.groupBy("lang").agg(*n)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def d(k: int) -> Column:
        value = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), F.coalesce(value, F.lit(k * 0.5)))).alias(f"d{k}")

    return c.select("lang", d(1), d(2), d(3))


def _order_tables(counts: DataFrame, order: int, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, p) of the sequences seen and (lang, context, escape) of their contexts."""
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = counts.join(_discounts(counts, order), "lang").withColumn("cut", F.least(cut, F.col("n").cast("double")))
    context = F.shiftright("gram", 8)
    contexts = rows.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("all"), F.sum("cut").alias("spared"))
    contexts = contexts.select("lang", "context", "all", (F.col("spared") / F.col("all")).alias("escape"))
    contexts = stage_table(contexts, f"kn-contexts-{order}")
    rows = rows.withColumn("context", context).join(contexts, ["lang", "context"])
    below = F.lit(1 / 256)
    if lower is not None:
        mask = (1 << 8 * (order - 1)) - 1
        low = lower.select("lang", F.col("gram").alias("low"), F.col("p").alias("below"))
        rows = rows.withColumn("low", F.col("gram").bitwiseAND(F.lit(mask))).join(low, ["lang", "low"])
        below = F.col("below")
    p = (F.col("n") - F.col("cut")) / F.col("all") + F.col("escape") * below
    return stage_table(rows.select("lang", "gram", p.alias("p")), f"kn-{order}"), contexts.select("lang", "context", "escape")


def train(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Tables of the orders 1 to ORDER from (lang, t)."""
    counted = trusted.mapInArrow(_count_batches, "lang bigint, gram bigint, n bigint")
    counts = [stage_table(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "kn-counts")]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")
        lower = counts[0].select("lang", shorter).groupBy("lang", "gram").agg(F.count("*").alias("n"))
        counts.insert(0, stage_table(lower, "kn-counts"))
    tables: list[tuple[DataFrame, DataFrame]] = []
    for order, c in enumerate(counts, 1):
        tables.append(_order_tables(c, order, tables[-1][0] if tables else None))
    return tables


def resolve(wanted: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """lang, gram and bits for distinct (lang, gram), from the highest order that was seen."""
    rows, p = wanted, None
    for order in range(len(tables), 0, -1):
        seen, contexts = tables[order - 1]
        mask = F.lit((1 << 8 * order) - 1)
        g, c = f"g{order}", f"c{order}"
        seen = seen.select("lang", F.col("gram").alias(g), F.col("p").alias(f"p{order}"))
        contexts = contexts.select("lang", F.col("context").alias(c), F.col("escape").alias(f"e{order}"))
        short = F.col("gram").bitwiseAND(mask)
        rows = rows.withColumns({g: short, c: F.shiftright(short, 8)})
        rows = rows.join(seen, ["lang", g], "left").join(contexts, ["lang", c], "left")
    for order in range(1, len(tables) + 1):
        below = F.lit(1 / 256) if p is None else p
        p = F.coalesce(F.col(f"p{order}"), F.coalesce(F.col(f"e{order}"), F.lit(1.0)) * below)
    # A language without a model has no context of order 1.
    return rows.filter(F.col("e1").isNotNull()).select("lang", "gram", (-F.log2(p)).alias("bits"))


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block together in one compressed value; nothing waits beyond HELD_BYTES."""
    held: dict[tuple[int, int], list[pa.RecordBatch]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        packs = []
        for parts in held.values():
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(parts).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            packs.append(sink.getvalue().to_pybytes())
        columns = [pa.array([k for k, _ in held], pa.int64()), pa.array([s for _, s in held], pa.int32()), pa.array(packs, pa.binary())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "salt", "pack"])

    for batch in batches:
        for part in (batch.slice(s, 1000) for s in range(0, batch.num_rows, 1000)):
            keys = np.stack([part.column("lang").to_numpy(), part.column("salt").to_numpy()], axis=1)
            found, at = np.unique(keys, axis=0, return_inverse=True)
            row = part.drop_columns(["lang", "salt"])
            for k, key in enumerate(found.tolist()):
                held.setdefault((key[0], key[1]), []).append(row.filter(pa.array(at.ravel() == k)))
            size += part.nbytes
            if size >= HELD_BYTES:
                yield flush()
                size = 0
    if held:
        yield flush()


def _unpacked(packs: pa.Table) -> Iterator[pa.Table]:
    for pack in packs.column("pack"):
        with pa.ipc.open_stream(pack.as_buffer()) as stream:
            yield stream.read_all()


def _wanted(packs: pa.Table) -> pa.Table:
    gram = np.unique(np.concatenate([_distinct(t.column("t"))[0] for t in _unpacked(packs)]))
    lang, salt = packs.column("lang")[0].as_py(), packs.column("salt")[0].as_py()
    return pa.table(
        {"lang": pa.array(np.full(len(gram), lang)), "salt": pa.array(np.full(len(gram), salt), pa.int32()), "gram": pa.array(gram)}
    )


def _scorer(carry: list[str]):
    """Perplexities of a block's documents, with the ``carry`` columns of the packs."""

    def score(packs: pa.Table, costs: pa.Table) -> pa.Table:
        gram, bits = costs.column("gram").to_numpy(), costs.column("bits").to_numpy()
        order = np.argsort(gram)
        gram, bits = gram[order], bits[order]
        scored = []
        for docs in _unpacked(packs):
            total, size = np.zeros(docs.num_rows), np.zeros(docs.num_rows, dtype=np.int64)
            for start, part in _parts(docs.column("t")):
                filled = [i for i, t in enumerate(part) if t]
                if not filled:
                    continue
                own = np.array([len(part[i]) for i in filled])
                size[start + np.array(filled)] = own
                if len(gram):
                    cost = bits[np.searchsorted(gram, np.concatenate([grams(part[i]) for i in filled]))]
                    total[start + np.array(filled)] = np.add.reduceat(cost, np.concatenate([[0], np.cumsum(own)[:-1]]))
            known = (size > 0) & (len(gram) > 0)
            perplexity = pa.array(np.exp2(total / np.maximum(size, 1)), mask=~known)
            docs = docs.select(carry)
            scored.append(docs.append_column("perplexity", perplexity).append_column("bytes", pa.array(size)))
        out = pa.concat_tables(scored)
        pa.default_memory_pool().release_unused()
        return out

    return score


def perplexities(
    df: DataFrame, trusted: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """__in (the ``keep`` columns), __lang, calibrates, perplexity and bytes of every row, written once.

    ``trusted`` has the ids of trusted documents.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__in"), F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"),
        _language(F.col(lang_col)).alias("lang"), text.alias("t"), fold(F.col(id_col), FOLDS).alias("fold"),
    )
    known = trusted.select(F.col(id_col).alias("__id"), F.lit(True).alias("trusted")).distinct()
    if known.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    text_bytes = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    salts = -(-text_bytes // BLOCK_BYTES) or 1
    rows = rows.join(known, "__id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    calibrates = F.col("trusted") & (F.col("fold") == 0)
    tables = train(rows.filter(F.col("trusted") & (F.col("fold") != 0) & (F.length("t") > 0)).select("lang", "t"))

    salt = F.pmod(F.xxhash64("__id", F.length("t")), F.lit(salts)).cast("int")
    docs = rows.select("__in", "__lang", "lang", salt.alias("salt"), "t", calibrates.alias("calibrates"))
    blocks = docs.mapInArrow(_pack_batches, "lang bigint, salt int, pack binary").repartition("lang", "salt")
    wanted = blocks.groupBy("lang", "salt").applyInArrow(_wanted, "lang bigint, salt int, gram bigint")
    costs = resolve(wanted.select("lang", "gram").distinct(), tables)
    answers = wanted.join(costs, ["lang", "gram"]).select("lang", "salt", "gram", F.col("bits").cast("float").alias("bits"))
    carry = ["__in", "__lang", "calibrates"]
    fields = [docs.schema[c] for c in carry]
    fields += [T.StructField("perplexity", T.DoubleType()), T.StructField("bytes", T.LongType())]
    both = blocks.groupBy("lang", "salt").cogroup(answers.groupBy("lang", "salt"))
    scored = both.applyInArrow(_scorer(carry), T.StructType(fields))
    return stage_table(scored, "perplexities")


def thresholds(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """__lang and threshold, from a histogram of BINS_PER_DOUBLING bins per doubling of the perplexity."""
    cell = F.ceil(F.log2("perplexity") * BINS_PER_DOUBLING)
    hist = scored.filter("calibrates AND perplexity IS NOT NULL").groupBy("__lang", cell.alias("cell")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("__lang")
    upto = F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = hist.withColumns({"upto": upto, "all": F.sum("n").over(w)})
    cut = ranked.filter(F.col("upto") >= F.lit(quantile) * F.col("all")).groupBy("__lang").agg(F.min("cell").alias("cell"))
    return cut.select(F.col("__lang").alias("of"), (F.pow(F.lit(2.0), F.col("cell") / BINS_PER_DOUBLING) * margin).alias("threshold"))


def judged(df: DataFrame, trusted: DataFrame, keep: list[str], **columns) -> DataFrame:
    """The scored rows with threshold and kept."""
    scored = perplexities(df, trusted, keep, **columns)
    out = scored.join(thresholds(scored), F.col("__lang").eqNullSafe(F.col("of")), "left")
    excess = (F.log2("perplexity") - F.log2("threshold")) * F.col("bytes")
    fits = F.coalesce(excess <= EVIDENCE_BITS, F.lit(True))
    return out.withColumn("kept", fits & (F.col("bytes") > 0))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents of which every label says good quality."""
    return labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")


def kept_rows(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that are not rejected, with the columns of the input.

    Rows of one id, language and text read alike, so the rejected ones are named by these (the text by two
    hashes) and taken out by an anti-join; texts do not stay in memory beside the model's answers.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A null id or language differs from any value.
    name = {
        "__id": F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")),
        "__of": _language(F.col(lang_col)),
        "__hash": F.xxhash64(text),
        "__crc": F.crc32(text.cast("binary")),
    }
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[c.alias(n) for n, c in name.items()])
    flat = rows.select("__row.*", *name)
    gone = judged(flat, trusted, list(name), id_col=id_col, text_col=text_col, lang_col=lang_col).filter(~F.col("kept"))
    gone = gone.select(*[F.col(f"__in.{n}").alias(n) for n in name]).distinct()
    return rows.join(gone, list(name), "left_anti").select("__row.*")


@query("op4_quality")
def op4_quality(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    rows = judged(docs, trusted_ids(load(spark, sf_dir, "labels")), ["doc_id", "lang"])
    return rows.select("__in.doc_id", "__in.lang", "perplexity", "threshold", "kept")
