"""Hybrid retrieval (R) and the joins built on it (J1 to J3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.functions import vectors as V
from tabloom.operators import metric_search, retrieve, sparse
from tabloom.plans.common import load, r6
from tabloom.plans.registry import query

WEIGHTS = {"subtype": 3.0, "type": 2.5, "metric": 2.0, "dataset": 1.0}
CATS = list(WEIGHTS)


def records(spark, d):
    """Embeddings with four derived categories and an owner group."""
    return load(spark, d, "embeddings").select(
        "vec_id",
        "embedding",
        F.concat(F.lit("s"), F.col("label").cast("string")).alias("subtype"),
        F.concat(F.lit("t"), (F.col("vec_id") % 2).cast("string")).alias("type"),
        F.when(F.col("vec_id") % 5 != 4, F.concat(F.lit("m"), (F.col("vec_id") % 5).cast("string"))).alias("metric"),
        F.concat(F.lit("d"), (F.col("vec_id") % 3).cast("string")).alias("dataset"),
        F.concat(F.lit("g"), (F.col("vec_id") % 40).cast("string")).alias("slug"),
    )


def query_side(spark, d):
    """The same rows as queries; every eleventh has a subtype the index does not know."""
    return records(spark, d).withColumn(
        "subtype", F.when(F.col("vec_id") % 11 == 0, F.lit("s99")).otherwise(F.col("subtype"))
    )


_RECORDS = """
 rec AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, 's' || label AS subtype,
                't' || (vec_id % 2) AS type, CASE WHEN vec_id % 5 = 4 THEN 'Unknown' ELSE 'm' || (vec_id % 5) END AS metric,
                'd' || (vec_id % 3) AS dataset, 'g' || (vec_id % 40) AS slug FROM embeddings),
 idx AS (SELECT *, sqrt(list_inner_product(v, v)) AS nv FROM rec),
 qry AS (SELECT vec_id AS qid, v AS qv, nv AS qn, CASE WHEN vec_id % 11 = 0 THEN 's99' ELSE subtype END AS q_subtype,
                type AS q_type, metric AS q_metric, dataset AS q_dataset, slug AS q_slug FROM idx)"""


def _topk_sql(t: float, k: int, exclude: bool, weights: dict[str, float] = WEIGHTS) -> str:
    """The closed form over all pairs."""
    total = sum(w * w for w in weights.values())
    match = " + ".join(f"CASE WHEN q_{c} = {c} THEN {w * w} ELSE 0 END" for c, w in weights.items())
    known = " + ".join(
        f"CASE WHEN q_{c} IN (SELECT {c} FROM idx) THEN {w * w} ELSE 0 END" for c, w in weights.items()
    )
    where = "WHERE q_slug <> slug" if exclude else ""
    return f"""WITH {_RECORDS},
 q2 AS (SELECT *, sqrt({t * t}::DOUBLE + {known}) AS qnorm FROM qry),
 s AS (SELECT qid, vec_id AS id, round(({t}::DOUBLE * list_inner_product(qv, v) / (qn * nv) + {match}) / (qnorm * sqrt(1.0::DOUBLE + {total})), 9) AS score
       FROM q2, idx {where}),
 hits AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank, id, score FROM s
          QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= {k})"""


def hits(spark, d, text_weight=1.0, k=5, exclude=False):
    index = retrieve.index_rows(records(spark, d), "vec_id", "embedding", CATS, "slug")
    queries = retrieve.index_rows(query_side(spark, d), "vec_id", "embedding", CATS, "slug")
    return metric_search.search(index, queries, WEIGHTS, k, text_weight, exclude)


@query(
    "r1_text_for_vector",
    """SELECT doc_id, md5(trim(coalesce(source, '')) || '  ' || trim(coalesce(CASE WHEN doc_id % 7 <> 0 THEN text END, ''), ' ')) AS digest
       FROM documents""",
)
def r1(spark, d):
    text = F.when(F.col("doc_id") % 7 != 0, F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.md5(S.joined_text(F.col("source"), text)).alias("digest"))


@query(
    "r2_category_defaults",
    """SELECT vec_id, 's' || label AS subtype, CASE WHEN vec_id % 5 = 4 THEN 'Unknown' ELSE 'm' || (vec_id % 5) END AS metric,
              'Unknown' AS dataset_type FROM embeddings""",
)
def r2(spark, d):
    return retrieve.fill_categories(
        records(spark, d).select("vec_id", "subtype", "metric"), ["subtype", "metric", "dataset_type"]
    )


def _vector_sql(source: str, t: float, prefix: str) -> str:
    blocks = " || ".join(
        f"(SELECT list_transform(list(v ORDER BY v), lambda x: CASE WHEN x = {prefix}{c} THEN {w}::DOUBLE ELSE 0 END) FROM (SELECT DISTINCT {c} AS v FROM idx))"
        for c, w in WEIGHTS.items()
    )
    vec, norm, key = ("qv", "qn", "qid") if prefix else ("v", "nv", "vec_id")
    return f"""WITH {_RECORDS},
 h AS (SELECT {key} AS vec_id, list_transform({vec}, lambda x: x / {norm} * {t}::DOUBLE) || {blocks} AS h FROM {source}),
 n AS (SELECT vec_id, list_transform(h, lambda x: x / sqrt(list_inner_product(h, h))) AS h FROM h)
 SELECT vec_id, CAST(unnest(range(len(h))) AS INT) AS pos, round(unnest(h), 9) AS value FROM n"""


def _hybrid(df, index, text_weight):
    coded = sparse.category_blocks(df, sparse.vocabularies(index, CATS), WEIGHTS, "blocks")
    return coded.select("vec_id", sparse.hybrid(F.col("embedding"), F.col("blocks"), text_weight).alias("h"))


def _explicit(df, index, text_weight):
    both = F.concat(F.col("h.text"), sparse.dense(F.col("h.blocks")))
    return _hybrid(df, index, text_weight).select("vec_id", F.posexplode(both).alias("pos", "value")).withColumn("value", F.round("value", 9))


def _entries(df, index, text_weight):
    """The entries that a row holds: text elements, and one element per known category behind them."""
    rows = _hybrid(df, index, text_weight).withColumn("d", F.size("h.text"))
    text = F.transform(F.col("h.text"), lambda x, i: F.struct(i.alias("pos"), x.alias("value")))
    blocks = F.zip_with(F.col("h.blocks.indices"), F.col("h.blocks.values"), lambda i, x: F.struct((F.col("d") + i).alias("pos"), x.alias("value")))
    out = rows.select("vec_id", (F.col("d") + F.col("h.blocks.size")).alias("width"), F.explode(F.concat(text, blocks)).alias("e"))
    return out.select("vec_id", "width", "e.pos", F.round("e.value", 9).alias("value"))


@query("r3_hybrid_index", _vector_sql("idx", 1.0, ""))
def r3(spark, d):
    index = retrieve.fill_categories(records(spark, d), CATS)
    return _explicit(index, index, 1.0)


@query("r4_query_vector", _vector_sql("qry", 0.5, "q_"))
def r4(spark, d):
    index = retrieve.fill_categories(records(spark, d), CATS)
    return _explicit(retrieve.fill_categories(query_side(spark, d), CATS), index, 0.5)


def _entry_sql(source: str, t: float, prefix: str) -> str:
    """Dense positions but those of zero blocks; text elements stay, whatever they are."""
    dims = "(SELECT any_value(len(v)) FROM idx)"
    width = "CAST(max(pos) OVER (PARTITION BY vec_id) + 1 AS INT)"
    dense = _vector_sql(source, t, prefix)
    head, tail = dense.split(" SELECT vec_id, CAST(unnest", 1)
    return f"""{head}, every AS (SELECT vec_id, CAST(unnest{tail})
 SELECT vec_id, width, pos, value FROM (SELECT *, {width} AS width FROM every) WHERE pos < {dims} OR value <> 0"""


@query("r3_sparse_index", _entry_sql("idx", 1.0, ""))
def r3_sparse(spark, d):
    index = retrieve.fill_categories(records(spark, d), CATS)
    return _entries(index, index, 1.0)


@query("r4_sparse_query", _entry_sql("qry", 0.5, "q_"))
def r4_sparse(spark, d):
    index = retrieve.fill_categories(records(spark, d), CATS)
    return _entries(retrieve.fill_categories(query_side(spark, d), CATS), index, 0.5)


@query("r5_hybrid_topk", _topk_sql(1.0, 5, False) + " SELECT * FROM hits")
def r5(spark, d):
    return hits(spark, d)


@query("r6_exclude_own", _topk_sql(1.0, 5, True) + " SELECT * FROM hits")
def r6_own(spark, d):
    return hits(spark, d, exclude=True)


@query(
    "r7_examples_payload",
    _topk_sql(1.0, 3, True)
    + """, found AS (SELECT h.*, x.lang, x.source FROM hits h JOIN documents x ON x.doc_id = h.id)
 SELECT qid, '[' || string_agg('{"rank":' || rank || ',"id":' || id || ',"lang":"' || lang || '","source":"' || source || '"}', ',' ORDER BY rank) || ']' AS examples,
        count(*) AS n_examples FROM found GROUP BY qid""",
)
def r7(spark, d):
    docs = retrieve.first_records(load(spark, d, "documents").select("doc_id", "lang", "source"), F.col("doc_id"), "doc_id")
    found = retrieve.lookup(hits(spark, d, k=3, exclude=True), docs, F.col("id"))
    return retrieve.payload(found, "qid", ["rank", "id", "lang", "source"])


@query(
    "r8_unit_vectors",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings)
       SELECT vec_id, CAST(unnest(range(len(v))) AS INT) AS pos, round(unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 9) AS value FROM v""",
)
def r8(spark, d):
    v = F.transform(V.as_double(F.col("embedding")), lambda x: x * 3)
    return load(spark, d, "embeddings").select(
        "vec_id", F.posexplode(V.unit(v)).alias("pos", "value")
    ).withColumn("value", F.round("value", 9))


@query(
    "j1_retrieval_lookup",
    _topk_sql(1.0, 5, True)
    + " SELECT h.qid, h.rank, h.id, h.score, x.lang, x.source, x.n_chars FROM hits h JOIN documents x ON x.doc_id = h.id",
)
def j1(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    # Every record twice, as an appended re-run leaves it: the first by load order wins.
    twice = docs.withColumn("load", F.lit(0)).unionByName(docs.withColumns({"load": F.lit(1), "lang": F.lit("zz")}))
    ref = F.concat(F.lit("https://records.example/"), F.col("doc_id").cast("string"), F.lit("?v=1"))
    key = S.bare_reference(ref, "records.example")
    first = retrieve.first_records(twice, key, "load").drop("load", "doc_id")
    return retrieve.lookup(hits(spark, d, exclude=True), first, F.col("id").cast("string"))


@query(
    "j2_unmatched_report",
    _topk_sql(1.0, 5, False)
    + " SELECT h.qid, h.rank, h.id, h.score FROM hits h WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = h.id)",
)
def j2(spark, d):
    labels = retrieve.first_records(load(spark, d, "labels"), F.col("doc_id"), "doc_id")
    return retrieve.unmatched(hits(spark, d), labels, F.col("id"))


@query("j3_topk_join", _topk_sql(4.0, 5, False) + " SELECT * FROM hits")
def j3(spark, d):
    return hits(spark, d, text_weight=4.0)


@query(
    "o3_global_topk",
    """WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS qv FROM embeddings WHERE vec_id = 0)
       SELECT vec_id, round(list_inner_product((SELECT qv FROM q), list_transform(embedding, lambda x: x::DOUBLE)), 9) AS score
       FROM embeddings ORDER BY score DESC, vec_id LIMIT 10""",
)
def o3(spark, d):
    df = load(spark, d, "embeddings")
    vec = V.as_double(F.col("embedding"))
    q = F.lit(df.filter("vec_id = 0").select(vec.alias("v")).first()["v"])
    return retrieve.nearest(df.select("vec_id", "embedding"), V.dot(vec, q), 10, "vec_id").select("vec_id", "score")


@query(
    "w2_hit_rank",
    _topk_sql(1.0, 5, False) + " SELECT qid, id, rank, rank = 1 AS is_best FROM hits",
)
def w2(spark, d):
    return hits(spark, d).select("qid", "id", "rank", (F.col("rank") == 1).alias("is_best"))


@query(
    "w9_cumulative_precision",
    _topk_sql(1.0, 5, True)
    + """, h AS (SELECT hits.*, CAST(a.label = b.label AS INT) AS hit FROM hits JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = id)
 SELECT qid, rank, round(sum(hit) OVER (PARTITION BY qid ORDER BY rank) / rank::DOUBLE, 6) AS precision FROM h""",
)
def w9(spark, d):
    from tabloom.operators.windows import cumulative_precision

    labels = load(spark, d, "embeddings").select("vec_id", "label")
    found = (
        hits(spark, d, exclude=True)
        .join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("want")), "qid")
        .join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("got")), "id")
        .withColumn("hit", (F.col("want") == F.col("got")).cast("int"))
    )
    return cumulative_precision(found, "qid", "rank", "hit").select(
        "qid", "rank", r6(F.col("precision")).alias("precision")
    )
