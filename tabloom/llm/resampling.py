"""Importance resampling towards a target distribution, ranked by a parallel sort with regular sampling.

A feature is a run of one to two words; it falls into one of BUCKETS buckets by its crc32. A bucket's gain
compares its share in the target texts with its share in all documents. Counts and gains are
arrays of BUCKETS numbers, the only thing that is collected and sent to tasks. The bytes of a batch are
scored together: checksums of all its words advance byte by byte, those of pairs go on from the first
word's, and a document's weight is the floored mean of its features' gains. A score adds seeded
Gumbel noise, so the highest scores are a sample without replacement by weight.

Ranks come from parallel sorting by regular sampling. P tasks (MAX_RUNS at most) sort their rows and write
them as runs. Every k-th row of a run is a regular sample, k = rows / P^2, so at most P^2 + P samples give
P - 1 splitters and no segment holds more than about twice its share. Segments are exchanged,
each is merged in its task, and prefix counts of the segments make local positions exact ranks.
Segments behind the last drawn rank are not exchanged. The order ends in a row's place in its run, so
rows that agree in everything, however many, are split like any others.

Defined results: a null or empty text has no features, weight 0 and a score. A null id is hashed as
empty text and comes last among equal scores. Rows with the same id count one by one; among equal
scores they are ordered by features and weight. Without target texts gains follow from the formula
with T = 0. An empty table gives no rows. Extra columns are ignored. A word may be of any length; texts
are scored in blocks of about BLOCK bytes that end between words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.support import crc32_sql, load, query, shuffle_parts, stage_table

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 7, 25, 20
MAX_RUNS = 512
BLOCK = 1 << 21
SHORT = 64
_ONES = np.uint32(0xFFFFFFFF)
_RUN_BITS = 33


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True


def _advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The states of unfinished checksums after the bytes data[start : start + size] of each."""
    order = np.argsort(-np.minimum(size, SHORT + 1).astype(np.int8), kind="stable")
    out, at, left = state[order], start[order], size[order]
    long = int(np.count_nonzero(left > SHORT))
    for i in range(long):
        word = data[at[i] : at[i] + left[i]]
        out[i] = zlib.crc32(word, int(out[i] ^ _ONES)) ^ int(_ONES)
    shorter = -left[long:]
    for step in range(int(left[long]) if long < len(left) else 0):
        m = int(np.searchsorted(shorter, -step))  # those longer than ``step``
        s = out[long : long + m]
        out[long : long + m] = _CRC[(s ^ data[at[long : long + m] + step]) & np.uint32(255)] ^ (s >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def _cuts(data: np.ndarray, offsets: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``block`` bytes that end at a text's end or before a byte outside words."""
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + block, end)
        text_end = int(offsets[np.searchsorted(offsets, hi)])
        step = 1 << 12
        while hi < text_end:
            outside = np.flatnonzero(~_WORD[_LOWER[data[hi : min(hi + step, text_end)]]])
            if len(outside):
                hi += int(outside[0])
                break
            hi = min(hi + step, text_end)
        yield lo, hi
        lo = hi


def features(texts: pa.Array, buckets: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of every word, row of every feature, bucket of every feature), block by block."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    open_row, open_state = -1, np.zeros(0, np.uint32)
    for lo, hi in _cuts(data, offsets, block):
        low = _LOWER[data[lo:hi]]
        word = _WORD[low]
        before = np.append(False, word[:-1])
        first = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        before[first] = False  # a text's first byte follows nothing
        start = np.flatnonzero(word & ~before)
        if not len(start):
            continue
        after = np.append(word[1:], False)
        after[first[first > 0] - 1] = False
        size = np.flatnonzero(word & ~after) + 1 - start
        row = np.searchsorted(offsets, start + lo, side="right") - 1
        state = _advance(np.full(len(start), _ONES), low, start, size)
        spaced = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        # Pairs: a word goes on from the one before it in its text, which may lie in the last block.
        before_row, before_state = np.append(open_row, row[:-1]), np.append(open_state[:1] if len(open_state) else np.uint32(0), spaced[:-1])
        second = np.flatnonzero(before_row == row)
        pair = _advance(before_state[second].astype(np.uint32), low, start[second], size[second])
        bucket = (np.concatenate([state, pair]) ^ _ONES) % np.uint32(buckets)
        yield row, np.concatenate([row, row[second]]), bucket.astype(np.int64)
        open_row, open_state = int(row[-1]), spaced[-1:]


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, bucket in features(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return count


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket: one row per task and bucket is shuffled, ``buckets`` rows arrive."""
    texts = df.select(F.col(text_col).cast("binary").alias("t"))
    found = texts.mapInArrow(_counter(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, dtype=np.int64)
    for r in found.collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of smoothed shares) per bucket, in doubles."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum()) + n, float(target.sum()) + n
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in pairs], dtype=np.int64)


def _weigher(gain: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for word_row, row, bucket in features(batch.column(1), len(gain)):
                words += np.bincount(word_row, minlength=len(words))
                n += np.bincount(row, minlength=len(n))
                total += np.bincount(row, gain[bucket], minlength=len(n)).astype(np.int64)
            columns = [batch.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return weigh


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, a function of the id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scores(df: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    out = slim.mapInArrow(_weigher(gain), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    return out.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


_ORDER = ["score", "doc_id", "n_features", "weight", "at"]


def sort_keys(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Byte strings in the order of the ranking: score downwards, then id (null last), features, weight, place."""
    columns = []
    for name in _ORDER:
        c = rows.column(name)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        values = c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = -values if name == "score" else values
        if name == "doc_id":
            columns.append(c.is_null().to_numpy(zero_copy_only=False).astype(np.uint64))
        columns.append(values.view(np.uint64) ^ np.uint64(1 << 63))
    return np.stack(columns, axis=1).astype(">u8").view(f"S{8 * len(columns)}").ravel()


def _segment_of(rows: pa.RecordBatch, splitters: np.ndarray) -> np.ndarray:
    return np.searchsorted(splitters, sort_keys(rows), side="right")


def _segment_counter(splitters: np.ndarray):
    def count(batches):
        total = np.zeros(len(splitters) + 1, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_segment_of(batch, splitters), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["segment", "n"])

    return count


def _segmenter(splitters: np.ndarray):
    def place(batches):
        for batch in batches:
            yield batch.append_column("segment", pa.array(_segment_of(batch, splitters).astype(np.int32)))

    return place


def _ranker(before: np.ndarray, take: int):
    """Rank of rows that come sorted, segment by segment: rows before the segment and before the row in it."""

    def rank(batches):
        seen = before.copy()
        for batch in batches:
            segment = batch.column("segment").to_numpy()
            if not len(segment):
                continue
            starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            sizes = np.diff(np.append(starts, len(segment)))
            place = np.arange(1, len(segment) + 1) - np.repeat(starts, sizes) + seen[segment]
            np.add.at(seen, segment[starts], sizes)
            yield batch.drop_columns(["segment"]).append_column("rank", pa.array(place, mask=place > take))

    return rank


def draw(rows: DataFrame, percent: int = PERCENT, parts: int | None = None) -> DataFrame:
    """doc_id, n_features, weight, score and rank of rows with these columns.

    The floor(percent * N / 100) highest scores have ranks 1, 2, 3, ...; the rest have null.
    """
    spark = rows.sparkSession
    parts = max(1, min(parts or shuffle_parts(spark), MAX_RUNS))
    slim = rows.select("score", "doc_id", "n_features", "weight").coalesce(parts)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    runs = stage_table(slim.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "runs")
    total = runs.count()
    stride = max(1, -(-total // parts**2))
    place = F.col("at").bitwiseAND(F.lit((1 << _RUN_BITS) - 1))
    samples = np.sort(sort_keys(runs.filter(place % stride == 0).toArrow()))
    splitters = samples[[len(samples) * i // parts for i in range(1, parts)]] if len(samples) else samples
    counted = runs.mapInArrow(_segment_counter(splitters), "segment bigint, n bigint").groupBy("segment").agg(F.sum("n").alias("n"))
    sizes = np.zeros(len(splitters) + 1, dtype=np.int64)
    for r in counted.collect():
        sizes[r["segment"]] = r["n"]
    before = np.cumsum(sizes) - sizes
    take = total * percent // 100
    wanted = F.col("segment") < int(np.searchsorted(before, take, side="left"))  # segments that begin before rank ``take``
    schema = "score bigint, doc_id bigint, n_features bigint, weight bigint, at bigint, "
    placed = runs.mapInArrow(_segmenter(splitters), schema + "segment int")
    exchanged = placed.filter(wanted).repartitionById(len(sizes), F.col("segment"))
    merged = exchanged.sortWithinPartitions("segment", *order, "at").mapInArrow(_ranker(before, take), schema + "rank bigint")
    out = merged.unionByName(placed.filter(~wanted).drop("segment").withColumn("rank", F.lit(None).cast("bigint")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def resample(
    df: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; ``target`` has texts in the same column.

    Rows of fewer than ``min_words`` words are scored and never drawn.
    """
    gain = gains(bucket_counts(df, text_col, buckets), bucket_counts(target, text_col, buckets))
    scored = stage_table(scores(df, gain, seed, id_col, text_col), "scores")
    fit = F.col("n_words") >= min_words
    rest = scored.filter(~fit).withColumn("rank", F.lit(None).cast("bigint"))
    return draw(scored.filter(fit), percent).unionByName(rest.drop("n_words"))


def drawn_rows(df: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of the drawn ids with the columns of the input; rows without an id are left out."""
    ids = resample(df, target, id_col=id_col, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return df.join(ids, F.col(f"`{id_col}`").cast("bigint") == F.col("__drawn"), "left_semi")


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT {_WORDS_SQL} AS w FROM benchmark),
df AS (
  SELECT r, unnest(w) AS f FROM d UNION ALL
  SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
bf AS (
  SELECT unnest(w) AS f FROM b UNION ALL
  SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b),
k AS (SELECT f, {crc32_sql("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
dk AS (SELECT r, bucket FROM df JOIN k USING (f)),
s AS (SELECT bucket, count(*) AS s FROM dk GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all),
gain AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS})
    / ((s + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
w AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dk JOIN gain USING (bucket) GROUP BY r),
x AS (
  SELECT doc_id, len(d.w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM x),
z AS (
  SELECT *, row_number() OVER (PARTITION BY words >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
    count(*) OVER (PARTITION BY words >= {MIN_WORDS}) AS docs
  FROM y)
SELECT doc_id, n_features, weight, score,
  CASE WHEN words >= {MIN_WORDS} AND place <= {PERCENT} * docs // 100 THEN place END AS rank
FROM z
"""


@query("op11_importance_resampling", _SQL)
def op11_importance_resampling(spark, sf_dir):
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
