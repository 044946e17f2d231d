"""Exact top-k search over weighted categories and unit vectors, by a metric index.

    score = (t * cos + sum of w_i^2 over equal categories) / (|query| * |row|)

1. Pivots are a bounded sample of the rows, those with the smallest id hashes: PIVOTS_PER_ROOT times the
   square root of the row count, at most MAX_PIVOTS and PIVOT_BYTES. They are sorted into groups by
   their categories, heaviest weight first: a group is a prefix of category values that two pivots share.
   A row belongs to the longest such prefix and, inside, to the cell of its nearest pivot. The rows with
   their cells are the one stage that is written.
2. A cell is described by its pivot, the least and largest angle of its rows to the pivot, the
   range of each category and its size. At most a few cells per pivot exist, so their descriptions are
   sent to all tasks. For every query a cell gives an upper and a lower bound of the score: by the
   triangle inequality on the sphere, an angle to a row differs from the angle to the pivot by no
   more than the row's angle to it.
3. The k-th score is at least the k-th best among the pivots, which are rows themselves, and at least the
   lower bound at which the cells hold k rows. Cells whose upper bound is below that are pruned
   before any vector moves. Neighbouring cells share a bucket of at most ``block_rows`` rows (larger cells
   are cut into several), queries of a bucket are cut into blocks as well, so that a task multiplies
   two bounded matrices, however hot a category is, and emits at most k rows per query.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import vectors as V
from tabloom.session import cut_lineage

# Executors need not have this package installed: what runs in tasks travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 2048
PIVOTS_PER_ROOT, MAX_PIVOTS, PIVOT_BYTES = 4, 4096, 16 << 20
# Rows that meet all cells together, and how many numbers one matrix of them and the cells may hold.
ROUTED_TOGETHER, ROUTED_NUMBERS = 256, 1 << 17
# Scores that a block computes at once.
SCORED_NUMBERS = 1 << 19
SCORE_DIGITS = 9
# Rounded scores and angles of nearly equal vectors are apart from the exact ones by less than these.
SCORE_SLACK, ANGLE_SLACK = 1e-8, 1e-6
NO_CELL = -1


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), dim)


def routed_together(columns: int) -> int:
    """How many rows are compared with ``columns`` cells at once, so that memory does not follow the cells."""
    return max(1, min(ROUTED_TOGETHER, ROUTED_NUMBERS // max(columns, 1)))


@dataclass
class Pivots:
    """Sampled rows and the groups they form; ``cats`` go from the heaviest weight down."""

    cats: list[str]
    vec: np.ndarray
    values: list[tuple[str, ...]]
    slug: list[str]

    def __post_init__(self) -> None:
        self.dim = self.vec.shape[1]
        depth = len(self.cats)
        seen: dict[tuple[str, ...], int] = {}
        for v in self.values:
            for p in range(depth + 1):
                seen[v[:p]] = seen.get(v[:p], 0) + 1
        self.groups = {key for key, n in seen.items() if n > 1} | {()}
        own: dict[tuple[str, ...], list[int]] = {key: [] for key in self.groups}
        first: dict[tuple[str, ...], int] = {}
        for i, v in enumerate(self.values):
            if not self.vec[i].any():
                continue
            own[self.group(v)].append(i)
            for p in range(depth + 1):
                first.setdefault(v[:p], i)
        #: The pivots of every group, and the number of the first of its cells.
        self.members = {key: np.array(m or [first[key]] if key in first else [], dtype=np.int64) for key, m in own.items()}
        self.start, self.center = {}, []
        for key in sorted(self.groups):
            self.start[key] = len(self.center)
            line = self.members[key]
            if len(line):  # near pivots get near numbers
                line = line[np.argsort(-(self.vec[line] @ self.vec[line[0]]), kind="stable")]
                self.members[key] = line
            # The last cell of a group holds the rows whose vector is zero.
            self.center += [*line.tolist(), NO_CELL]
        self.cells = len(self.center)

    def group(self, values: tuple[str, ...]) -> tuple[str, ...]:
        for p in range(len(self.cats), 0, -1):
            if values[:p] in self.groups:
                return values[:p]
        return ()

    def place(self, vec: np.ndarray, values: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """Cell and angle to the cell's pivot of every row."""
        cell, angle = np.zeros(len(vec), dtype=np.int64), np.zeros(len(vec))
        by_group: dict[tuple[str, ...], list[int]] = {}
        for i, v in enumerate(values):
            by_group.setdefault(self.group(v), []).append(i)
        for key, rows in by_group.items():
            rows = np.array(rows)
            members, start = self.members[key], self.start[key]
            cell[rows] = start + len(members)
            full = rows[vec[rows].any(axis=1)]
            for part in np.array_split(full, -(-len(full) // routed_together(len(members))) or 1):
                if len(part) and len(members):
                    cos = vec[part] @ self.vec[members].T
                    best = cos.argmax(axis=1)
                    cell[part] = start + best
                    angle[part] = np.arccos(np.clip(cos[np.arange(len(part)), best], -1, 1))
        return cell, angle


@dataclass
class Cells:
    """What is known of every cell that has rows, and the bounds that follow for queries."""

    pivots: Pivots
    squares: list[float]
    text_weight: float
    k: int
    exclude: bool
    number: np.ndarray
    rows: np.ndarray
    hot: np.ndarray  # most rows of one slug
    near: np.ndarray
    far: np.ndarray
    low: list[list[str]]  # per category
    high: list[list[str]]

    def __post_init__(self) -> None:
        p = self.pivots
        self.total = sum(self.squares)
        pivot = np.array([p.center[c] for c in self.number], dtype=np.int64)
        self.zero = pivot == NO_CELL
        self.center = p.vec[np.maximum(pivot, 0)]
        self.norm = np.sqrt(np.where(self.zero, 0.0, 1.0) + self.total)
        self.pivot_norm = np.sqrt(p.vec.any(axis=1) + self.total)
        self.known = [np.array(sorted({*lo, *hi, *(v[c] for v in p.values)}), dtype=object)
                      for c, (lo, hi) in enumerate(zip(self.low, self.high, strict=True))]
        self.span = [(self._rank(c, lo), self._rank(c, hi)) for c, (lo, hi) in enumerate(zip(self.low, self.high, strict=True))]
        self.pivot_rank = [self._rank(c, [v[c] for v in p.values]) for c in range(len(p.cats))]
        slugs = {s: i for i, s in enumerate(dict.fromkeys(p.slug))}
        self.slugs, self.pivot_slug = slugs, np.array([slugs[s] for s in p.slug])

    def _rank(self, c: int, values: Sequence[str]) -> np.ndarray:
        """Odd for a known value, even for the gap between two."""
        at = np.searchsorted(self.known[c], np.array(values, dtype=object))
        same = np.array([i < len(self.known[c]) and self.known[c][i] == v for i, v in zip(at.tolist(), values, strict=True)], dtype=bool)
        return 2 * at + same

    def bounds(self, vec: np.ndarray, norm: np.ndarray, values: list[list[str]], slug: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Whether a cell may hold one of the k best, and the score that these reach at least, per query."""
        zero = ~vec.any(axis=1)[:, None]
        sure = np.zeros((len(vec), len(self.number)))
        may = np.zeros_like(sure)
        exact = np.zeros((len(vec), len(self.pivots.values)))
        for c, square in enumerate(self.squares):
            rank = self._rank(c, values[c])[:, None]
            lo, hi = self.span[c]
            sure += square * ((rank == lo) & (lo == hi))
            may += square * ((rank >= lo) & (rank <= hi))
            exact += square * (rank == self.pivot_rank[c])
        angle = np.arccos(np.clip(vec @ self.center.T, -1, 1))
        least = np.maximum(np.maximum(angle - self.far, self.near - angle) - ANGLE_SLACK, 0)
        most = np.minimum(angle + self.far + ANGLE_SLACK, math.pi)
        flat = zero | self.zero
        t = self.text_weight

        def score(cos, match, row_norm):
            norms = norm[:, None] * row_norm
            return np.divide(t * cos + match, norms, out=np.zeros_like(match), where=norms > 0)

        upper = score(np.where(flat, 0, np.cos(least)), may, self.norm)
        lower = score(np.where(flat, 0, np.cos(most)), sure, self.norm)
        # Rows of the query's own slug do not count: in a cell these are ``hot`` at most.
        held = np.maximum(self.rows - self.hot, 0) if self.exclude else self.rows
        order = np.argsort(-lower, axis=1)
        enough = np.cumsum(held[order], axis=1) >= self.k
        line = np.arange(len(vec))
        at = enough.argmax(axis=1)
        floor = np.where(enough.any(axis=1), lower[line, order[line, at]], -np.inf) if len(self.number) else np.full(len(vec), -np.inf)
        found = score(vec @ self.pivots.vec.T, exact, self.pivot_norm)
        if self.exclude:
            own = np.array([self.slugs.get(s, -1) for s in slug])
            found = np.where(own[:, None] == self.pivot_slug, -np.inf, found)
        if found.shape[1] >= self.k:
            floor = np.maximum(floor, np.partition(found, found.shape[1] - self.k, axis=1)[:, -self.k])
        floor = floor - SCORE_SLACK
        return upper >= floor[:, None], floor


@dataclass
class Buckets:
    """Neighbouring cells together, or one large cell in blocks."""

    of: np.ndarray  # cell -> bucket, by position in Cells
    blocks: np.ndarray  # blocks of rows per bucket
    rows: np.ndarray

    @staticmethod
    def deal(rows: np.ndarray, block_rows: int) -> Buckets:
        of, sizes = np.zeros(len(rows), dtype=np.int64), []
        for i, n in enumerate(rows.tolist()):
            if not sizes or sizes[-1] + n > block_rows:
                sizes.append(0)
            of[i] = len(sizes) - 1
            sizes[-1] += n
        sizes = np.array(sizes or [0], dtype=np.int64)
        return Buckets(of, np.maximum(-(-sizes // block_rows), 1), sizes)


def _router(cells: Cells, buckets: Buckets, cats: list[str]):
    """Per query the buckets that it must see."""

    def wanted(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        together = routed_together(max(len(cells.number), len(cells.pivots.values)))
        for start in range(0, batch.num_rows, together):
            part = batch.slice(start, together)
            vec = matrix(part.column("vec"), cells.pivots.dim)
            values = [part.column(c).to_pylist() for c in cats]
            keep, floor = cells.bounds(vec, part.column("qnorm").to_numpy(), values, part.column("slug").to_pylist())
            q, c = np.nonzero(keep)
            pairs = np.unique(q * len(buckets.rows) + buckets.of[c])
            q, bucket = np.divmod(pairs, len(buckets.rows))
            yield start + q, bucket, floor[q]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(buckets.rows), dtype=np.int64)
        for batch in batches:
            for _, bucket, _ in wanted(batch):
                total += np.bincount(bucket, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "nq"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, bucket, floor in wanted(batch):
                copies = buckets.blocks[bucket]
                starts = np.repeat(np.cumsum(copies) - copies, copies)
                block = np.arange(len(starts)) - starts
                q, bucket, floor = np.repeat(q, copies), np.repeat(bucket, copies), np.repeat(floor, copies)
                for s in range(0, len(q), 4096):
                    e = s + 4096
                    out = batch.take(pa.array(q[s:e]))
                    for name, x in (("floor", floor), ("bucket", bucket.astype(np.int32)), ("rb", block.astype(np.int32))):
                        out = out.append_column(name, pa.array(x[s:e]))
                    yield out

    return count, send


def _codes(q: pa.ChunkedArray, r: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    both = pa.chunked_array([*q.chunks, *r.chunks], q.type).combine_chunks().dictionary_encode().indices.to_numpy()
    return both[: len(q), None], both[None, len(q) :]


def _kernel(cells: Cells, cats: list[str], schema: pa.Schema):
    """Scores of a block of queries against a block of rows; the k best rows per query."""
    k, dim = cells.k, cells.pivots.dim

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return schema.empty_table()
        r = r.sort_by("id")
        qv, rv = matrix(q["vec"], dim), matrix(r["vec"], dim)
        codes = [(*_codes(q[c], r[c]), square) for c, square in zip(cats, cells.squares, strict=True)]
        own = _codes(q["slug"], r["slug"]) if cells.exclude else None
        qnorm, floor = q["qnorm"].to_numpy()[:, None], q["floor"].to_numpy()[:, None]
        rnorm = np.sqrt(rv.any(axis=1) + cells.total)[None, :]
        found = []
        step = max(1, SCORED_NUMBERS // len(rv))
        for part in (slice(s, s + step) for s in range(0, len(qv), step)):
            score = cells.text_weight * (qv[part] @ rv.T)
            for a, b, square in codes:
                score += square * (a[part] == b)
            norms = qnorm[part] * rnorm
            score = np.round(np.divide(score, norms, out=np.zeros_like(score), where=norms > 0), SCORE_DIGITS)
            usable = score >= floor[part]
            if own:
                usable &= own[0][part] != own[1]
            score = np.where(usable, score, -np.inf)
            if score.shape[1] > k:
                cut = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
                usable &= score >= cut[:, None]
            qi, ri = np.nonzero(usable)
            # Rows are in id order: best score first, then the smallest id, k of each query.
            order = np.lexsort((ri, -score[qi, ri], qi))
            qi, ri = qi[order], ri[order]
            first = np.searchsorted(qi, qi)
            best = np.arange(len(qi)) - first < k
            qi, ri = qi[best], ri[best]
            found.append((part.start + qi, ri, score[qi, ri]))
        qi, ri, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([q["qid"].take(pa.array(qi)), r["id"].take(pa.array(ri)), pa.chunked_array([score])], schema=schema)

    return run


def fit(index: DataFrame, cats: list[str]) -> Pivots | None:
    """The pivots of an index, None if it is empty."""
    first = index.orderBy(F.xxhash64("id"), "id").select("vec", *cats, "slug").limit(MAX_PIVOTS).toArrow()
    if not first.num_rows:
        return None
    dim = len(first["vec"][0])
    n = first.num_rows if first.num_rows < MAX_PIVOTS else index.count()  # a short sample is the whole index
    wanted = min(max(16, PIVOTS_PER_ROOT * math.isqrt(n)), PIVOT_BYTES // (8 * max(dim, 1)))
    first = first.slice(0, max(1, wanted))
    values = list(zip(*[first[c].to_pylist() for c in cats], strict=True)) if cats else [()] * first.num_rows
    return Pivots(cats, matrix(first["vec"], dim), values, first["slug"].to_pylist())


def deal(index: DataFrame, pivots: Pivots) -> DataFrame:
    """The index rows with cell and angle, written once."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(zip(*[batch.column(c).to_pylist() for c in pivots.cats], strict=True)) if pivots.cats else [()] * batch.num_rows
            cell, angle = pivots.place(matrix(batch.column("vec"), pivots.dim), values)
            yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("angle", pa.array(angle))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields)
    return cut_lineage(index.mapInArrow(place, f"{schema}, cell int, angle double"), "cells")


def describe(dealt: DataFrame, pivots: Pivots, weights: Mapping[str, float], k: int, text_weight: float, exclude: bool) -> Cells:
    """Size, angles and category ranges of the cells; a bounded number of rows reaches the driver."""
    cats = pivots.cats
    ranges = [f(c).alias(f"{p}{i}") for i, c in enumerate(cats) for p, f in (("low", F.min), ("high", F.max))]
    facts = [F.min("angle").alias("near"), F.max("angle").alias("far"), *ranges]
    if exclude:  # the size of the largest slug of every cell
        by_slug = dealt.groupBy("cell", "slug").agg(F.count("*").alias("n"), *facts)
        merged = [f(f"{p}{i}").alias(f"{p}{i}") for i in range(len(cats)) for p, f in (("low", F.min), ("high", F.max))]
        rows = by_slug.groupBy("cell").agg(F.sum("n").alias("n"), F.max("n").alias("hot"), F.min("near").alias("near"), F.max("far").alias("far"), *merged)
    else:
        rows = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("hot"), *facts)
    found = rows.toArrow().sort_by("cell")
    column = lambda name: found[name].to_numpy()
    bound = lambda p: [found[f"{p}{i}"].to_pylist() for i in range(len(cats))]
    squares = [float(weights[c]) ** 2 for c in cats]
    return Cells(
        pivots, squares, float(text_weight), k, exclude, column("cell"), column("n"), column("hot"), column("near"), column("far"),
        bound("low"), bound("high"),
    )


def with_norms(queries: DataFrame, dealt: DataFrame, cats: Sequence[str], weights: Mapping[str, float], text_weight: float) -> DataFrame:
    """Adds the length of the query's hybrid vector: a category counts if the index knows its value."""
    known = F.lit(float(text_weight) ** 2) * F.pow(V.norm(F.col("vec")), F.lit(2.0))
    combinations = dealt.select(*cats).distinct()
    for i, c in enumerate(cats):
        values = combinations.select(F.col(c).alias(f"__v{i}")).distinct()
        queries = queries.join(values, F.col(c) == F.col(f"__v{i}"), "left")
        known = known + F.when(F.col(f"__v{i}").isNotNull(), F.lit(float(weights[c]) ** 2)).otherwise(F.lit(0.0))
    return queries.withColumn("qnorm", F.sqrt(known)).drop(*[f"__v{i}" for i in range(len(cats))])


def _counted(requests: DataFrame, count) -> np.ndarray:
    found = requests.mapInArrow(count, "bucket bigint, nq bigint").groupBy("bucket").agg(F.sum("nq").alias("nq")).toArrow()
    return np.stack([found["bucket"].to_numpy(), found["nq"].to_numpy()])


def compared_pairs(index: DataFrame, queries: DataFrame, weights: Mapping[str, float], k: int = 5, text_weight: float = 1.0,
                   exclude_own: bool = False, block_rows: int = BLOCK_ROWS) -> int:
    """How many (query, row) pairs a search multiplies."""
    plan = _plan(index, queries, weights, k, text_weight, exclude_own, block_rows)
    return 0 if plan is None else int((plan[4][1] * plan[3].rows[plan[4][0]]).sum())


def _plan(index, queries, weights, k, text_weight, exclude_own, block_rows):
    cats = sorted(weights, key=lambda c: -abs(weights[c]))
    index = index.select("id", "vec", *cats, "slug")
    pivots = fit(index, cats)
    if pivots is None:
        return None
    dealt = deal(index, pivots)
    cells = describe(dealt, pivots, weights, k, text_weight, exclude_own)
    buckets = Buckets.deal(cells.rows, block_rows)
    requests = queries.select(F.col("id").alias("qid"), "vec", *cats, "slug")
    requests = with_norms(requests, dealt, cats, weights, text_weight)
    count, send = _router(cells, buckets, cats)
    return dealt, cells, requests, buckets, _counted(requests, count), send


def search(
    index: DataFrame, queries: DataFrame, weights: Mapping[str, float], k: int = 5, text_weight: float = 1.0, exclude_own: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact top-k rows per query as ``(qid, rank, id, score)``, ties by id.

    Both tables come from ``retrieve.index_rows``; ``text_weight`` is not negative. With ``exclude_own`` rows
    with the slug of the query are left out before ranking.
    """
    qtype, rtype = queries.schema["id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    plan = _plan(index, queries, weights, k, text_weight, exclude_own, block_rows)
    if plan is None:
        return queries.sparkSession.createDataFrame([], f"qid {qtype}, rank int, id {rtype}, score double")
    dealt, cells, requests, buckets, (asked, nq), send = plan
    cats = cells.pivots.cats
    # Blocks of queries per bucket; cells that no query asks for stay where they are.
    qblocks = np.zeros(len(buckets.rows), dtype=np.int64)
    qblocks[asked] = -(-nq // block_rows)
    bucket_of = np.full(cells.pivots.cells, -1, dtype=np.int64)
    bucket_of[cells.number] = buckets.of

    def by_number(values: np.ndarray, at):
        # One literal, whatever the number of cells.
        return F.element_at(F.from_json(F.lit(str(values.tolist())), "array<int>"), at + 1)

    left = dealt.withColumn("bucket", by_number(bucket_of, F.col("cell"))).withColumn("blocks", by_number(qblocks, F.col("bucket")))
    left = left.filter("blocks > 0").select(
        "id", "vec", "slug", *cats, "bucket", F.pmod(F.xxhash64("id"), by_number(buckets.blocks, F.col("bucket"))).cast("int").alias("rb"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qb"),
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    right = requests.mapInArrow(send, f"{fields}, `floor` double, bucket int, rb int")
    right = right.withColumn("qb", F.pmod(F.xxhash64("qid"), by_number(qblocks, F.col("bucket"))).cast("int"))
    group = ["bucket", "rb", "qb"]
    # The work of a group is arithmetic, not bytes, so the configured parallelism is kept.
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(parts, *group), right.repartition(parts, *group)
    from pyspark.sql.pandas.types import to_arrow_schema

    hits = queries.sparkSession.createDataFrame([], f"qid {qtype}, id {rtype}, score double").schema
    kernel = _kernel(cells, cats, to_arrow_schema(hits))
    found = right.groupBy(*group).cogroup(left.groupBy(*group)).applyInArrow(kernel, hits)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "rank", "id", "score")
