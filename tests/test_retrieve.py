"""Exact search against the explicit vectors, with skew, ties, exclusion and small blocks."""

import numpy as np
import pytest

from tabloom.operators import metric_search, retrieve

WEIGHTS = {"a": 3.0, "b": 2.5, "c": 2.0, "d": 1.0}


def make(n, seed, dim=6, hot=0.5, zero=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        if zero and i % 9 == 0:
            v = np.zeros(dim)
        cats = ["x"] * 4 if rng.random() < hot else [f"v{rng.integers(0, 3)}" for _ in range(4)]
        rows.append((i, [float(x) for x in v], *cats, f"g{i % 5}"))
    return rows


def frame(spark, rows, unknown=False):
    if unknown:
        rows = [(r[0], r[1], "never seen" if r[0] % 4 == 0 else r[2], *r[3:]) for r in rows]
    df = spark.createDataFrame(rows, "id long, v array<double>, a string, b string, c string, d string, slug string")
    return retrieve.index_rows(df, "id", "v", list(WEIGHTS), "slug")


def brute(index_rows, query_rows, weights, k, t, exclude):
    """Concatenated one-hot vectors, normalised, all inner products."""
    vocab = {i: sorted({r[2 + i] for r in index_rows}) for i in range(len(weights))}

    def vector(r, text_weight):
        v = np.array(r[1])
        n = np.linalg.norm(v)
        parts = [v / n * text_weight if n else v]
        for i, w in enumerate(weights.values()):
            parts.append(np.array([w if x == r[2 + i] else 0.0 for x in vocab[i]]))
        v = np.concatenate(parts)
        n = np.linalg.norm(v)
        return v / n if n else v

    out = {}
    for q in query_rows:
        qv = vector(q, t)
        scored = [
            (-round(float(qv @ vector(r, 1.0)), 9), r[0]) for r in index_rows if not (exclude and r[-1] == q[-1])
        ]
        out[q[0]] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize(
    "t,k,exclude,unknown,block",
    [(1.0, 5, False, False, 2048), (1.0, 5, True, True, 16), (6.0, 3, True, False, 7), (0.0, 4, False, True, 2048)],
)
def test_search_is_exact(spark, t, k, exclude, unknown, block):
    rows, queries = make(120, 1), make(40, 2)
    if unknown:
        queries = [(r[0], r[1], "never seen" if r[0] % 4 == 0 else r[2], *r[3:]) for r in queries]
    got = metric_search.search(
        frame(spark, rows), frame(spark, queries), WEIGHTS, k, t, exclude, block
    ).collect()
    want = brute(rows, queries, WEIGHTS, k, t, exclude)
    found = {}
    for r in sorted(got, key=lambda r: (r.qid, r.rank)):
        found.setdefault(r.qid, []).append((r.id, r.score))
    assert set(found) == set(want)
    for q, hits in want.items():
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in hits], abs=1e-8)
        assert [i for i, _ in found[q]] == [i for i, _ in hits]


def test_zero_vectors_and_short_index(spark):
    rows, queries = make(30, 3, zero=True), make(10, 4, zero=True)
    got = metric_search.search(frame(spark, rows), frame(spark, queries), WEIGHTS, 40, 1.0, False, 8).collect()
    want = brute(rows, queries, WEIGHTS, 40, 1.0, False)
    assert len(got) == 300
    for r in got:
        assert r.score == pytest.approx(want[r.qid][r["rank"] - 1][1], abs=1e-8)


def clustered(spark, n, clusters=12, dim=8):
    """Vectors around a few centres, one category for all rows."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(clusters, dim))
    rows = [(i, (centres[i % clusters] + 0.02 * rng.normal(size=dim)).tolist(), "x", "x", "x", "x", f"g{i % 5}") for i in range(n)]
    return rows, frame(spark, rows)


def test_compared_pairs_grow_less_than_quadratically(spark):
    pairs = {}
    for n in (600, 2400):
        _, df = clustered(spark, n, n // 40)
        pairs[n] = metric_search.compared_pairs(df, df, WEIGHTS, 5, 1.0, False, 32)
    # Four times the rows on both sides are sixteen times the pairs; 4 ** 1.5 = 8.
    assert pairs[2400] < 0.1 * 2400**2
    assert pairs[2400] < 8 * pairs[600]


@pytest.mark.parametrize("exclude, block", [(False, 32), (True, 5)])
def test_clustered_search_is_exact(spark, exclude, block):
    rows, df = clustered(spark, 300)
    got = metric_search.search(df, df, WEIGHTS, 4, 3.0, exclude, block).collect()
    want = brute(rows, rows, WEIGHTS, 4, 3.0, exclude)
    found = {}
    for r in sorted(got, key=lambda r: (r.qid, r.rank)):
        found.setdefault(r.qid, []).append(r.id)
    assert found == {q: [i for i, _ in hits] for q, hits in want.items()}


def test_hot_category_and_equal_vectors(spark):
    """A third of the rows are the same vector: blocks stay bounded and ties go by id."""
    rows = [(i, [1.0, 0.0], "x", "x", "x", "x", "g") if i % 3 == 0 else (i, [float(i % 7), 1.0], f"v{i % 4}", "y", "y", "y", "h") for i in range(240)]
    df = frame(spark, rows)
    got = metric_search.search(df, df, WEIGHTS, 3, 1.0, False, 16).collect()
    want = brute(rows, rows, WEIGHTS, 3, 1.0, False)
    for r in got:
        assert r.id == want[r.qid][r["rank"] - 1][0]
    assert len(got) == 720


def test_empty_index_and_no_queries(spark):
    df = frame(spark, make(20, 1))
    assert metric_search.search(df.filter("id < 0"), df, WEIGHTS).count() == 0
    assert metric_search.search(df, df.filter("id < 0"), WEIGHTS).count() == 0


def test_first_record_wins(spark):
    df = spark.createDataFrame([("u/k", 2, "late"), ("u/k", 1, "first"), ("v", 3, "v")], "ref string, o int, t string")
    out = {r.record_key: r.t for r in retrieve.first_records(df, df.ref, "o").collect()}
    assert out == {"u/k": "first", "v": "v"}


def test_memory_of_a_block_is_bounded():
    """A full block of scores is computed in slices, and the slices give the k best rows in order."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rnd = np.random.default_rng(1)
    n, k = metric_search.BLOCK_ROWS, 3
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    qv, rv = unit(rnd.normal(size=(n, 8))), unit(rnd.normal(size=(n, 8)))
    lists = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
    cat = lambda m: pa.array([f"c{i % m}" for i in range(n)])
    q = pa.table({"qid": list(range(n)), "vec": lists(qv), "c": cat(3), "slug": cat(5), "qnorm": np.full(n, 2.0), "floor": np.full(n, -9.0)})
    r = pa.table({"id": list(range(n)), "vec": lists(rv), "c": cat(2), "slug": cat(4)})
    cells = SimpleNamespace(k=k, pivots=SimpleNamespace(dim=8), squares=[4.0], total=4.0, text_weight=1.0, exclude=True)
    kernel = metric_search._kernel(cells, ["c"], pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))
    tracemalloc.start()
    try:
        got = kernel(q, r)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60_000_000
    i = np.arange(n)
    score = np.round((qv @ rv.T + 4.0 * ((i % 3)[:, None] == (i % 2)[None, :])) / (2.0 * np.sqrt(5.0)), metric_search.SCORE_DIGITS)
    score[(i % 5)[:, None] == (i % 4)[None, :]] = -np.inf
    want = np.argsort(-score, axis=1, kind="stable")[:, :k]
    assert got["qid"].to_pylist() == np.repeat(i, k).tolist() and got["id"].to_pylist() == want.ravel().tolist()
    for columns in (1, 600, 10_000, 1 << 20):
        assert metric_search.routed_together(columns) * columns <= max(metric_search.ROUTED_NUMBERS, columns)
