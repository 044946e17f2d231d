import itertools
import random

from pyspark.sql import functions as F

from tabloom.llm import mixing
from tabloom.llm.support import text_of
from tests.llm.fixtures import awkward, awkward_rows, empty


def test_targets_stop_at_three_times_the_source():
    sizes = {"a": 10, "b": 1000, None: 100}
    targets = mixing.share_targets(sizes, mixing.cyclic_weights(list(sizes)))
    assert targets["a"] == 30
    assert targets[None] == 300  # weight 3 would be above it
    assert abs(sum(targets.values()) - 1110) < 1e-6


def _brute_cost(patterns, quotas, passes):
    """Best (taken, cost) over all splits of each pattern's words to its sources."""
    best = None
    choices = [[c for c in itertools.product(*[range(passes * n + 1) for _ in p]) if sum(c) <= passes * n] for p, n in patterns.items()]
    for split in itertools.product(*choices):
        into = {s: 0 for s in quotas}
        for p, c in zip(patterns, split):
            for s, x in zip(p, c):
                into[s] += x
        if all(into[s] <= quotas[s] for s in quotas):
            taken = sum(into.values())
            cost = sum(max(0, sum(c) - k * n) for (p, n), c in zip(patterns.items(), split) for k in range(1, passes))
            best = max(best or (-1, 0), (taken, -cost))
    return best


def test_route_is_a_least_cost_maximum_flow():
    rnd = random.Random(3)
    for _ in range(25):
        patterns = {("a",): rnd.randrange(4), ("a", "b"): rnd.randrange(3), ("b",): rnd.randrange(3)}
        quotas = {"a": rnd.randrange(8), "b": rnd.randrange(6)}
        taken = mixing.route(patterns, quotas, 2)
        cost = sum(max(0, taken[p] - n) for p, n in patterns.items())
        assert (sum(taken.values()), -cost) == _brute_cost(patterns, quotas, 2)


def test_mix_takes_whole_documents_near_the_targets(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 40)), rnd.choice(["x", "x", "y", "z", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    size = mixing.word_count(text_of("text"))
    got = mixing.mix(df, F.array("source"), size).collect()
    again = mixing.mix(df.repartition(7), F.array("source"), size).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
        by.setdefault(r["sources"][0], []).append(r)
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 2


def test_overlapping_sources(spark):
    rows = [(i, "a b c d", ["p", "q"] if i % 2 else ["p"]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string, s array<string>")
    got = mixing.mix(df, F.col("s"), mixing.word_count(F.col("text")), weights=lambda s: {"p": 1, "q": 3}).collect()
    assert sum(r["taken"] for r in got) == 160
    assert all(r["target"] == 40 for r in got)


def test_awkward_rows(spark):
    got = mixing.mix(awkward(spark), F.array("source"), mixing.word_count(F.col("text"))).collect()
    assert len(got) == len(awkward_rows())
    assert all(r["size"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (4, 5, 6, 7))
    assert mixing.mix(empty(spark), F.array("source"), mixing.word_count(F.col("text"))).count() == 0
    rows = mixing.mixed_rows(awkward(spark))
    assert rows.columns == awkward(spark).columns
