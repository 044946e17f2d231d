"""Mixing of overlapping sources to target weights by a minimum-cost flow.

Documents with the same set of sources form one pattern. Patterns offer their words once, twice,
up to MAX_PASSES times; each further pass costs more (0, 1, 2, ...). The flow sends words from
patterns to the sources they belong to, up to every source's target, at least cost. Costs lie
only on the arcs out of the origin, so opening the passes in order of cost and augmenting to a
maximum flow after each one is optimal: an augmenting path never takes back words already sent.

Targets: weights share all words; a target stops at MAX_PASSES times its source's words and the
excess is shared again by weight.

Selection: a pattern's flow is some full passes over all its documents and a rest. The rest takes
documents in the order of a seeded hash. The cut in that order is found by two histograms of the
hash (1024 bins each) and a window over the one remaining cell, so no pattern is sorted
whole, even if it holds a third of all rows. FILLS times the largest document that still fits
goes into the gap, so taken words stay just below a pattern's flow.

The driver holds one entry per pattern and source; more than MAX_PATTERNS patterns raise an
error before anything is taken.

Defined results: a null text has 0 words and is taken 0 times; null sources form a source of
their own that sorts last; repeated rows are documents of their own; an empty table gives no
rows. Equal hashes are ordered by id, then by size.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.support import load, query, stage_table, text_of

SEED = 42
MAX_PASSES = 3
MAX_PATTERNS = 100_000
BINS = 1024
FILLS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def cyclic_weights(sources: list[str | None]) -> dict[str | None, float]:
    """1, 2, 3, repeating, by code point with null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: 1 + i % 3 for i, s in enumerate(ordered)}


def share_targets(sizes: dict, weights: dict, passes: int = MAX_PASSES, total: float | None = None) -> dict:
    """Targets by weight, each at most ``passes`` times its source's size."""
    left = float(sum(sizes.values()) if total is None else total)
    targets: dict = {}
    free = [s for s in weights if weights[s] > 0]
    while free:
        unit = left / sum(weights[s] for s in free)
        above = [s for s in free if unit * weights[s] > passes * sizes[s]]
        if not above:
            return targets | {s: 0.0 for s in weights if weights[s] <= 0} | {s: unit * weights[s] for s in free}
        for s in above:
            targets[s] = float(passes * sizes[s])
            left -= targets[s]
        free = [s for s in free if s not in targets]
    return targets | {s: 0.0 for s in weights if s not in targets}


class _Flow:
    """Maximum flow by level graphs on integer capacities."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def augment(self, s: int, t: int) -> None:
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if t not in level:
                return
            at = [0] * len(self.out)
            while path := self._path(s, t, level, at):
                sent = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= sent
                    self.room[e ^ 1] += sent

    def _path(self, s: int, t: int, level: dict, at: list[int]) -> list[int]:
        path: list[int] = []
        a = s
        while a != t:
            while at[a] < len(self.out[a]):
                e = self.out[a][at[a]]
                if self.room[e] and level.get(self.to[e]) == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(self.out[a]):
                path.append(self.out[a][at[a]])
                a = self.to[path[-1]]
            elif path:
                a = self.to[path.pop() ^ 1]
                at[a] += 1
            else:
                return []
        return path


def route(patterns: dict[tuple, int], targets: dict, passes: int = MAX_PASSES) -> dict[tuple, int]:
    """Words to take from each pattern: a least-cost flow of the patterns' passes to the targets."""
    origin, sink = 0, 1
    pattern_at = {p: 2 + i for i, p in enumerate(patterns)}
    source_at = {s: 2 + len(patterns) + i for i, s in enumerate(targets)}
    flow = _Flow(2 + len(patterns) + len(targets))
    offers = {p: flow.arc(origin, at, 0) for p, at in pattern_at.items()}
    for p, at in pattern_at.items():
        for s in p:
            flow.arc(at, source_at[s], passes * patterns[p])
    for s, at in source_at.items():
        flow.arc(at, sink, round(targets[s]))
    for _ in range(passes):  # the next pass costs more: open it when the cheaper ones are used up
        for p, arc in offers.items():
            flow.room[arc] += patterns[p]
        flow.augment(origin, sink)
    return {p: flow.room[arc ^ 1] for p, arc in offers.items()}


def _first_above(hist: DataFrame, cell: str) -> DataFrame:
    """Per pattern the cell in which the running words pass ``rest``, less the words before it."""
    w = Window.partitionBy("pat").orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = hist.withColumn("upto", F.sum("n").over(w))
    cut = run.filter(F.col("upto") > F.col("rest")).groupBy("pat").agg(
        F.min_by(F.struct(F.col(cell), (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")), cell).alias("cut")
    )
    return cut.select("pat", F.col(f"cut.{cell}").alias(f"cut_{cell}"), F.col("cut.rest").alias("rest"))


def mix(
    df: DataFrame, sources: Column, size: Column, id_col: str = "doc_id", weights=cyclic_weights,
    seed: int = SEED, passes: int = MAX_PASSES, carry: tuple[str, ...] = (),
) -> DataFrame:
    """id, sources, size, source_size, target (of the first source by code point) and taken of every row.

    ``sources`` is an array column. ``carry`` names columns of the input to keep, in the struct ``carried``.
    """
    spark = df.sparkSession
    order = F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit((1 << 63) - 1))
    members = F.array_sort(F.array_distinct(sources))
    rows = df.select(
        F.col(id_col).alias("__id"), members.alias("__src"), F.to_json(members, {"ignoreNullFields": "false"}).alias("pat"),
        size.alias("__size"), order.alias("__h"), F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0)]).alias("__carry"),
    ).withColumns({"b1": F.shiftright("__h", 53), "b2": F.shiftright("__h", 43) % BINS})
    rows = stage_table(rows, "mix-rows")

    found = rows.groupBy("pat").agg(F.first("__src").alias("src"), F.sum("__size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} combinations of sources")
    pattern_of = {r["pat"]: tuple(r["src"]) for r in found}
    words = {tuple(r["src"]): int(r["n"]) for r in found}
    sizes: dict = {}
    for p, n in words.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = share_targets(sizes, weights(list(sizes)), passes, sum(words.values()))
    taken = route(words, targets, passes)

    plan = []
    for pat, p in pattern_of.items():
        full, rest = divmod(taken[p], words[p]) if words[p] else (0, 0)
        first = min(p, key=lambda s: (s is None, s or ""))
        plan.append((pat, sizes[first], targets[first], full, rest))
    plan = spark.createDataFrame(plan, "pat string, source_size bigint, target double, full bigint, rest bigint")
    rests = plan.select("pat", "rest")

    one = rows.groupBy("pat", "b1").agg(F.sum("__size").alias("n"))
    cut1 = _first_above(one.join(rests, "pat"), "b1")
    in1 = rows.join(cut1, (rows["pat"] == cut1["pat"]) & (rows["b1"] == cut1["cut_b1"])).drop(cut1["pat"])
    two = in1.groupBy("pat", "b2", "rest").agg(F.sum("__size").alias("n"))
    cut2 = stage_table(cut1.drop("rest").join(_first_above(two, "b2"), "pat"), "mix-cuts")
    cell = (rows["pat"] == cut2["pat"]) & (rows["b1"] == cut2["cut_b1"]) & (rows["b2"] == cut2["cut_b2"])
    last = rows.join(cut2, cell).drop(cut2["pat"])
    w = Window.partitionBy("pat").orderBy("__h", "__id", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct("__h", F.coalesce("__id", F.lit(-1)), "__size")
    fits = last.withColumn("upto", F.sum("__size").over(w)).filter(F.col("upto") <= F.col("rest"))
    ends = fits.groupBy("pat").agg(F.max(key).alias("end"), F.max("upto").alias("got"))
    cuts = plan.join(cut2.select("pat", "cut_b1", "cut_b2", F.col("rest").alias("cell_rest")), "pat", "left")
    cuts = cuts.join(ends, "pat", "left").withColumn("left", F.col("cell_rest") - F.coalesce("got", F.lit(0)))

    before = (F.col("b1") < F.col("cut_b1")) | ((F.col("b1") == F.col("cut_b1")) & (F.col("b2") < F.col("cut_b2")))
    here = (F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2")) & (key <= F.col("end"))
    more = F.coalesce(before | F.coalesce(here, F.lit(False)), F.lit(False))
    placed = rows.join(F.broadcast(cuts), "pat").withColumn("more", more)  # at most MAX_PATTERNS rows
    own = F.struct("__size", "__h", F.coalesce("__id", F.lit(-1)))
    for _ in range(FILLS):  # the largest document that still fits into what is left
        fits = placed.filter(~F.col("more") & F.col("__size").between(1, F.col("left")))
        fill = fits.groupBy("pat").agg(F.max(own).alias("fill"))
        placed = placed.join(F.broadcast(fill), "pat", "left").withColumns(
            {
                "more": F.col("more") | F.coalesce(own == F.col("fill"), F.lit(False)),
                "left": F.col("left") - F.coalesce(F.col("fill.__size"), F.lit(0)),
            }
        ).drop("fill")
    again = F.col("more").cast("bigint")
    return placed.select(
        F.col("__id").alias(id_col), F.col("__src").alias("sources"), F.col("__size").alias("size"), "source_size",
        "target", (F.col("__size") * (F.col("full") + again)).alias("taken"),
        *[F.col("__carry").alias("carried")] * bool(carry),
    )


def mixed_rows(df: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of the mix with the columns of the input, each as often as it is taken."""
    found = mix(df, F.array(source_col), word_count(text_of(text_col)), id_col, carry=tuple(df.columns))
    times = F.array_repeat(F.lit(0), (F.col("taken") / F.col("size")).cast("int"))
    return found.filter("taken > 0").select("carried", F.explode(times)).select("carried.*")


@query("op6_mix_sources")
def op6_mix_sources(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    mixed = mix(docs, F.array("source"), word_count(text_of("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("sources")[0].alias("source"))
