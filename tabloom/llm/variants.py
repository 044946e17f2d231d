"""Spelling variants by permuterm rotations.

A word's runs are counted per document (and, with ``thin``, lose one code point where a hash of id and
run says so). Words of MIN_POINTS code points and MIN_COUNT occurrences form the vocabulary. A word's
rotations with a terminator, "rest-of-word TERMINATOR start-of-word", are sorted. Words that differ in one
replaced code point share a rotation up to its last code point, the edited one; a word with one
more code point shares the whole rotation of the shorter word. So every neighbour lies in the prefix range
of a rotation without its last code point: the range holds the word that equals the prefix (at
most one) and the words that go on by a single code point (at most one per letter, 90 of them). A scan over
the sorted ranges gives every member the number and the best of its neighbours in the range; no
pair is emitted. A code point deleted out of a run of equal ones gives one word at several places: only
the first of the run counts, so each pair is met once.

A word's form is its most frequent neighbour if that is FACTOR times as frequent; forms get strictly more
frequent, so they end in roots, found by pointer doubling (chains have at most log(n) / log(FACTOR) steps).

Everything grows with the vocabulary only after the counting: counts collapse in the task and by Spark's
partial aggregate, so a word that is a third of the text costs a row per task.

Defined results: a null or empty text has no runs. A null id is hashed as empty text. Repeated rows count
each time. An empty table gives no rows. Extra columns are ignored. Texts are read in parts of about PART
code points that end outside of runs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.support import LETTERS_UP, crc32_sql, load, query, stage_table

MIN_POINTS, MIN_COUNT, FACTOR, THIN = 6, 5, 5, 199
PART = 1 << 20
HELD = 300_000
END = "$"
_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_OUTSIDE = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {ord(c): c.lower() for c in LETTERS_UP}


def _runs(text: str) -> Iterator[Counter]:
    """Counts of the lower-cased runs of every part of a text."""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            found = _OUTSIDE.search(text, end)
            end = found.start() if found else len(text)
        yield Counter(_RUNS.findall(text[at:end].translate(_LOWER)))
        at = end


def _counter(least: int, thin: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for runs in _runs(text.as_py() or ""):
                    for run, n in runs.items():
                        if len(run) >= least:
                            if thin and (h := zlib.crc32(run.encode(), salt)) % thin == 0:
                                at = h % len(run)
                                run = run[:at] + run[at + 1 :]
                                if len(run) < least:
                                    continue
                            held[run] = held.get(run, 0) + n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    return count


def word_counts(
    df: DataFrame, least_points: int = MIN_POINTS, least_count: int = MIN_COUNT, thin: int = THIN, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """word and n: the words of enough code points and occurrences."""
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    counted = slim.mapInArrow(_counter(least_points, thin), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """The entries of the index: prefix, last (the edited code point, empty for the whole rotation), first, word, n.

    ``first`` says that the code point before the edited one differs from it.
    """
    size = F.length("word")
    turned = words.select(
        "word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"), size.alias("size")
    ).select(
        "word", "n", "i",
        F.concat(F.expr("substr(word, i + 1)"), F.lit(END), F.expr("substr(word, 1, i)")).alias("rotation"),
        F.expr("substr(word, i, 1)").alias("last"), F.expr("substr(word, i - 1, 1)").alias("before"),
        F.expr("substr(word, i + 1, 1)").alias("next"),
    )
    whole = F.struct(F.col("rotation").alias("prefix"), F.lit("").alias("last"), F.lit(True).alias("first"))
    first = (F.col("i") == 1) | (F.col("before") != F.col("last"))
    cut = F.struct(F.expr("substr(rotation, 1, length(rotation) - 1)").alias("prefix"), "last", first.alias("first"))
    entries = F.array(F.when(F.lit(True), whole), F.when(F.col("i") > 0, cut))
    return turned.select("word", "n", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("e.*", "word", "n")


def _better(a: tuple[int, str] | None, b: tuple[int, str] | None):
    """The larger count, the smaller word on ties."""
    if a is None or b is None:
        return a or b
    return min(a, b, key=lambda x: (-x[0], x[1]))


def _range(entries: list[tuple[str, bool, str, int]]) -> Iterator[tuple[str, int, tuple[int, str] | None]]:
    """(word, neighbours here, the best of them) for the members of one prefix range, the whole rotation first."""
    whole = entries[0] if entries[0][0] == "" else None
    cut = entries[1:] if whole else entries
    ordered = sorted(((n, word) for _, _, word, n in cut), key=lambda x: (-x[0], x[1]))
    top = ordered[:2]
    near_whole = None
    if whole:
        firsts = [(n, word) for _, first, word, n in cut if first]
        if firsts:
            best = None
            for x in firsts:
                best = _better(best, x)
            yield whole[2], len(firsts), best
        near_whole = (whole[3], whole[2])
    for _, first, word, n in cut:
        others = len(cut) - 1
        best = (top[1] if top[0][1] == word else top[0]) if others else None
        if near_whole and first:
            others, best = others + 1, _better(best, near_whole)
        if others:
            yield word, others, best


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial neighbour counts of every prefix range; rows come sorted by prefix and last."""
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    held: list[tuple] = []
    prefix = None

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def found(entries):
        return [(word, near, best[0], best[1]) for word, near, best in _range(entries)] if len(entries) > 1 else []

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("prefix")
        alike = pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        # Only ranges of two members, and the last one, which may go on, leave Arrow.
        ends = [*(i + 1 for i in (~alike).nonzero()[0].tolist()), batch.num_rows]
        rows, start = [], 0
        for end in ends:
            head = key[start].as_py() if start == 0 or end == batch.num_rows or end - start > 1 else None
            if head is not None:
                part = batch.slice(start, end - start)
                entries = list(zip(*[part.column(c).to_pylist() for c in ("last", "first", "word", "n")]))
                if head != prefix:
                    rows += found(held)
                    held, prefix = [], head
                held += entries
                if end < batch.num_rows:
                    rows += found(held)
                    held, prefix = [], None
            start = end
        if rows:
            yield out(rows)
    rows = found(held)
    if rows:
        yield out(rows)


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best and best_n of the words that have a neighbour; ``words`` are distinct."""
    entries = rotations(words)
    ranges = entries.repartition("prefix").sortWithinPartitions("prefix", "last")
    partial = ranges.mapInArrow(_scan, "word string, near bigint, best_n bigint, best string")
    order = F.struct(-F.col("best_n"), "best")
    return partial.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min_by("best", order).alias("best"), F.max("best_n").alias("best_n")
    )


def roots(links: DataFrame) -> DataFrame:
    """word and root from (word, form) links without circles, by pointer doubling."""
    reached = stage_table(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        moved = reached.join(onward, F.col("root") == F.col("__at"), "left")
        moved = moved.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved"))
        written = stage_table(moved, "roots")
        reached = written.select("word", "root")
        if written.filter("moved").isEmpty():
            return reached


def variants(
    df: DataFrame, least_points: int = MIN_POINTS, least_count: int = MIN_COUNT, factor: int = FACTOR, thin: int = THIN,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary; ``thin`` = 0 deletes nothing."""
    words = stage_table(word_counts(df, least_points, least_count, thin, id_col, text_col), "words")
    near = words.join(neighbours(words), "word", "left")
    formed = F.col("best_n") >= factor * F.col("n")
    near = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"),
    )
    near = stage_table(near, "near")
    ends = roots(near.filter("form IS NOT NULL").select("word", "form"))
    out = near.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{LETTERS_UP}', '{LETTERS_UP.lower()}'),
    '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {MIN_POINTS} GROUP BY doc_id, run),
named AS (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS name FROM runs),
hashed AS (SELECT run, n, {crc32_sql("name")} AS h FROM named),
thinned AS (
  SELECT n, CASE WHEN h % {THIN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= {MIN_POINTS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
cuts AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
  FROM pairs GROUP BY word),
near AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {FACTOR} * w.n THEN other END AS form,
    CASE WHEN other_n >= {FACTOR} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
way AS (
  SELECT word, word AS root, form AS onward FROM near
  UNION ALL SELECT way.word, near.word, near.form FROM way JOIN near ON way.onward = near.word)
SELECT near.word, form, root, n, n_near, form_n FROM near JOIN way ON near.word = way.word WHERE onward IS NULL
"""


@query("op13_spelling_variants", _SQL)
def op13_spelling_variants(spark, sf_dir):
    return variants(load(spark, sf_dir, "documents"))
