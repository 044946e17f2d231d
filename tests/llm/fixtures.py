"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, extra columns."""

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, row string, ids int"

LONG = "lorem ipsum dolor sit amet consectetur " * 3000


def awkward_rows():
    base = "the quick brown fox jumps over the lazy dog and runs away from the old red barn at noon today"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.upper(), "en", "b"), (4, None, "en", "b"), (5, "", None, None),
        (6, None, None, None), (7, " \t\n ", "en", "a"), (8, "one", "en", "c"), (9, "one two", "en", "c"),
        (10, LONG, "en", "a"), (11, LONG + "x", "en", "a"), (12, "ñandú élan ☃ 你好 \U0001f600", "es", "b"),
        (13, "12 34 56 !!", "fr", "b"), (None, base, "en", "a"), (None, None, None, "c"), (14, "a" * 5000, "de", "d"),
        (1, base, "en", "a"), (15, base + " indeed", "en", "é"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 7, "x", 0) for i, t, lang, s in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
