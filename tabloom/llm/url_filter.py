"""URL filter rules by a sort-merge range join on reversed-host keys.

A rule is (verdict, host, path). It fits a url whose host is the rule's or a subdomain of it and
whose path starts with the rule's path. The canonical key is the reversed host labels, ``?``
(which no host or path can contain) and the path, so every rule covers one interval of keys and
the intervals are nested or disjoint. A url has one key for each of its parent domains that a
rule host can have.

Rules and url keys are swept together in key order. Every rule carries the stack of the rules
whose interval encloses its own start; at a url, the stack of the last rule passed, less the
rules whose interval has ended, is what is active. The longest active rule (host and path
characters) decides; equal lengths go to the longer host, then to the larger text.

Urls are dealt evenly by a salt and the rules are repeated for each salt, so a host that holds
most urls is spread like any other. Only DataFrame functions are used.

Defined results: a null url or one without ``://`` has empty host and path and matches no rule
with a non-empty host; a url that no rule fits gets ``default``. Of rules with equal host and
path the first listed counts. Repeated rows are judged one by one. No rules: ``default``
everywhere. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.support import ascii_lower, load, query, shuffle_parts

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Url keys of one sweep task are about rows / (SALTS_PER_PARTITION * spark.sql.shuffle.partitions).
SALTS_PER_PARTITION = 4


def host_of(url: Column) -> Column:
    start = F.instr(url, "://")
    rest = F.substr(url, start + 3)
    return F.when(start > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    start = F.instr(url, "://")
    rest = F.substr(url, start + 3)
    return F.when(start > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("?"), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """key and stack: the rules whose interval holds the key's start, itself included.

    ``rules`` has verdict, host, path and rank (order of listing).
    """
    keyed = rules.withColumn("key", _key(F.col("host"), F.col("path")))
    keyed = keyed.groupBy("key").agg(F.min_by(F.struct("verdict", "host", "path"), "rank").alias("rule"))
    entry = F.struct(
        (F.length("rule.host") + F.length("rule.path")).alias("length"),
        F.length("rule.host").alias("host_length"),
        F.concat("rule.host", "rule.path").alias("rule"),
        F.col("rule.verdict").alias("verdict"),
        F.col("key").alias("prefix"),
    )
    # Enclosing rules are prefixes of the key, and only lengths that some rule has can occur.
    lengths = keyed.agg(F.collect_set(F.length("key")).alias("ls")).select("ls").scalar()
    own = keyed.select("key", F.explode(lengths).alias("l")).filter(F.col("l") <= F.length("key"))
    own = own.select("key", F.substring("key", F.lit(1), F.col("l")).alias("prefix"))
    above = keyed.select(F.col("key").alias("prefix"), entry.alias("e"))
    return own.join(above, "prefix").groupBy("key").agg(F.collect_list("e").alias("stack"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """page id, host, path, rule and verdict of every row."""
    spark = pages.sparkSession
    salts = SALTS_PER_PARTITION * shuffle_parts(spark)
    url = F.col(url_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")
    ).withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))

    # Parent domains: the last n labels, for n up to the longest rule host.
    most = F.coalesce(rules.agg(F.max(F.size(F.split("host", r"\.", -1))).alias("m")).scalar(), F.lit(1))
    labels = F.split("host", r"\.", -1)
    depth = F.least(most, F.size(labels))
    urls = rows.withColumn("n", F.explode(F.sequence(F.lit(1), depth)))
    parent = F.array_join(F.slice(labels, -F.col("n"), F.col("n")), ".")
    urls = urls.select("salt", _key(parent, F.col("path")).alias("key"), "row", "page_id", "host", "path")
    starts = rule_stacks(rules).select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", "stack")
    events = starts.unionByName(urls, allowMissingColumns=True)

    # A rule that starts at the very key of a url comes first: it fits.
    sweep = Window.partitionBy("salt").orderBy("key", F.col("row").asc_nulls_first())
    passed = sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(passed)).filter(F.col("row").isNotNull())
    active = F.array_max(F.filter("stack", lambda e: F.startswith(F.col("key"), e["prefix"])))
    best = swept.withColumn("best", active).groupBy("salt", "row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max("best").alias("best"),
    )
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def rules_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A short list of rules as a table, without leaving the JVM."""
    if not rules:
        return spark.sql("SELECT '' verdict, '' host, '' path, 0 rank WHERE false")
    rows = [
        F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(i).alias("rank"))
        for i, (v, h, p) in enumerate(rules)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'),
  ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
m AS (
  SELECT h.page_id, h.host, h.path, max(struct_pack(l := length(rhost || rpath), rule := rhost || rpath, v := verdict)) AS b
  FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL)
SELECT page_id, host, path,
  CASE WHEN b.rule IS NOT NULL THEN b.rule END AS rule, coalesce(b.v, 'allow') AS verdict FROM m
"""


@query("op8_url_filter", _SQL)
def op8_url_filter(spark, sf_dir):
    return judge_urls(load(spark, sf_dir, "pages"), rules_table(spark, RULES))
