"""Page, reply and script jobs (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import markup
from tabloom.operators import pages, replies
from tabloom.plans.common import load
from tabloom.plans.registry import query
from tabloom.plans.scalars import _MARKED, marked


# The names that occur in the given pages.
_IN_PAGES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _decoded_sql(e: str) -> str:
    for entity, char in _IN_PAGES.items():
        quoted = char.replace("'", "''")
        e = f"replace({e}, '{entity}', '{quoted}')"
    return e


def _strip_sql(e: str) -> str:
    e = f"regexp_replace({e}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g')"
    e = _decoded_sql(f"regexp_replace({e}, '(?s)<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


_H1 = "regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"


@query("h1_page_title", f"SELECT page_id, {_strip_sql(_H1)} AS title FROM pages")
def h1(spark, d):
    return load(spark, d, "pages").select("page_id", markup.first_heading(F.col("html")).alias("title"))


def _extended(spark, d):
    """Pages with headings before the footer; every third has no evaluation text."""
    n = F.col("page_id").cast("string")
    score = F.when(F.col("page_id") % 3 == 0, F.lit("<p> </p>")).otherwise(
        F.concat(F.lit("<p>Scored by  <b>measure "), n, F.lit("</b></p><ul><li>once</li></ul>"))
    )
    extra = F.concat(
        F.lit("<section><h2>Evaluation metric</h2>"), score,
        F.lit("<h3>Submission File</h3>id,target<p>0,"), n, F.lit("</p><h2>Files</h2><div></div><p>"), n,
        F.lit(" files</p><h2>Size</h2><div>12 <i>MB</i></div><h2>License</h2></section><p>open</p>"),
    )
    html = F.replace(F.col("html"), F.lit("<footer>"), F.concat(extra, F.lit("<footer>")))
    return load(spark, d, "pages").select("page_id", pages.sections(html).alias("s"))


_EVAL = "CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Scored by measure ' || page_id || ' once' END"


@query(
    "h2_section_text",
    f"SELECT page_id, {_EVAL} AS evaluation, 'id,target 0,' || page_id AS submission, '' AS absent FROM pages",
)
def h2(spark, d):
    s = F.col("s")
    return _extended(spark, d).select(
        "page_id",
        pages.section_text(s, ["evaluation"]).alias("evaluation"),
        pages.section_text(s, ["submission file"]).alias("submission"),
        pages.section_text(s, ["prizes"]).alias("absent"),
    )


@query(
    "h3_description",
    f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE '## Evaluation' || chr(10) || chr(10) || {_EVAL} || chr(10) || chr(10) END
               || '## Submission File' || chr(10) || chr(10) || 'id,target 0,' || page_id AS description FROM pages""",
)
def h3(spark, d):
    return _extended(spark, d).select("page_id", pages.description(F.col("s")).alias("description"))


@query(
    "h4_labelled_facts",
    "SELECT page_id, page_id || ' files' AS files, '12MB' AS size, 'open' AS license, 3 AS n FROM pages",
)
def h4(spark, d):
    f = _extended(spark, d).select("page_id", pages.facts(F.col("s")).alias("f"))
    return f.select(
        "page_id", *[F.col("f")[k].alias(k) for k in ("files", "size", "license")], F.size("f").alias("n")
    )


# The text pieces behind the first heading, up to the end of the article.
_PIECES = f"""list_filter(list_transform(regexp_split_to_array(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '<[^>]*>'),
  lambda x: trim({_decoded_sql("x")})), lambda x: x <> '')"""


@query(
    "h2_all_sections",
    f"""WITH t AS (SELECT page_id, html, {_PIECES} AS p FROM pages)
        SELECT page_id, CAST(1 AS INT) AS level, {_strip_sql(_H1)} AS heading,
          trim(regexp_replace(array_to_string(p, ' '), '\\s+', ' ', 'g')) AS text, CASE WHEN len(p) > 0 THEN array_to_string(p, '') END AS block,
          CASE WHEN len(p) > 0 THEN array_to_string(p, chr(10)) END AS body, '' AS items FROM t""",
)
def h2_all(spark, d):
    found = load(spark, d, "pages").select("page_id", F.inline(pages.sections(F.col("html"))))
    return found.withColumn("items", F.array_join("items", "|"))


def _data_pages(spark, d):
    """Pages with a described data set and two lists, of which one stands under the wanted heading."""
    n = F.col("page_id").cast("string")
    lists = F.concat(
        F.lit("<h2>Other</h2><ul><li><p>wrong "), n, F.lit("</p></li></ul><h2>Dataset Description</h2><div> </div><ul><li>Rows of <b>page "),
        n, F.lit("</b></li><li>two columns</li></ul><h3>Inner</h3><h2>Files</h2><p>2 files</p><h2>My Data Explorer</h2><p>before</p><ul><li><div><p>train_"),
        n, F.lit(".csv</p></div></li><li>no paragraph</li><li><p> </p><ul><li><p>te<i>st</i>.csv</p></li></ul></li></ul><ul><li><p>late</p></li></ul>"),
    )
    lists = F.when(F.col("page_id") % 4 == 0, F.lit("<h2>Files</h2><p>none</p>")).otherwise(lists)
    html = F.replace(F.col("html"), F.lit("<footer>"), F.concat(lists, F.lit("<footer>")))
    return load(spark, d, "pages").select("page_id", pages.sections(html).alias("s"))


@query(
    "h4_described_data",
    """SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN 'Rows of' || chr(10) || 'page ' || page_id || chr(10) || 'two columns' END AS described,
              CASE WHEN page_id % 4 = 0 THEN 'none' ELSE '2 files' END AS files, CAST(CASE WHEN page_id % 4 = 0 THEN 1 ELSE 2 END AS INT) AS n FROM pages""",
)
def h4_described(spark, d):
    f = _data_pages(spark, d).select("page_id", pages.facts(F.col("s")).alias("f"))
    return f.select("page_id", F.col("f")["dataset_description"].alias("described"), F.col("f")["files"].alias("files"), F.size("f").alias("n"))


@query(
    "h5_listed_files",
    "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'train_' || page_id || '.csv|test.csv' END AS files FROM pages",
)
def h5_listed(spark, d):
    """Of several lists only the one under the heading, with its nested list."""
    return _data_pages(spark, d).select("page_id", F.array_join(pages.listed(F.col("s")), "|").alias("files"))


@query(
    "h5_list_items",
    f"""WITH i AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1), lambda x: {_strip_sql("x")}), lambda x: x <> '') AS items FROM pages)
        SELECT page_id, array_to_string(items, '|') AS items, CAST(len(items) AS INT) AS n FROM i""",
)
def h5(spark, d):
    items = load(spark, d, "pages").select("page_id", markup.list_items(F.col("html")).alias("items"))
    return items.select("page_id", F.array_join("items", "|").alias("items"), F.size("items").alias("n"))


@query("h6_page_text", f"SELECT page_id, md5({_strip_sql('html')}) AS digest FROM pages")
def h6(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(markup.strip_tags(F.col("html"))).alias("digest"))


_NAMES = sorted(n for n in markup.html5 if n.endswith(";"))
_CHARS = [markup.html5[n].replace("\u00a0", " ") for n in _NAMES]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(
    "h6_all_entities",
    f"""SELECT page_id, {_sql_list(_CHARS)}[page_id % {len(_NAMES)} + 1] || '&&' || {_sql_list(_CHARS)}[page_id * 7 % {len(_NAMES)} + 1] || 'lt;x&none;' AS text FROM pages""",
)
def h6_entities(spark, d):
    """Every standard name, next to others, escaped ampersands and unknown names."""
    name = lambda i: F.element_at(F.lit(_NAMES), (i % len(_NAMES) + 1).cast("int"))
    n = F.col("page_id")
    text = F.concat(F.lit("&"), name(n), F.lit("&&amp;&"), name(n * 7), F.lit("lt;x&none;"))
    return load(spark, d, "pages").select("page_id", markup.decode_entities(text).alias("text"))


def _replies(spark, d):
    """Property objects as replies: clean, wrapped, quoted as Python, cut off or without a key."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit('{"k": '), k))
        .when(kind == 1, F.concat(F.lit("Here it is:\n```"), F.col("props"), F.lit("```\nDone {ok}")))
        .when(kind == 2, F.concat(F.lit("{'k': "), k, F.lit(", 'note': None, 'ok': True}")))
        .when(kind == 3, F.concat(F.lit('{"v": '), k, F.lit("}")))
        .when(kind == 4, F.concat(F.lit("Answer: "), F.col("props")))
        .otherwise(F.col("props"))
    )
    return load(spark, d, "events").select("event_id", raw.alias("raw"))


@query(
    "h7_reply_validation",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'unreadable' WHEN 3 THEN 'missing keys' ELSE 'parsed' END AS state,
              CASE event_id % 6 WHEN 3 THEN 'k' ELSE '' END AS missing,
              CASE WHEN event_id % 6 IN (2, 4, 5) THEN json_extract_string(props, '$.k') END AS k FROM events""",
)
def h7(spark, d):
    checked = replies.validate(_replies(spark, d), "raw", ["k"])
    return checked.select(
        "event_id",
        "state",
        F.coalesce(F.array_join("missing", ","), F.lit("")).alias("missing"),
        F.when(F.col("state") == "parsed", F.col("args")["k"]).alias("k"),
    )


@query(
    "h8_vocabulary_check",
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'competition_problem_type' END, CASE WHEN p_partkey % 5 = 0 THEN 'competition_problem_subtype' END,
              CASE WHEN p_partkey % 7 = 0 THEN 'competition_dataset_type' END) AS bad FROM part""",
)
def h8(spark, d):
    key = F.col("p_partkey")
    df = load(spark, d, "part").select(
        "p_partkey",
        F.when(key % 3 != 0, "regression").alias("competition_problem_type"),
        F.when(key % 5 == 0, "ranking").otherwise("ordinal-regression").alias("competition_problem_subtype"),
        F.when(key % 7 == 0, "tabular").otherwise("Tabular").alias("competition_dataset_type"),
        F.lit("DL").alias("used_technique"),
    )
    return df.select("p_partkey", F.array_join(replies.violations(), ",").alias("bad"))


@query(
    "h8_metric_names",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Log Loss' WHEN 1 THEN 'RMSLE – Root Mean Squared Logarithmic Error|AUCROC' WHEN 2 THEN 'F1 Score|speed' WHEN 3 THEN '' ELSE 'a thing' END AS names,
              CASE p_partkey % 5 WHEN 2 THEN 'speed' WHEN 4 THEN 'a thing' ELSE '' END AS unknown FROM part""",
)
def h8_metrics(spark, d):
    """One name, lists with other case, blanks and repeats, null, and names outside the vocabulary."""
    raw = F.element_at(
        F.array(F.lit(" log loss"), F.lit('["RMSLE – root mean squared logarithmic error", "AucRoc ", "AUCROC"]'), F.lit('["F1 Score", " speed"]'), F.lit(None), F.lit("a thing")),
        (F.col("p_partkey") % 5 + 1).cast("int"),
    )
    names = load(spark, d, "part").select("p_partkey", replies.metric_names(raw).alias("m"))
    return names.select("p_partkey", F.array_join("m", "|").alias("names"), F.array_join(replies.unknown_metrics(F.col("m")), "|").alias("unknown"))


@query(
    "h9_code_and_error",
    f"""WITH t AS ({_MARKED}) SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'incomplete' ELSE 'ok' END AS state, CASE WHEN turn % 5 <> 4 THEN role END AS error,
               md5(CASE WHEN turn % 5 <> 4 THEN regexp_replace(text, '(^\\s+)|(\\s+$)', '', 'g') ELSE text END) AS code FROM t""",
)
def h9(spark, d):
    out = replies.code_and_error(marked(spark, d), "t")
    return out.select("conv_id", "turn", "state", "error", F.md5(replies.code_or_text(F.col("t"))).alias("code"))


@query(
    "h10_tagged_sections",
    """SELECT doc_id, '<Subtype>' || chr(10) || lang || chr(10) || '</Subtype>' || chr(10) || '<Metadata>' || chr(10) || '{"source":"' || source || '","n_chars":' || n_chars || '}' || chr(10) || '</Metadata>' || chr(10) AS context FROM documents""",
)
def h10(spark, d):
    parts = {"Subtype": F.col("lang"), "Metadata": F.to_json(F.struct("source", "n_chars"))}
    return load(spark, d, "documents").select("doc_id", replies.tagged_sections(parts).alias("context"))


@query(
    "h11_model_block",
    """SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN 'model = Net(''' || role || ''')' || chr(10) || 'model.compile()' END AS block,
              CASE WHEN turn % 4 <> 3 THEN 'model.fit(x, y,' || chr(10) || '  epochs=' || turn || ')' END AS fit FROM conversations""",
)
def h11(spark, d):
    turn = F.col("turn").cast("string")
    code = F.concat(
        F.lit("import lib\nx = 1\nmodel = Net('"), F.col("role"), F.lit("')\nmodel.compile()\nhistory = model.fit(x, y,\n  epochs="),
        turn, F.lit(")\nmodel = None\nmodel.fit(z)\n# "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")),
    )
    code = F.when(F.col("turn") % 4 != 3, code).otherwise("print('no network')")
    return load(spark, d, "conversations").select(
        "conv_id", "turn", replies.model_block(code).alias("block"), replies.fit_call(code).alias("fit")
    )


@query(
    "h12_record_payload",
    "SELECT doc_id, md5(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'text': text}) AS VARCHAR)) AS digest FROM documents",
)
def h12(spark, d):
    payload = F.to_json(F.struct("doc_id", "lang", "source", "text"))
    return load(spark, d, "documents").select("doc_id", F.md5(payload).alias("digest"))
