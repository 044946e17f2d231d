"""Checks and extraction on tables of model replies and scripts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.operators.metrics import METRICS

# Required keys of a structured record and its closed vocabularies.
REQUIRED = [
    "competition_problem_type",
    "competition_problem_subtype",
    "competition_problem_description",
    "dataset_metadata",
    "competition_dataset_type",
    "preprocessing_steps",
    "notebook_model_layers_code",
    "used_technique",
    "library",
    "target_column",
]
VOCABULARY = {
    "competition_problem_type": ["classification", "regression"],
    "competition_problem_subtype": [
        "binary-classification",
        "multiclass-classification",
        "multi-label-classification",
        "time-series-forecasting",
        "continuous-regression",
        "quantile-regression",
        "multi-output-regression",
        "ordinal-regression",
        "missing-value-imputation",
    ],
    "competition_dataset_type": [
        "Tabular", "Time-series", "Text", "Image", "Audio", "Video", "Geospatial", "Graph", "Multimodal",
    ],
    "used_technique": ["DL", "ML"],
}


def _object(text: Column, single_quotes: bool) -> Column:
    """The text as one JSON object. Inside brackets, text after the object is an error too."""
    options = {"allowSingleQuotes": str(single_quotes).lower()}
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", options)
    return F.when(F.size(listed) == 1, F.element_at(listed, 1))


# Quoted texts whole, then runs without quotes, then lone quotes.
_TOKENS = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++|['"]"""


def python_literal(text: Column) -> Column:
    """Python's None, True and False as JSON words, outside quoted texts only."""

    def plain(token: Column) -> Column:
        out = token
        for word, value in (("None", "null"), ("True", "true"), ("False", "false")):
            out = F.regexp_replace(out, rf"\b{word}\b", value)
        return F.when(token.rlike("^['\"]"), token).otherwise(out)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), plain), "")


def parsed_reply(raw: Column) -> Column:
    """Keys and values of a reply: as it is, between its outer braces, or as a Python literal."""
    trimmed = S.outer_braces(raw)
    return F.coalesce(_object(raw, False), _object(trimmed, False), _object(python_literal(trimmed), True))


def validate(df: DataFrame, raw: str, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Adds ``args``, ``missing`` and ``state``: parsed, missing keys or unreadable."""
    args = df.withColumn("args", parsed_reply(F.col(raw)))
    missing = F.array_except(F.lit(list(required)), F.map_keys("args"))
    return args.withColumn("missing", missing).withColumn(
        "state",
        F.when(F.col("args").isNull(), "unreadable").when(F.size("missing") > 0, "missing keys").otherwise("parsed"),
    )


def violations(vocabulary: Mapping[str, Sequence[str]] = VOCABULARY) -> Column:
    """Names of the fields whose value is null or outside its vocabulary."""
    checks = [
        F.when(F.coalesce(F.col(c).isin(list(values)), F.lit(False)), F.lit(None)).otherwise(F.lit(c))
        for c, values in vocabulary.items()
    ]
    return F.array_compact(F.array(*checks))


def metric_names(value: Column) -> Column:
    """A reply's metrics, given as a JSON list, one name or null, as a list of names as the vocabulary writes them.

    Case and outer blanks do not matter; unknown names stay as they are, repeats go.
    """
    known = F.create_map(*[F.lit(x) for name in METRICS for x in (name.lower(), name)])
    listed = F.filter(F.coalesce(S.as_list(value), F.array().cast("array<string>")), lambda m: m.isNotNull() & (F.trim(m) != ""))
    return F.array_distinct(F.transform(listed, lambda m: F.coalesce(F.try_element_at(known, F.lower(F.trim(m))), F.trim(m))))


def unknown_metrics(names: Column) -> Column:
    """The names of a list that the vocabulary lacks."""
    return F.filter(names, lambda m: ~m.isin(METRICS))


def code_or_text(text: Column) -> Column:
    """Text between the code markers, the whole text when there are none."""
    return F.coalesce(S.between_tags(text, "Code"), text)


def code_and_error(df: DataFrame, text: str) -> DataFrame:
    """Adds ``code`` and ``error``; ``state`` names rows that lack either."""
    out = df.withColumns({"code": S.between_tags(F.col(text), "Code"), "error": S.between_tags(F.col(text), "Error")})
    return out.withColumn(
        "state", F.when(F.col("code").isNull() | F.col("error").isNull(), "incomplete").otherwise("ok")
    )


def tagged_sections(parts: Mapping[str, Column]) -> Column:
    """``<Name>`` blocks on lines of their own."""
    blocks = [
        F.concat(F.lit(f"<{n}>\n"), F.coalesce(c.cast("string"), F.lit("")), F.lit(f"\n</{n}>\n"))
        for n, c in parts.items()
    ]
    return F.concat(*blocks)


def model_block(code: Column) -> Column:
    """From the first ``model =`` to the line before the first ``model.fit``."""
    return F.nullif(F.regexp_extract(code, r"(?s)(model\s*=.*?)(?=\n[^\n]*model\.fit)", 1), F.lit(""))


def fit_call(code: Column) -> Column:
    """The fit call up to its closing bracket at the end of a line."""
    return F.nullif(F.regexp_extract(code, r"(?s)(model\.fit\(.*?\))[ \t]*(?:\n|$)", 1), F.lit(""))
