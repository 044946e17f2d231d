"""Tag sets of a problem and the choice of its hyper-parameter profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.profile import size_class


# The profiles in priority order, with their tags and search spaces.
BANK = [
    {
        "name": "synthetic_mlp",
        "tags": ["classification", "multiclass", "tabular", "low_features", "multi-label"],
        "description": "Scaled MLP on 2–5 features for larger datasets",
        "params": {
            "layers": {"type": "int", "min": 2, "max": 8, "step": 1},
            "units": {"type": "int", "min": 64, "max": 1024, "step": 64},
            "activation": {"type": "choice", "values": ["relu"]},
            "dropout": {"type": "float", "min": 0.0, "max": 0.5, "step": 0.1},
            "optimizer": {"type": "choice", "values": ["adam"]},
            "learning_rate": {"type": "float", "min": 1e-5, "max": 1e-2, "sampling": "log"},
            "batch_size": {"type": "choice", "values": ["32", "64", "128", "256", "512", "1024"]},
            "epochs": {"type": "int", "min": 20, "max": 200, "step": 10},
        },
    },
    {
        "name": "tabular_classification",
        "tags": ["classification", "multiclass", "tabular", "low_features", "multi-label"],
        "description": "Binary classification on ~50–500 features",
        "params": {
            "layers": {"type": "int", "min": 2, "max": 8, "step": 1},
            "units": {"type": "int", "min": 64, "max": 512, "step": 64},
            "activation": {"type": "choice", "values": ["relu"]},
            "dropout": {"type": "float", "min": 0.0, "max": 0.5, "step": 0.1},
            "optimizer": {"type": "choice", "values": ["adam"]},
            "learning_rate": {"type": "float", "min": 1e-4, "max": 1e-2, "sampling": "log"},
            "batch_size": {"type": "choice", "values": ["64", "128", "256", "512"]},
            "epochs": {"type": "int", "min": 10, "max": 50, "step": 5},
        },
    },
    {
        "name": "ts_lstm_forecasting",
        "tags": ["time-series", "forecasting", "sequence"],
        "description": "Univariate/multivariate forecasting with stacked LSTM layers",
        "params": {
            "layers": {"type": "int", "min": 1, "max": 4, "step": 1},
            "units": {"type": "int", "min": 32, "max": 256, "step": 32},
            "dense_units": {"type": "int", "min": 16, "max": 128, "step": 16},
            "activation": {"type": "choice", "values": ["tanh"]},
            "dropout": {"type": "float", "min": 0.0, "max": 0.5, "step": 0.1},
            "optimizer": {"type": "choice", "values": ["adam"]},
            "learning_rate": {"type": "float", "min": 1e-5, "max": 1e-2, "sampling": "log"},
            "batch_size": {"type": "choice", "values": ["32", "64", "128", "256"]},
            "epochs": {"type": "int", "min": 10, "max": 100, "step": 10},
        },
    },
    {
        "name": "regression_mlp",
        "tags": ["regression", "tabular", "low_features", "medium_features", "missing-values"],
        "description": "Scaled MLP for regression on low-dimensional tabular data",
        "params": {
            "layers": {"type": "int", "min": 2, "max": 8, "step": 1},
            "units": {"type": "int", "min": 64, "max": 1024, "step": 64},
            "activation": {"type": "choice", "values": ["relu"]},
            "dropout": {"type": "float", "min": 0.0, "max": 0.5, "step": 0.1},
            "optimizer": {"type": "choice", "values": ["adam"]},
            "learning_rate": {"type": "float", "min": 1e-5, "max": 1e-2, "sampling": "log"},
            "batch_size": {"type": "choice", "values": ["32", "64", "128", "256", "512", "1024"]},
            "epochs": {"type": "int", "min": 20, "max": 200, "step": 10},
        },
    },
]

PARAM = "struct<type:string,min:double,max:double,step:double,sampling:string,values:array<string>>"


def bank_table(spark: SparkSession) -> DataFrame:
    """The bank as a table with its order kept in ``ord``."""
    fields = ("type", "min", "max", "step", "sampling", "values")
    rows = []
    for i, p in enumerate(BANK):
        params = {
            k: tuple(float(v[f]) if f in ("min", "max", "step") and v.get(f) is not None else v.get(f) for f in fields)
            for k, v in p["params"].items()
        }
        rows.append((i, p["name"], p["tags"], p["description"], params))
    return spark.createDataFrame(
        rows, f"ord int, name string, tags array<string>, description string, params map<string,{PARAM}>"
    )


def problem_tags(
    problem_type: Column,
    subtype: Column,
    has_text: Column,
    has_datetime: Column,
    n_features: Column,
    has_missing: Column,
) -> Column:
    """Type, words of the subtype, kind of data, size and missing-value tags, without repeats."""
    kind = F.when(has_text, "text").when(has_datetime, "time-series").otherwise("tabular")
    rules = F.array(problem_type, kind, size_class(n_features), F.when(has_missing, "missing-values"))
    return F.array_distinct(F.array_compact(F.concat(F.split(subtype, "-"), rules)))


def is_text_column(name: Column, type_label: Column, string_type: bool = False) -> Column:
    """Names that end in text or comment; optionally every string column."""
    by_name = F.endswith(F.lower(name), F.lit("text")) | F.endswith(F.lower(name), F.lit("comment"))
    by_name = by_name | F.startswith(type_label, F.lit("object"))
    return by_name | (type_label == "string") if string_type else by_name


def best_profile(tags: Column, bank: Sequence[dict] = BANK) -> Column:
    """Name of the profile that shares most tags, the first one on ties.

    The bank is a handful of fixed entries, so the choice is an expression on the row and
    needs no join.
    """
    scored = F.array(
        *[
            F.struct(
                (-F.size(F.array_intersect(tags, F.lit(p["tags"])))).alias("neg"),
                F.lit(i).alias("ord"),
                F.lit(p["name"]).alias("name"),
            )
            for i, p in enumerate(bank)
        ]
    )
    return F.array_min(scored)["name"]
