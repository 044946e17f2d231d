"""From replies to the record table: rejects, quality filter, votes and ties."""

import json

from tabloom.operators import records, replies


def reply(**changes):
    base = {k: "x" for k in replies.REQUIRED}
    base.update(used_technique="DL", library="Tensorflow", target_column=["y"], preprocessing_steps=["scale", "impute"])
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v is not None})


def test_records(spark):
    rows = [
        ("c1", "u/a", 5, reply()),
        ("c1", "u/b", 9, "Sure: " + reply(used_technique="dl", library="TensorFlow")),
        ("c1", "u/c", 99, reply(used_technique="ML")),
        ("c1", "u/d", 98, reply(library="Pytorch")),
        ("c1", "u/e", 5, reply(target_column="y")),
        ("c2", "u/f", 1, reply(library=None)),
        ("c2", "u/g", 1, "no reply"),
    ]
    df = spark.createDataFrame(rows, "competition_slug string, kernel_ref string, votes long, raw string").selectExpr(
        "*", "'tensorflow' as tag", "'RMSE' as evaluation_metrics", "concat('https://host/', kernel_ref) as kernel_link"
    )
    accepted, rejected = records.split_replies(df)
    assert sorted((r.kernel_ref, r.state) for r in rejected.collect()) == [("u/f", "missing keys"), ("u/g", "unreadable")]
    table = records.as_records(records.keep_best(accepted, "tag", 2))
    assert table.schema.names == records.RECORD.names
    got = sorted((r.kernel_ref, r.target_column, r.preprocessing_steps) for r in table.collect())
    assert got == [("u/a", ["y"], ["scale", "impute"]), ("u/b", ["y"], ["scale", "impute"])]
    everyone = records.keep_best(accepted, "tag", 10).collect()
    assert sorted(r.kernel_ref for r in everyone) == ["u/a", "u/b", "u/e"]
