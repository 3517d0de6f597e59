"""Metric documents read as VARIANT."""

import json

from quillon.sources import documents

CLASSES = ["Rust", "Blight", "a b"]
DOCS = {
    "one": {"Rust": {"f1": 0.5, "recall": 1, "note": "N/A"}, "Blight": {"f1": 1.0e-3, "new_metric": [1, {"deep": None}]}},
    "two": {"f1": {"Rust": 0.25, "Blight": None}, "macro": 0.75, "auc": {"a b": 2}},
    "three": {"f1": [0.1, 0.2, 0.3], "short": [1, 2], "words": ["x", "y", "z"], "macro": True},
    "unicode": {"Röst": {"f1": 12345678901234567890}},
}
BAD = {"missing": None, "no_json": '{"a": ', "no_object": "[1, 2]", "empty": "{}", "no_json2": '{"a": 1, "a": 2}', "no_object2": '"text"', "no_json3": ""}


def rows(spark):
    return spark.createDataFrame([*((k, json.dumps(v)) for k, v in DOCS.items()), *BAD.items()], "run string, text string")


def test_three_shapes_and_unknown_metrics(spark):
    got = {(r.run, r["shape"], r.class_name, r.metric): (r.value, r.raw) for r in documents.class_metrics(rows(spark), ["run"], "text", CLASSES).collect()}
    assert got == {
        ("one", "by_class", "Rust", "f1"): (0.5, "0.5"), ("one", "by_class", "Rust", "recall"): (1.0, "1"), ("one", "by_class", "Rust", "note"): (None, "N/A"),
        ("one", "by_class", "Blight", "f1"): (0.001, "0.001"), ("one", "by_class", "Blight", "new_metric"): (None, '[1,{"deep":null}]'),
        ("two", "by_metric", "Rust", "f1"): (0.25, "0.25"), ("two", "by_metric", "Blight", "f1"): (None, "null"), ("two", "by_metric", None, "macro"): (0.75, "0.75"), ("two", "by_metric", "a b", "auc"): (2.0, "2"),
        ("three", "by_order", "Rust", "f1"): (0.1, "0.1"), ("three", "by_order", "Blight", "f1"): (0.2, "0.2"), ("three", "by_order", "a b", "f1"): (0.3, "0.3"), ("three", "by_order", None, "short"): (None, "[1,2]"),
        ("three", "by_order", "Rust", "words"): (None, "x"), ("three", "by_order", "Blight", "words"): (None, "y"), ("three", "by_order", "a b", "words"): (None, "z"), ("three", "by_order", None, "macro"): (None, "true"),
        ("unicode", "by_class", "Röst", "f1"): (1.2345678901234567e19, "12345678901234567890"),
    }


def test_bad_documents_are_listed(spark):
    got = {r.run: r.reason for r in documents.bad_documents(rows(spark), ["run"], "text").collect()}
    assert got == {k: k.rstrip("23") for k in BAD}


def test_schema_and_wide_rows(spark):
    schema, n = documents.schemas(rows(spark).filter("run in ('one', 'two')"), "text").first()
    assert n == 2 and "Rust: OBJECT<" in schema and "macro: " in schema
    table = {r.run: tuple(r)[1:] for r in documents.wide(documents.class_metrics(rows(spark), ["run"], "text", CLASSES), ["run"], "f1", CLASSES).collect()}
    assert table == {"one": (0.5, 0.001, None), "two": (0.25, None, None), "three": (0.1, 0.2, 0.3), "unicode": (None, None, None)}
    none = rows(spark).limit(0)
    assert documents.class_metrics(none, ["run"], "text", CLASSES).count() == 0 and documents.bad_documents(none, ["run"], "text").count() == 0 and documents.class_metrics(rows(spark), ["run"], "text", []).count() > 0
