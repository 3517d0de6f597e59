"""Metric documents of unknown metrics, read once as VARIANT and without a fixed schema.

Three shapes are taken, told by the document itself:

* ``by_class``: every entry is an object, ``{"<class>": {"<metric>": value, ...}, ...}``;
* ``by_metric``: an entry is an object, ``{"<metric>": {"<class>": value, ...}, ...}``;
* ``by_order``: an entry is a list with a value for each of ``classes``, ``{"<metric>": [value, ...], ...}``.

The first that fits counts. All metrics are kept; a value that is no number has a null ``value`` and its text as ``raw``.
Entries outside the shape (numbers beside objects, lists of another length) are kept with a null class. Documents that are
no JSON, no object or empty are listed by ``bad_documents``, not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def parsed(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``doc`` (VARIANT, null if it can't be parsed) and ``entries`` (name to VARIANT, null unless an object)."""
    found = docs.withColumn("doc", F.try_parse_json(text))
    return found.withColumn("entries", F.when(_kind(F.col("doc")) == "OBJECT", F.try_variant_get("doc", "$", "map<string,variant>")))


def _values(entry: str, classes: list[str]) -> Column:
    """(class_name, metric or null, leaf) of one entry's value ``e.value``, by the shape."""
    value = F.col(f"{entry}.value")
    inner = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    listed = F.try_variant_get(value, "$", "array<variant>")
    name = F.col(f"{entry}.key")
    row = lambda c, m, v: F.struct(c.alias("class_name"), m.alias("metric"), v.alias("leaf"))
    none = F.lit(None).cast("string")
    order = F.array(*(F.lit(c) for c in classes)) if classes else F.array().cast("array<string>")
    alone = F.array(row(none, name, value))
    by_class = F.transform(inner, lambda x: row(name, x["key"], x["value"]))
    by_metric = F.when(_kind(value) == "OBJECT", F.transform(inner, lambda x: row(x["key"], name, x["value"]))).otherwise(alone)
    by_order = F.when((_kind(value) == "ARRAY") & (F.size(listed) == len(classes)), F.transform(listed, lambda x, i: row(F.get(order, i), name, x))).otherwise(alone)
    return F.when(F.col("shape") == "by_class", by_class).when(F.col("shape") == "by_metric", by_metric).otherwise(by_order)


def class_metrics(docs: DataFrame, key: list[str], text: str, classes: list[str]) -> DataFrame:
    """(key, shape, class_name, metric, value, raw) of all good documents, in one pass over them."""
    kinds = F.transform(F.map_values("entries"), _kind)
    shape = F.when(F.forall(kinds, lambda k: k == "OBJECT"), "by_class").when(F.exists(kinds, lambda k: k == "OBJECT"), "by_metric").otherwise("by_order")
    good = parsed(docs, text).filter(F.size("entries") > 0).withColumn("shape", shape)
    each = good.select(*key, "shape", F.explode(F.map_entries("entries")).alias("e"))
    leaves = each.select(*key, "shape", F.explode(_values("e", classes)).alias("x")).select(*key, "shape", "x.*")
    number = F.when(_kind(F.col("leaf")).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get("leaf", "$", "double"))
    raw = F.coalesce(F.when(_kind(F.col("leaf")) == "STRING", F.try_variant_get("leaf", "$", "string")), F.to_json("leaf"))
    return leaves.select(*key, "shape", "class_name", "metric", number.alias("value"), raw.alias("raw"))


def bad_documents(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, reason): missing, no_json (repeated names included), no_object or empty."""
    p = parsed(docs, text)
    reason = F.when(F.col(text).isNull(), "missing").when(F.col("doc").isNull(), "no_json").when(F.col("entries").isNull(), "no_object").when(F.size("entries") == 0, "empty")
    return p.select(*key, reason.alias("reason")).filter("reason is not null")


def schemas(docs: DataFrame, text: str) -> DataFrame:
    """One row: the schema that all documents have room in, and how many were parsed."""
    return parsed(docs, text).agg(F.schema_of_variant_agg("doc").alias("schema"), F.count("doc").alias("n"))


def wide(metrics: DataFrame, key: list[str], metric: str, classes: list[str]) -> DataFrame:
    """(key, a column for each class) of one metric; a class that a document lacks is null. Keys without the metric stay."""
    chosen = F.when(F.col("metric") == metric, F.col("value"))
    return metrics.groupBy(*key).agg(*(F.max(F.when(F.col("class_name") == c, chosen)).alias(c) for c in classes))
