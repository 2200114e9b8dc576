"""Feature stores: port indexes, search, truncation, samples."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.text import dot_get
from tilewright.plans import ship

#: Paths that the index can be searched by.
SEARCH_FIELDS = [".attributes.gml_id", ".metadata.featureType", ".attributes.lod"]
MOST_ITEMS, PAGE = 5, 50
_RINGS = ("exterior", "interior", "pos")


def simplify(value: object, most: int = MOST_ITEMS) -> object:
    """JSON with each list cut to ``most`` items and a note of how many more there were."""
    if isinstance(value, dict):
        return {k: simplify(v, most) for k, v in value.items()}
    if isinstance(value, list):
        head = [simplify(v, most) for v in value[:most]]
        return head + [f"... and {len(value) - most} more items"] * (len(value) > most)
    return value


def _is_points(value: object) -> bool:
    if not isinstance(value, list) or not value:
        return False
    head = value[0]
    return isinstance(head, int | float) or isinstance(head, dict) and {"x", "y"} <= head.keys()


def elide(value: object) -> object:
    """JSON with coordinate lists under ring keys replaced by their number."""
    if isinstance(value, dict):
        return {k: f"({len(v)} coordinates)" if k in _RINGS and _is_points(v) else elide(v) for k, v in value.items()}
    return [elide(v) for v in value] if isinstance(value, list) else value


def _over_json(function):  # noqa: ANN001, ANN202
    """An Arrow-batched function over JSON text; text that is no JSON becomes null."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(function(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def simplified(features: DataFrame, col: str = "feature") -> DataFrame:
    """Features with ``simplified`` JSON: nested lists need recursion, which no built-in function offers."""
    ship(features.sparkSession)
    return features.withColumn("simplified", _over_json(simplify)(col))


def elided(features: DataFrame, col: str = "feature") -> DataFrame:
    """Features with ``elided`` JSON."""
    ship(features.sparkSession)
    return features.withColumn("elided", _over_json(elide)(col))


def truncated(items: Column, most: int = MOST_ITEMS) -> Column:
    """A flat array of texts cut to ``most`` items and a note of the rest."""
    more = F.concat(F.lit("... and "), (F.size(items) - most).cast("string"), F.lit(" more items"))
    return F.when(F.size(items) > most, F.concat(F.slice(items, 1, most), F.array(more))).otherwise(items)


def search_columns(features: DataFrame, fields: list[str] = SEARCH_FIELDS, col: str = "feature") -> DataFrame:
    """Features with a typed column per search field (named by its last part), ``''`` for missing and falsy values."""
    return features.select("*", *(dot_get(F.col(col), f).alias(f.rsplit(".", 1)[-1]) for f in fields))


def port_entries(features: DataFrame, fields: list[str] = SEARCH_FIELDS) -> DataFrame:
    """(port, _idx, search fields): an entry per line of a store; ports without lines have none."""
    names = [f.rsplit(".", 1)[-1] for f in fields]
    return search_columns(features, fields).select("port", F.col("line_no").alias("_idx"), *names)


def port_counts(features: DataFrame) -> DataFrame:
    """(port, count) of the lines of each store."""
    return features.groupBy("port").agg(F.count("*").alias("count"))


def port_index(features: DataFrame, fields: list[str] = SEARCH_FIELDS) -> DataFrame:
    """(port, count, features) as a page's script reads it: a port's entries in line order as one value.

    For stores that a page can hold; larger ones stay in the rows of ``port_entries``.
    """
    entries = port_entries(features, fields)
    entry = F.struct(*(c for c in entries.columns if c != "port"))
    return entries.groupBy("port").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(entry)).alias("features"))


def matching(features: DataFrame, filters: list[tuple[str, str]]) -> DataFrame:
    """Rows whose columns contain the filters' values, case aside; filters with an empty name or value are left out."""
    found = features
    for name, value in filters:
        if name and value:
            found = found.where(F.contains(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lower(F.lit(value))))
    return found


def page(rows: DataFrame, order: list[str], number: int, size: int = PAGE) -> DataFrame:
    """Page ``number`` (from 0) of the ordered rows."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def edge_samples(features: DataFrame) -> DataFrame:
    """(port, count, sample, attributes): lines per port, the first feature and its first ten attribute names."""
    first = features.groupBy("port").agg(F.count("*").alias("count"), F.min_by("feature", "line_no").alias("sample"))
    keys = F.json_object_keys(F.get_json_object("sample", "$.attributes"))
    return first.withColumn("attributes", F.coalesce(F.slice(keys, 1, 10), F.array().cast("array<string>")))


def port_of(stem: Column) -> Column:
    """Edge id of a store's file name: its last dot part."""
    return F.element_at(F.split(stem, r"\."), -1)


def one_per_port(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """First row of each group."""
    first = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def leaves(value: object, path: str = "") -> list[tuple[str, str]]:
    """(path, JSON text) of a document's values that hold no others, in order."""
    if isinstance(value, dict) and value:
        return [leaf for k, v in value.items() for leaf in leaves(v, f"{path}.{k}")]
    if isinstance(value, list) and value:
        return [leaf for i, v in enumerate(value) for leaf in leaves(v, f"{path}[{i}]")]
    return [(path, json.dumps(value, ensure_ascii=False))]


def flattened(features: DataFrame, col: str = "feature") -> DataFrame:
    """One row per leaf of each feature: its columns, nth, path and value; text that is no JSON has none."""
    ship(features.sparkSession)

    def one(text: str | None) -> list[tuple[str, str]]:
        try:
            return [] if text is None else leaves(json.loads(text))
        except ValueError:
            return []

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"path": p, "value": v} for p, v in one(t)])

    return features.withColumn("_leaves", run(col)).select(
        *features.columns, F.posexplode("_leaves").alias("nth", "_leaf")
    ).select(*features.columns, "nth", "_leaf.path", "_leaf.value")
