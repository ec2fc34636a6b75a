"""Facets over all matching documents."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.errors import UserError
from docquarry.mapping import FieldSpec, Mapping
from docquarry.operators.filters import column, in_range
from docquarry.plans import dsl


def _label(f: FieldSpec, value: Column) -> Column:
    if f.base == "date":
        return F.date_format(value, "yyyy-MM-dd")
    if f.base == "datetime":
        return F.regexp_replace(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), r"\.000Z$", "Z")
    return value.cast("string")


def term_counts(matches: DataFrame, m: Mapping, a: dsl.TermAgg) -> DataFrame:
    """(term, count): documents per value, the most frequent first, ties by value."""
    f = m.need(a.field, "facet")
    if f.base in ("bool", "geopoint", "id"):
        raise UserError(f"field {f.name!r} of type {f.type} has no term facet")
    c = column(f.name)
    values = matches.select(F.explode(F.array_distinct(c)).alias("v") if f.is_list else c.alias("v")).where("v is not null")
    top = values.groupBy("v").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "v")
    return (top if a.size is None else top.limit(a.size)).select(_label(f, F.col("v")).alias("term"), "count")


def range_counts(matches: DataFrame, m: Mapping, a: dsl.RangeAgg) -> DataFrame:
    """(bucket, count) in the order of the request; empty buckets stay."""
    f = m.need(a.field, "facet")
    counts = matches.agg(*[F.count_if(in_range(f, b)).alias(f"r{i}") for i, b in enumerate(a.ranges)])
    return counts.select(F.posexplode(F.array(*[F.col(f"r{i}") for i in range(len(a.ranges))])).alias("bucket", "count"))


def _plain(v: Any) -> Any:
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


def facets(matches: DataFrame, m: Mapping, aggs: dict[str, Any]) -> dict[str, dict]:
    """All facets of a request, as in a response; their size is bounded by the request, or for "all" by the distinct values."""
    out = {}
    for name, a in aggs.items():
        if isinstance(a, dsl.TermAgg):
            out[name] = {"buckets": [{"term": r["term"], "count": r["count"]} for r in term_counts(matches, m, a).collect()]}
        else:
            counts = {r["bucket"]: r["count"] for r in range_counts(matches, m, a).collect()}
            out[name] = {"buckets": [{k: _plain(v) for k, v in vars(b).items() if v is not None} | {"count": counts[i]} for i, b in enumerate(a.ranges)]}
    return out
