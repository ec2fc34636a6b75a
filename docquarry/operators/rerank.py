"""Reranking: reciprocal rank fusion and cross-encoder scoring of a bounded window of hits."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.errors import UserError
from docquarry.mapping import Mapping
from docquarry.operators.filters import column

_PLACE = re.compile(r"\{\{\s*([A-Za-z0-9_.]+)\s*\}\}")


def fuse(lists: Sequence[DataFrame], k: float) -> DataFrame:
    """(_id, _score) from lists of (_id, _score, _seq): the sum of 1 / (k + rank), ranks from 0. One list is returned as it is."""
    if len(lists) == 1:
        return lists[0].select("_id", "_score")
    ranked = []
    for hits in lists:  # each a window of bounded size
        order = Window.orderBy(F.desc("_score"), "_seq", "_id")
        ranked.append(hits.select("_id", (1.0 / (k + F.row_number().over(order) - 1)).alias("part")))
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out.groupBy("_id").agg(F.sum("part").alias("_score"))


def render(template: str, m: Mapping) -> Column:
    """A document template with ``{{ field }}`` places as a column; only stored string fields may stand in it."""
    parts: list[Column] = []
    at = 0
    for x in _PLACE.finditer(template):
        f = m.need(x[1], "store")
        if f.type not in ("text", "id"):
            raise UserError(f"field {f.name!r} of type {f.type} can't stand in a template")
        parts += [F.lit(template[at : x.start()]), F.coalesce(column(f.name), F.lit(""))]
        at = x.end()
    return F.concat(*parts, F.lit(template[at:]))


def cross_encode(window: DataFrame, query: str, text: Column, score: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """The window's rows with ``_score`` replaced by a model's score of (query, text)."""

    @F.pandas_udf("double")
    def scored(t: pd.Series) -> pd.Series:
        return pd.Series(score(query, t.fillna("").tolist()), dtype="float64")

    return window.withColumn("_score", scored(text))
