"""Orders of hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.errors import UserError
from docquarry.functions.geo import haversine
from docquarry.mapping import Mapping
from docquarry.operators.filters import column
from docquarry.plans import dsl


def _key(m: Mapping, s: dsl.SortBy) -> Column:
    if s.field == "_score":
        return F.col("_score")
    if s.field == "_doc":
        return F.col("_seq")
    f = m.need(s.field, "sort")
    c = column(f.name)
    if s.origin is not None:
        if f.type != "geopoint":
            raise UserError(f"field {f.name!r} is not a geopoint")
        return haversine(c["lat"], c["lon"], *s.origin)
    if f.type == "geopoint":
        raise UserError(f"sorting by {f.name!r} needs a point of origin")
    if f.is_list:
        c = F.array_min(c) if s.ascending else F.array_max(c)
    return c


def order(m: Mapping, keys: tuple[dsl.SortBy, ...]) -> list[Column]:
    """Sort keys, then insertion order; without keys, the best score first."""
    if not keys:
        return [F.desc("_score"), F.asc("_seq")]
    out = []
    for s in keys:
        k = _key(m, s)
        if s.ascending:
            out.append(k.asc_nulls_first() if s.missing_first else k.asc_nulls_last())
        else:
            out.append(k.desc_nulls_first() if s.missing_first else k.desc_nulls_last())
    return [*out, F.asc("_seq")]
