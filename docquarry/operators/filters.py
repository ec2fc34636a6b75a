"""Filters as Boolean column expressions; null never passes, and a negation keeps what the filter doesn't match."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.errors import UserError
from docquarry.functions import geo
from docquarry.mapping import FieldSpec, Mapping
from docquarry.plans import dsl

_LIMITS = {"int": 2**31, "long": 2**63}


def column(name: str) -> Column:
    """The column of a field; flattened nested fields keep the dot in their name."""
    return F.col(f"`{name}`")


def _matches(f: FieldSpec, test) -> Column:
    c = column(f.name)
    return F.exists(c, test) if f.is_list else test(c)


def term(m: Mapping, t: dsl.Term) -> Column:
    f, v = m.need(t.field, "filter"), t.value
    text, whole = isinstance(v, str), isinstance(v, int) and not isinstance(v, bool)
    if f.base in ("id", "text") and text:
        value: Any = F.lit(v)
    elif f.base == "id" and whole:
        value = F.lit(str(v))
    elif f.base in _LIMITS and whole:
        if not -_LIMITS[f.base] <= v < _LIMITS[f.base]:
            raise UserError(f"{v} doesn't fit field {f.name!r}")
        value = F.lit(v).cast("long")
    elif f.base == "bool" and isinstance(v, bool):
        value = F.lit(v)
    elif f.base in ("date", "datetime") and text:
        value = F.lit(_moment(f, v))
    else:
        raise UserError(f"field {f.name!r} of type {f.type} can't equal {v!r}")
    return _matches(f, lambda c: c == value)


def _moment(f: FieldSpec, v: str) -> Any:
    try:
        if f.base == "date":
            return dt.date.fromisoformat(v)
        return dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
    except ValueError:
        raise UserError(f"{v!r} is no ISO value for field {f.name!r}") from None


def in_range(f: FieldSpec, b: dsl.Bounds) -> Column:
    """Whether a value (of a list: any) lies within the bounds; NaN and infinities lie in no range."""
    if f.base not in ("int", "long", "float", "double", "date", "datetime"):
        raise UserError(f"field {f.name!r} of type {f.type} has no ranges")

    def fit(v: Any) -> Column:
        if f.base in ("date", "datetime"):
            if isinstance(v, (int, float)):
                if f.base == "date":
                    return F.date_add(F.lit(dt.date(1970, 1, 1)), int(v))
                return F.timestamp_millis(F.lit(int(v)))
            if f.base == "date":
                return F.lit(v.date() if isinstance(v, dt.datetime) else v)
            return F.lit(v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day, tzinfo=dt.UTC))
        if not isinstance(v, (int, float)):
            raise UserError(f"{v!r} is no bound for field {f.name!r} of type {f.type}")
        return F.lit(float(v)).cast("float") if f.base == "float" else F.lit(v)

    def test(c: Column) -> Column:
        parts = [getattr(c, op)(fit(v)) for op, v in (("__gt__", b.gt), ("__ge__", b.gte), ("__lt__", b.lt), ("__le__", b.lte)) if v is not None]
        if f.base in ("float", "double"):
            parts += [~F.isnan(c), F.abs(c) != float("inf")]
        return reduce(and_, parts)

    return _matches(f, test)


def _point(m: Mapping, name: str) -> Column:
    f = m.need(name, "filter")
    if f.type != "geopoint":
        raise UserError(f"field {name!r} is not a geopoint")
    return column(name)


def predicate(m: Mapping, p: Any) -> Column:
    """A filter tree as one expression that is true or false, never null."""
    if isinstance(p, dsl.And):
        return reduce(and_, [predicate(m, x) for x in p.of])
    if isinstance(p, dsl.Or):
        return reduce(or_, [predicate(m, x) for x in p.of])
    if isinstance(p, dsl.Not):
        return ~reduce(or_, [predicate(m, x) for x in p.of])
    if isinstance(p, dsl.Term):
        c = term(m, p)
    elif isinstance(p, dsl.Range):
        c = in_range(m.need(p.field, "filter"), p.bounds)
    elif isinstance(p, dsl.GeoDistance):
        c = geo.within(_point(m, p.field), p.lat, p.lon, p.meters)
    elif isinstance(p, dsl.GeoBox):
        c = geo.in_box(_point(m, p.field), p.a, p.b)
    else:
        raise UserError(f"not a filter: {p!r}")
    return F.coalesce(c, F.lit(False))


def filters(m: Mapping, f: dsl.Filters) -> Column | None:
    parts = ([predicate(m, f.include)] if f.include is not None else []) + ([~predicate(m, f.exclude)] if f.exclude is not None else [])
    return reduce(and_, parts) if parts else None
