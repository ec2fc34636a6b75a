"""The request language: strict parsing of JSON objects into dataclasses. Unknown keys and types are errors."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from typing import Any

from docquarry.errors import UserError
from docquarry.functions.geo import meters


# ---- queries -------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class MatchAll:
    pass


@dataclass(frozen=True)
class Match:
    field: str
    query: str
    operator: str = "or"


@dataclass(frozen=True)
class MultiMatch:
    query: str
    fields: tuple[str, ...]
    kind: str = "best_fields"
    tie: float = 0.0


@dataclass(frozen=True)
class Bool:
    should: tuple = ()
    must: tuple = ()
    must_not: tuple = ()


@dataclass(frozen=True)
class DisMax:
    queries: tuple
    tie: float = 0.0


@dataclass(frozen=True)
class Knn:
    field: str
    vector: tuple[float, ...]
    k: int | None = None
    candidates: int | None = None


@dataclass(frozen=True)
class Semantic:
    field: str
    query: str
    k: int | None = None
    candidates: int | None = None


@dataclass(frozen=True)
class Rrf:
    retrieve: tuple
    k: float = 60.0
    window: int | None = None


@dataclass(frozen=True)
class CrossEncoder:
    model: str
    query: str
    retrieve: Any
    template: str
    window: int | None = None


# ---- filters -------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class And:
    of: tuple


@dataclass(frozen=True)
class Or:
    of: tuple


@dataclass(frozen=True)
class Not:
    of: tuple


@dataclass(frozen=True)
class Term:
    field: str
    value: Any


@dataclass(frozen=True)
class Bounds:
    gt: Any = None
    gte: Any = None
    lt: Any = None
    lte: Any = None


@dataclass(frozen=True)
class Range:
    field: str
    bounds: Bounds


@dataclass(frozen=True)
class GeoDistance:
    field: str
    lat: float
    lon: float
    meters: float


@dataclass(frozen=True)
class GeoBox:
    field: str
    a: tuple[float, float]
    b: tuple[float, float]


@dataclass(frozen=True)
class Filters:
    include: Any = None
    exclude: Any = None


# ---- the rest of a request -----------------------------------------------------------------------------------------
@dataclass(frozen=True)
class TermAgg:
    field: str
    size: int | None = 10  # None: all


@dataclass(frozen=True)
class RangeAgg:
    field: str
    ranges: tuple[Bounds, ...]


@dataclass(frozen=True)
class SortBy:
    field: str
    ascending: bool = True
    missing_first: bool = False
    origin: tuple[float, float] | None = None


@dataclass(frozen=True)
class Rag:
    prompt: str
    model: str
    fields: tuple[str, ...] = ()
    top_docs: int = 10
    max_doc_length: int = 128
    max_response_length: int = 64
    stream: bool = False


@dataclass(frozen=True)
class SearchRequest:
    query: Any = field(default_factory=MatchAll)
    filters: Filters = field(default_factory=Filters)
    size: int = 10
    fields: tuple[str, ...] = ("_id", "_score")
    aggs: dict[str, Any] = field(default_factory=dict)
    sort: tuple[SortBy, ...] = ()
    rag: Rag | None = None


@dataclass(frozen=True)
class SuggestRequest:
    query: str
    fields: tuple[str, ...]
    count: int = 10
    depth: int = 50
    scale: float = 60.0


#: Most neighbours and ranks that a query may ask for: such lists go to all executors, so larger ones are refused.
MOST_CANDIDATES = 10_000


def _object(x: Any, what: str, allowed: set[str], needed: tuple[str, ...] = ()) -> dict:
    if not isinstance(x, dict):
        raise UserError(f"{what} must be an object")
    if set(x) - allowed:
        raise UserError(f"{what} has unknown keys {sorted(set(x) - allowed)}")
    if missing := [n for n in needed if n not in x]:
        raise UserError(f"{what} lacks {missing}")
    return x


def _one(x: Any, what: str) -> tuple[str, Any]:
    if not isinstance(x, dict) or len(x) != 1:
        raise UserError(f"{what} must be an object with exactly one key")
    return next(iter(x.items()))


def _count(x: Any, what: str, least: int = 1) -> int:
    if not isinstance(x, int) or isinstance(x, bool) or x < least:
        raise UserError(f"{what} must be a whole number of at least {least}")
    return x


def _bounded(x: Any, what: str) -> int:
    if _count(x, what) > MOST_CANDIDATES:
        raise UserError(f"{what} can't be more than {MOST_CANDIDATES}")
    return x


def _text(x: Any, what: str) -> str:
    if not isinstance(x, str):
        raise UserError(f"{what} must be a string")
    return x


def _many(x: Any, what: str, least: int = 1) -> list:
    if not isinstance(x, list) or len(x) < least:
        raise UserError(f"{what} must be a list of at least {least}")
    return x


def _neighbours(d: dict) -> dict:
    return {"k": None if d.get("k") is None else _bounded(d["k"], "k"), "candidates": None if d.get("num_candidates") is None else _bounded(d["num_candidates"], "num_candidates")}


def parse_query(x: Any) -> Any:
    kind, d = _one(x, "a query")
    if kind == "match_all":
        _object(d, kind, set())
        return MatchAll()
    if kind == "match":
        name, q = _one(d, kind)
        if isinstance(q, str):
            return Match(name, q)
        q = _object(q, kind, {"query", "operator"}, ("query",))
        op = str(q.get("operator", "or")).lower()
        if op not in ("or", "and"):
            raise UserError(f"unknown operator {op!r}")
        return Match(name, _text(q["query"], "query"), op)
    if kind == "multi_match":
        d = _object(d, kind, {"query", "fields", "type", "tie_breaker"}, ("query", "fields"))
        how = d.get("type", "best_fields")
        if how not in ("best_fields", "most_fields"):
            raise UserError(f"unknown type {how!r} of multi_match")
        return MultiMatch(_text(d["query"], "query"), tuple(_many(d["fields"], "fields")), how, float(d.get("tie_breaker") or 0.0))
    if kind == "bool":
        d = _object(d, kind, {"should", "must", "must_not"})
        b = Bool(*(tuple(parse_query(q) for q in _many(d.get(c, []), c, 0)) for c in ("should", "must", "must_not")))
        if not (b.should or b.must or b.must_not):
            raise UserError("bool needs at least one clause")
        return b
    if kind == "dis_max":
        d = _object(d, kind, {"queries", "tie_breaker"}, ("queries",))
        return DisMax(tuple(parse_query(q) for q in _many(d["queries"], "queries", 2)), float(d.get("tie_breaker") or 0.0))
    if kind == "knn":
        d = _object(d, kind, {"field", "query_vector", "k", "num_candidates"}, ("field", "query_vector"))
        return Knn(_text(d["field"], "field"), tuple(float(v) for v in _many(d["query_vector"], "query_vector")), **_neighbours(d))
    if kind == "semantic":
        if isinstance(d, dict) and len(d) == 1 and isinstance(next(iter(d.values())), str):
            return Semantic(*next(iter(d.items())))
        d = _object(d, kind, {"field", "query", "k", "num_candidates"}, ("field", "query"))
        return Semantic(_text(d["field"], "field"), _text(d["query"], "query"), **_neighbours(d))
    if kind == "rrf":
        d = _object(d, kind, {"retrieve", "k", "rank_window_size"}, ("retrieve",))
        w = d.get("rank_window_size")
        return Rrf(tuple(parse_query(q) for q in _many(d["retrieve"], "retrieve")), float(d.get("k", 60.0)), None if w is None else _bounded(w, "rank_window_size"))
    if kind == "cross_encoder":
        d = _object(d, kind, {"model", "query", "retrieve", "doc_template", "rank_window_size"}, ("model", "query", "retrieve", "doc_template"))
        w = d.get("rank_window_size")
        return CrossEncoder(d["model"], _text(d["query"], "query"), parse_query(d["retrieve"]), _text(d["doc_template"], "doc_template"), None if w is None else _bounded(w, "rank_window_size"))
    raise UserError(f"unknown query type {kind!r}")


def _bound(x: Any) -> Any:
    """A number, or an ISO date or date and time."""
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        raise UserError(f"bad bound {x!r}")
    if isinstance(x, str):
        try:
            return dt.date.fromisoformat(x) if len(x) == 10 else dt.datetime.fromisoformat(x.replace("Z", "+00:00"))
        except ValueError:
            raise UserError(f"bound {x!r} is neither a number nor an ISO date") from None
    return x


def parse_bounds(d: dict) -> Bounds:
    d = _object(d, "a range", {"gt", "gte", "lt", "lte"})
    if not d or ("gt" in d and "gte" in d) or ("lt" in d and "lte" in d):
        raise UserError("a range needs a bound, and at most one on each side")
    return Bounds(**{k: _bound(v) for k, v in d.items()})


def parse_filter(x: Any) -> Any:
    kind, d = _one(x, "a filter")
    if kind in ("and", "or", "not"):
        return {"and": And, "or": Or, "not": Not}[kind](tuple(parse_filter(f) for f in (_many(d, kind) if isinstance(d, list) else [d])))
    if kind == "term":
        name, value = _one(d, kind)
        if not isinstance(value, (str, bool, int)):
            raise UserError(f"a term must be a string, a Boolean or a whole number, not {value!r}")
        return Term(name, value)
    if kind == "range":
        name, b = _one(d, kind)
        return Range(name, parse_bounds(b))
    if kind == "geo_distance":
        d = _object(d, kind, {"field", "lat", "lon", "distance"}, ("field", "lat", "lon", "distance"))
        return GeoDistance(d["field"], float(d["lat"]), float(d["lon"]), meters(d["distance"]))
    if kind == "geo_box":
        d = _object(d, kind, {"field", "top_left", "bottom_right"}, ("field", "top_left", "bottom_right"))
        corner = lambda c: (float(c["lat"]), float(c["lon"]))
        return GeoBox(d["field"], corner(d["top_left"]), corner(d["bottom_right"]))
    raise UserError(f"unknown filter {kind!r}")


def parse_aggs(x: dict) -> dict[str, Any]:
    out = {}
    for name, a in _object(x, "aggs", set(x)).items():
        kind, d = _one(a, f"aggregation {name!r}")
        if kind == "term":
            d = _object(d, kind, {"field", "size"}, ("field",))
            size = d.get("size", 10)
            out[name] = TermAgg(d["field"], None if size == "all" else _count(size, "size"))
        elif kind == "range":
            d = _object(d, kind, {"field", "ranges"}, ("field", "ranges"))
            out[name] = RangeAgg(d["field"], tuple(parse_bounds(r) for r in _many(d["ranges"], "ranges")))
        else:
            raise UserError(f"unknown aggregation {kind!r}")
    return out


def parse_sort(x: Any) -> SortBy:
    if isinstance(x, str):
        return SortBy(x, ascending=x != "_score")
    name, d = _one(x, "a sort key")
    if isinstance(d, str):
        d = {"order": d}
    if "lat" in d or "lon" in d:
        d = _object(d, "a distance sort", {"lat", "lon"}, ("lat", "lon"))
        return SortBy(name, origin=(float(d["lat"]), float(d["lon"])))
    d = _object(d, "a sort key", {"order", "missing"})
    order, missing = d.get("order", "desc" if name == "_score" else "asc"), d.get("missing", "last")
    if order not in ("asc", "desc") or missing not in ("first", "last"):
        raise UserError(f"bad order {order!r} or missing {missing!r}")
    return SortBy(name, order == "asc", missing == "first")


def _rag(d: dict) -> Rag:
    d = _object(d, "rag", {"prompt", "model", "fields", "topDocs", "maxDocLength", "maxResponseLength", "stream"}, ("prompt", "model"))
    return Rag(d["prompt"], d["model"], tuple(d.get("fields", ())), d.get("topDocs", 10), d.get("maxDocLength", 128), d.get("maxResponseLength", 64), d.get("stream", False))


def parse_search(x: dict | None) -> SearchRequest:
    d = _object(x or {}, "a search request", {"query", "filters", "size", "fields", "aggs", "sort", "rag"})
    f = _object(d.get("filters") or {}, "filters", {"include", "exclude"})
    sort = d.get("sort") or []
    return SearchRequest(
        parse_query(d["query"]) if d.get("query") else MatchAll(),
        Filters(*(parse_filter(f[k]) if f.get(k) else None for k in ("include", "exclude"))),
        _count(d.get("size", 10), "size", 0),
        tuple(d.get("fields") or ("_id", "_score")),
        parse_aggs(d.get("aggs") or {}),
        tuple(parse_sort(s) for s in (sort if isinstance(sort, list) else [sort])),
        _rag(d["rag"]) if d.get("rag") else None,
    )


def parse_suggest(x: dict) -> SuggestRequest:
    d = _object(x, "a suggest request", {"query", "fields", "count", "rerank"}, ("query", "fields"))
    kind, r = _one(d.get("rerank") or {"rrf": {}}, "rerank")
    if kind != "rrf":
        raise UserError(f"suggestions can't be ranked by {kind!r}")
    r = _object(r, "rrf", {"depth", "scale"})
    return SuggestRequest(_text(d["query"], "query"), tuple(_many(d["fields"], "fields")), _count(d.get("count", 10), "count"), int(r.get("depth", 50)), float(r.get("scale", 60.0)))


def normalize(r: SearchRequest) -> SearchRequest:
    """Top-level neighbours take k from the size; windows default to it; fusion can't be sorted by fields."""

    def windows(q: Any) -> Any:
        if isinstance(q, Rrf):
            return replace(q, window=q.window or _bounded(max(r.size, 1), "size"), retrieve=tuple(windows(c) for c in q.retrieve))
        if isinstance(q, CrossEncoder):
            return replace(q, window=q.window or _bounded(max(r.size, 1), "size"), retrieve=windows(q.retrieve))
        return q

    q = windows(r.query)
    if isinstance(q, (Knn, Semantic)) and q.k is None:
        q = replace(q, k=_bounded(max(r.size, 1), "size"))
    if r.sort and isinstance(q, (Rrf, CrossEncoder)):
        raise UserError("reranked results can't be sorted by fields")
    return replace(r, query=q)
