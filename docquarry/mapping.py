"""Declared document schemas: fields, their types and flags, names with wildcards and one level of nesting, migration."""

from __future__ import annotations

import fnmatch
import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from docquarry.errors import UserError

GEO = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
_SCALAR = {
    "id": T.StringType(), "text": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "bool": T.BooleanType(), "geopoint": GEO, "date": T.DateType(), "datetime": T.TimestampType(),
}
LISTS = ("text[]", "int[]", "long[]", "float[]", "double[]")
TYPES = (*_SCALAR, *LISTS)
NUMERIC = ("int", "long", "float", "double")
_ALIASES = {"string": "text", "string[]": "text[]", "boolean": "bool", "integer": "int"}
_NAME = re.compile(r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)?$|^[A-Za-z0-9_]*\*[A-Za-z0-9_]*$|^[A-Za-z0-9_]+\.[A-Za-z0-9_]*\*[A-Za-z0-9_]*$")
DISTANCES, QUANTIZERS = ("dot", "cosine"), ("float32", "int8", "int4", "int1")


@dataclass(frozen=True)
class Semantic:
    model: str | None = None
    dim: int | None = None
    distance: str = "dot"
    quantize: str = "float32"
    ef: int = 32
    m: int = 16
    workers: int | None = None


@dataclass(frozen=True)
class Suggest:
    analyze: str = "generic"
    expand: tuple[int, int] | None = (1, 3)


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str
    store: bool = True
    sort: bool = False
    facet: bool = False
    filter: bool = False
    required: bool = False
    lexical: str | None = None
    semantic: Semantic | None = None
    suggest: Suggest | None = None

    @property
    def is_list(self) -> bool:
        return self.type.endswith("[]")

    @property
    def base(self) -> str:
        return self.type.removesuffix("[]")

    def spark_type(self) -> T.DataType:
        return T.ArrayType(_SCALAR[self.base]) if self.is_list else _SCALAR[self.type]

    @property
    def wildcard(self) -> bool:
        return "*" in self.name


ID = FieldSpec("_id", "id", store=True, filter=True)


def _flag(spec: dict, key: str, default: bool) -> bool:
    value = spec.get(key, default)
    if not isinstance(value, bool):
        raise UserError(f"{key} must be true or false, not {value!r}")
    return value


def _semantic(spec: dict) -> Semantic:
    unknown = set(spec) - {"model", "dim", "ef", "m", "workers", "quantize", "distance"}
    if unknown:
        raise UserError(f"unknown settings of semantic search: {sorted(unknown)}")
    if not spec.get("model") and not spec.get("dim"):
        raise UserError("semantic search needs a model or a number of dimensions")
    s = Semantic(**spec)
    if s.distance not in DISTANCES or s.quantize not in QUANTIZERS or (s.dim or 1) > 8192:
        raise UserError("unsupported distance, quantisation or number of dimensions")
    return s


def parse_field(name: str, spec: dict) -> FieldSpec:
    """One field of a mapping from its declaration."""
    if not _NAME.match(name):
        raise UserError(f"bad field name {name!r}")
    kind = _ALIASES.get(spec.get("type", ""), spec.get("type", ""))
    if kind not in TYPES:
        raise UserError(f"field {name!r} has unknown type {spec.get('type')!r}")
    known = {"type", "store", "sort", "facet", "filter", "required", "search", "suggest"}
    if set(spec) - known:
        raise UserError(f"field {name!r} has unknown settings {sorted(set(spec) - known)}")
    if name == "_id":
        return ID
    text = kind in ("text", "text[]")
    f = FieldSpec(name, kind, **{k: _flag(spec, k, d) for k, d in (("store", True), ("sort", False), ("facet", False), ("filter", False), ("required", False))})
    if f.sort and f.is_list and not text:
        raise UserError(f"list field {name!r} can't be sorted by")
    if f.facet and kind in ("id", "geopoint"):
        raise UserError(f"field {name!r} of type {kind} has no facets")
    search = spec.get("search") or {}
    if search is not False and search:
        if not text:
            raise UserError(f"field {name!r} is not a text field and can't be searched")
        if set(search) - {"lexical", "semantic"}:
            raise UserError(f"field {name!r} has unknown kinds of search")
        if "lexical" in search:
            f = replace(f, lexical=(search["lexical"] or {}).get("analyze", "generic"))
        if "semantic" in search:
            f = replace(f, semantic=_semantic(dict(search["semantic"] or {})))
    suggest = spec.get("suggest")
    if suggest:
        if not text:
            raise UserError(f"field {name!r} is not a text field and gives no suggestions")
        s = {} if suggest is True else suggest
        e = s.get("expand", {})
        f = replace(f, suggest=Suggest(s.get("analyze", "generic"), None if e is None or e is False else (e.get("min-terms", 1), e.get("max-terms", 3))))
    return f


@dataclass(frozen=True)
class Mapping:
    """An index's name, aliases and fields; ``_id`` is always there."""

    name: str
    fields: dict[str, FieldSpec]
    aliases: tuple[str, ...] = ()
    config: dict = field(default_factory=dict)
    store: dict = field(default_factory=dict)

    @staticmethod
    def parse(name: str, spec: dict) -> Mapping:
        if set(spec) - {"alias", "config", "store", "fields"}:
            raise UserError(f"unknown settings {sorted(set(spec) - {'alias', 'config', 'store', 'fields'})} of index {name!r}")
        fields = {n: parse_field(n, s) for n, s in (spec.get("fields") or {}).items()}
        if not fields:
            raise UserError(f"index {name!r} has no fields")
        for w in (f.name for f in fields.values() if f.wildcard):
            clash = [n for n in fields if n != w and "*" not in n and fnmatch.fnmatchcase(n, w)]
            if clash:
                raise UserError(f"fields {clash} also match the wildcard {w!r}")
        alias = spec.get("alias") or ()
        return Mapping(name, {"_id": ID} | fields, (alias,) if isinstance(alias, str) else tuple(alias), spec.get("config") or {}, spec.get("store") or {})

    def answers_to(self, name: str) -> bool:
        return name == self.name or name in self.aliases

    def resolve(self, name: str) -> FieldSpec | None:
        """The field a concrete name belongs to, by itself or by a wildcard."""
        if (f := self.fields.get(name)) is not None:
            return f
        for f in self.fields.values():
            if f.wildcard and fnmatch.fnmatchcase(name, f.name) and ("." in name) == ("." in f.name):
                return replace(f, name=name)
        return None

    def need(self, name: str, flag: str) -> FieldSpec:
        """The field, which must exist and have the flag."""
        f = self.resolve(name)
        if f is None:
            raise UserError(f"field {name!r} is not in the mapping of {self.name!r}")
        if not getattr(f, flag):
            raise UserError(f"field {name!r} is not declared with '{flag}: true'")
        return f

    def expand(self, names: list[str], present: list[str]) -> list[str]:
        """Names and wildcards -> concrete names among those present, in order of first mention."""
        out: list[str] = []
        for n in names:
            out += [p for p in ([n] if n in present else [p for p in present if "*" in n and fnmatch.fnmatchcase(p, n)]) if p not in out]
        return out

    def to_struct_type(self, concrete: list[str] | None = None) -> T.StructType:
        """The schema of JSON documents with these fields: nested names become structs, lists of structs are told apart by type."""
        out: dict[str, T.DataType] = {}
        parents: dict[str, list[FieldSpec]] = {}
        for f in [f for n in (concrete or self.fields) if (f := self.resolve(n)) and not f.wildcard]:
            if "." in f.name:
                parents.setdefault(f.name.split(".")[0], []).append(f)
            else:
                out[f.name] = f.spark_type()
        for p, fs in parents.items():
            many = any(f.is_list for f in fs)
            inner = T.StructType([T.StructField(f.name.split(".")[1], _SCALAR[f.base]) for f in fs])
            out[p] = T.ArrayType(inner) if many else inner
        return T.StructType([T.StructField(n, t) for n, t in out.items()])

    def migrate(self, new: Mapping) -> Mapping:
        """The new mapping, if the old one's documents can be read under it."""
        free = ("int", "long", "text", "text[]")
        for n, f in new.fields.items():
            old = self.fields.get(n)
            if old is None or old == f or (old.type == f.type and f.type in free) or (old.type == "text" and f.type == "id"):
                continue
            raise UserError(f"field {n!r} can't go from {old.type} to {f.type}, or its settings can't change")
        return new

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "aliases": list(self.aliases), "config": self.config, "store": self.store, "fields": [asdict(f) for f in self.fields.values()]})

    @staticmethod
    def from_json(text: str) -> Mapping:
        d = json.loads(text)
        fields = {}
        for f in d["fields"]:
            f["semantic"] = Semantic(**f["semantic"]) if f["semantic"] else None
            s = f["suggest"]
            f["suggest"] = Suggest(s["analyze"], tuple(s["expand"]) if s["expand"] else None) if s else None
            fields[f["name"]] = FieldSpec(**f)
        return Mapping(d["name"], fields, tuple(d["aliases"]), d["config"], d["store"])
