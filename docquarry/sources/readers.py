"""JSON documents from files, bytes and queues, flattened and typed by a mapping; no schema is ever inferred."""

from __future__ import annotations

import bz2
import gzip
import json
import re
import urllib.request
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.errors import UserError
from docquarry.mapping import FieldSpec, Mapping

_EMBEDDED = "struct<text:string,embedding:array<float>>"


@dataclass(frozen=True)
class Url:
    """Where documents or indexes lie; ``path`` is what Spark reads."""

    scheme: str
    path: str
    settings: tuple[tuple[str, str], ...] = ()


def parse_url(x: str | dict) -> Url:
    """``file:/p``, ``file://p``, ``file:///p``, absolute and relative paths, ``s3://b/p`` or ``{"s3": {...}}``, ``http(s)://``."""
    if isinstance(x, dict):
        s = x.get("s3")
        if not s or "bucket" not in s:
            raise UserError(f"bad location {x!r}")
        # of this bucket only: other locations keep the session's settings
        own = {"endpoint": s.get("endpoint"), "endpoint.region": s.get("region"), "path.style.access": "true" if s.get("endpoint") else None}
        settings = tuple((f"fs.s3a.bucket.{s['bucket']}.{k}", v) for k, v in own.items() if v)
        return Url("s3", f"s3a://{s['bucket']}/{s.get('prefix', '').lstrip('/')}", settings)
    if m := re.match(r"^(https?)://", x):
        return Url(m[1], x)
    if m := re.match(r"^s3a?://([^/]+)/?(.*)$", x):
        return Url("s3", f"s3a://{m[1]}/{m[2]}")
    if x.startswith("file:"):
        return Url("file", "/" + x.removeprefix("file:").lstrip("/"))
    if "://" in x:
        raise UserError(f"unknown kind of location {x!r}")
    return Url("file", x)


def decompress(raw: bytes) -> bytes:
    """By the first bytes: gzip, bzip2, zstandard or as it is."""
    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    if raw[:3] == b"BZh":
        return bz2.decompress(raw)
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return raw


def decode_payload(raw: bytes) -> list[dict]:
    """Documents of a pushed body: one JSON object a line, or a JSON array. An empty body has none."""
    text = decompress(raw).decode().strip()
    if not text:
        return []
    if text[0] == "[":
        docs = json.loads(text)
    elif text[0] == "{":
        try:
            docs = [json.loads(line) for line in text.splitlines() if line.strip()]
        except json.JSONDecodeError:
            docs = [json.loads(text)]
    else:
        raise UserError("documents must be a JSON array or one JSON object a line")
    if not all(isinstance(d, dict) for d in docs):
        raise UserError("every document must be a JSON object")
    return docs


def _lines(spark: SparkSession, url: Url, recursive: bool) -> DataFrame:
    """(value, _order): a JSON object each, and of files where it stands."""
    if url.scheme in ("http", "https"):
        if recursive:
            raise UserError("HTTP locations can't be listed")
        with urllib.request.urlopen(url.path, timeout=60) as r:  # noqa: S310
            return payload_lines(spark, decode_payload(r.read()))
    for k, v in url.settings:
        spark._jsc.hadoopConfiguration().set(k, v)
    if packed := _packed(spark, url.path):
        return _unpacked(spark, packed, recursive)
    reader = spark.read.option("recursiveFileLookup", recursive)
    first = reader.option("wholetext", False).text(url.path).where("trim(value) <> ''").select(F.substring(F.ltrim("value"), 1, 1)).first()
    if first is None:
        return spark.createDataFrame([], "value string")
    # where a line stands: Spark reads larger files first, so the order of rows alone doesn't say
    place = F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_order")
    if first[0] == "{":
        return reader.text(url.path).select("value", place).where("trim(value) <> ''")
    if first[0] == "[":
        whole = reader.option("wholetext", True).text(url.path).select("value", place)
        return whole.select("_order", F.explode(F.from_json("value", "array<variant>")).alias("v")).select(F.to_json("v").alias("value"), "_order")
    raise UserError("documents must be a JSON array or one JSON object a line")


#: Endings by which Spark's own text reader unpacks a file.
_KNOWN = (".gz", ".bz2", ".deflate")


def _packed(spark: SparkSession, path: str) -> str | None:
    """The location, if its first file is packed (by its first bytes) in a way that its name doesn't tell Spark."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    if found is None or not len(found):
        return None
    s = found[0]
    if s.isDirectory():
        files = [x for x in fs.listStatus(s.getPath()) if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
        if not files:
            return None
        s = files[0]
    if s.getPath().getName().endswith(_KNOWN):
        return None
    stream = fs.open(s.getPath())
    try:
        head = bytes(b & 0xFF for b in (stream.read() for _ in range(4)) if b >= 0)
    finally:
        stream.close()
    return path if head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head == b"\x28\xb5\x2f\xfd" else None


def _unpacked(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """(value, _order) of packed files, each unpacked whole by one task, as no other part of it can be read by itself."""
    import pyarrow as pa

    def unpack(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs = decode_payload(raw)
                for k in range(0, len(docs), 4096):
                    part = [json.dumps(d) for d in docs[k : k + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(k, k + len(part)), pa.int64()), pa.array(part)], names=["file", "place", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "content")
    lines = files.mapInArrow(unpack, "file string, place long, value string")
    return lines.select("value", F.struct(F.col("file").alias("file_path"), F.col("place").alias("file_block_start")).alias("_order"))


def payload_lines(spark: SparkSession, docs: list[dict]) -> DataFrame:
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")


def _keys(lines: DataFrame, m: Mapping) -> list[str]:
    """Concrete field names; only wildcards need a look at the documents, for distinct keys."""
    plain = [n for n, f in m.fields.items() if not f.wildcard]
    if len(plain) == len(m.fields):
        return plain
    top = lines.select(F.explode(F.json_object_keys("value")).alias("k")).distinct()
    found = sorted(r["k"] for r in top.collect())
    parents = {f.name.split(".")[0] for f in m.fields.values() if f.wildcard and "." in f.name}
    for p in [p for p in found if p in parents]:
        inner = lines.select(F.explode(F.json_object_keys(F.get_json_object("value", f"$.{p}"))).alias("k")).distinct()
        found += sorted(f"{p}.{r['k']}" for r in inner.collect())
    return plain + [k for k in found if k not in plain and m.resolve(k) is not None]


def _column(f: FieldSpec) -> Column:
    if "." not in f.name:
        return F.col(f"d.`{f.name}`")
    parent, child = f.name.split(".")
    return F.col(f"d.`{parent}`")[child]


def documents(lines: DataFrame, m: Mapping) -> DataFrame:
    """JSON lines as typed, flattened documents: ``_id``, every concrete field, ``<field>__vec`` where texts bring vectors.

    Unknown keys are passed over; a line that is no JSON object is an error; ``""`` and ``[]`` count as absent; a missing id
    becomes a random one. Documents without a required field are an error. A column ``_order`` of the lines is carried along.
    """
    names = _keys(lines, m)
    schema = m.to_struct_type(names)
    semantic = [f for n in names if (f := m.resolve(n)).semantic is not None]
    for f in semantic:
        if "." in f.name:
            raise UserError(f"nested field {f.name!r} can't hold vectors")
    # texts that may bring a vector are read as raw JSON: a string, an object or a list
    raw = {f.name for f in semantic if f.is_list}
    schema = T.StructType([T.StructField(x.name, T.StringType() if x.name in raw else x.dataType) for x in schema])
    carried = [c for c in ("_order",) if c in lines.columns]
    parsed = lines.select(*carried, F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d"))
    out: list[Column] = []
    for n in names:
        f = m.resolve(n)
        c = _column(f)
        if n == "_id":
            out.append(F.coalesce(c, F.uuid()).alias("_id"))
        elif f.semantic is None:
            out.append(_present(c, f).alias(n))
        elif f.is_list:
            given = F.from_json(c, f"struct<text:array<string>,embedding:array<array<float>>>")
            out.append(_present(F.coalesce(F.from_json(c, "array<string>"), given["text"]), f).alias(n))
            out.append(given["embedding"].alias(f"{n}__vec"))
        else:
            given = F.when(c.startswith("{"), F.from_json(c, _EMBEDDED))
            out.append(_present(F.coalesce(given["text"], c), f).alias(n))
            out.append(given["embedding"].alias(f"{n}__vec"))
    docs = parsed.select(*carried, *out)
    required = [n for n in names if m.resolve(n).required]
    if required:
        lacking = [n for n, lacks in docs.agg(*[F.max(F.col(f"`{n}`").isNull()).alias(n.replace(".", "_")) for n in required]).first().asDict().items() if lacks]
        if lacking:
            raise UserError(f"documents lack required fields: {lacking}")
    return docs


def _present(c: Column, f: FieldSpec) -> Column:
    if f.type in ("text", "id"):
        return F.nullif(c, F.lit(""))
    return F.when(F.size(c) > 0, c) if f.is_list else c


def read_files(spark: SparkSession, location: str | dict, m: Mapping, recursive: bool = False) -> DataFrame:
    """Documents of a file, a folder, an object store prefix or an HTTP address."""
    return documents(_lines(spark, parse_url(location), recursive), m)


#: Tables below so many bytes aren't worth spreading.
SPREAD_LEAST = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small Parquet table with its rows on all cores, where its files have fewer row groups than there are cores.

    A row group is read by one task, so a table in one group would keep all but one core idle. Tables of a split for each core or
    more come back as they are, and what is shuffled is less than that.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if not SPREAD_LEAST <= size <= cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df
    import pyarrow.parquet as pq
    from pyarrow import fs

    groups = 0
    for uri in df.inputFiles():
        system, path = fs.FileSystem.from_uri(uri)
        groups += pq.ParquetFile(path, filesystem=system).num_row_groups
        if groups >= cores:
            return df
    return df.repartition(cores)


def kafka_options(topic: str, servers: list[str], offset: str | None = None, options: dict | None = None, now_ms: int | None = None) -> dict[str, str]:
    """Settings of Spark's Kafka source. offset: latest, earliest, ``ts=<ms>``, ``last=<n>[smhd]`` or None (committed, else earliest)."""
    out = {"subscribe": topic, "kafka.bootstrap.servers": ",".join(servers)} | {f"kafka.{k}": str(v) for k, v in (options or {}).items()}
    if offset in ("latest", "earliest"):
        return out | {"startingOffsets": offset}
    if offset is None:
        return out | {"startingOffsets": "earliest"}
    if m := re.fullmatch(r"ts=(\d+)", offset):
        return out | {"startingTimestamp": m[1]}
    if m := re.fullmatch(r"last=(\d+)([smhd])", offset):
        import time

        now = int(time.time() * 1000) if now_ms is None else now_ms
        return out | {"startingTimestamp": str(now - int(m[1]) * {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}[m[2]])}
    raise UserError(f"bad offset {offset!r}")
