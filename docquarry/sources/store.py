"""Index snapshots in any file system that Spark reaches: immutable segments, deletion lists, and numbered manifests.

A version is what its manifest names: segments (documents, and postings of their lexical fields, each file sorted by field and term),
lists of deleted rows, and totals of each lexical field. The postings of the empty term, which no text has, hold texts' lengths. A flush adds one segment and one list at most; nothing is rewritten but by merging.
A manifest is written under a temporary name and renamed to a number that isn't there yet, so readers see the old version or
the new one, and of two writers one is refused. The highest number is the current version.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.errors import UserError
from docquarry.mapping import Mapping
from docquarry.sources.readers import spread

MERGE_POLICIES = ("none", "tiered", "byte_size", "doc_count")
#: Segments beyond which the tiered policy merges, and share of deleted rows beyond which it merges all.
TIER, MOST_DELETED = 10, 0.25


@dataclass(frozen=True)
class FileEntry:
    name: str
    size: int


@dataclass
class Segment:
    """A folder of documents and their postings; ``schema``: of the documents, as JSON."""

    name: str
    docs: int
    size: int
    schema: str


@dataclass
class Manifest:
    """What a version of an index is made of. ``files``: of documents; ``more``: of postings and deletions."""

    mapping: Mapping
    seqnum: int
    files: list[FileEntry] = field(default_factory=list)
    next_seq: int = 0
    batches: dict[str, int] = field(default_factory=dict)
    segments: list[Segment] = field(default_factory=list)
    deletions: list[str] = field(default_factory=list)
    deleted: int = 0
    totals: dict[str, list[int]] = field(default_factory=dict)
    more: list[FileEntry] = field(default_factory=list)

    @property
    def docs(self) -> int:
        return sum(s.docs for s in self.segments) - self.deleted

    def schema(self) -> T.StructType:
        """The columns of all segments."""
        out: dict[str, T.StructField] = {}
        for s in self.segments:
            for f in T.StructType.fromJson(json.loads(s.schema)):
                out.setdefault(f.name, f)
        return T.StructType(list(out.values()))

    def to_json(self) -> str:
        plain = {k: getattr(self, k) for k in ("seqnum", "next_seq", "batches", "deletions", "deleted", "totals")}
        return json.dumps({"mapping": self.mapping.to_json()} | plain | {k: [vars(x) for x in getattr(self, k)] for k in ("files", "more", "segments")})

    @staticmethod
    def from_json(text: str) -> Manifest:
        d = json.loads(text)
        lists = {"files": [FileEntry(**f) for f in d["files"]], "more": [FileEntry(**f) for f in d["more"]], "segments": [Segment(**s) for s in d["segments"]]}
        return Manifest(**(d | lists | {"mapping": Mapping.from_json(d["mapping"])}))


def diff(source: list[FileEntry], target: list[FileEntry] | None) -> list[tuple[str, str]]:
    """(add | delete, file name) that turn the target into the source; a file of another size is copied again, the manifest always."""
    have = {f.name: f.size for f in target or []}
    want = {f.name: f.size for f in source}
    ops = [("add", n) for n, s in want.items() if have.get(n) != s]
    ops += [("delete", n) for n in have if n not in want]
    return [*ops, ("add", "manifest.json")]


class StateClient:
    """Files of one index location, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def files(self, name: str = "") -> list[FileEntry]:
        """All data files below a folder; manifests and hidden files are none."""
        if not self.exists(name):
            return []
        base, out = self._fs.makeQualified(self._path("")).toString().rstrip("/") + "/", []
        it = self._fs.listFiles(self._path(name), True)
        while it.hasNext():
            s = it.next()
            rel = s.getPath().toString().removeprefix(base)
            if not rel.rpartition("/")[2].startswith((".", "_")) and not rel.startswith("manifest-"):
                out.append(FileEntry(rel, s.getLen()))
        return sorted(out, key=lambda f: f.name)

    def folders(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.isDirectory()) if self.exists("") else []

    def read(self, name: str) -> bytes:
        if not self.exists(name):
            raise UserError(f"no file {name!r} in {self.root}")
        s = self._fs.open(self._path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(s))
        finally:
            s.close()

    def create(self, name: str, data: bytes) -> None:
        """A new file, whole or not at all: written beside, then renamed to a name that must be free."""
        beside, target = self._path(f".{uuid.uuid4().hex}.new"), self._path(name)
        s = self._fs.create(beside, True)
        s.write(bytearray(data))
        s.close()
        if self._fs.exists(target) or not self._fs.rename(beside, target):
            self._fs.delete(beside, False)
            raise UserError(f"{name!r} of {self.root} was written by somebody else")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def copy_from(self, other: StateClient, name: str) -> None:
        self._fs.mkdirs(self._path(name).getParent())
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(other._fs, other._path(name), self._fs, self._path(name), False, True, self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the manifests that are there, ascending."""
        if not self.exists(""):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in names if n.startswith("manifest-"))

    def manifest(self, number: int | None = None) -> Manifest | None:
        """The current version's manifest, or that of a given one."""
        have = self.versions()
        if not have:
            return None
        return Manifest.from_json(self.read(f"manifest-{have[-1] if number is None else number}.json").decode())

    def publish(self, m: Manifest) -> None:
        self._fs.mkdirs(self._path(""))
        self.create(f"manifest-{m.seqnum}.json", m.to_json().encode())


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors see: below ``spark.checkpoint.dir``; only where that is unset, on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise UserError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docquarry-")
    return f"{base.rstrip('/')}/docquarry-{uuid.uuid4().hex}"


POSTINGS = T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("_seq", "tf", "n")]])


def documents(client: StateClient, m: Manifest, segments: list[Segment] | None = None) -> DataFrame:
    """Live documents of all segments, or of some."""
    every = client.spark.read.schema(m.schema()).parquet(*[f"{client.root}/{s.name}/docs" for s in segments or m.segments])
    return _live(client, m, every)


def postings(client: StateClient, m: Manifest, segments: list[Segment] | None = None) -> DataFrame:
    """field, term, _seq, tf, n (terms of the document's field), of live documents."""
    return _live(client, m, client.spark.read.schema(POSTINGS).parquet(*[f"{client.root}/{s.name}/terms" for s in segments or m.segments]))


def _live(client: StateClient, m: Manifest, rows: DataFrame) -> DataFrame:
    if not m.deletions:
        return rows
    return rows.join(client.spark.read.schema("_seq long").parquet(*[f"{client.root}/{d}" for d in m.deletions]), "_seq", "left_anti")


def lengths(rows: DataFrame) -> DataFrame:
    """Of postings those that tell how many terms (n) a document's field has."""
    return rows.where(F.col("term") == "")


#: Terms of documents that are counted at once.
AT_ONCE = 2_000_000


def runs(docs: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """Postings of documents' fields (``terms``: field -> its terms). Those of the documents that a task reads are counted and sorted
    by that task, so that nothing is shuffled: a term's postings lie in as many places as tasks read the documents."""
    at_once = AT_ONCE

    def counted(batches):
        """Of some documents at a time: a row for each term, with its documents by ``_seq``, and one of the empty term for lengths."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def lists(kind, offsets, values):
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

        def pieces(b):
            # here and not before: Spark would analyse texts once for the condition and once for the terms
            b = b.filter(pc.greater(pc.list_value_length(b.column(1)), 0))
            ends = np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(ends):
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, "right")))
                yield b.slice(start, end - start)
                start = end

        for b in (p for whole in batches for p in pieces(whole)):
            seq, words = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            n = words.value_lengths().to_numpy(zero_copy_only=False)
            order = np.argsort(seq, kind="stable")
            place = np.empty(len(seq), np.int64)
            place[order] = np.arange(len(seq))
            seq, sizes = seq[order], n[order]
            coded = words.flatten().dictionary_encode()
            # a number for each term and document: unique ones come out sorted by both
            key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(seq) + np.repeat(place, n)
            key, tf = np.unique(key, return_counts=True)
            doc, starts = key % len(seq), np.searchsorted(key, np.arange(len(coded.dictionary) + 1) * len(seq))
            for found, offsets, at, times in ((pa.array([""], coded.dictionary.type), [0, len(seq)], slice(None), sizes), (coded.dictionary, starts, doc, tf)):
                columns = [found, lists(pa.int64(), offsets, seq[at]), lists(pa.int32(), offsets, times), lists(pa.int32(), offsets, sizes[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "seqs", "tfs", "ns"])

    parts = []
    for name, column in terms.items():
        lists = docs.select("_seq", column.alias("terms")).mapInArrow(counted, "term string, seqs array<long>, tfs array<int>, ns array<int>").sortWithinPartitions("term", F.col("seqs")[0])
        each = lists.select("term", "tfs", "ns", F.posexplode("seqs").alias("p", "_seq"))
        parts.append(each.select(F.lit(name).alias("field"), "term", "_seq", F.col("tfs")[F.col("p")].cast("long").alias("tf"), F.col("ns")[F.col("p")].cast("long").alias("n")))
    return reduce(DataFrame.union, parts)


def add_postings(client: StateClient, name: str, docs: DataFrame, terms: dict[str, Column]) -> Segment:
    """A new segment whose documents have been written; their postings are written beside."""
    rows = runs(spread(docs), terms) if terms else client.spark.createDataFrame([], POSTINGS)
    rows.write.parquet(f"{client.root}/{name}/terms")
    return Segment(name, docs.count(), sum(f.size for f in client.files(f"{name}/docs")), docs.schema.json())


def write_segment(client: StateClient, docs: DataFrame, terms: DataFrame, files: int | None = None) -> Segment:
    """A new segment of what others had. ``terms``: postings, sorted here by field and term, so that a reader takes the row groups of its terms only."""
    name = f"seg-{uuid.uuid4().hex}"
    (docs.coalesce(files) if files else docs).write.parquet(f"{client.root}/{name}/docs")
    keys = ("field", "term", "_seq")
    (terms.coalesce(files).sortWithinPartitions(*keys) if files else terms.repartitionByRange(*keys).sortWithinPartitions(*keys)).write.parquet(f"{client.root}/{name}/terms")
    back = client.spark.read.schema(docs.schema).parquet(f"{client.root}/{name}/docs")
    return Segment(name, back.count(), sum(f.size for f in client.files(f"{name}/docs")), docs.schema.json())


def listed(client: StateClient, m: Manifest, old: Manifest | None) -> Manifest:
    """``m`` with its files: those known from before, and those of new folders."""
    known = {f.name: f for f in [*old.files, *old.more]} if old else {}
    want = [*[f"{s.name}/docs" for s in m.segments], *[f"{s.name}/terms" for s in m.segments], *m.deletions]
    m.files, m.more = [], []
    for folder in want:
        own = [f for n, f in known.items() if n.startswith(folder + "/")] or client.files(folder)
        (m.files if folder.endswith("/docs") else m.more).extend(own)
    return m


def sweep(client: StateClient, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions, and folders that none of these names (a failed flush leaves such)."""
    have = client.versions()
    named = {f.name.split("/")[0] for v in have[-keep:] for m in [client.manifest(v)] for f in [*m.files, *m.more]}
    named |= {s.name for v in have[-keep:] for s in client.manifest(v).segments}
    for v in have[:-keep]:
        client.delete(f"manifest-{v}.json")
    for folder in client.folders():
        if folder.startswith(("seg-", "del-")) and folder not in named:
            client.delete(folder)


def replicate(source: StateClient, target: StateClient) -> list[tuple[str, str]]:
    """Bring the target to the source's current version; the manifest is written last but for deletions."""
    m = source.manifest()
    if m is None:
        raise UserError(f"no index in {source.root}")
    old = target.manifest()
    ops = diff([*m.files, *m.more], [*old.files, *old.more] if old else None)
    for op, name in ops:
        if op == "add" and name != "manifest.json":
            target.copy_from(source, name)
    if old is None or old.seqnum < m.seqnum:
        target.publish(m)
    for op, name in ops:
        if op == "delete":
            target.delete(name)
    return ops


def _policy(policy: dict | str | None) -> tuple[str, dict]:
    kind, spec = next(iter((policy or {"tiered": {}}).items())) if isinstance(policy, dict) or not policy else (policy, {})
    if kind not in MERGE_POLICIES:
        raise UserError(f"unknown merge policy {kind!r}")
    return kind, spec or {}


def merge_files(docs_bytes: int, n_docs: int, policy: dict | None) -> int | None:
    """How many files a merge policy leaves; None: as written."""
    kind, spec = _policy(policy)
    if kind == "byte_size":
        return max(1, -(-docs_bytes // int(spec.get("max_merge_size", 512 << 20))))
    if kind == "doc_count":
        return max(1, -(-n_docs // int(spec.get("max_merge_docs", 10_000_000))))
    return None


def to_merge(m: Manifest, policy: dict | str | None) -> list[Segment]:
    """Segments that a policy merges into one after a flush; all of them, where many rows are deleted.

    ``tiered``: the smallest ones, once there are more than ``TIER``. ``byte_size`` and ``doc_count``: the smallest ones that
    together stay below the policy's size, once there are more than ``TIER`` of them.
    """
    kind, spec = _policy(policy)
    if kind == "none" or not m.segments:
        return []
    if m.deleted > MOST_DELETED * sum(s.docs for s in m.segments):
        return m.segments
    small, total = [], 0
    for s in sorted(m.segments, key=lambda s: (s.docs, s.name)):
        total += s.size if kind == "byte_size" else s.docs
        most = {"byte_size": int(spec.get("max_merge_size", 512 << 20)), "doc_count": int(spec.get("max_merge_docs", 10_000_000))}.get(kind)
        if most is not None and total > most:
            break
        small.append(s)
    return small[:TIER] if len(small) > TIER else []
