r"""Token-id files: patched frame-of-reference blocks with an index of block starts and of documents.

Layout (little-endian)::

    "DQTK" version:u32 block:u32 | blocks | block index | document index | footer

    block           minimum:u32 width:u8 pad:u8 n_exceptions:u16 | packed values | positions:u16 x e | overflow:u32 x e
    block index     start:u64 x (blocks + 1)
    document index  doc_id:i64 x docs, flags:u8 x docs (1: null id), first token:u64 x (docs + 1)
    footer          blocks:u64 docs:u64 tokens:u64 block_index_at:u64 doc_index_at:u64 "DQTK"

A block holds 1,024 values (the last is padded). Its minimum is taken off; the width is that of the 95th percentile of what
is left, unless some other width makes the block smaller; higher bits of larger values go to the exception list. Values lie in
32 lanes, so packing and unpacking are 32 vector steps over all blocks of equal width.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.bpe import word_encoder
from docquarry.llm.common import local_file, send_file, shared_dir, ship, written

MAGIC, VERSION, BLOCK, LANES = b"DQTK", 1, 1024, 32
ROWS = BLOCK // LANES
PERCENTILE = 95
_HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("pad", "u1"), ("n", "<u2")])
_FLUSH = 256 * BLOCK


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned integers below 2**53."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """(blocks, 1024) values below 2**w -> (blocks, 32 * w) words."""
    v = v.reshape(-1, ROWS, LANES).astype(np.uint32)
    out = np.zeros((len(v), w, LANES), np.uint32)
    for r in range(ROWS if w else 0):
        word, off = divmod(r * w, 32)
        out[:, word] |= v[:, r] << np.uint32(off)
        if off + w > 32:
            out[:, word + 1] |= v[:, r] >> np.uint32(32 - off)
    return out.reshape(len(v), -1)


def _unpack(p: np.ndarray, w: int) -> np.ndarray:
    p = p.reshape(-1, w, LANES)
    out = np.zeros((len(p), ROWS, LANES), np.uint32)
    mask = np.uint32((1 << w) - 1)
    for r in range(ROWS if w else 0):
        word, off = divmod(r * w, 32)
        x = p[:, word] >> np.uint32(off)
        if off + w > 32:
            x = x | (p[:, word + 1] << np.uint32(32 - off))
        out[:, r] = x & mask
    return out.reshape(-1, BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of a multiple of 1,024 ids."""
    v = ids.astype(np.uint32).reshape(-1, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    bits = _bits(v)
    width = np.percentile(bits, PERCENTILE, axis=1, method="higher").astype(np.int64)
    top = bits.max(axis=1)
    # an exception costs 6 bytes, a bit of width 128: no exceptions where they would cost more
    over = (bits > width[:, None]).sum(axis=1)
    width = np.where(over * 6 >= (top - width) * BLOCK // 8, top, width)
    out: list[bytes] = [b""] * len(v)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        packed = _pack(v[at] & np.uint32((1 << w) - 1), w)
        for k, i in enumerate(at.tolist()):
            ex = np.flatnonzero(bits[i] > w)
            head = np.array([(low[i], w, 0, len(ex))], _HEAD).tobytes()
            out[i] = head + packed[k].tobytes() + ex.astype("<u2").tobytes() + (v[i, ex] >> np.uint32(w)).astype("<u4").tobytes()
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """Ids of blocks, in order."""
    heads = [np.frombuffer(b, _HEAD, 1)[0] for b in blocks]
    out = np.empty((len(blocks), BLOCK), np.uint32)
    widths = np.array([int(h["width"]) for h in heads], np.int64)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        words = np.frombuffer(b"".join(blocks[i][8 : 8 + 4 * LANES * w] for i in at.tolist()), "<u4")
        out[at] = _unpack(words, w) if w else 0
    for i, h in enumerate(heads):
        if n := int(h["n"]):
            base = 8 + 4 * LANES * int(h["width"])
            pos = np.frombuffer(blocks[i], "<u2", n, base)
            out[i, pos] |= np.frombuffer(blocks[i], "<u4", n, base + 2 * n) << np.uint32(h["width"])
        out[i] += h["minimum"]
    return out.ravel()


class Writer:
    """Streams documents into one file; holds at most a flush of ids and 17 bytes a document."""

    def __init__(self, sink):
        self.sink, self.at, self.starts = sink, 12, []
        self.buffer: list[np.ndarray] = []
        self.buffered = self.tokens = 0
        self.docs: list[int | None] = []
        self.first: list[int] = []
        sink.write(MAGIC + struct.pack("<II", VERSION, BLOCK))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.first.append(self.tokens)
        self.tokens += len(ids)
        self.buffer.append(ids)
        self.buffered += len(ids)
        if self.buffered >= _FLUSH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.buffer) if self.buffer else np.empty(0, np.uint32)
        n = len(ids) // BLOCK * BLOCK
        rest = ids[n:]
        if last and len(rest):
            ids, n, rest = np.concatenate([ids, np.full(BLOCK - len(rest), rest[0], np.uint32)]), n + BLOCK, ids[:0]
        for k in range(0, n, _FLUSH):
            for b in encode_blocks(ids[k : min(n, k + _FLUSH)]):
                self.starts.append(self.at)
                self.sink.write(b)
                self.at += len(b)
        self.buffer, self.buffered = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        index_at = self.at
        index = np.array([*self.starts, self.at], "<u8").tobytes()
        docs = (
            np.array([d or 0 for d in self.docs], "<i8").tobytes()
            + np.array([d is None for d in self.docs], "u1").tobytes()
            + np.array([*self.first, self.tokens], "<u8").tobytes()
        )
        self.sink.write(index + docs + struct.pack("<QQQQQ", len(self.starts), len(self.docs), self.tokens, index_at, index_at + len(index)) + MAGIC)


class Reader:
    """Reads any run of tokens by the block index."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - 44)
        tail = source.read(44)
        if tail[-4:] != MAGIC:
            raise ValueError("not a token file")
        self.n_blocks, self.n_docs, self.n_tokens, index_at, docs_at = struct.unpack("<QQQQQ", tail[:40])
        source.seek(index_at)
        self.starts = np.frombuffer(source.read(8 * (self.n_blocks + 1)), "<u8").astype(np.int64)
        source.seek(docs_at)
        raw = source.read(9 * self.n_docs + 8 * (self.n_docs + 1))
        ids, null = np.frombuffer(raw, "<i8", self.n_docs), np.frombuffer(raw, "u1", self.n_docs, 8 * self.n_docs)
        self.docs = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.first = np.frombuffer(raw, "<u8", self.n_docs + 1, 9 * self.n_docs).astype(np.int64)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // BLOCK, (stop - 1) // BLOCK + 1
        self.source.seek(int(self.starts[a]))
        raw = self.source.read(int(self.starts[b] - self.starts[a]))
        cuts = self.starts[a : b + 1] - self.starts[a]
        ids = decode_blocks([raw[cuts[k] : cuts[k + 1]] for k in range(b - a)])
        return ids[start - a * BLOCK : stop - a * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first token, ids) in order; about a flush of tokens is decoded at a time."""
        k = 0
        while k < self.n_docs:
            stop = max(k + 1, int(np.searchsorted(self.first, self.first[k] + _FLUSH, "right")) - 1)
            base = int(self.first[k])
            ids = self.tokens(base, int(self.first[stop]))
            for d in range(k, stop):
                yield self.docs[d], int(self.first[d]), ids[int(self.first[d]) - base : int(self.first[d + 1]) - base]
            k = stop


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


MANIFEST = "part int, path string, n_docs long, n_tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, key: str = "doc_id", text: str = "text", plain: bool = False) -> DataFrame:
    """Encode the texts and write them in ascending order of key; the manifest: part, path, n_docs, n_tokens.

    One file per range of keys. A task writes to a name of its own and only the attempt that succeeds is in the manifest, so
    a task can be run again anywhere. Nulls: a null text is empty (its document holds only the end id); a null key comes
    first. Rows with equal keys are ordered by text, and repeated rows are all written. No input, no files. Texts of any length are encoded whole, and other columns play no part.
    A special token's string in a text is that token; with ``plain`` it is ordinary text.
    """
    spark = docs.sparkSession
    ship(spark)
    send_file(spark, tokenizer)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, sink, uri = word_encoder(local_file(tokenizer), plain), None, None, ""
        end = np.array([end_id], np.uint32).tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                keys = part.column(0).to_pylist()
                for k, ids in zip(keys, encoder.encode_batch([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    if writer is None:
                        uri = f"{folder}/{uuid.uuid4().hex}.dqtk"
                        filesystem, path = _filesystem(uri)
                        filesystem.create_dir(path.rpartition("/")[0], recursive=True)
                        sink = filesystem.open_output_stream(path)
                        writer = Writer(sink)
                    writer.add(k, np.frombuffer(ids + end, np.uint32))
        if writer is not None:
            writer.close()
            sink.close()
            row = {"part": [TaskContext.get().partitionId()], "path": [uri], "n_docs": [len(writer.docs)], "n_tokens": [writer.tokens]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(parts, "k").sortWithinPartitions("k", "t")
    return written(ordered.mapInArrow(write, MANIFEST), folder, "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    ship(manifest.sparkSession)
    # one row a file, and a file a range of keys: the table is as small as the number of tasks
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                filesystem, p = _filesystem(path)
                with filesystem.open_input_file(p) as source:
                    rows: tuple[list, ...] = ([], [], [], [])
                    for doc, first, ids in Reader(source).documents():
                        for column, v in zip(rows, (doc, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(v)
                        if len(rows[0]) >= 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = ([], [], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("path", "base").repartition(n, "path").mapInArrow(read, RESULT)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", plain: bool = False) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back.

    Nulls, empty and long texts, equal keys, empty tables, other columns and special strings: see ``write_files``.
    """
    return read_files(write_files(docs, tokenizer, shared_dir(docs.sparkSession), end_id, key, text, plain))
