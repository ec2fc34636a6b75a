"""Token counts by field or section, from one encoding of the whole document.

A document is encoded once; each token's span is known from the bytes that it stands for. Sections are spans that tile the
document. Tokens are given to sections by an interval join on sorted starts; a token that crosses a border goes, whole, where
the rule says: ``first`` (the section of its first character), ``last`` (of its last character) or ``most`` (the section that
holds most of its bytes, the earlier of equals). So the counts of a document's sections always add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.bpe import byte_encoder
from docquarry.llm.common import local_file, send_file, ship

RULES = ("first", "last", "most")


def allocate(token_ends: np.ndarray, borders: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. token_ends: running byte ends; borders: byte starts of the sections, first 0."""
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(borders, starts, "right") - 1
    if rule == "first":
        at = first
    else:
        last = np.searchsorted(borders, token_ends - 1, "right") - 1
        at = last
        if rule == "most" and (crossing := np.flatnonzero(first != last)).size:
            at = first.copy()
            for i in crossing.tolist():
                edges = [int(starts[i]), *borders[first[i] + 1 : last[i] + 1].tolist(), int(token_ends[i])]
                at[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(at, minlength=len(borders))


def count_tokens(
    docs: DataFrame, tokenizer: str, fields: Sequence[str] = ("text",), sections: str = "lines", separator: str = "\n", rule: str = "first", key: str = "doc_id", plain: bool = False,
) -> DataFrame:
    """One row per section: doc_id, section (from 0), start, end (code points in the document, end exclusive), n_tokens.

    The document is the fields' texts joined by ``separator``. sections ``lines``: each line with its line end; ``fields``: each
    field with the separator behind it. Null fields are empty. A document without text has one section (as many as
    fields, for ``fields``) without tokens. Repeated rows are counted each, a null key stays null, texts are encoded whole
    at any length, an empty table gives an empty table, and other columns play no part. A special token's string in a text is
    that token; with ``plain`` it is ordinary text.
    """
    if rule not in RULES or sections not in ("lines", "fields"):
        raise ValueError(f"unknown rule {rule!r} or sections {sections!r}")
    ship(docs.sparkSession)
    send_file(docs.sparkSession, tokenizer)
    n_fields = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_encoder(local_file(tokenizer), plain)
        size = np.zeros(max(enc.token_bytes) + 1, np.int64)
        for i, t in enc.token_bytes.items():
            size[i] = len(t)
        names = ["doc_id", "section", "start", "end", "n_tokens"]
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                p = b.slice(lo, 512)
                keys, parts = [], []
                texts = [c.to_pylist() for c in p.columns[1:]]
                for k, row in zip(p.column(0).to_pylist(), zip(*texts, strict=True), strict=True):
                    row = [x or "" for x in row]
                    doc = separator.join(row)
                    raw = np.frombuffer(doc.encode(), np.uint8)
                    ends = np.cumsum(size[np.array(enc.encode(doc), np.int64)]) if doc else np.empty(0, np.int64)
                    if sections == "lines":
                        borders = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
                        if len(borders) > 1 and borders[-1] == len(raw):
                            borders = borders[:-1]
                    else:
                        widths = [len(x.encode()) + len(separator.encode()) for x in row]
                        borders = np.concatenate([[0], np.cumsum(widths[:-1])]).astype(np.int64)
                    signs = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    edge = signs[np.concatenate([borders, [len(raw)]])]
                    keys.append((k, len(borders)))
                    parts.append((np.arange(len(borders)), edge[:-1], edge[1:], allocate(ends, borders, rule)))
                ids = pa.array([k for k, n in keys for _ in range(n)], pa.int64())
                columns = [np.concatenate([x[c] for x in parts]) for c in range(4)]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]], names=names)

    chosen = [F.col(key).cast("long").alias("k"), *[F.col(f).cast("string").alias(f"t{i}") for i, f in enumerate(fields)]]
    if not n_fields:
        raise ValueError("no fields")
    return docs.select(*chosen).mapInArrow(run, "doc_id long, section int, start long, end long, n_tokens long")
