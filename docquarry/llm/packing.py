"""Best-fit packing by minimum bin slack.

The plan is made on the histogram of piece lengths, at most ``capacity`` numbers whatever the corpus holds. For each pattern
of a bin, the longest length that is left opens it, and a bitset subset-sum over the lengths that are left (with their
counts) finds the fullest combination for the rest; the pattern is then taken out as often as the counts allow. Pieces
find their place by rank among pieces of equal length. Ranks come from per-task counts and their running sums, so a
length that a third of all pieces have is never gathered in one place.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.bpe import byte_encoder
from docquarry.llm.common import local_file, send_file, shared_dir, ship, written

CAPACITY, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: full ones, and before them what is over."""
    if n <= capacity:
        return [(0, n)]
    over = n % capacity
    return ([(0, over)] if over else []) + [(s, capacity) for s in range(over, n, capacity)]


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of the fullest sum within ``room``; longer lengths are preferred."""
    items: list[tuple[int, int]] = []
    reached = [1]
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            m = min(k, left)
            items.append((length, m))
            reached.append(reached[-1] | (reached[-1] << (length * m)) & mask)
            left, k = left - m, k * 2
        if reached[-1] >> room & 1:
            break
    at = reached[-1].bit_length() - 1
    used: dict[int, int] = {}
    for i in range(len(items), 0, -1):
        if reached[i - 1] >> at & 1:
            continue
        length, m = items[i - 1]
        used[length] = used.get(length, 0) + m
        at -= length * m
    return list(used.items())


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of each pattern of a bin; all pieces are placed."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        first = max(left)
        left[first] -= 1
        rest = fullest({k: v for k, v in left.items() if v > 0}, capacity - first)
        left[first] += 1
        use = dict(rest)
        use[first] = use.get(first, 0) + 1
        times = min(left[k] // v for k, v in use.items())
        out.append((times, [first] + [k for k, v in rest for _ in range(v)]))
        for k, v in use.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", plain: bool = False) -> DataFrame:
    """Pieces of each document with the task that made them and their number there among pieces of equal length."""
    ship(docs.sparkSession)
    send_file(docs.sparkSession, tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), byte_encoder(local_file(tokenizer), plain).encode
        for b in batches:
            rows: list[tuple] = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc(t or "")
                ids.append(end_id)
                raw = array("I", ids).tobytes()
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), part, int(seen[n])))
                    seen[n] += 1
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(encode, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", plain: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece in a sequence of at most ``capacity`` tokens.

    A null text is empty: its document is one piece that holds the end id. A null key stays null. Repeated rows are packed
    each; texts of any length are cut only where they exceed the capacity. An empty table gives an empty table. Other
    columns of the input play no part. A special token's string in a text is that token; with ``plain`` it is ordinary text.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    made = written(pieces(docs, tokenizer, capacity, end_id, key, text, plain), folder, "pieces")
    per_task = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_task = written(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), folder, "per_task")
    counts = {int(r["length"]): int(r["n"]) for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    # a row for each slot of each pattern: pieces of that length with ranks from lo to lo + times lie at `offset`
    taken: dict[int, int] = {}
    slots: list[tuple[int, int, int, int]] = []
    bins = 0
    for times, lengths in plan(counts, capacity):
        offset = 0
        for n in lengths:
            lo = taken.get(n, 0)
            slots.append((n, lo, bins, offset))
            taken[n], offset = lo + times, offset + n
        bins += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    edges = {int(n): (int(np.searchsorted(table[:, 0], n)), int(np.searchsorted(table[:, 0], n, "right"))) for n in counts}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                a, z = edges[n]
                own = np.flatnonzero(length == n)
                at[own] = a + np.searchsorted(table[a:z, 1], rank[own], "right") - 1
            found = table[at]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    # one row for each length of each task: it grows with the corpus, so it is sorted and merged, whatever its files' size says
    ranked = made.join(per_task.select("part", "length", "base").hint("merge"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
