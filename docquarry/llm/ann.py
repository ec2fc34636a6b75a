"""Approximate nearest neighbours by inner product: inverted file with product-quantised residuals and exact reranking.

Fitting: coarse centroids and codebooks come from a sample of about ``SAMPLE`` rows (those whose id's hash is below a bound). There
are ``LISTS`` times the square root of the rows as many lists. Every row is indexed. How many lists a query probes is set by the true
neighbours, among all rows, of ``TRIALS`` rows of the sample: as few as hold ``TARGET`` of them.

Search: lists that lie near each other form groups of about ``GROUP`` rows (the leaves of a tree of median cuts); a longer list is a
group of its own, split by hash. Queries are routed first: each goes to the groups that hold a list it probes, and the queries of a
group are cut into chunks of about ``BLOCK``. So a row is copied only as often as its group has chunks, and a task holds one part
of a group and one chunk, whatever a list's share of the rows. There, asymmetric distance tables score the rows of probed lists.
The best ``SHORTLIST`` are scored again on the original vectors in double precision; so is every other row whose score, raised
by the most that its quantisation error can hide, reaches the k-th of these. So a group's best are those of an exact scan of the
probed lists, ties included.

Original vectors travel with the codes: a query needs those of a few per cent of the rows, and there is a query for every few rows,
so fetching them afterwards would move more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import shared_dir, ship, written

#: Rows the index is fitted on; lists for the square root of the rows, most lists, least rows a list; share of the true neighbours that
#: probing must reach for some of the sample's rows, and how many these are.
SAMPLE, LISTS, MOST_LISTS, LEAST_ROWS, TARGET, TRIALS = 40_000, 9, 16_384, 4, 0.94, 256
#: How far, in standard deviations, a list's best row is expected to lie beyond its centroid; lists are probed in the order of that.
REACH = 2.0
#: Lists whose promise lies within this share of a query's and the best centroid's size can't be told apart: all or none are probed.
TIE = 5e-3
#: Dimensions of a subquantiser and its codes, rows of a group, queries of a chunk, rows of a group that set the bound for the others.
SUB, CODES, GROUP, BLOCK, SHORTLIST = 4, 256, 4096, 8192, 120
#: Share of a row's size that sums in double precision may be off, with room to spare.
ROUNDING = 1e-9
#: Numbers that a sample, a group's part or a chunk holds at most; vectors of many dimensions make each of them fewer rows.
MOST_SAMPLE, MOST_HELD = 1 << 25, 1 << 21


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, steps: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        s = np.stack([np.bincount(a, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid by Euclidean distance, in slices of bounded size."""
    half = (c * c).sum(1) / 2
    step = max(1, 4_000_000 // len(c))
    return np.concatenate([(x[i : i + step] @ c.T - half).argmax(1) for i in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)


def lists_for(rows: int, sampled: int) -> int:
    """How many lists a table has: more for larger ones, a few rows each at least."""
    return int(max(1, min(MOST_LISTS, LISTS * rows**0.5, rows / LEAST_ROWS, sampled / 2)))


class Quantizer:
    def __init__(self, sample: np.ndarray, lists: int):
        d = sample.shape[1]
        self.centroids = kmeans(sample, lists)
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        #: How far rows lie from their list's centroid along any one direction, as a standard deviation; set from all rows.
        self.spread = np.zeros(len(self.centroids))
        self.cuts = [(i, min(i + SUB, d)) for i in range(0, d, SUB)]
        self.books = [kmeans(rest[:, a:z], CODES, 6) for a, z in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, a bound of the distance between row and code, with room for rounding, and the residual."""
        at = nearest(x, self.centroids)
        rest = x - self.centroids[at]
        code = np.stack([nearest(rest[:, a:z], b) for (a, z), b in zip(self.cuts, self.books, strict=True)], 1)
        kept = np.concatenate([b[c] for b, c in zip(self.books, code.T, strict=True)], 1)
        far, size = np.linalg.norm(rest - kept, axis=1), np.linalg.norm(self.centroids[at], axis=1) + np.linalg.norm(kept, axis=1)
        return at, code.astype(np.uint8), far + ROUNDING * (far + size), rest

    def promise(self, y: np.ndarray, lists: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What the best row of each list is expected to give with a query: long rows far from their centroid count."""
        return self.centroids[lists] @ y + REACH * np.linalg.norm(y) * self.spread[lists]

    def groups(self, sizes: np.ndarray, rows: int) -> np.ndarray:
        """The group of each list: median cuts along the main direction, until a group has at most ``rows`` rows or one list."""
        out, n, todo = np.zeros(len(sizes), np.int64), 0, [np.flatnonzero(sizes > 0)]
        while todo:
            own = todo.pop()
            if not len(own):
                continue
            if len(own) == 1 or sizes[own].sum() <= rows:
                out[own], n = n, n + 1
                continue
            c = self.centroids[own] - np.average(self.centroids[own], axis=0, weights=sizes[own])
            way = np.linalg.eigh(c.T @ (c * sizes[own, None]))[1][:, -1]
            order = own[np.argsort(c @ way, kind="stable")]
            half = int(np.clip(np.searchsorted(np.cumsum(sizes[order]), sizes[own].sum() / 2) + 1, 1, len(own) - 1))
            todo += [order[half:], order[:half]]
        return out


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """Vectors, kept as the bytes of their components, in double precision."""
    raw = b"".join(x.as_buffer() for x in column)
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * d * len(column) else np.float64).reshape(-1, d).astype(np.float64)


def _bytes(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _one_row_an_id(v: DataFrame) -> DataFrame:
    again = v.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if again.isEmpty():
        return v
    merged = v.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
    return v.join(again, "vec_id", "left_anti").unionByName(merged)


def _probes_needed(indexed: DataFrame, q: Quantizer, some: np.ndarray, k: int, target: float) -> int:
    """The fewest lists, those of most promise first, that hold ``target`` of the true neighbours of ``some`` rows among all rows.

    One pass: a task keeps the best k of its rows for each of the queries.
    """
    d, n = some.shape[1], len(some)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, at = np.full((n, k + 1), -np.inf), np.full((n, k + 1), -1)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                p = b.slice(i, 4096)
                score = np.concatenate([top, some @ _matrix(p.column("x"), d).T], axis=1)
                lists = np.concatenate([at, np.broadcast_to(p.column("list").to_numpy(zero_copy_only=False), (n, p.num_rows))], axis=1)
                keep = np.argpartition(-score, k, axis=1)[:, : k + 1]
                top, at = np.take_along_axis(score, keep, axis=1), np.take_along_axis(lists, keep, axis=1)
        q_at, _ = np.nonzero(at >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(q_at), pa.array(top[at >= 0]), pa.array(at[at >= 0].astype(np.int32))], names=["q", "score", "list"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "list")
    found = indexed.select("list", "x").mapInArrow(best, "q long, score double, list int").withColumn("r", F.row_number().over(order))
    held, own = [], nearest(some, q.centroids)
    ranks = np.empty((n, len(q.centroids)), np.int64)
    for i, y in enumerate(some):
        ranks[i, np.argsort(-q.promise(y), kind="stable")] = np.arange(len(q.centroids))
    for i, rows in groupby(found.where(F.col("r") <= k + 1).orderBy("q", "r").collect(), key=lambda r: r["q"]):  # at most TRIALS x (k + 1) rows
        lists = [r["list"] for r in rows]
        # the query itself is one of them, unless others are so long that it isn't
        if own[i] in lists:
            lists.remove(own[i])
        held += ranks[i, lists[:k]].tolist()
    held.sort()
    return held[min(len(held) - 1, math.ceil(target * len(held)))] + 1 if held else len(q.centroids)


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each usable row that ``is_query`` selects, the k nearest other rows found.

    Ties go to the smaller id; fewer than k candidates are all returned. Rows with a null id, a null or zero vector, or a null or
    non-finite component take no part. Rows are compared with those of their own dimension, each dimension with an index of its
    own. Of rows that repeat an id the smallest vector counts. An empty table gives an empty table; other columns play no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    narrow = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind = "array<float>" if narrow else "array<double>"
    v = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    clean = _one_row_an_id(v.where(F.col("vec_id").isNotNull() & usable(F.col("v"))))
    dims = clean.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    found = [_search(clean.where(F.size("v") == r["d"]), r["d"], r["count"], narrow, k, target) for r in dims]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], RESULT)


def _search(clean: DataFrame, d: int, total: int, narrow: bool, k: int, target: float) -> DataFrame:
    spark, folder = clean.sparkSession, shared_dir(clean.sparkSession)
    wanted = min(SAMPLE, MOST_SAMPLE // d)
    drawn = clean if total <= wanted else clean.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < round(wanted / total * (1 << 30)))
    t = drawn.select("vec_id", "v").toArrow()
    sample = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    sample = sample[np.argsort(t["vec_id"].to_numpy(), kind="stable")][np.random.default_rng(2).permutation(len(sample))]
    q = Quantizer(sample, lists_for(total, len(sample)))
    some = sample[: min(TRIALS, len(sample))]
    del t, sample

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                at, code, far, rest = q.encode(x.astype(np.float64))
                columns = [pa.array(at.astype(np.int32)), _bytes(code), pa.array(far), pa.array((rest * rest).mean(1)), _bytes(x)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("is_query"), *columns], names=["vec_id", "is_query", "list", "code", "far", "square", "x"])

    indexed = written(clean.select("vec_id", "is_query", "v").mapInArrow(index, "vec_id long, is_query boolean, list int, code binary, far double, square double, x binary"), folder, "index")
    sizes = np.zeros(len(q.centroids), np.int64)
    for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.avg("square").alias("square")).collect():  # at most MOST_LISTS rows
        sizes[r["list"]], q.spread[r["list"]] = r["n"], r["square"] ** 0.5
    need = _probes_needed(indexed, q, some, k, target)
    most_rows, most_queries = min(GROUP, max(1, MOST_HELD // d)), min(BLOCK, max(1, MOST_HELD // d))
    group = q.groups(sizes, most_rows)
    n_groups = int(group.max()) + 1
    parts = np.maximum(1, -(-np.bincount(group, sizes, n_groups).astype(np.int64) // most_rows))

    def route(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The groups of the lists that each query probes (enough lists, and enough rows for k and more), and the last one's promise."""
        out, cuts = [], np.empty(len(x))
        for i, y in enumerate(x):
            product = q.promise(y)
            order = np.argsort(-product, kind="stable")
            many = min(len(order), max(need, int((np.cumsum(sizes[order]) < 4 * k).sum()) + 1))
            cuts[i] = product[order[many - 1]] - TIE * np.linalg.norm(y) * np.linalg.norm(q.centroids[order[0]])
            own = np.flatnonzero((product >= cuts[i]) & (sizes > 0))
            out.append(np.unique(group[own]))
        return out, cuts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_groups, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                for own in route(_matrix(b.column("x")[i : i + 1024], d))[0]:
                    n[own] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["g", "n"])

    queries = indexed.where("is_query")
    chunks = np.zeros(n_groups, np.int64)
    for r in queries.select("x").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():  # at most MOST_LISTS rows
        chunks[r["g"]] = -(-r["n"] // most_queries)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                p = b.slice(i, 1024)
                targets, cuts = route(_matrix(p.column("x"), d))
                own = np.repeat(np.arange(p.num_rows), [len(t) for t in targets])
                g = np.concatenate(targets)
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), pa.array(parts[g]), pa.array(chunks[g]), p.column("vec_id").take(take), pa.array(cuts[own]), p.column("x").take(take)], names=["g", "parts", "chunks", "query_id", "cut", "y"]
                )

    asked = queries.select("vec_id", "x").mapInArrow(ask, "g long, parts long, chunks long, query_id long, cut double, y binary")
    asked = asked.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("chunks")).alias("chunk"), "query_id", "cut", "y")
    # at most MOST_LISTS rows of four numbers
    table = spark.createDataFrame([(i, int(group[i]), int(parts[group[i]]), int(chunks[group[i]])) for i in range(len(sizes)) if sizes[i] and chunks[group[i]]], "list int, g long, parts long, chunks long")
    rows = indexed.join(F.broadcast(table), "list").select(
        "g", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "vec_id", "list", "code", "far", "x"
    )

    def scan(rows: pa.Table, asks: pa.Table) -> pa.Table:
        ids, lists = rows["vec_id"].to_numpy(), rows["list"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, lists, far = ids[order], lists[order], rows["far"].to_numpy()[order]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(ids) and asks.num_rows:
            x = _matrix(rows["x"], d)[order]
            code = np.frombuffer(b"".join(c.as_buffer() for c in rows["code"]), np.uint8).reshape(len(ids), -1)[order].astype(np.int64)
            code += np.arange(code.shape[1]) * CODES
            own, inside = np.unique(lists, return_inverse=True)
            y, cut = _matrix(asks["y"], d), asks["cut"].to_numpy()
            coarse, norms = y @ q.centroids[own].T, np.linalg.norm(y, axis=1)
            for i, asker in enumerate(asks["query_id"].to_numpy().tolist()):
                able = np.flatnonzero((q.promise(y[i], own) >= cut[i])[inside] & (ids != asker))
                if len(able) > (most := max(k, SHORTLIST)):
                    distances = np.zeros((len(q.books), CODES))
                    for m, ((a, z), book) in enumerate(zip(q.cuts, q.books, strict=True)):
                        distances[m, : len(book)] = book @ y[i, a:z]
                    score = coarse[i, inside[able]] + distances.ravel()[code[able]].sum(1)
                    first_best = able[np.argpartition(-score, most - 1)[:most]]
                    least = np.sort((x[first_best] * y[i]).sum(1))[-k]
                    able = able[~(score + norms[i] * far[able] < least)]
                exact = (x[able] * y[i]).sum(1)  # row by row, so that equal vectors tie wherever they stand
                best = np.lexsort((ids[able], -exact))[:k]
                out.append((np.full(len(best), asker), ids[able][best], exact[best]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    # as many tasks as the work asks for: bytes, by which small partitions are joined, say little about it
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((parts * chunks).sum()) // 16)
    meet = ["g", "part", "chunk"]
    found = rows.repartition(n, *meet).groupBy(*meet).cogroup(asked.repartition(n, *meet).groupBy(*meet)).applyInArrow(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
