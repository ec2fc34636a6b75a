"""N-gram Jaccard join: an exact, size-aware heavy-light set join, by DataFrame functions only.

1. Each text's set of 5-word shingles, as sorted 64-bit hashes; texts with equal sets form a class and only its smallest id goes on.
2. One shuffle of (shingle, document) counts each shingle's documents. Shingles of one document cannot be shared; they only
   take up the front of the document's prefix under the order (documents, hash). Few documents have anything else in it. Shingles
   that a sample of documents shows to be frequent are spread over many tasks; they come last in the order, by the sample's count
   (any order that all documents share will do, so the sample never shows in the result).
3. A set that is similar to a partner shares with it at least one element of its prefix of n - ceil(t n) + 1 elements, and at
   least two elements of the prefix that is one longer. Light sets (n <= boundary) meet by the 2-element subsets of the
   longer prefix; pairs with a heavy set meet by scanning the inverted lists of the prefix elements. The boundary is the size
   at which enumerating subsets and scanning lists cost least in total, from counts by size. A posting carries the elements before
   it, up to ``BEFORE`` of them, so a pair is given at the first element (or two) that both have, and not again at the next ones.
4. Candidates are gathered by pairs of buckets (sets with equal smallest hash, split by documents and by elements) and checked on the
   shared elements of both sets. Each set is sent once to each pair of buckets in which it has candidates, not once to each candidate.
5. A pair of buckets gives sums of links by document and, for components, its links without those between documents that two
   linked documents of it join already. So of a cluster of m near copies m * m / 2 links are counted, but not kept.

Shingles are compared as 64-bit hashes. Within a pair of documents of 20,000 shingles, two different ones agree with a
probability of about 1e-11.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import lower_ascii, remove, shared_dir, words_of, written
from docquarry.llm.components import components

SHINGLE, PERCENT = 5, 80
#: Largest size that may be light; sizes above it are always heavy.
LIGHT_MOST = 64
#: Posting lists are split into parts of about this many documents; a bucket of candidates has about so many documents and elements at most.
LIST_PART, BUCKET, BUCKET_ELEMENTS = 512, 128, 1 << 18
#: Elements before it that a posting carries; pairs that meet behind so many may meet again, and are told apart when they are gathered.
BEFORE = 64
#: Documents of the sample that shows frequent shingles; how many of them (and which share) such a shingle stands in; tasks that it is
#: spread over; most shingles that are treated so, the most frequent first (the others stay whole).
HOT_SAMPLE, HOT_LEAST, HOT_SHARE, HOT_TASKS, HOT_MOST = 5_000, 20, 0.004, 1024, 100_000
#: Ids are broadcast up to this many; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Sorted distinct hashes of the word shingles of a text; of all words as one where they are fewer."""
    words = words_of(lower_ascii(F.coalesce(text, F.lit(""))))

    def hashed(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.slice(w, 1, n - (size - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, F.array(F.xxhash64(w))).otherwise(each)

    return F.array_sort(F.array_distinct(F.transform(F.array(words), hashed)[0]))


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose key is in ``ids`` (a written table, one column of that name)."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti")


def _one_row_an_id(docs: DataFrame, digest: DataFrame, folder: str) -> tuple[DataFrame, bool]:
    again = written(digest.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), folder, "repeated_ids")
    if again.isEmpty():
        return docs, False
    merged = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(again, "doc_id", "left_anti").unionByName(merged), True


def _digest(docs: DataFrame) -> DataFrame:
    d = docs.withColumn("s", shingles(F.col("text")))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(7), "s").alias("k2"))


def _frequent(reps: DataFrame, total: int, folder: str) -> DataFrame:
    """(h, hot): shingles that stand in many documents of a sample by the key's hash, and about how many documents have them."""
    one_in = max(1, total // HOT_SAMPLE)
    least = max(HOT_LEAST, round(HOT_SHARE * total / one_in))
    drawn = reps.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select(F.explode(shingles(F.col("text"))).alias("h"))
    return written(drawn.groupBy("h").agg((F.count("*") * one_in).alias("hot")).where(F.col("hot") >= least * one_in).orderBy(F.desc("hot"), "h").limit(HOT_MOST), folder, "frequent")


def _entries(reps: DataFrame, sizes: DataFrame, percent: int, frequent: DataFrame) -> DataFrame:
    """Sets that can have a partner: doc, n, copies, alone (elements of no other set), arr (shared ones in order), dfs, and pre (how
    many of arr lie in the prefix)."""
    posts = reps.select(F.col("doc_id").alias("doc"), F.explode(shingles(F.col("text"))).alias("h"))
    # at most HOT_MOST rows of two numbers
    posts = posts.join(F.broadcast(frequent), "h", "left").withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("doc"), F.lit(HOT_TASKS))).otherwise(0))
    shared = posts.withColumn("df", F.coalesce("hot", F.count("*").over(Window.partitionBy("h", "salt")))).where("df > 1")
    lists = shared.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("e"))
    joined = lists.join(sizes, "doc")
    least = F.floor((percent * F.col("n") + 99) / 100)
    return (
        joined.withColumn("alone", F.col("n") - F.size("e"))
        .withColumn("pre", (F.col("n") - least + 1 - F.col("alone")).cast("int"))
        .where("pre > 0")
        .select("doc", "n", "copies", "alone", "pre", F.transform("e", lambda x: x["h"]).alias("arr"), F.transform(F.slice("e", 1, F.col("pre") + 1), lambda x: x["df"]).alias("dfs"))
    )


def bucketed(entries: DataFrame, folder: str) -> DataFrame:
    """``entries`` with k, the bucket of each set: those of equal smallest element, split where they are many or large."""
    placed = entries.withColumn("low", F.array_min("arr"))
    parts = F.greatest(F.ceil(F.count("*") / BUCKET), F.ceil(F.sum("n") / BUCKET_ELEMENTS)).cast("int")
    split = written(placed.groupBy("low").agg(parts.alias("split")).where("split > 1"), folder, "split")
    split = F.broadcast(split) if split.count() <= BROADCAST_IDS else split.hint("merge")
    k = F.xxhash64("low", F.pmod(F.xxhash64("doc"), F.coalesce("split", F.lit(1))))
    return placed.join(split, "low", "left").withColumn("k", k).drop("low", "split")


def boundary(entries: DataFrame) -> int:
    """The size up to which enumerating 2-element subsets, over all sets, costs less than scanning lists."""
    costs = (
        entries.where(F.col("n") <= LIGHT_MOST)
        .groupBy("n")
        .agg(F.sum((F.col("pre") + 1) * F.col("pre") / 2).alias("light"), F.sum(F.aggregate(F.slice("dfs", 1, F.col("pre")), F.lit(0.0), lambda s, x: s + x / 2)).alias("heavy"))
        .collect()
    )  # at most LIGHT_MOST rows
    best, at, now = 0.0, 0, 0.0
    for r in sorted(costs, key=lambda r: r["n"]):
        now += r["light"] - r["heavy"]
        if now < best:
            best, at = now, int(r["n"])
    return at


def _met(posts: DataFrame, pair: Column) -> DataFrame:
    """Pairs (a < b) of documents that meet under a key h and under no key before it, with their buckets.

    ``before``: what stands before the key; null where that is much. Long lists are split by the left document and copied on the right.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("df") / LIST_PART)).cast("int")
    own = ("doc", "n", "pos", "k", "before")
    left = posts.select("h", F.pmod(F.xxhash64("doc"), parts).cast("int").alias("part"), *[F.col(c).alias(f"a_{c}") for c in own])
    right = posts.select("h", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"b_{c}") for c in own])
    # a fixed number of partitions: what a list costs shows in pairs, not in the bytes by which small partitions would be joined
    n = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.repartition(n, "h", "part").hint("merge").join(right.repartition(n, "h", "part"), ["h", "part"]).where("a_doc < b_doc").where(pair).where(~F.coalesce(F.arrays_overlap("a_before", "b_before"), F.lit(False)))
    return met.select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"), F.least("a_k", "b_k").alias("k"), F.greatest("a_k", "b_k").alias("k2"))


def candidates(entries: DataFrame, percent: int, light: int) -> DataFrame:
    """The pairs (a < b) that the filters leave, with their buckets: a, b, k, k2; those with short prefixes once each."""
    a, b = F.col("a_n"), F.col("b_n")
    sizes_fit = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    needed = F.ceil(percent * (a + b) / (100 + percent))
    room = F.least(a - F.col("a_pos"), b - F.col("b_pos"))  # of the first common element, positions from 0
    heavy_posts = (
        entries.where(100 * F.col("n") >= percent * (light + 1))
        .select("doc", "n", "k", "alone", "arr", F.posexplode(F.arrays_zip(F.slice("arr", 1, F.col("pre")).alias("h"), F.slice("dfs", 1, F.col("pre")).alias("df"))).alias("at", "x"))
        .select(F.col("x.h").alias("h"), F.col("x.df").alias("df"), "doc", "n", "k", (F.col("alone") + F.col("at")).alias("pos"), F.when(F.col("at") <= BEFORE, F.slice("arr", 1, F.col("at"))).alias("before"))
    )
    heavy = _met(heavy_posts, sizes_fit & (room >= needed) & (F.greatest(a, b) > light))
    front = F.slice("arr", 1, F.col("pre") + 1)
    subsets = F.flatten(
        F.transform(
            front,
            lambda x, i: F.transform(
                F.slice(front, i + 2, F.size(front)),
                lambda y, j: F.struct(
                    F.xxhash64(x, y).alias("h"), F.least(F.get("dfs", i), F.get("dfs", i + j + 1)).alias("df"), F.array_remove(F.slice(front, 1, i + j + 1), x).alias("before")
                ),
            ),
        )
    )
    light_posts = entries.where(F.col("n") <= light).select("doc", "n", "k", F.lit(0).cast("long").alias("pos"), F.explode(subsets).alias("x")).select(
        F.col("x.h").alias("h"), F.col("x.df").alias("df"), "doc", "n", "k", "pos", F.col("x.before").alias("before")
    )
    return heavy.union(_met(light_posts, sizes_fit))


def gathered(pairs: DataFrame) -> DataFrame:
    """k, k2, pairs: the candidates of each pair of buckets."""
    return pairs.groupBy("k", "k2").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))


def links(entries: DataFrame, work: DataFrame, percent: int) -> DataFrame:
    """k, k2, sets, links (array of a, b): the candidate pairs whose sets are similar; sets without their elements."""
    docs = F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["a"], p["b"]))))
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed, as in _met
    sent = work.select("k", "k2", F.explode(docs).alias("doc")).join(entries.select("doc", "n", "copies", "arr").hint("merge"), "doc").repartition(n, "k", "k2")
    sent = sent.groupBy("k", "k2").agg(F.collect_list(F.struct("doc", "n", "copies", "arr")).alias("sets"))
    both = work.repartition(n, "k", "k2").hint("merge").join(sent, ["k", "k2"]).withColumn("ids", F.transform("sets", lambda x: x["doc"]))
    at = lambda doc: F.get("sets", (F.array_position("ids", doc) - 1).cast("int"))

    def checked(p: Column) -> Column:
        # one-element arrays bind the two sets, so each is looked up once
        return F.transform(
            F.array(F.struct(at(p["a"]).alias("l"), at(p["b"]).alias("r"))),
            lambda x: F.struct(
                x["l"]["doc"].alias("a"), x["r"]["doc"].alias("b"), x["l"]["copies"].alias("wa"), x["r"]["copies"].alias("wb"),
                F.size(F.array_intersect(x["l"]["arr"], x["r"]["arr"])).alias("c"), (x["l"]["n"] + x["r"]["n"]).alias("n"),
            ),
        )[0]

    found = F.filter(F.transform("pairs", checked), lambda x: 100 * x["c"] >= percent * (x["n"] - x["c"]))
    return both.select("k", "k2", found.alias("links"))


def summed(found: DataFrame) -> DataFrame:
    """kind, a, b, w. Kind 0: w other documents are linked with document a. Kind 1: a link (a, b) that components need."""
    each = F.col("links")
    touching = lambda x: F.transform(F.filter(each, lambda p: (p["a"] == x) | (p["b"] == x)), lambda p: F.when(p["a"] == x, p["b"]).otherwise(p["a"]))
    # two linked documents, and all that are linked with either
    hub = F.struct(F.get(each, F.lit(0))["a"].alias("p"), F.get(each, F.lit(0))["b"].alias("q"))
    joined = F.transform(F.array(hub), lambda h: F.struct(h["p"].alias("p"), h["q"].alias("q"), F.array_union(touching(h["p"]), touching(h["q"])).alias("near")))
    is_hub = lambda h, x: (x == h["p"]) | (x == h["q"])
    thinned = F.transform(
        joined,
        lambda h: F.filter(each, lambda p: is_hub(h, p["a"]) | is_hub(h, p["b"]) | ~(F.array_contains(h["near"], p["a"]) & F.array_contains(h["near"], p["b"]))),
    )[0]
    row = lambda kind, a, b, w: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), w.cast("long").alias("w"))
    none = F.lit(None).cast("long")
    rows = F.concat(
        F.flatten(F.transform(each, lambda p: F.array(row(0, p["a"], none, p["wb"]), row(0, p["b"], none, p["wa"])))), F.transform(thinned, lambda p: row(1, p["a"], p["b"], F.lit(0)))
    )
    return found.select(F.explode(rows).alias("x")).select("x.*").groupBy("kind", "a", "b").agg(F.sum("w").alias("w"))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_similar, component_id, class_id (smallest document with an equal set).

    Nulls: a null or empty text has an empty set and links with nothing; a row with a null key is returned with its set size,
    no links and null component. Rows that repeat a key count as one document, with the smallest of their texts. An empty
    table gives an empty table; texts are read whole; other columns play no part.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    digest = written(_digest(docs), folder, "digest")
    docs, changed = _one_row_an_id(docs, digest, folder)
    if changed:
        digest = written(_digest(docs), folder, "digest-again")
    known = digest.where("doc_id is not null")
    classes = known.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    members = written(
        known.join(classes, ["k1", "k2", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), folder, "members"
    )
    copies = written(members.where("doc_id <> rep").select("doc_id"), folder, "copies")
    reps = without(docs.where("doc_id is not null"), copies, "doc_id")
    sizes = members.where("doc_id = rep").select(F.col("doc_id").alias("doc"), "n", "copies")
    frequent = _frequent(reps, sizes.count(), folder)
    entries = bucketed(written(_entries(reps, sizes, percent, frequent), folder, "entries"), folder)
    work = written(gathered(candidates(entries, percent, boundary(entries))), folder, "candidates")
    found = written(summed(links(entries, work, percent)), folder, "links")
    for name in ("entries", "candidates"):
        remove(spark, f"{folder}/{name}")
    joined = components(found.where("kind = 1").select("a", "b"), folder)
    degree = found.where("kind = 0").select(F.col("a").alias("rep"), F.col("w").alias("others"))
    of_rep = written(degree.join(joined.select(F.col("v").alias("rep"), "m"), "rep", "left"), folder, "of_rep")
    out = members.join(of_rep, "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"),
        F.coalesce("m", "rep").alias("component_id"), F.col("rep").alias("class_id"),
    )
    none = F.lit(None).cast("long")
    return out.union(digest.where("doc_id is null").select("doc_id", "n", F.lit(0).cast("long"), none, none))
