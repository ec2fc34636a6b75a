"""Autocomplete: prefix, fuzzy and pattern lists of candidate phrases, fused by reciprocal ranks."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.text import analyze, word_ngrams
from docquarry.mapping import Mapping
from docquarry.operators.filters import column
from docquarry.plans import dsl

#: Fuzzy lists need a query of so many letters; so many first letters must be exact.
FUZZY_LEAST, FUZZY_PREFIX = 3, 1


def candidates(docs: DataFrame, m: Mapping, name: str) -> DataFrame:
    """(text): distinct phrases of a field, as the index keeps them."""
    f = m.need(name, "suggest")
    texts = docs.select(F.explode(column(name)).alias("x") if f.is_list else column(name).alias("x")).where("x is not null")
    s = f.suggest
    if s.expand is None:
        return texts.select(F.col("x").alias("text")).where("text <> ''").distinct()
    grams = word_ngrams(F.col("terms"), *s.expand)
    return texts.withColumn("terms", analyze(F.col("x"), s.analyze)).select(F.explode(grams).alias("text")).where("text <> ''").distinct()


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours (restricted), or ``most`` + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most and (not one or min(one) > most):
            return most + 1
        two, one = one, now
    return one[-1]


def _rough(text: Column, query: str, most: int) -> Column:
    """A condition without Python that all texts meet of which some prefix is within ``most`` edits of the query."""
    if len(query) < FUZZY_LEAST:
        return F.lit(False)
    # without transpositions a prefix is at most twice as far away
    widths = range(max(1, len(query) - most), len(query) + most + 1)
    return text.startswith(query[:FUZZY_PREFIX]) & reduce(lambda a, b: a | b, [F.levenshtein(F.substring(text, 1, n), F.lit(query), 2 * most) >= 0 for n in widths])


def _edits_of_prefix(text: Column, query: str) -> Column:
    """The fewest edits between the query and a prefix of a text as long as it, give or take as many; 3 if more than 2."""

    @F.pandas_udf("int")
    def fewest(t: pd.Series) -> pd.Series:
        def one(s: str) -> int:
            return next((most for most in (0, 1, 2) if any(edits(s[:n], query, most) <= most for n in range(max(1, len(query) - most), min(len(s), len(query) + most) + 1))), 3)

        return t.map(one)

    return fewest(text)


def flagged(phrases: DataFrame, query: str) -> DataFrame:
    """(text, seen): phrases with the lists that they stand in (0 prefix, 1 and 2 fuzzy, 3 pattern), in one pass over the phrases.

    Cheap conditions in front leave few phrases for Python.
    """
    q, t = query.lower(), F.col("text")
    starts, holds, rough = t.startswith(q), F.lower(t).contains(q), _rough(t, q, 2)
    some = phrases.where(starts | holds | rough).withColumn("_rough", rough)
    close = some.withColumn("_edits", _edits_of_prefix(t, q)) if len(q) >= FUZZY_LEAST else some.withColumn("_edits", F.lit(3))
    near = lambda most: F.col("_rough") & (F.col("_edits") <= most)
    lists = F.array(*[F.when(x, F.lit(i)) for i, x in enumerate((starts, near(1), near(2), holds))])
    return close.select("text", F.explode(F.array_compact(lists)).alias("seen"))


def lists(phrases: DataFrame, query: str, depth: int) -> list[DataFrame]:
    """The four lists of a field, each (text) in order, at most ``depth`` long."""
    found = flagged(phrases, query)
    return [found.where(F.col("seen") == i).select("text").orderBy("text").limit(depth) for i in range(4)]


def suggest(docs: DataFrame, m: Mapping, r: dsl.SuggestRequest) -> DataFrame:
    """(text, score): the best ``count`` suggestions. Phrases of each field are derived and looked through once."""
    depth = max(r.depth, r.count)
    order = Window.partitionBy("seen").orderBy("text")
    parts = []
    for i, name in enumerate(r.fields):
        ranked = flagged(candidates(docs, m, name), r.query).withColumn("n", F.row_number().over(order)).where(F.col("n") <= depth)
        parts.append(ranked.select("text", (1.0 / (r.scale + F.col("n") - 1)).alias("part"), (F.col("seen") + 4 * i).alias("seen")))
    every = reduce(DataFrame.unionByName, parts)
    fused = every.groupBy(F.lower("text").alias("key")).agg(F.min_by("text", F.struct("seen", "text")).alias("text"), F.sum("part").alias("score"))
    return fused.orderBy(F.desc("score"), "key").limit(r.count).select("text", "score")
