"""Retrieval queries compiled to column expressions over the documents.

A query becomes two columns, whether a document matches and its score, so any tree of match, bool and dis_max is one scan with
one projection, and filters are plain conditions beside it. Only nearest neighbours end in rows of their own (a bounded
top-k), which come back as a broadcast join of at most 10,000 ids.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.errors import UserError
from docquarry.functions.text import analyze, analyze_query
from docquarry.functions.vectors import quantize, restored, similarity
from docquarry.mapping import Mapping
from docquarry.operators.filters import column
from docquarry.plans import dsl

K1, B = 1.2, 0.75


def vector_column(name: str) -> str:
    return f"{name}__vec"


def codes_column(name: str, kind: str) -> str:
    return f"{name}__{kind}"


def length_column(name: str) -> str:
    return f"{name}__len"


@dataclass
class Postings:
    """An index's postings (field, term, _seq, tf, n), sorted by field and term, and each field's documents and terms."""

    rows: DataFrame
    totals: dict[str, tuple[int, int]]

    def of(self, wanted: dict[str, list[str]]) -> DataFrame:
        """Postings of some terms: conditions that pick the row groups which hold them."""
        return self.rows.where(reduce(or_, [(F.col("field") == f) & F.col("term").isin(t) for f, t in wanted.items()]))


@dataclass
class FieldStats:
    """Of one field: documents that have it, their terms in all, documents by term (query terms only)."""

    docs: int = 0
    terms: int = 0
    df: dict[str, int] = field(default_factory=dict)


@dataclass
class Corpus:
    """Documents with analysed terms, and statistics over all of them, whatever is filtered."""

    docs: DataFrame
    mapping: Mapping
    present: list[str]
    embed: Callable[[str, str], list[float]] | None = None
    cache: dict[str, FieldStats] = field(default_factory=dict)
    postings: Postings | None = None

    def terms(self, name: str) -> Column:
        return lexical_terms(self.mapping, name)

    def stats(self, wanted: dict[str, set[str]]) -> None:
        """One aggregate over all documents for every field and term that a query names and isn't known yet."""
        todo = {f: sorted(t - self.cache[f].df.keys()) if f in self.cache else sorted(t) for f, t in wanted.items()}
        todo = {f: t for f, t in todo.items() if t or f not in self.cache}
        if not todo:
            return
        if self.postings is not None:
            for f in todo:
                self.cache.setdefault(f, FieldStats(*self.postings.totals.get(f, (0, 0)))).df.update(dict.fromkeys(todo[f], 0))
            asked = {f: t for f, t in todo.items() if t}
            for r in self.postings.of(asked).groupBy("field", "term").count().collect() if asked else []:  # at most a row for each term of the query
                self.cache[r["field"]].df[r["term"]] = r["count"]
            return
        names = list(todo)
        staged = self.docs.select(*[self.terms(f).alias(f"t{i}") for i, f in enumerate(names)])
        aggs = []
        for i, f in enumerate(names):
            t = F.col(f"t{i}")
            aggs += [F.count_if(F.size(t) > 0).alias(f"n{i}"), F.sum(F.greatest(F.size(t), F.lit(0))).alias(f"s{i}")]
            aggs += [F.count_if(F.array_contains(t, w)).alias(f"d{i}_{j}") for j, w in enumerate(todo[f])]
        r = staged.agg(*aggs).first()
        for i, f in enumerate(names):
            s = self.cache.setdefault(f, FieldStats())
            s.docs, s.terms = r[f"n{i}"], r[f"s{i}"] or 0
            s.df |= {w: r[f"d{i}_{j}"] for j, w in enumerate(todo[f])}


def lexical_terms(m: Mapping, name: str) -> Column:
    f = m.resolve(name)
    if f.is_list:
        return F.flatten(F.transform(F.coalesce(column(name), F.array().cast("array<string>")), lambda x: analyze(x, "generic"))) if (f.lexical or "generic") == "generic" else analyze(
            F.array_join(column(name), "\n"), f.lexical
        )
    return analyze(column(name), f.lexical or "generic")


def _lexical(corpus: Corpus, name: str) -> str:
    f = corpus.mapping.resolve(name)
    if f is None or not f.lexical:
        raise UserError(f"field {name!r} is not declared for lexical search")
    return f.lexical


def rewrite(q: Any, corpus: Corpus) -> Any:
    """multi_match to dis_max (best_fields) or bool (most_fields) of matches on the fields that exist."""
    if isinstance(q, dsl.MultiMatch):
        parts = tuple(dsl.Match(f, q.query) for f in corpus.mapping.expand(list(q.fields), corpus.present))
        if not parts:
            return dsl.Bool()
        return dsl.DisMax(parts, q.tie) if q.kind == "best_fields" else dsl.Bool(should=parts)
    if isinstance(q, dsl.Bool):
        return dsl.Bool(*(tuple(rewrite(x, corpus) for x in c) for c in (q.should, q.must, q.must_not)))
    if isinstance(q, dsl.DisMax):
        return dsl.DisMax(tuple(rewrite(x, corpus) for x in q.queries), q.tie)
    return q


def _wanted(q: Any, corpus: Corpus, out: dict[str, set[str]]) -> None:
    if isinstance(q, dsl.Match):
        out.setdefault(q.field, set()).update(analyze_query(q.query, _lexical(corpus, q.field)))
    for part in getattr(q, "queries", ()) or [x for c in ("should", "must", "must_not") for x in getattr(q, c, ())]:
        _wanted(part, corpus, out)


def bm25(tf: Column, length: Column, stats: FieldStats, term: str) -> Column:
    """Weight of a term in a document: idf * tf / (tf + k1 (1 - b + b length / average))."""
    n = stats.df.get(term, 0)
    idf = math.log(1 + (stats.docs - n + 0.5) / (n + 0.5))
    average = stats.terms / stats.docs if stats.docs else 1.0
    return F.lit(idf) * tf / (tf + K1 * (1 - B + B * length / F.lit(average)))


class Compiler:
    """Compiles one query tree; ``docs`` gains the columns that the expressions need."""

    def __init__(self, corpus: Corpus, where: Column | None):
        self.corpus, self.where, self.docs = corpus, where, corpus.docs
        self.added: dict[tuple, str] = {}

    def compile(self, q: Any) -> tuple[DataFrame, Column, Column]:
        """(documents, matches, score). The filter is not applied yet."""
        q = rewrite(q, self.corpus)
        wanted: dict[str, set[str]] = {}
        _wanted(q, self.corpus, wanted)
        self.corpus.stats(wanted)
        for f, terms in wanted.items():
            self._frequencies(f, sorted(terms))
        hit, score = self.node(q)
        return self.docs, hit, score

    def _frequencies(self, name: str, terms: list[str]) -> None:
        """A column with the document's length and the frequencies of the query's terms: each text is analysed once, or none where
        there are postings."""
        if self.corpus.postings is not None:
            key = f"_tf_{len(self.added)}"
            if terms:
                of = [F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"{key}_{i}") for i, w in enumerate(terms)]
                found = self.corpus.postings.of({name: terms}).groupBy("_seq").agg(F.max("n").alias(f"{key}_n"), *of)
                self.docs = self.docs.join(found, "_seq", "left")
            for i, w in enumerate(terms):
                self.added[name, w] = f"coalesce({key}_{i}, 0)"
            self.added[name, None] = f"coalesce({key}_n, 0)"
            return
        t, key = self.corpus.terms(name), f"_tf_{len(self.added)}"
        staged = self.docs.withColumn("_terms", t)
        times = lambda w: F.size(F.filter("_terms", lambda x: x == w))
        found = F.struct(F.size("_terms").alias("n"), F.array(*[times(w) for w in terms] or [F.lit(0)]).alias("tf"))
        self.docs = staged.withColumn(key, found).drop("_terms")
        for i, w in enumerate(terms):
            self.added[name, w] = f"{key}.tf[{i}]"
        self.added[name, None] = f"{key}.n"

    def node(self, q: Any) -> tuple[Column, Column]:
        no, zero = F.lit(False), F.lit(0.0)
        if isinstance(q, dsl.MatchAll):
            return F.lit(True), F.lit(1.0)
        if isinstance(q, dsl.Match):
            terms = Counter(analyze_query(q.query, _lexical(self.corpus, q.field)))
            if not terms:
                return no, zero
            stats = self.corpus.cache[q.field]
            length = F.expr(self.added[q.field, None])
            tf = {w: F.expr(self.added[q.field, w]) for w in terms}
            score = reduce(add, [F.when(tf[w] > 0, times * bm25(tf[w], length, stats, w)).otherwise(zero) for w, times in sorted(terms.items())])
            return reduce(and_ if q.operator == "and" else or_, [tf[w] > 0 for w in terms]), score
        if isinstance(q, dsl.Bool):
            should, must, never = ([self.node(x) for x in c] for c in (q.should, q.must, q.must_not))
            if not should and not must:
                return no, zero
            hit = reduce(and_, [h for h, _ in must]) if must else reduce(or_, [h for h, _ in should])
            hit = reduce(and_, [~h for h, _ in never], hit)
            return hit, reduce(add, [F.when(h, s).otherwise(zero) for h, s in should + must])
        if isinstance(q, dsl.DisMax):
            parts = [self.node(x) for x in q.queries]
            scores = [F.when(h, s).otherwise(zero) for h, s in parts]
            best = F.greatest(*scores) if len(scores) > 1 else scores[0]
            return reduce(or_, [h for h, _ in parts]), best + q.tie * (reduce(add, scores) - best)
        if isinstance(q, (dsl.Knn, dsl.Semantic)):
            return self._neighbours(q)
        raise UserError(f"{type(q).__name__} can't stand inside another query")

    def _neighbours(self, q: Any) -> tuple[Column, Column]:
        name = f"_knn_{len(self.added)}"
        self.added[name,] = name
        top = nearest(self.corpus, q, self.where).select("_id", F.col("_score").alias(name))
        # at most MOST_CANDIDATES rows of an id and a number
        self.docs = self.docs.join(F.broadcast(top), "_id", "left")
        return F.col(name).isNotNull(), F.coalesce(F.col(name), F.lit(0.0))


def nearest(corpus: Corpus, q: Any, where: Column | None) -> DataFrame:
    """(_id, _score) of the k nearest documents among those that the filter passes; of several vectors the best counts."""
    f = corpus.mapping.resolve(q.field)
    if f is None or f.semantic is None:
        raise UserError(f"field {q.field!r} is not declared for semantic search")
    if isinstance(q, dsl.Semantic):
        if not f.semantic.model:
            raise UserError(f"field {q.field!r} has no model")
        if corpus.embed is None:
            raise UserError("no embedding models are configured")
        vector = list(corpus.embed(f.semantic.model, q.query))
    else:
        vector = list(q.vector)
    k = q.k or 10
    final = min(dsl.MOST_CANDIDATES, max(k, q.candidates or round(1.5 * k)))
    docs = corpus.docs if where is None else corpus.docs.where(where)
    v = F.col(f"`{vector_column(q.field)}`")
    own = lambda x: similarity(quantize(x, f.semantic.quantize), vector, f.semantic.distance)
    if f.semantic.quantize != "float32" and (stored := codes_column(q.field, f.semantic.quantize)) in docs.columns:
        # the codes alone are read, a byte for each component
        v, own = F.col(f"`{stored}`"), lambda x: similarity(restored(x), vector, f.semantic.distance)
    score = F.array_max(F.transform(v, own)) if f.is_list else own(v)
    return docs.select("_id", "_seq", score.alias("_score")).where("_score is not null").orderBy(F.desc("_score"), "_seq").limit(final).select("_id", "_score")
