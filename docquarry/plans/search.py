"""Search requests as DataFrame plans."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.errors import UserError
from docquarry.mapping import Mapping
from docquarry.models import Models
from docquarry.operators import filters as flt
from docquarry.operators import rerank, sorting
from docquarry.operators.retrieve import Compiler, Corpus, Postings, nearest
from docquarry.plans import dsl


def corpus_of(docs: DataFrame, mapping: Mapping, models: Models | None = None, postings: Postings | None = None) -> Corpus:
    """A searchable corpus. ``docs``: ``_id``, the mapping's fields and, for insertion order, ``_seq`` (else the id's order)."""
    if "_seq" not in docs.columns:
        docs = docs.withColumn("_seq", F.col("_id"))
    present = [c for c in docs.columns if not c.startswith("_") and "__" not in c]
    embed = None if models is None else lambda model, text: models.get("embedding", model).embed([text], "query")[0].tolist()
    return Corpus(docs, mapping, present, embed, postings=postings)


class Search:
    """One request against one corpus."""

    def __init__(self, corpus: Corpus, request: dsl.SearchRequest, models: Models | None = None):
        self.corpus, self.models = corpus, models
        self.request = dsl.normalize(request)
        self.where: Column | None = flt.filters(corpus.mapping, request.filters)

    def matches(self, q: Any = None) -> DataFrame:
        """All documents that match, with ``_score``; what facets count."""
        q = self.request.query if q is None else q
        if isinstance(q, dsl.CrossEncoder):
            return self.matches(q.retrieve)
        if isinstance(q, dsl.Rrf):
            ids = reduce(DataFrame.union, [self.matches(c).select("_id") for c in q.retrieve]).distinct()
            return self.corpus.docs.join(ids, "_id", "left_semi").withColumn("_score", F.lit(None).cast("double"))
        if isinstance(q, (dsl.Knn, dsl.Semantic)):
            return self.corpus.docs.join(F.broadcast(nearest(self.corpus, q, self.where)), "_id")  # at most MOST_CANDIDATES rows
        docs, hit, score = Compiler(self.corpus, self.where).compile(q)
        docs = docs if self.where is None else docs.where(self.where)
        return docs.where(hit).withColumn("_score", score)

    def top(self, q: Any, size: int) -> DataFrame:
        """The best ``size`` documents with ``_score``: a bounded result."""
        best = [F.desc("_score"), F.asc("_seq")]
        if isinstance(q, dsl.Rrf):
            lists = [self.top(c, q.window or size).select("_id", "_score", "_seq") for c in q.retrieve]
            fused = rerank.fuse(lists, q.k)
            return self.corpus.docs.join(F.broadcast(fused), "_id").orderBy(*best).limit(size)
        if isinstance(q, dsl.CrossEncoder):
            if self.models is None:
                raise UserError("no ranking models are configured")
            model = self.models.get("ranker", q.model)
            window = self.top(q.retrieve, q.window or size)
            return rerank.cross_encode(window, q.query, rerank.render(q.template, self.corpus.mapping), model.score).orderBy(*best).limit(size)
        return self.matches(q).orderBy(*best).limit(size)

    def hits(self) -> DataFrame:
        """Requested fields of the top documents, in order; ``_id`` and ``_score`` are always there."""
        r = self.request
        if r.sort:
            found = self.matches().orderBy(*sorting.order(self.corpus.mapping, r.sort)).limit(r.size)
            if not any(s.field == "_score" for s in r.sort):
                found = found.withColumn("_score", F.lit(None).cast("double"))
        else:
            found = self.top(r.query, r.size)
        return found.select("_id", "_score", *[flt.column(n) for n in self.projection()])

    def projection(self) -> list[str]:
        m, out = self.corpus.mapping, []
        for n in self.request.fields:
            if n in ("_id", "_score"):
                continue
            if "*" in n:
                out += [p for p in m.expand([n], self.corpus.present) if m.need(p, "store") and p not in out]
            elif m.need(n, "store") and n not in out:
                out.append(n)
        return [n for n in out if n in self.corpus.present]
