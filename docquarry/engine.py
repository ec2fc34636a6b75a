"""Indexes and the engine that holds them: ingest, search, suggestions, inference, administration."""

from __future__ import annotations

import datetime as dt
import os
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.errors import UserError
from docquarry.functions.vectors import codes
from docquarry.mapping import Mapping
from docquarry.models import Models, streamed
from docquarry.operators import aggs, filters, rag, suggest
from docquarry.operators.retrieve import Postings, codes_column, length_column, lexical_terms, vector_column
from docquarry.plans import dsl
from docquarry.plans.search import Search, corpus_of
from docquarry.sources import store
from docquarry.sources.readers import documents, payload_lines, read_files


def _plain(v: Any) -> Any:
    """A stored value as JSON has it."""
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=dt.UTC).isoformat().replace("+00:00", "Z") if v.tzinfo is None else v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return v


def embedding_udf(model: Any):
    @F.pandas_udf("array<float>")
    def embed(t: pd.Series) -> pd.Series:
        return pd.Series([x.astype("float32").tolist() for x in model.embed(t.tolist(), "document")])

    return embed


def _totals(length: Column) -> list[Column]:
    """Documents that have terms, and how many terms."""
    return [F.count_if(length > 0), F.sum(length)]


class Index:
    """One index in a folder that all executors share. Changes are staged and become visible with ``flush``."""

    def __init__(self, spark: SparkSession, mapping: Mapping, root: str, models: Models | None = None):
        self.spark, self.models = spark, models or Models()
        for f in mapping.fields.values():
            if f.semantic is not None and f.semantic.model:
                self.models.get("embedding", f.semantic.model)
        self.client = store.StateClient(spark, root)
        self.manifest = self.client.manifest()
        self.mapping = self.manifest.mapping.migrate(mapping) if self.manifest else mapping
        self.pending: list[tuple[str, Any]] = []
        self.pending_folders: list[str] = []
        self.metrics: Counter = Counter()

    # ---- documents -------------------------------------------------------------------------------------------------
    def _empty(self) -> DataFrame:
        schema = self.mapping.to_struct_type([n for n, f in self.mapping.fields.items() if not f.wildcard and "." not in n])
        empty = self.spark.createDataFrame([], schema).withColumn("_seq", F.lit(0).cast("long"))
        for f in self.mapping.fields.values():
            if f.semantic is not None and not f.wildcard:
                empty = empty.withColumn(vector_column(f.name), F.lit(None).cast("array<array<float>>" if f.is_list else "array<float>"))
        return empty

    def docs(self) -> DataFrame:
        """The current version's documents; fields that none of them has yet are null."""
        m, empty = self.manifest, self._empty()
        if m is None or not m.segments:
            return empty
        docs = store.documents(self.client, m)
        # codes count only where all segments have them: the mapping may have asked for others, or none, before
        for f in self.mapping.fields.values():
            if f.semantic is not None and (c := codes_column(f.name, f.semantic.quantize)) in docs.columns and not all(f'"{c}"' in s.schema for s in m.segments):
                docs = docs.drop(c)
        return docs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in empty.schema if f.name not in docs.columns})

    def add(self, docs: list[dict]) -> None:
        """Stage documents given as dicts; later ones replace earlier ones with the same id."""
        if docs:
            self.add_documents(documents(payload_lines(self.spark, docs), self.mapping))

    def add_files(self, location: str | dict, recursive: bool = False) -> None:
        """Stage documents of files. Of those with the same id the last one counts: by path, then by place in the file."""
        self.add_documents(read_files(self.spark, location, self.mapping, recursive))

    def add_documents(self, docs: DataFrame) -> None:
        """Stage documents; ``_order``, where there is such a column, says which come later, else the rows' order does."""
        path = f"{self.client.root}/_staging/{uuid.uuid4().hex}"
        order = F.monotonically_increasing_id()
        docs.withColumn("_order", F.struct(F.col("_order"), order) if "_order" in docs.columns else order).write.parquet(path)
        self.pending.append(("add", path))

    def delete(self, ids: list[str] | None = None, where: dict | None = None) -> None:
        """Stage a deletion by ids, by a filter, or of everything."""
        if ids is not None:
            self.pending.append(("ids", [str(i) for i in ids]))
        else:
            f = None if where is None else filters.filters(self.mapping, dsl.Filters(*(dsl.parse_filter(where[k]) if where.get(k) else None for k in ("include", "exclude"))))
            self.pending.append(("where", f))

    def done(self, name: str) -> int:
        """The last batch of a stream that is in the index; -1: none."""
        return self.manifest.batches.get(name, -1) if self.manifest else -1

    def flush(self, batch: tuple[str, int] | None = None) -> int:
        """Apply what is staged as a new version; how many documents the index gained (or lost).

        Only new documents and the numbers of replaced or deleted ones are written; of old documents only what finds them is
        read (ids, or a filter's fields). Then segments are merged as the index's policy says.
        """
        if not self.pending and batch is None:
            return 0
        began, old = time.time(), self.manifest
        m = store.Manifest(self.mapping, old.seqnum + 1 if old else 1, next_seq=old.next_seq if old else 0, batches=(old.batches if old else {}) | ({batch[0]: batch[1]} if batch else {}))
        m.segments, m.deletions, m.deleted = (list(old.segments), list(old.deletions), old.deleted) if old else ([], [], 0)
        m.totals = {k: list(v) for k, v in old.totals.items()} if old else {}
        live, fresh, gone = self.docs(), [], []
        for kind, x in self.pending:
            if kind == "add":
                staged = self.spark.read.parquet(x)
                ids = staged.select("_id")
                if old and old.segments:
                    gone.append(live.join(ids, "_id", "left_semi"))
                fresh = [d.join(ids, "_id", "left_anti") for d in fresh] + [self._last(staged)]
            else:
                hit = F.col("_id").isin(x) if kind == "ids" else F.lit(True) if x is None else x
                if old and old.segments:
                    gone.append(live.where(hit))
                known = self._empty().schema
                fresh = [d.withColumns({f.name: F.lit(None).cast(f.dataType) for f in known if f.name not in d.columns}).where(~hit) for d in fresh]
        if gone:
            self._delete(m, gone)
        if fresh:
            self._append(m, fresh)
        self._publish(store.listed(self.client, m, old))
        for kind, x in self.pending:
            if kind == "add":
                self.client.delete(x.removeprefix(self.client.root + "/"))
        self.pending = []
        chosen = store.to_merge(self.manifest, self._merge_policy())
        if chosen:
            self._merge(chosen, None)
        store.sweep(self.client)
        self.metrics["flushes"] += 1
        self.metrics["flush_seconds"] += time.time() - began
        return m.docs - (old.docs if old else 0)

    def _last(self, staged: DataFrame) -> DataFrame:
        """Of a batch's rows with one id the last one. Whole rows are moved only where an id comes twice."""
        if staged.groupBy("_id").count().where("count > 1").isEmpty():
            return staged
        whole = F.struct(*[F.col(f"`{c}`") for c in staged.columns])
        return staged.groupBy("_id").agg(F.max_by(whole, "_order").alias("d")).select("d.*")

    def _numbered(self, docs: DataFrame, m: store.Manifest) -> DataFrame:
        """``_seq`` in the order of arrival, above all numbers so far."""
        return docs.orderBy("_order").drop("_order").withColumn("_seq", F.monotonically_increasing_id() + m.next_seq)

    def _delete(self, m: store.Manifest, gone: list[DataFrame]) -> None:
        """A list of deleted rows, if there are any; the totals lose what these had."""
        names = list(m.totals)
        # segments of earlier versions have lengths in columns of their documents, not among the postings
        kept = [[F.col(f"`{length_column(n)}`") if length_column(n) in g.columns else F.lit(None).cast("long").alias(length_column(n)) for n in names] for g in gone]
        rows = reduce(DataFrame.union, [g.select("_seq", *k) for g, k in zip(gone, kept, strict=True)]).distinct()
        if names:
            found = store.lengths(store.postings(self.client, self.manifest)).groupBy("_seq").agg(*[F.max(F.when(F.col("field") == n, F.col("n"))).alias(f"_len_{i}") for i, n in enumerate(names)])
            both = [F.coalesce(F.col(f"`{length_column(n)}`"), F.col(f"_len_{i}")).alias(length_column(n)) for i, n in enumerate(names)]
            rows = rows.join(found, "_seq", "left").select("_seq", *both)
        name = f"del-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.client.root}/{name}")
        r = self.spark.read.schema(rows.schema).parquet(f"{self.client.root}/{name}").agg(F.count("*"), *[x for n in names for x in _totals(F.col(f"`{length_column(n)}`"))]).first()
        if r[0]:
            m.deletions.append(name)
            m.deleted += r[0]
            for i, n in enumerate(names):
                m.totals[n] = [m.totals[n][0] - r[1 + 2 * i], m.totals[n][1] - (r[2 + 2 * i] or 0)]
        else:
            self.client.delete(name)

    def _append(self, m: store.Manifest, fresh: list[DataFrame]) -> None:
        """A segment of new documents, batch after batch, with postings of their lexical fields."""
        schema = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.drop("_order") for d in fresh]).schema
        name, modelled = f"seg-{uuid.uuid4().hex}", any(f.semantic is not None and f.semantic.model for f in self.mapping.fields.values())
        path = f"{self.client.root}/{name}/docs"
        for d in fresh:
            docs = self._numbered(d.select("_order", *[(F.col(f"`{f.name}`") if f.name in d.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]), m)
            if modelled:  # rows are joined to their vectors by what is numbered once
                staged = f"{self.client.root}/_staging/{uuid.uuid4().hex}"
                docs.write.parquet(staged)
                self.pending_folders.append(staged)
                docs = self._embedded(self.spark.read.parquet(staged))
            docs = self._quantised(docs)
            docs.write.mode("append").parquet(path)
            out = self.spark.read.schema(docs.schema).parquet(path)
            m.next_seq = max(m.next_seq, (out.agg(F.max("_seq")).first()[0] or 0) + 1)
        lexical = [n for n in out.columns if not n.startswith("_") and "__" not in n and (f := self.mapping.resolve(n)) is not None and f.lexical]
        segment = store.add_postings(self.client, name, out, {n: lexical_terms(self.mapping, n) for n in lexical})
        if not segment.docs:
            self.client.delete(segment.name)
            return
        m.segments.append(segment)
        written = self.spark.read.schema(store.POSTINGS).parquet(f"{self.client.root}/{name}/terms")
        for r in store.lengths(written).groupBy("field").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).collect():  # a row for each field
            had = m.totals.get(r["field"], [0, 0])
            m.totals[r["field"]] = [had[0] + r["docs"], had[1] + r["terms"]]

    def _merge_policy(self) -> dict | str | None:
        return (self.mapping.config.get("indexer") or {}).get("merge_policy")

    def _publish(self, m: store.Manifest) -> None:
        self.client.publish(m)
        self.manifest = m
        for path in self.pending_folders:
            self.client.delete(path.removeprefix(self.client.root + "/"))
        self.pending_folders = []

    def _merge(self, segments: list[store.Segment], files: int | None) -> None:
        """Some segments as one; deletion lists go when all segments are merged."""
        old = self.manifest
        rest = [s for s in old.segments if s not in segments]
        one = store.write_segment(self.client, store.documents(self.client, old, segments), store.postings(self.client, old, segments), files)
        m = store.Manifest(self.mapping, old.seqnum + 1, next_seq=old.next_seq, batches=old.batches, totals=old.totals, segments=rest + [one] * (one.docs > 0))
        if rest:
            m.deletions, m.deleted = old.deletions, old.deleted - (sum(s.docs for s in segments) - one.docs)
        self._publish(store.listed(self.client, m, old))
        self.metrics["merges"] += 1

    def _quantised(self, docs: DataFrame) -> DataFrame:
        """Codes of vectors beside them, where the mapping asks for quantisation; whole vectors stay for changes of the mapping."""
        for f in self.mapping.fields.values():
            if f.semantic is not None and f.semantic.quantize != "float32" and (v := vector_column(f.name)) in docs.columns:
                kind = f.semantic.quantize
                own = F.transform(F.col(f"`{v}`"), lambda x: codes(x, kind)) if f.is_list else codes(F.col(f"`{v}`"), kind)  # noqa: B023
                docs = docs.withColumn(codes_column(f.name, kind), own)
        return docs

    def _embedded(self, docs: DataFrame) -> DataFrame:
        """Vectors of semantic fields that came without; each distinct text is embedded once."""
        for f in [f for f in self.mapping.fields.values() if f.semantic is not None and f.semantic.model and f.name in docs.columns]:
            model, v = self.models.get("embedding", f.semantic.model), vector_column(f.name)
            kind = "array<array<float>>" if f.is_list else "array<float>"
            if v not in docs.columns:
                docs = docs.withColumn(v, F.lit(None).cast(kind))
            c = F.col(f"`{f.name}`")
            todo = docs.where(F.col(f"`{v}`").isNull() & c.isNotNull())
            texts = todo.select(F.explode(c).alias("text") if f.is_list else c.alias("text")).distinct()

            known = texts.withColumn("vector", embedding_udf(model)("text"))
            if f.is_list:
                each = todo.select("_id", F.posexplode(c).alias("pos", "text")).join(known, "text")
                made = each.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vector"))), lambda x: x["vector"]).alias("_made"))
            else:
                made = todo.select("_id", c.alias("text")).join(known, "text").select("_id", F.col("vector").alias("_made"))
            docs = docs.join(made, "_id", "left").withColumn(v, F.coalesce(F.col(f"`{v}`"), F.col("_made"))).drop("_made")
        return docs

    def merge(self, files: int | None = None) -> None:
        """Rewrite the current version as one segment of so many files, or as many as the merge policy says."""
        m = self.manifest
        if m is not None and m.segments:
            self._merge(m.segments, files or store.merge_files(sum(f.size for f in m.files), m.docs, self._merge_policy()) or 1)
            store.sweep(self.client)

    # ---- requests --------------------------------------------------------------------------------------------------
    def corpus(self):
        """The current version with its postings and totals."""
        m = self.manifest
        indexed = Postings(store.postings(self.client, m), {k: tuple(v) for k, v in m.totals.items()}) if m and m.segments else None
        return corpus_of(self.docs(), self.mapping, self.models, indexed)

    def plan(self, request: dict | None) -> Search:
        return Search(self.corpus(), dsl.parse_search(request), self.models)

    def search(self, request: dict | None = None) -> dict:
        """A response: took, hits, aggs, ts and, if asked for, the generated answer."""
        began = time.time()
        request = dsl.parse_search(request)
        parsed = time.time()
        corpus = self.corpus()
        opened = time.time()
        s = Search(corpus, request, self.models)
        r = s.request
        plan = s.hits() if r.size else None
        planned = time.time()
        rows = plan.collect() if plan is not None else []  # at most `size` rows
        collected = time.time()
        hits = [{k: _plain(v) for k, v in row.asDict().items() if v is not None or k == "_score"} for row in rows]
        searched = time.time()
        found = aggs.facets(s.matches(), self.mapping, r.aggs) if r.aggs else {}
        out = {"hits": hits, "aggs": found, "ts": int(time.time() * 1000)}
        if r.rag is not None:
            out["response"] = self.answer(s, r.rag)
        self.metrics["searches"] += 1
        ended = time.time()
        # reranking is a part of the plan that is collected: its share isn't told apart from the search's
        out["took"] = {"total": ended - began, "request": parsed - began, "open": opened - parsed, "plan": planned - opened, "search": collected - planned, "fetch": searched - collected, "agg": ended - searched}
        self.metrics["search_seconds"] += ended - began
        return out

    def answer(self, s: Search, r: dsl.Rag) -> str:
        return "".join(self._answer(s, r, False))

    def _answer(self, s: Search, r: dsl.Rag, stream: bool) -> Iterator[str]:
        model = self.models.get("completion", r.model)
        top = s.top(s.request.query, r.top_docs)
        fields = [f for f in r.fields or s.corpus.present if s.corpus.mapping.resolve(f) and f in s.corpus.present]
        rows = rag.context(top, self.mapping, fields, r.max_doc_length).orderBy(F.desc("_score"), "_seq").select("context").collect()
        self.metrics["answers"] += 1
        prompt = rag.prompt(r.prompt, [x["context"] for x in rows])
        yield from streamed(model, prompt, r.max_response_length) if stream else [model.complete(prompt, r.max_response_length)]

    def search_stream(self, request: dict) -> Iterator[dict]:
        """The response without its answer, then the answer's parts as they arrive, each with its time, the last one marked."""
        parsed = dsl.parse_search(request)
        if parsed.rag is None:
            raise UserError("only requests for an answer are streamed")
        yield {"results": self.search({k: v for k, v in request.items() if k != "rag"})}
        began = time.time()
        for part in self._answer(Search(self.corpus(), parsed, self.models), parsed.rag, True):
            now = time.time()
            yield {"rag": {"token": part, "took": now - began, "last": False}}
            began = now
        yield {"rag": {"token": "", "took": time.time() - began, "last": True}}

    def suggest(self, request: dict) -> list[dict]:
        began = time.time()
        rows = suggest.suggest(self.docs(), self.mapping, dsl.parse_suggest(request)).collect()
        self.metrics["suggestions"] += 1
        self.metrics["suggest_seconds"] += time.time() - began
        return [{"text": x["text"], "score": x["score"]} for x in rows]

    def stats(self) -> dict:
        """Versions, files, documents and, by field, documents that have it."""
        docs, m = self.docs(), self.manifest
        names = [c for c in docs.columns if not c.startswith("_") and "__" not in c]
        r = docs.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in names]).first().asDict()
        return {"version": m.seqnum if m else 0, "segments": [{"name": x.name, "docs": x.docs, "size": x.size} for x in m.segments] if m else [], "files": [vars(f) for f in m.files] if m else [], "deleted": m.deleted if m else 0, "docs": r.pop("_n"), "fields": r}

    def replicate(self, root: str) -> list[tuple[str, str]]:
        """Bring a copy of the index elsewhere up to date."""
        return store.replicate(self.client, store.StateClient(self.spark, root))


#: Settings of the sections ``core`` and ``searcher`` with their defaults.
SETTINGS: dict[str, dict[str, Any]] = {"core": {"host": "0.0.0.0", "port": 8080, "loglevel": "warn", "cache_dir": None}, "searcher": {"host": "0.0.0.0", "port": 8080}}


def settings(config: dict) -> dict[str, dict[str, Any]]:
    """The two sections, defaults filled in; ``DOCQUARRY_<SECTION>_<KEY>`` in the environment goes first. Unknown keys are an error."""
    out: dict[str, dict[str, Any]] = {}
    for section, defaults in SETTINGS.items():
        given = config.get(section) or {}
        if set(given) - set(defaults):
            raise UserError(f"unknown settings {sorted(set(given) - set(defaults))} of {section}")
        out[section] = {}
        for k, v in (defaults | given).items():
            v = os.environ.get(f"DOCQUARRY_{section}_{k}".upper(), v)
            try:
                out[section][k] = int(v) if k == "port" else v
            except ValueError:
                raise UserError(f"port of {section} must be a number, not {v!r}") from None
    return out


class Engine:
    """All indexes of a configuration."""

    def __init__(self, spark: SparkSession, config: dict, root: str):
        if set(config) - {"inference", "searcher", "core", "schema"}:
            raise UserError(f"unknown sections {sorted(set(config) - {'inference', 'searcher', 'core', 'schema'})}")
        self.settings = settings(config)
        self.models = Models.parse(config.get("inference"))
        self.indexes = {n: Index(spark, Mapping.parse(n, s), f"{root.rstrip('/')}/{n}", self.models) for n, s in (config.get("schema") or {}).items()}

    @staticmethod
    def from_yaml(spark: SparkSession, path: str, root: str) -> Engine:
        import yaml

        with open(path, encoding="utf-8") as f:
            return Engine(spark, yaml.safe_load(f) or {}, root)

    def index(self, name: str) -> Index:
        for i in self.indexes.values():
            if i.mapping.answers_to(name):
                return i
        raise UserError(f"no index {name!r}")

    def names(self) -> list[str]:
        return sorted(self.indexes)

    def embed(self, model: str, texts: list[str]) -> list[list[float]]:
        return self.models.get("embedding", model).embed(texts, "raw").tolist()

    def complete(self, model: str, prompt: str, max_tokens: int = 64) -> str:
        return self.models.get("completion", model).complete(prompt, max_tokens)

    def health(self) -> dict:
        return {"status": "ok"}

    def metrics(self) -> dict[str, dict[str, float]]:
        """Counts and seconds by index, and how many documents it holds."""
        return {n: dict(i.metrics) | {"docs": i.manifest.docs if i.manifest else 0} for n, i in self.indexes.items()}

    def metrics_text(self) -> str:
        """The same in the text format that monitoring systems read."""
        rows = [(k, n, v) for n, m in self.metrics().items() for k, v in m.items()]
        kinds = {k: "gauge" if k == "docs" else "counter" for k, _, _ in rows}
        out = []
        for k in sorted(kinds):
            out += [f"# TYPE docquarry_{k} {kinds[k]}", *[f'docquarry_{k}{{index="{n}"}} {v:g}' for x, n, v in rows if x == k]]
        return "\n".join(out) + "\n"
