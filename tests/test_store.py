"""Segments, postings, deletions, versions, and the order of arrival."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.engine import Index
from docquarry.errors import UserError
from docquarry.mapping import Mapping
from docquarry.plans import dsl
from docquarry.plans.search import Search, corpus_of
from docquarry.sources import store

LEX = {"type": "text", "search": {"lexical": {"analyze": "generic"}}}
FIELDS = {"title": LEX, "body": LEX, "n": {"type": "int", "filter": True}}


def index(spark, root, fields=FIELDS, **more):
    return Index(spark, Mapping.parse("t", {"fields": fields} | more), f"file://{root}")


def test_last_file_wins_whatever_its_size(spark, tmp_path):
    """Spark reads large files first; the path says which comes later, then the place in the file."""
    folder = tmp_path / "in"
    folder.mkdir()
    pad = "x" * 2000
    (folder / "a.jsonl").write_text("\n".join(json.dumps({"_id": k, "title": "old", "body": pad}) for k in (1, 2)))
    (folder / "b.jsonl").write_text("\n".join(json.dumps({"_id": k, "title": f"new {j}", "body": pad}) for j in range(300) for k in (1, 3)))
    (folder / "c.json").write_text(json.dumps([{"_id": 3, "title": "array one"}, {"_id": 3, "title": "array two"}]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        i = index(spark, tmp_path / "i")
        for name in ("a.jsonl", "b.jsonl"):
            (folder / "both").mkdir(exist_ok=True)
            (folder / "both" / name).write_text((folder / name).read_text())
        i.add_files(f"file://{folder}/both")
        i.add_files(f"file://{folder}/c.json")
        i.flush()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {h["_id"]: h["title"] for h in i.search({"fields": ["title"], "size": 9})["hits"]}
    assert got == {"1": "new 299", "2": "old", "3": "array two"}


def test_flush_writes_only_what_is_new(spark, tmp_path):
    i = index(spark, tmp_path)
    i.add([{"_id": k, "title": f"word{k} common", "n": k} for k in range(200)])
    assert i.flush() == 200
    first = i.manifest
    i.add([{"_id": 7, "title": "seven again"}])
    assert i.flush() == 0
    second = i.manifest
    assert second.segments[: len(first.segments)] == first.segments and len(second.segments) == len(first.segments) + 1
    assert second.segments[-1].docs == 1 and len([f for f in second.files if f.name.startswith(second.segments[-1].name)]) == 1
    assert set(first.files) <= set(second.files) and second.docs == 200 and second.deleted == 1
    assert i.flush() == 0 and i.manifest is second  # nothing staged, nothing written
    assert not i.client.exists("_staging") or not [f for f in i.client.files("_staging") if f.name.endswith(".parquet")]


def test_match_reads_the_row_groups_of_its_terms(spark, tmp_path):
    i = index(spark, tmp_path)
    before = spark._jsc.hadoopConfiguration().get("parquet.block.size")
    spark._jsc.hadoopConfiguration().set("parquet.block.size", "20000")
    spark._jsc.hadoopConfiguration().set("parquet.page.row.count.limit", "500")
    try:
        i.add([{"_id": k, "title": " ".join(f"w{(k * j) % 997:04d}" for j in range(1, 40)), "body": "b"} for k in range(600)])
        i.flush()
    finally:
        spark._jsc.hadoopConfiguration().unset("parquet.page.row.count.limit")
        (spark._jsc.hadoopConfiguration().set("parquet.block.size", before) if before else spark._jsc.hadoopConfiguration().unset("parquet.block.size"))
    rows = i.corpus().postings.of({"title": ["w0500"]})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "In" in plan or "EqualTo(term,w0500)" in plan
    assert "EqualTo(field,title)" in plan
    rows.collect()
    node = rows._jdf.queryExecution().executedPlan()
    scans = []
    todo = [node]
    while todo:
        x = todo.pop()
        if "Scan" in x.nodeName():
            scans.append(x)
        todo += [x.children().apply(k) for k in range(x.children().size())]
    read = sum(s.metrics().apply("numOutputRows").value() for s in scans)
    every = i.corpus().postings.rows.count()
    assert 0 < read < every / 3
    s = i.plan({"query": {"match": {"title": "w0500"}}})
    plan = s.hits()._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "regexp" not in plan  # documents without the term are left out, no text is analysed


def test_like_analysed_texts(spark, tmp_path):
    """Upserts, deletions and merges in any order: hits and scores equal those of an index-free search of what is left."""
    r = random.Random(5)
    words = "red green blue dress shirt shoe old new".split()
    i = index(spark, tmp_path, config={"indexer": {"merge_policy": "none"}})
    left: dict[str, dict] = {}
    arrived = 0
    for step in range(5):
        for _ in range(2):
            batch = [{"_id": str(r.randrange(25)), "title": " ".join(r.choices(words, k=r.randint(1, 6))), "body": " ".join(r.choices(words, k=r.randint(0, 9))), "n": r.randrange(9)} for _ in range(8)]
            i.add(batch)
            for d in batch:
                left[d["_id"]] = d
        if step == 2:
            i.delete(where={"include": {"range": {"n": {"lt": 3}}}})
            left = {k: d for k, d in left.items() if not d["n"] < 3}
        if step == 3:
            i.delete(ids=["1", "2", "3"])
            left = {k: d for k, d in left.items() if k not in ("1", "2", "3")}
        i.flush()
        arrived += 1
        assert i.manifest.docs == len(left)
    request = {"query": {"bool": {"should": [{"match": {"title": "red dress"}}, {"match": {"body": "shoe new"}}], "must_not": [{"match": {"title": "blue"}}]}}, "size": 50, "filters": {"exclude": {"term": {"n": 8}}}}

    def hits(x):
        return sorted((h["_id"], round(h["_score"], 9)) for h in x)

    raw = corpus_of(spark.createDataFrame([(d["_id"], d["title"], d["body"] or None, d["n"]) for d in left.values()], "_id string, title string, body string, n int"), i.mapping)
    want = hits(x.asDict() for x in Search(raw, dsl.parse_search(request)).hits().collect())
    assert want and hits(i.search(request)["hits"]) == want
    i.merge(1)
    assert len(i.manifest.segments) == 1 and i.manifest.deleted == 0 and not i.manifest.deletions
    assert hits(i.search(request)["hits"]) == want
    assert hits(Index(spark, i.mapping, i.client.root).search(request)["hits"]) == want


def test_versions_and_policies(spark, tmp_path):
    i = index(spark, tmp_path / "a")
    other = index(spark, tmp_path / "a")
    i.add([{"_id": 1, "title": "a"}])
    i.flush()
    other.add([{"_id": 2, "title": "b"}])
    with pytest.raises(UserError):  # of two writers one is refused
        other.flush()
    assert i.client.versions() == [1] and i.client.manifest().docs == 1
    for k in range(2, 14):
        i.add([{"_id": k, "title": "a"}])
        i.flush()
    assert len(i.manifest.segments) <= store.TIER and i.manifest.docs == 13 and len(i.client.versions()) == 2
    named = {s.name for v in i.client.versions() for s in i.client.manifest(v).segments}
    assert {f for f in i.client.folders() if f.startswith("seg-")} == named
    m = store.Manifest(i.mapping, 1, segments=[store.Segment(f"s{k}", 10 * k + 1, 100, "{}") for k in range(20)])
    assert [s.docs for s in store.to_merge(m, None)] == [10 * k + 1 for k in range(10)] and store.to_merge(m, "none") == []
    assert store.to_merge(m, {"doc_count": {"max_merge_docs": 200}}) == [] and len(store.to_merge(m, {"doc_count": {"max_merge_docs": 2000}})) == 10
    m.deleted = 1000
    assert len(store.to_merge(m, None)) == 20
    with pytest.raises(UserError):
        store.to_merge(m, "nonesuch")
    assert i.flush() == 0 and i.docs().where(F.col("_id") == "5").count() == 1


def test_packed_files_by_their_first_bytes(spark, tmp_path):
    import bz2
    import gzip

    import zstandard

    body = b'{"_id": 1, "title": "one"}\n{"_id": 1, "title": "two"}\n'
    for k, raw in enumerate((gzip.compress(body), bz2.compress(body), zstandard.ZstdCompressor().compress(body), body)):
        path = tmp_path / f"docs{k}.jsonl"
        path.write_bytes(raw)
        i = index(spark, tmp_path / f"i{k}")
        i.add_files(f"file://{path}")
        assert i.flush() == 1 and i.search({"fields": ["title"]})["hits"][0]["title"] == "two", k


def test_settings_caches_and_metrics(spark, tmp_path, monkeypatch):
    from docquarry.engine import Engine, settings
    from docquarry.models import CachedEmbedder, HashEmbedder, Models
    from docquarry.sources.readers import parse_url

    monkeypatch.setenv("DOCQUARRY_CORE_PORT", "9000")
    assert settings({"core": {"port": 1, "host": "h"}})["core"] == {"host": "h", "port": 9000, "loglevel": "warn", "cache_dir": None}
    with pytest.raises(UserError):
        settings({"searcher": {"nope": 1}})
    asked = []

    class Spy(HashEmbedder):
        def embed(self, texts, task="raw"):
            asked.append(list(texts))
            return super().embed(texts, task)

    c = CachedEmbedder(Spy(8), most=2)
    assert (c.embed(["a", "b", "a"]) == HashEmbedder(8).embed(["a", "b", "a"])).all() and asked == [["a", "b"]]
    c.embed(["a"]), c.embed(["c"]), c.embed(["a"]), c.embed(["b"])
    assert asked == [["a", "b"], ["c"], ["b"]]
    m = Models.parse({"embedding": {"x": {"provider": "hash", "cache": {"inmem": {"max_size": 5}}}, "y": {"provider": "hash", "cache": False}}})
    assert m.embedding["x"].most == 5 and isinstance(m.embedding["y"], HashEmbedder)
    u = parse_url({"s3": {"bucket": "b", "prefix": "p", "endpoint": "http://h:1", "region": "r"}})
    assert u.path == "s3a://b/p" and dict(u.settings) == {"fs.s3a.bucket.b.endpoint": "http://h:1", "fs.s3a.bucket.b.endpoint.region": "r", "fs.s3a.bucket.b.path.style.access": "true"}
    e = Engine(spark, {"schema": {"x": {"fields": FIELDS}}}, f"file://{tmp_path}")
    e.index("x").add([{"_id": 1, "title": "a"}])
    e.index("x").flush()
    took = e.index("x").search({})["took"]
    assert set(took) == {"total", "request", "open", "plan", "search", "fetch", "agg"}
    text = e.metrics_text()
    assert 'docquarry_docs{index="x"} 1\n' in text and "# TYPE docquarry_search_seconds counter" in text
    for bad in ({"query": {"knn": {"field": "v", "query_vector": [1], "k": 20_000}}}, {"query": {"rrf": {"retrieve": [{"match_all": {}}], "rank_window_size": 20_000}}}):
        with pytest.raises(UserError):
            e.index("x").search(bad)


@pytest.mark.parametrize("kind", ["int8", "int4", "int1"])
def test_quantised_vectors_are_stored(spark, tmp_path, kind):
    """A request reads the codes, not the vectors, and scores as the quantised vectors do."""
    r = random.Random(2)
    fields = {"v": {"type": "text", "search": {"semantic": {"dim": 8, "quantize": kind}}}, "w": {"type": "text[]", "search": {"semantic": {"dim": 8, "quantize": kind}}}}
    i = index(spark, tmp_path, fields)
    vector = lambda: [round(r.uniform(-1, 1), 3) for _ in range(8)]
    docs = [{"_id": k, "v": {"text": "x", "embedding": vector()}, "w": {"text": ["a", "b"], "embedding": [vector(), vector()]}} for k in range(30)] + [{"_id": 99, "v": {"text": "zero", "embedding": [0.0] * 8}}, {"_id": 100}]
    i.add(docs)
    i.flush()
    q = vector()

    def back(v):
        v = [float(np.float32(x)) for x in v]  # as they are stored
        top, steps = max(map(abs, v)), {"int8": 127, "int4": 7}.get(kind)
        return [1 if x > 0 else -1 for x in v] if kind == "int1" else [0 if not top else int(abs(x) * steps / top + 0.5) * (1 if x > 0 else -1) * top / steps for x in v]

    dot = lambda v: (1 + sum(a * b for a, b in zip(back(v), q, strict=True))) / 2
    for name, best in (("v", lambda d: dot(d["v"]["embedding"])), ("w", lambda d: max(map(dot, d["w"]["embedding"])))):
        request = {"query": {"knn": {"field": name, "query_vector": q, "k": 40}}, "size": 40}
        got = {h["_id"]: h["_score"] for h in i.search(request)["hits"]}
        want = {str(d["_id"]): best(d) for d in docs if name in d}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    plan = i.plan({"query": {"knn": {"field": "v", "query_vector": q}}}).hits()._jdf.queryExecution().executedPlan().toString()
    assert f"v__{kind}" in plan and "v__vec" not in plan
    # another kind is asked for: what is stored doesn't fit until all is written anew
    other = "int4" if kind == "int8" else "int8"
    fields["v"]["search"]["semantic"]["quantize"] = other
    again = index(spark, tmp_path, fields)
    again.add([{"_id": 7, "v": {"text": "x", "embedding": vector()}}])
    again.flush()
    assert len(again.search({"query": {"knn": {"field": "v", "query_vector": q, "k": 40}}, "size": 40})["hits"]) == 31


def test_answers_of_a_model_server(spark, tmp_path):
    """A server on this machine: whole and streamed answers."""
    import http.server
    import threading

    from docquarry.models import EchoCompleter, HttpCompleter, Models

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            self.send_response(200)
            self.end_headers()
            if body["stream"]:
                for part in ("red ", "dress"):
                    self.wfile.write(b"data: " + json.dumps({"choices": [{"delta": {"content": part}}]}).encode() + b"\n\n")
                self.wfile.write(b": a comment\n\ndata: [DONE]\n\n")
            else:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": "whole"}}]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        m = Models.parse({"completion": {"m": {"provider": "http", "endpoint": f"http://127.0.0.1:{server.server_port}/v1/chat/completions", "model": "x"}, "e": {"provider": "echo"}}})
        assert isinstance(m.get("completion", "m"), HttpCompleter) and isinstance(m.get("completion", "e"), EchoCompleter)
        i = Index(spark, Mapping.parse("t", {"fields": {"title": LEX}}), f"file://{tmp_path}", m)
        i.add([{"_id": 1, "title": "red dress"}])
        i.flush()
        request = {"query": {"match": {"title": "dress"}}, "rag": {"prompt": "Which?", "model": "m", "fields": ["title"], "maxResponseLength": 9}}
        assert i.search(request)["response"] == "whole" and seen[0]["max_tokens"] == 9 and "title: red dress" in seen[0]["messages"][0]["content"]
        first, *rest = list(i.search_stream(request))
        assert first["results"]["hits"][0]["_id"] == "1" and [x["rag"]["token"] for x in rest] == ["red ", "dress", ""] and [x["rag"]["last"] for x in rest] == [False, False, True]
        request["rag"]["model"] = "e"
        assert [x["rag"]["token"] for x in list(i.search_stream(request))[1:]] == ["title: red dress", ""]
        with pytest.raises(UserError):
            next(i.search_stream({}))
    finally:
        server.shutdown()


def _shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_a_flush_shuffles_texts_once_and_no_postings(spark, tmp_path, monkeypatch):
    """Texts are moved once, for their order; what is counted of them stays where it was read."""
    monkeypatch.setattr("docquarry.sources.readers.SPREAD_LEAST", 1 << 40)  # tables of few row groups are spread over the cores besides
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4000)]
    docs = spark.createDataFrame([(str(k), " ".join(r.choices(words, k=250)), -k) for k in range(1500)], "_id string, title string, _order long")
    i = index(spark, tmp_path, {"title": LEX})
    i.add_documents(docs)
    before = _shuffled(spark)
    assert i.flush() == 1500
    assert _shuffled(spark) - before < 1.5 * sum(f.size for f in i.manifest.files)
    assert [h["_id"] for h in i.search({"size": 3})["hits"]] == ["1499", "1498", "1497"]


def test_postings_are_counted_in_pieces(spark, tmp_path, monkeypatch):
    """Files are sorted by term; frequencies and lengths are those of the texts, whatever is counted at once."""
    monkeypatch.setattr(store, "AT_ONCE", 7)
    texts = {"1": "a b a", "2": None, "3": "", "4": "b " * 20, "5": "?", "6": "c a", "7": "a"}
    i = index(spark, tmp_path)
    i.add_documents(spark.createDataFrame([(k, t, "x y" if k in "23" else None, int(k)) for k, t in texts.items()], "_id string, title string, body string, _order long").coalesce(1))
    i.flush()
    numbers = {x["_seq"]: x["_id"] for x in i.docs().collect()}
    rows = [x for x in i.corpus().postings.rows.collect()]
    want = {("title", w, k, t.split().count(w), len(t.split())) for k, t in texts.items() if t and t != "?" for w in set(t.split())} | {("body", w, k, 1, 2) for w in "xy" for k in "23"}
    assert sorted((x["field"], x["term"], numbers[x["_seq"]], x["tf"], x["n"]) for x in rows if x["term"]) == sorted(want)
    assert sorted((x["field"], numbers[x["_seq"]], x["n"]) for x in rows if not x["term"]) == [("body", "2", 2), ("body", "3", 2), ("title", "1", 3), ("title", "4", 20), ("title", "6", 2), ("title", "7", 1)]
    assert i.manifest.totals == {"title": [4, 26], "body": [2, 4]}
    for f in i.manifest.more:
        terms = [x["term"] for x in spark.read.parquet(f"file://{tmp_path}/{f.name}").collect()]
        assert terms == sorted(terms)


def test_totals_after_deletions_of_earlier_segments(spark, tmp_path):
    """Segments that hold lengths in columns of their documents, as earlier versions wrote them, go on counting."""
    i = index(spark, tmp_path, {"title": LEX}, config={"indexer": {"merge_policy": "none"}})
    i.add([{"_id": k, "title": "w " * k} for k in range(1, 6)])
    i.flush()
    n = store.lengths(i.corpus().postings.rows).select("_seq", F.col("n").alias("title__len"))
    docs = i.docs().join(n, "_seq", "left")
    docs.write.parquet(f"file://{tmp_path}/seg-old/docs")
    i.corpus().postings.rows.where("term <> ''").write.parquet(f"file://{tmp_path}/seg-old/terms")
    m = i.manifest
    m.seqnum, m.segments = m.seqnum + 1, [store.Segment("seg-old", 5, 1, docs.schema.json())]
    i.client.publish(store.listed(i.client, m, None))
    i = index(spark, tmp_path, {"title": LEX}, config={"indexer": {"merge_policy": "none"}})
    i.add([{"_id": 6, "title": "w w"}, {"_id": 2, "title": "v"}])
    i.flush()
    assert i.manifest.totals == {"title": [6, 16]}
    i.delete(ids=["2", "5", "6"])
    i.flush()
    assert i.manifest.totals == {"title": [3, 8]} and i.manifest.docs == 3
    assert [h["_id"] for h in i.search({"query": {"match": {"title": "w"}}})["hits"]] == ["4", "3", "1"]
