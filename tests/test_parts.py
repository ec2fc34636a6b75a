"""Parts of the engine by themselves, and its formats, stores, streams and random cross-checks."""

import bz2
import gzip
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.engine import Index
from docquarry.errors import UserError
from docquarry.functions import geo
from docquarry.functions.text import analyze, analyze_query, light_stem, porter, word_ngrams
from docquarry.mapping import Mapping
from docquarry.models import HttpEmbedder, Models, logits, pool
from docquarry.operators import filters
from docquarry.operators.aggs import term_counts
from docquarry.operators.suggest import edits
from docquarry.plans import dsl
from docquarry.plans.search import Search, corpus_of
from docquarry.sources import readers, store

SIMPLE = Mapping.parse("t", {"fields": {"text": {"type": "text"}}})


# ---- mapping -------------------------------------------------------------------------------------------------------
def mapping(**fields):
    return Mapping.parse("t", {"fields": fields})


def test_mapping_errors_and_round_trip():
    for bad in ({"a b": {"type": "text"}}, {"a": {"type": "decimal"}}, {"a": {"type": "int[]", "sort": True}}, {"g": {"type": "geopoint", "facet": True}}, {"f_*": {"type": "text"}, "f_x": {"type": "text"}}, {"a": {"type": "text", "x": 1}}, {"a": {"type": "text", "search": {"semantic": {}}}}, {}):
        with pytest.raises(UserError):
            Mapping.parse("t", {"fields": bad})
    m = mapping(a={"type": "string", "suggest": {"expand": {"min-terms": 2}}, "search": {"lexical": {}, "semantic": {"dim": 3}}}, b={"type": "int[]"}, c_x={"type": "double"})
    assert Mapping.from_json(m.to_json()) == m and m.fields["a"].suggest.expand == (2, 3)


def test_migration():
    old = mapping(a={"type": "int"}, b={"type": "text"}, c={"type": "float"})
    assert old.migrate(mapping(a={"type": "int", "sort": True}, d={"type": "date"}))
    assert old.migrate(mapping(b={"type": "text", "facet": True}))
    for bad in ({"a": {"type": "long"}}, {"c": {"type": "float", "sort": True}}):
        with pytest.raises(UserError):
            old.migrate(mapping(**bad))


# ---- text ----------------------------------------------------------------------------------------------------------
def test_analyzers_agree_on_driver_and_cluster(spark):
    texts = ["It's 3.5 l'école, Ünïcode—Test_x!", "", "The running dogs' tails relational hopping", "日本語 x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("generic", "english", "french", "jp", "de"):
        got = [r[0] for r in df.select(analyze(F.col("t"), name)).collect()]
        assert got == [analyze_query(t, name) for t in texts], name
    with pytest.raises(UserError):
        analyze_query("x", "klingon")


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("happy", "happi"), ("adjustment", "adjust"), ("controlling", "control"), ("sky", "sky"), ("dresses", "dress")])
def test_porter(word, stem):
    assert porter(word) == stem


@pytest.mark.parametrize("code, pairs", [
    ("de", "kindern:kind häuser:haus schönsten:schon autos:autos haus:haus freundlichen:freundlich tages:tag besst:besst"),
    ("es", "casas:cas niños:niñ veces:vez meses:mes sol:sol camión:camion grande:grand"),
    ("it", "ragazze:ragazz amiche:amic libri:libri bottega:botteg orologio:orolog"),
    ("fr", "chevaux:cheval parlers:parl donnés:don bijoux:bijou petite:petit chat:chat belles:bel 180000:180000"),
    ("sv", "flickorna:flick husens:hus bilar:bil snabbast:snabb"),
])
def test_light_stemmers(spark, code, pairs):
    words = [p.split(":") for p in pairs.split()]
    assert [light_stem(w, code) for w, _ in words] == [s for _, s in words]
    df = spark.createDataFrame([(w,) for w, _ in words], "t string")
    assert [r[0] for r in df.select(analyze(F.col("t"), code)).collect()] == [analyze_query(w, code) for w, _ in words]


def test_ngrams(spark):
    got = spark.range(1).select(word_ngrams(F.array(*[F.lit(x) for x in "hello world foo bar".split()]), 1, 3)).first()[0]
    assert got == ["hello", "world", "foo", "bar", "hello world", "world foo", "foo bar", "hello world foo", "world foo bar"]


def test_edits():
    assert edits("ab", "ba", 1) == 1 and edits("abc", "abd", 2) == 1 and edits("abc", "xyz", 2) == 3 and edits("", "ab", 2) == 2


# ---- geo -----------------------------------------------------------------------------------------------------------
def test_distances(spark):
    assert geo.meters("5 km") == 5000 and geo.meters("1mi") == 1609.344 and geo.meters("2 meters") == 2
    for bad in ("-1 km", "5", "x km", "5 parsnips"):
        with pytest.raises(UserError):
            geo.meters(bad)
    at = lambda lat, lon: F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    r = spark.range(1).select(
        geo.haversine(F.lit(90.0), F.lit(0.0), -90.0, 0.0), geo.haversine(F.lit(0.0), F.lit(179.9), 0.0, -179.9),
        geo.within(at(0.0, 179.99), 0.0, -179.99, 5000), geo.in_box(at(0.0, 179.99), (1.0, 170.0), (-1.0, -170.0)),
    ).first()
    assert math.isclose(r[0], math.pi * geo.RADIUS_M, rel_tol=1e-9) and r[1] < 23_000 and r[2] and not r[3]  # boxes do not wrap


# ---- formats -------------------------------------------------------------------------------------------------------
DOC = b'{"_id":"1","text":"foo"}'


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress, bz2.compress])
@pytest.mark.parametrize(("raw", "n"), [(DOC, 1), (DOC + b"\n" + DOC, 2), (DOC + b"\n\n" + DOC + b"\n", 2), (b"[" + DOC + b"]", 1), (b"[" + DOC + b"," + DOC + b"]", 2), (b"", 0)])
def test_payloads(raw, n, pack):
    assert len(readers.decode_payload(pack(raw))) == n


def test_zstd_and_bad_payloads():
    import zstandard

    assert len(readers.decode_payload(zstandard.ZstdCompressor().compress(DOC))) == 1
    with pytest.raises(UserError):
        readers.decode_payload(b"foo")
    with pytest.raises(UserError):
        readers.decode_payload(b"[1]")


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_bytes(DOC + b"\n\n" + DOC.replace(b"1", b"2"))
    (tmp_path / "a" / "y.json.gz").write_bytes(gzip.compress(DOC.replace(b"1", b"3")))
    (tmp_path / "b.json").write_text(json.dumps([{"_id": 4, "text": "foo"}, {"_id": 5, "text": ""}, {"text": "no id"}]))
    (tmp_path / "c.json").write_text("hello")
    got = readers.read_files(spark, f"file://{tmp_path}/a", SIMPLE).collect()
    assert sorted(r["_id"] for r in got) == ["1", "2", "3"]
    got = readers.read_files(spark, f"{tmp_path}/b.json", SIMPLE).collect()
    assert {r["_id"]: r["text"] for r in got}["4"] == "foo" and {r["_id"]: r["text"] for r in got}["5"] is None and all(r["_id"] for r in got)
    with pytest.raises(UserError):
        readers.read_files(spark, f"{tmp_path}/c.json", SIMPLE)
    with pytest.raises(UserError):
        readers.documents(readers.payload_lines(spark, [{"_id": 1}]), mapping(text={"type": "text", "required": True}))


def test_locations_and_offsets():
    assert readers.parse_url("file:/a/b").path == readers.parse_url("file:///a/b").path == "/a/b"
    assert readers.parse_url("s3://b/p").path == readers.parse_url({"s3": {"bucket": "b", "prefix": "p"}}).path == "s3a://b/p"
    assert readers.parse_url("http://x/y").scheme == "http"
    with pytest.raises(UserError):
        readers.parse_url("ftp://x")
    assert readers.kafka_options("t", ["h:1"], "last=2h", now_ms=10_000_000)["startingTimestamp"] == "2800000"
    assert readers.kafka_options("t", ["h:1"], "latest", {"group.id": "g"})["kafka.group.id"] == "g"
    with pytest.raises(UserError):
        readers.kafka_options("t", [], "soon")


# ---- store and stream ----------------------------------------------------------------------------------------------
def test_diff():
    f = store.FileEntry
    end = [("add", "manifest.json")]
    assert store.diff([f("a", 1)], None) == [("add", "a"), *end]
    assert store.diff([f("a", 1)], [f("a", 1)]) == end
    assert store.diff([f("a", 1), f("b", 1)], [f("a", 1)]) == [("add", "b"), *end]
    assert store.diff([f("a", 1)], [f("a", 1), f("b", 1)]) == [("delete", "b"), *end]
    assert store.diff([f("a", 2)], [f("a", 1)]) == [("add", "a"), *end]
    assert store.merge_files(10, 5, {"doc_count": {"max_merge_docs": 2}}) == 3 and store.merge_files(10, 5, None) is None
    with pytest.raises(UserError):
        store.merge_files(1, 1, {"odd": {}})


def test_stream_counts_each_batch_once(spark, tmp_path):
    from docquarry.streaming.ingest import file_lines, ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_bytes(DOC)
    i = Index(spark, SIMPLE, f"file://{tmp_path}/idx")
    ingest(file_lines(spark, str(src)), i, str(tmp_path / "cp"), None).awaitTermination(60)
    (src / "2.json").write_text('{"_id":"1","text":"bar"}\n{"_id":"2","text":"x"}')
    ingest(file_lines(spark, str(src)), i, str(tmp_path / "cp"), None).awaitTermination(60)
    assert {r["_id"]: r["text"] for r in i.docs().collect()} == {"1": "bar", "2": "x"} and i.done("ingest") == 1


# ---- models --------------------------------------------------------------------------------------------------------
def test_models():
    import numpy as np

    s, m = np.arange(12.0).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert pool(s, m, "mean").tolist() == [[2, 3, 4, 5]] and pool(s, m, "cls").tolist() == [[0, 1, 2, 3]] and pool(s, m, "last").tolist() == [[4, 5, 6, 7]]
    assert logits(0.0, "sigmoid") == 0.5
    calls = []

    def send(url, headers, body):
        calls.append(body)
        if len(calls) == 1:
            raise OSError("busy")
        return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(body["input"])]}

    assert HttpEmbedder("openai", "m", "http://x", "K", send=send).embed(["a", "bb"]).tolist() == [[1.0], [2.0]] and len(calls) == 2
    with pytest.raises(UserError):
        Models.parse({"embedding": {"x": {"provider": "odd"}}})


# ---- ranges and requests -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["int", "long", "float", "double", "int[]", "long[]", "float[]", "double[]"])
def test_ranges(spark, kind):
    many = kind.endswith("[]")
    m = mapping(field={"type": kind, "filter": True})
    rows = [(i, [v] if many else v) for i, v in enumerate((10, 15, 20, 30), 1)] + [(5, None)]
    docs = spark.createDataFrame([(i, None if v is None else ([float(x) for x in v] if many else float(v))) for i, v in rows], f"_id long, v {'array<double>' if many else 'double'}").select("_id", F.col("v").cast(m.fields["field"].spark_type()).alias("field"))
    ids = lambda **b: [r[0] for r in docs.where(filters.predicate(m, dsl.parse_filter({"range": {"field": b}}))).orderBy("_id").collect()]
    assert ids(gte=0, lte=100) == [1, 2, 3, 4] and ids(gte=100, lte=200) == [] and ids(gte=12, lte=22) == [2, 3]
    assert ids(gte=10, lte=20) == [1, 2, 3] and ids(gt=10, lt=20) == [2] and ids(lt=10.5) == [1]


@pytest.mark.parametrize("bad", [{"size": -1}, {"query": {"match": {"a": {"query": "x", "operator": "xor"}}}}, {"filters": {"include": {"range": {"a": {}}}}}, {"filters": {"include": {"range": {"a": {"gt": 1, "gte": 2}}}}}, {"filters": {"include": {"term": {"a": 1.5}}}}, {"aggs": {"a": {"sum": {}}}}, {"sort": [{"a": {"lat": 1, "lon": 2, "order": "asc"}}]}, {"query": {"rrf": {"retrieve": []}}}, {"filters": {"maybe": {}}}])
def test_bad_requests(bad):
    with pytest.raises(UserError):
        dsl.parse_search(bad)
    with pytest.raises(UserError):
        dsl.parse_suggest({"query": "x", "fields": ["a"], "rerank": {"ltr": {}}})


def test_fusion_is_not_sorted():
    with pytest.raises(UserError):
        dsl.normalize(dsl.parse_search({"query": {"rrf": {"retrieve": [{"match_all": {}}]}}, "sort": ["a"]}))


_leaf = st.one_of(st.builds(lambda v: {"term": {"a": v}}, st.integers(0, 3)), st.builds(lambda lo, hi: {"range": {"b": {"gte": lo, "lt": hi}}}, st.integers(0, 5), st.integers(0, 5)))
_tree = st.recursive(_leaf, lambda c: st.builds(lambda k, xs: {k: xs}, st.sampled_from(["and", "or", "not"]), st.lists(c, min_size=1, max_size=3)), max_leaves=6)


def _holds(f, row):
    (k, d), = f.items()
    if k == "term":
        return row[1] is not None and row[1] == d["a"]
    if k == "range":
        return row[2] is not None and d["b"]["gte"] <= row[2] < d["b"]["lt"]
    each = [_holds(x, row) for x in d]
    return all(each) if k == "and" else any(each) if k == "or" else not any(each)


@settings(max_examples=15, deadline=None)
@given(f=_tree)
def test_filters_like_a_naive_model(spark, f):
    m = mapping(a={"type": "int", "filter": True}, b={"type": "int", "filter": True})
    rows = [(i, i % 4 if i % 5 else None, i % 6 if i % 7 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "_id int, a int, b int")
    got = {r[0] for r in docs.where(filters.predicate(m, dsl.parse_filter(f))).collect()}
    assert got == {r[0] for r in rows if _holds(f, r)}


def test_scan_plan_has_no_shuffle_before_the_top(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "a", "de")], "_id int, text string, lang string")
    m = mapping(text={"type": "text", "search": {"lexical": {}}}, lang={"type": "text", "filter": True})
    s = Search(corpus_of(docs, m), dsl.parse_search({"query": {"match": {"text": "a"}}, "filters": {"include": {"term": {"lang": "en"}}}}))
    plan = s.hits()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrderedAndProject" in plan


def test_facet_of_all_terms(spark):
    m = mapping(n={"type": "int", "facet": True})
    a = dsl.parse_search({"aggs": {"t": {"term": {"field": "n", "size": "all"}}}}).aggs["t"]
    assert term_counts(spark.range(140_000).select(F.col("id").cast("int").alias("n")), m, a).count() == 140_000
