"""Small indexes with exact expected hits."""

import pytest

from docquarry.engine import Engine, Index
from docquarry.errors import UserError
from docquarry.mapping import Mapping
from docquarry.models import HashEmbedder, Models, OverlapRanker, EchoCompleter

MODELS = Models({"hash": HashEmbedder()}, {"overlap": OverlapRanker()}, {"echo": EchoCompleter()})


def make(spark, tmp_path, fields, docs, **more):
    i = Index(spark, Mapping.parse("t", {"fields": fields} | more), f"file://{tmp_path}/idx", MODELS)
    i.add(docs)
    i.flush()
    return i


def ids(i, request):
    return [h["_id"] for h in i.search(request)["hits"]]


LEX = {"type": "text", "search": {"lexical": {"analyze": "generic"}}}
CLOTHES = [{"_id": 1, "title": "red dress", "price": 10}, {"_id": 2, "title": "white dress", "price": 20}, {"_id": 3, "title": "red pajama"}]


@pytest.fixture(scope="module")
def clothes(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("c"), {"title": LEX | {"sort": True}, "price": {"type": "int", "sort": True, "facet": True, "filter": True}}, CLOTHES)


def test_match_and_bool(clothes):
    m = lambda w: {"match": {"title": w}}
    assert ids(clothes, {"query": m("pajama")}) == ["3"]
    assert ids(clothes, {"query": {"bool": {"must": [m("pajama"), m("red")]}}}) == ["3"]
    assert ids(clothes, {"query": {"bool": {"should": [m("pajama"), m("red")]}}}) == ["3", "1"]
    assert ids(clothes, {"query": {"bool": {"should": [m("pajama"), m("red")], "must_not": [m("dress")]}}}) == ["3"]
    assert ids(clothes, {"query": {"bool": {"must_not": [m("dress")]}}}) == []
    assert ids(clothes, {"query": {"match": {"title": {"query": "red dress", "operator": "and"}}}}) == ["1"]
    assert ids(clothes, {"query": m("")}) == [] and len(ids(clothes, {})) == 3


def test_sort_filter_facets(clothes):
    assert ids(clothes, {"sort": ["price"]}) == ["1", "2", "3"]
    assert ids(clothes, {"sort": [{"price": {"order": "desc", "missing": "first"}}]}) == ["3", "2", "1"]
    assert ids(clothes, {"filters": {"include": {"range": {"price": {"gt": 10}}}}}) == ["2"]
    assert ids(clothes, {"filters": {"exclude": {"term": {"price": 10}}}, "sort": ["_doc"]}) == ["2", "3"]
    assert ids(clothes, {"filters": {"include": {"not": [{"term": {"price": 10}}]}}, "sort": ["_doc"]}) == ["2", "3"]
    r = clothes.search({"size": 1, "aggs": {"p": {"term": {"field": "price"}}, "r": {"range": {"field": "price", "ranges": [{"lt": 5}, {"gte": 10, "lte": 20}]}}}})
    assert r["aggs"]["p"]["buckets"] == [{"term": "10", "count": 1}, {"term": "20", "count": 1}]
    assert r["aggs"]["r"]["buckets"] == [{"lt": 5, "count": 0}, {"gte": 10, "lte": 20, "count": 2}]
    with pytest.raises(UserError):
        clothes.search({"filters": {"include": {"term": {"title": "x"}}}})
    with pytest.raises(UserError):
        clothes.search({"fields": ["nope"]})
    with pytest.raises(UserError):
        clothes.search({"aggs": {"a": {"range": {"field": "title", "ranges": [{"lt": 1}]}}}})


def test_update_delete_and_versions(spark, tmp_path):
    i = make(spark, tmp_path, {"title": LEX, "price": {"type": "int", "filter": True}}, CLOTHES)
    i.add([{"_id": "3", "title": "blue pajama"}, {"_id": "3", "title": "green pajama"}])
    assert i.flush() == 0
    assert ids(i, {"query": {"match": {"title": "green"}}}) == ["3"] and ids(i, {"query": {"match": {"title": "blue"}}}) == []
    i.delete(ids=["1"])
    assert i.flush() == -1
    i.delete(where={"include": {"range": {"price": {"gte": 20}}}})
    i.flush()
    assert ids(i, {}) == ["3"]
    again = Index(spark, i.mapping, i.client.root, MODELS)
    assert ids(again, {}) == ["3"] and again.stats()["docs"] == 1
    ops = i.replicate(f"file://{tmp_path}/copy")
    assert ops[-1] == ("add", "manifest.json")
    assert ids(Index(spark, i.mapping, f"file://{tmp_path}/copy", MODELS), {}) == ["3"]
    i.merge(1)
    assert len(i.manifest.files) == 1
    i.delete()
    assert i.flush() == -1


def test_wildcards_nested_and_types(spark, tmp_path):
    i = make(
        spark, tmp_path,
        {"title": LEX, "field_*": LEX | {"filter": True}, "info.group": {"type": "float", "filter": True}, "tracks.name": {"type": "text[]", "filter": True, "facet": True}},
        [{"_id": 1, "title": "a", "field_desc": "foo", "info": {"group": 1.5}, "tracks": [{"name": "x"}, {"name": "y"}]}, {"_id": 2, "field_info": "foo"}, {"_id": 3, "field_stuff": "foo", "junk": {"a": 1}}],
    )
    assert sorted(ids(i, {"query": {"multi_match": {"query": "foo", "fields": ["field_*"]}}})) == ["1", "2", "3"]
    assert ids(i, {"filters": {"include": {"term": {"tracks.name": "y"}}}}) == ["1"]
    assert ids(i, {"filters": {"include": {"range": {"info.group": {"lt": 2}}}}}) == ["1"]
    assert i.search({"query": {"match": {"field_desc": "foo"}}, "fields": ["field_*"]})["hits"][0]["field_desc"] == "foo"


def test_dates_and_geo(spark, tmp_path):
    i = make(
        spark, tmp_path,
        {"d": {"type": "date", "filter": True, "facet": True, "sort": True}, "t": {"type": "datetime", "filter": True, "facet": True}, "p": {"type": "geopoint", "filter": True, "sort": True}, "b": {"type": "bool", "filter": True, "sort": True}},
        [{"_id": n, "d": f"2024-0{n}-01", "t": f"2024-0{n}-01T00:00:00Z", "p": {"lat": 52.0 + n, "lon": 13.4}, "b": n == 2} for n in (1, 2, 3)],
    )
    inc = lambda f: {"filters": {"include": f}, "sort": ["_doc"]}
    assert ids(i, inc({"term": {"d": "2024-02-01"}})) == ["2"] and ids(i, inc({"range": {"t": {"gt": "2024-02-01T00:00:00Z"}}})) == ["3"]
    assert ids(i, inc({"term": {"b": True}})) == ["2"]
    assert ids(i, inc({"geo_distance": {"field": "p", "lat": 53, "lon": 13.4, "distance": "120 km"}})) == ["1", "2"]
    assert ids(i, inc({"geo_box": {"field": "p", "top_left": {"lat": 54.5, "lon": 13}, "bottom_right": {"lat": 52.5, "lon": 14}}})) == ["1", "2"]
    assert ids(i, {"sort": [{"p": {"lat": 55, "lon": 13.4}}]}) == ["3", "2", "1"]
    r = i.search({"aggs": {"d": {"term": {"field": "d"}}, "t": {"term": {"field": "t", "size": 1}}}})["aggs"]
    assert r["d"]["buckets"][0] == {"term": "2024-01-01", "count": 1} and r["t"]["buckets"] == [{"term": "2024-01-01T00:00:00Z", "count": 1}]


def test_vectors_fusion_rerank_answer(spark, tmp_path):
    fields = {"title": {"type": "text", "search": {"lexical": {"analyze": "english"}, "semantic": {"model": "hash"}}}, "tag": {"type": "text", "filter": True}, "many": {"type": "text[]", "search": {"semantic": {"dim": 2}}}}
    docs = [{"_id": 1, "title": "red dresses", "tag": "a"}, {"_id": 2, "title": "white dress", "tag": "a"}, {"_id": 3, "title": {"text": "red pajama", "embedding": [0.0] * 63 + [1.0]}, "tag": "b", "many": {"text": ["x", "y"], "embedding": [[1, 0], [0, 1]]}}]
    i = make(spark, tmp_path, fields, docs)
    assert ids(i, {"query": {"match": {"title": "dress"}}}) == ["1", "2"]
    assert ids(i, {"query": {"semantic": {"title": "white dress"}}})[0] == "2"
    assert ids(i, {"query": {"knn": {"field": "title", "query_vector": [0.0] * 63 + [1.0], "k": 1}}, "size": 1}) == ["3"]
    assert "3" not in ids(i, {"query": {"knn": {"field": "title", "query_vector": [0.0] * 63 + [1.0]}}, "filters": {"include": {"term": {"tag": "a"}}}})
    assert ids(i, {"query": {"knn": {"field": "many", "query_vector": [0, 1]}}}) == ["3"]
    hits = i.search({"query": {"rrf": {"retrieve": [{"semantic": {"title": "white dress"}}, {"match": {"title": "dress"}}]}}})["hits"]
    assert {h["_id"] for h in hits} == {"1", "2", "3"} and hits[0]["_score"] <= 2 / 60 + 1e-12
    ce = {"cross_encoder": {"model": "overlap", "query": "pajama", "retrieve": {"match_all": {}}, "doc_template": "{{ title }}"}}
    assert ids(i, {"query": ce})[0] == "3"
    r = i.search({"query": {"match": {"title": "pajama"}}, "rag": {"prompt": "Say", "model": "echo", "fields": ["title"]}})
    assert r["response"] == "title: red pajama"


def test_suggest(spark, tmp_path):
    i = make(spark, tmp_path, {"title": {"type": "text", "suggest": True}, "genres": {"type": "text[]", "suggest": True}}, [{"_id": 1, "title": "hello world", "genres": ["action", "arcade"]}, {"_id": 2, "title": "I like hotdogs", "genres": ["action", "romance"]}, {"_id": 3, "title": "where is my mind?", "genres": ["sports"]}])
    texts = lambda r: [x["text"] for x in i.suggest(r)]
    assert texts({"query": "he", "fields": ["title"]})[:2] == ["hello", "hello world"]
    assert texts({"query": "a", "fields": ["genres"]})[:2] == ["action", "arcade"]
    assert "hello" in texts({"query": "hlelo", "fields": ["title"]})


def test_engine_and_errors(spark, tmp_path):
    e = Engine(spark, {"inference": {"embedding": {"h": {"provider": "hash", "dim": 8}}}, "schema": {"x": {"alias": "y", "fields": {"a": LEX}}}}, f"file://{tmp_path}")
    assert e.names() == ["x"] and e.index("y") is e.index("x") and len(e.embed("h", ["q"])[0]) == 8
    with pytest.raises(UserError):
        e.index("z")
    for bad in ({"query": {"nope": {}}}, {"query": {"match_all": {}, "match": {}}}, {"x": 1}, {"query": {"dis_max": {"queries": [{"match_all": {}}]}}}, {"query": {"bool": {}}}):
        with pytest.raises(UserError):
            e.index("x").search(bad)
