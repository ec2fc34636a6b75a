"""The query catalogue of the search engine: each operator over the driver's tables, and the DuckDB SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import analyze
from docquarry.mapping import Mapping
from docquarry.models import Models, OverlapRanker
from docquarry.operators import aggs, rag, suggest
from docquarry.plans import dsl
from docquarry.plans.search import Search, corpus_of
from docquarry.sources.readers import spread

_LEX = {"type": "text", "search": {"lexical": {"analyze": "generic"}}, "facet": True, "filter": True}
_ALL = {"filter": True, "facet": True, "sort": True}
_MODELS = Models(ranker={"overlap": OverlapRanker()})
_TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+(?:[''.’][\p{{L}}\p{{N}}_]+)*')"


def _f(kind: str, **more) -> dict:
    return {"type": kind} | ({k: v for k, v in _ALL.items() if not (k == "sort" and kind.endswith("[]")) and not (k == "facet" and kind == "geopoint")}) | more


def _table(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet")).withColumnRenamed(key, "_id")


def _search(docs: DataFrame, fields: dict, request: dict) -> Search:
    return Search(corpus_of(docs, Mapping.parse("q", {"fields": fields}), _MODELS), dsl.parse_search(request), _MODELS)


def _scored(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select(F.col("_id").alias("id"), F.round("_score", 6).alias("score"), *more)


def _ids(docs: DataFrame, fields: dict, filters: dict) -> DataFrame:
    return _search(docs, fields, {"filters": filters}).matches().select(F.col("_id").alias("id"))


def _bm25(cte: str, table: str, key: str, column: str, words: list[str], weights: list[int] | None = None) -> str:
    """CTEs that end in ``cte`` (id, score, n): BM25 over words, n of them present."""
    terms = ", ".join(f"('{w}', {n})" for w, n in zip(words, weights or [1] * len(words), strict=True))
    return f"""
{cte}_t AS (SELECT {key} AS id, {_TOKENS.format(column)} AS ws FROM {table}),
{cte}_s AS (SELECT sum(len(ws)) / count(*) AS avgdl, count(*) AS n FROM {cte}_t WHERE len(ws) > 0),
{cte}_q AS (SELECT * FROM (VALUES {terms}) AS v(w, times)),
{cte}_f AS (SELECT id, w, times, len(list_filter(ws, lambda x: x = w)) AS tf, len(ws) AS dl FROM {cte}_t, {cte}_q),
{cte}_d AS (SELECT w, count(*) FILTER (tf > 0) AS df FROM {cte}_f GROUP BY w),
{cte} AS (SELECT f.id, sum(times * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / s.avgdl))) AS score, count(*) AS n
  FROM {cte}_f f JOIN {cte}_d d ON d.w = f.w, {cte}_s s WHERE tf > 0 GROUP BY f.id)"""


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# ---- retrieval -----------------------------------------------------------------------------------------------------
@_register("SELECT p_partkey AS id, 1.0::DOUBLE AS score, p_name FROM part ORDER BY p_partkey LIMIT 20")
def match_all_top(spark, sf):
    return _scored(_search(_table(spark, sf, "part", "p_partkey"), {"p_name": _LEX}, {"size": 20, "fields": ["p_name"]}).hits(), "p_name")


def _documents(spark, sf, request):
    return _search(_table(spark, sf, "documents", "doc_id"), {"text": _LEX, "lang": _f("text"), "source": _f("text")}, request)


@_register(f"WITH {_bm25('m', 'documents', 'doc_id', 'text', ['license', 'version', 'the'])} SELECT id, round(score, 6) AS score FROM m")
def match_or(spark, sf):
    return _scored(_documents(spark, sf, {"query": {"match": {"text": "License version the"}}}).matches())


@_register(f"WITH {_bm25('m', 'documents', 'doc_id', 'text', ['license', 'version'])} SELECT id, round(score, 6) AS score FROM m WHERE n = 2")
def match_and(spark, sf):
    return _scored(_documents(spark, sf, {"query": {"match": {"text": {"query": "license version", "operator": "and"}}}}).matches())


@_register(f"""WITH {_bm25('m', 'documents', 'doc_id', 'text', ['of', 'and'])}
SELECT id, round(score, 6) AS score, lang FROM m JOIN documents ON doc_id = id WHERE lang = 'en' ORDER BY m.score DESC, id LIMIT 50""")
def match_filtered_top(spark, sf):
    return _scored(_documents(spark, sf, {"query": {"match": {"text": "of and"}}, "filters": {"include": {"term": {"lang": "en"}}}, "size": 50, "fields": ["lang"]}).hits(), "lang")


@_register(f"""WITH {_bm25('a', 'part', 'p_partkey', 'p_name', ['red', 'part'])}, {_bm25('b', 'part', 'p_partkey', 'p_type', ['red', 'part', 'brass'])},
u AS (SELECT id, score FROM a UNION ALL SELECT id, score FROM b)
SELECT id, round(max(score) + 0.3 * (sum(score) - max(score)), 6) AS score FROM u GROUP BY id""")
def dis_max_tie(spark, sf):
    q = {"dis_max": {"queries": [{"match": {"p_name": "red part"}}, {"match": {"p_type": "red part brass"}}], "tie_breaker": 0.3}}
    return _scored(_search(_table(spark, sf, "part", "p_partkey"), {"p_name": _LEX, "p_type": _LEX}, {"query": q}).matches())


_BOTH = f"""WITH {_bm25('a', 'pages', 'page_id', 'url', ['html', 'com', 'title'])}, {_bm25('b', 'pages', 'page_id', 'html', ['html', 'com', 'title'])},
u AS (SELECT id, score FROM a UNION ALL SELECT id, score FROM b) SELECT id, round(@@, 6) AS score FROM u GROUP BY id"""


def _pages(spark, sf, kind):
    q = {"multi_match": {"query": "html com title", "fields": ["url", "ht*"], "type": kind}}
    return _scored(_search(_table(spark, sf, "pages", "page_id"), {"url": _LEX, "html": _LEX}, {"query": q}).matches())


@_register(_BOTH.replace("@@", "max(score)"))
def multi_match_best(spark, sf):
    return _pages(spark, sf, "best_fields")


@_register(_BOTH.replace("@@", "sum(score)"))
def multi_match_most(spark, sf):
    return _pages(spark, sf, "most_fields")


@_register(f"""WITH {_bm25('a', 'documents', 'doc_id', 'text', ['the'])}, {_bm25('b', 'documents', 'doc_id', 'text', ['and', 'of'])}, {_bm25('c', 'documents', 'doc_id', 'text', ['license'])}
SELECT a.id, round(a.score + coalesce(b.score, 0), 6) AS score FROM a LEFT JOIN b ON a.id = b.id WHERE a.id NOT IN (SELECT id FROM c)""")
def bool_must_should_not(spark, sf):
    m = lambda w: {"match": {"text": w}}
    return _scored(_documents(spark, sf, {"query": {"bool": {"must": [m("the")], "should": [m("and of")], "must_not": [m("license")]}}}).matches())


# ---- vectors -------------------------------------------------------------------------------------------------------
_VECTOR = [round(((i * 37) % 17 - 8) / 10, 1) for i in range(64)]
_V = "[" + ", ".join(f"{x}::DOUBLE" for x in _VECTOR) + "]"
_NORM = sum(x * x for x in _VECTOR) ** 0.5


def _vectors(spark, sf, distance, request):
    docs = _table(spark, sf, "embeddings", "vec_id").withColumnRenamed("embedding", "v__vec").withColumn("v", F.lit("x"))
    return _scored(_search(docs, {"v": {"type": "text", "search": {"semantic": {"dim": 64, "distance": distance}}}, "label": _f("int")}, request).hits())


def _knn(k: int) -> dict:
    return {"knn": {"field": "v", "query_vector": _VECTOR, "k": k}}


@_register(f"SELECT vec_id AS id, round((1 + list_inner_product(embedding::DOUBLE[], {_V})) / 2, 6) AS score FROM embeddings ORDER BY (1 + list_inner_product(embedding::DOUBLE[], {_V})) / 2 DESC, id LIMIT 25")
def knn_dot(spark, sf):
    return _vectors(spark, sf, "dot", {"query": _knn(25), "size": 25})


@_register(f"SELECT vec_id AS id, round((1 + list_cosine_similarity(embedding::DOUBLE[], {_V})) / 2, 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_V}) DESC, id LIMIT 25")
def knn_cosine(spark, sf):
    return _vectors(spark, sf, "cosine", {"query": _knn(25), "size": 25})


@_register(f"SELECT vec_id AS id, round((1 + list_inner_product(embedding::DOUBLE[], {_V})) / 2, 6) AS score FROM embeddings WHERE label >= 5 ORDER BY list_inner_product(embedding::DOUBLE[], {_V}) DESC, id LIMIT 25")
def knn_filtered(spark, sf):
    return _vectors(spark, sf, "dot", {"query": _knn(25), "size": 25, "filters": {"include": {"range": {"label": {"gte": 5}}}}})


@_register(f"SELECT vec_id // 4 AS id, round(max((1 + list_inner_product(embedding::DOUBLE[], {_V})) / 2), 6) AS score FROM embeddings GROUP BY 1 ORDER BY max(list_inner_product(embedding::DOUBLE[], {_V})) DESC, id LIMIT 25")
def knn_multivector(spark, sf):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet").groupBy(F.floor(F.col("vec_id") / 4).alias("_id")).agg(F.collect_list("embedding").alias("v__vec")).withColumn("v", F.array(F.lit("x")))
    return _scored(_search(docs, {"v": {"type": "text[]", "search": {"semantic": {"dim": 64}}}}, {"query": _knn(25), "size": 25}).hits())


_SIGNS = "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"


def _steps(n: int) -> str:
    top = "list_max(list_transform(embedding, lambda y: abs(y::DOUBLE)))"
    return f"list_transform(embedding, lambda x: CASE WHEN {top} = 0 THEN 0 ELSE round(x::DOUBLE * {n} / {top}) * {top} / {n} END)"


def _quantised(kind: str, vector: str) -> None:
    def query(spark, sf):
        docs = _table(spark, sf, "embeddings", "vec_id").withColumnRenamed("embedding", "v__vec").withColumn("v", F.lit("x"))
        fields = {"v": {"type": "text", "search": {"semantic": {"dim": 64, "quantize": kind}}}}
        # sums of few distinct numbers tie often and differ in the last digit by the order of summing: ranked again on rounded scores
        found = _search(docs, fields, {"query": _knn(4000), "size": 4000}).hits()
        return found.select(F.col("_id").alias("id"), F.round("_score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(25)

    _QUERIES[f"knn_{kind}"] = query
    _SQL[f"knn_{kind}"] = f"SELECT vec_id AS id, round((1 + list_inner_product({vector}, {_V})) / 2, 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 25"


_quantised("int1", _SIGNS)
_quantised("int8", _steps(127))
_quantised("int4", _steps(7))


class LetterEmbedder:
    """Letters counted, at unit length: an embedding that SQL can express."""

    def embed(self, texts: list[str], task: str = "raw") -> np.ndarray:
        v = np.array([[t.count(c) for c in _LETTERS] for t in texts], float).reshape(len(texts), len(_LETTERS))
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_COUNTS = "[" + ", ".join(f"(length(p_name) - length(replace(p_name, '{c}', '')))::DOUBLE" for c in _LETTERS) + "]"
_ASKED = "[" + ", ".join(f"{float('deep red'.count(c))}::DOUBLE" for c in _LETTERS) + "]"


@_register(f"SELECT p_partkey AS id, round((1 + list_cosine_similarity({_COUNTS}, {_ASKED})) / 2, 4) AS score FROM part ORDER BY 2 DESC, 1 LIMIT 40")
def semantic_letters(spark, sf):
    from docquarry.engine import embedding_udf

    docs = _table(spark, sf, "part", "p_partkey").withColumn("p_name__vec", embedding_udf(LetterEmbedder())("p_name"))
    models = Models(embedding={"letters": LetterEmbedder()})
    fields = {"p_name": {"type": "text", "search": {"semantic": {"model": "letters"}}}}
    s = Search(corpus_of(docs, Mapping.parse("q", {"fields": fields}), models), dsl.parse_search({"query": {"semantic": {"field": "p_name", "query": "deep red", "k": 10_000}}, "size": 10_000}), models)
    return s.hits().select(F.col("_id").alias("id"), F.round("_score", 4).alias("score")).orderBy(F.desc("score"), "id").limit(40)


# ---- reranking -----------------------------------------------------------------------------------------------------
@_register(f"""WITH {_bm25('a', 'part', 'p_partkey', 'p_name', ['red'])}, {_bm25('b', 'part', 'p_partkey', 'p_type', ['brass'])},
x AS (SELECT id, 1 / (60.0 + row_number() OVER (ORDER BY score DESC, id) - 1) AS r FROM (SELECT * FROM a ORDER BY score DESC, id LIMIT 30)),
y AS (SELECT id, 1 / (60.0 + row_number() OVER (ORDER BY score DESC, id) - 1) AS r FROM (SELECT * FROM b ORDER BY score DESC, id LIMIT 30)),
s AS (SELECT id, sum(r) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY id)
SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 30""")
def rrf_hybrid(spark, sf):
    q = {"rrf": {"retrieve": [{"match": {"p_name": "red"}}, {"match": {"p_type": "brass"}}], "rank_window_size": 30}}
    return _scored(_search(_table(spark, sf, "part", "p_partkey"), {"p_name": _LEX, "p_type": _LEX}, {"query": q, "size": 30}).hits())


@_register(f"""WITH w AS (SELECT p_partkey AS id, {_TOKENS.format('p_name')} AS a FROM part ORDER BY p_partkey LIMIT 100)
SELECT id, round(len(list_intersect(list_distinct(a), ['red', 'part'])) / 2, 6) AS score FROM w ORDER BY score DESC, id LIMIT 10""")
def cross_encoder_overlap(spark, sf):
    q = {"cross_encoder": {"model": "overlap", "query": "red part", "retrieve": {"match_all": {}}, "doc_template": "{{ p_name }}", "rank_window_size": 100}}
    return _scored(_search(_table(spark, sf, "part", "p_partkey"), {"p_name": _LEX}, {"query": q, "size": 10}).hits())


# ---- filters -------------------------------------------------------------------------------------------------------
_ORDERS = {"o_orderstatus": _f("text"), "o_orderpriority": _f("text"), "o_totalprice": _f("double"), "o_custkey": _f("long"), "o_orderdate": _f("datetime")}



def _simple(name: str, table: str, key: str, fields: dict, filters: dict, where: str) -> None:
    _QUERIES[name] = lambda spark, sf: _ids(_table(spark, sf, table, key), fields, filters)
    _SQL[name] = f"SELECT {key} AS id FROM {table} WHERE {where}"


_PART = {"p_name": _LEX, "p_brand": _f("text"), "p_type": _f("text"), "p_size": _f("int"), "p_retailprice": _f("double")}
_simple("filter_term_text", "orders", "o_orderkey", _ORDERS, {"include": {"term": {"o_orderstatus": "F"}}}, "o_orderstatus = 'F'")
_simple("filter_term_int", "part", "p_partkey", _PART, {"include": {"term": {"p_size": 7}}}, "p_size = 7")
_simple("filter_term_id", "part", "p_partkey", _PART, {"include": {"term": {"_id": "42"}}}, "p_partkey = 42")
_simple("filter_range_double", "orders", "o_orderkey", _ORDERS, {"include": {"range": {"o_totalprice": {"gt": 1000.5, "lte": 200000}}}}, "o_totalprice > 1000.5 AND o_totalprice <= 200000")
_simple("filter_range_int", "part", "p_partkey", _PART, {"include": {"range": {"p_size": {"gte": 3, "lt": 17.5}}}}, "p_size >= 3 AND p_size < 17.5")
_simple("filter_range_datetime", "events", "event_id", {"ts": _f("datetime")}, {"include": {"range": {"ts": {"gte": "2024-01-05", "lt": "2024-02-01T12:00:00Z"}}}}, "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-02-01 12:00:00'")
_simple("filter_and_or_not", "orders", "o_orderkey", _ORDERS, {"include": {"and": [{"or": [{"term": {"o_orderstatus": "F"}}, {"term": {"o_orderstatus": "O"}}]}, {"not": [{"range": {"o_totalprice": {"lt": 50000}}}]}]}}, "o_orderstatus IN ('F', 'O') AND NOT coalesce(o_totalprice < 50000, false)")
_simple("filter_include_exclude", "orders", "o_orderkey", _ORDERS, {"include": {"term": {"o_orderstatus": "F"}}, "exclude": {"range": {"o_totalprice": {"gte": 100000}}}}, "o_orderstatus = 'F' AND NOT coalesce(o_totalprice >= 100000, false)")
_simple("filter_exclude_only", "orders", "o_orderkey", _ORDERS, {"exclude": {"term": {"o_orderstatus": "F"}}}, "NOT coalesce(o_orderstatus = 'F', false)")


@_register("SELECT o_orderkey AS id FROM orders WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders)")
def filter_term_datetime(spark, sf):
    docs = _table(spark, sf, "orders", "o_orderkey")
    first = docs.agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).first()[0]
    return _ids(docs, _ORDERS, {"include": {"term": {"o_orderdate": first}}})




def _users(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy(F.col("user_id").alias("_id")).agg(F.collect_list(F.round("value").cast("long")).alias("vs"), F.collect_list("event_type").alias("ts"))


_USERS = {"vs": _f("long[]"), "ts": _f("text[]")}


@_register("SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase'")
def filter_term_list(spark, sf):
    return _ids(_users(spark, sf), _USERS, {"include": {"term": {"ts": "purchase"}}})


@_register("SELECT DISTINCT user_id AS id FROM events WHERE round(value) BETWEEN 40 AND 45")
def filter_range_list(spark, sf):
    return _ids(_users(spark, sf), _USERS, {"include": {"range": {"vs": {"gte": 40, "lte": 45}}}})


# ---- geo -----------------------------------------------------------------------------------------------------------
_LAT, _LON = "((c_custkey * 13) % 1700 / 10.0 - 85)", "((c_custkey * 29) % 3600 / 10.0 - 180)"
_KM = f"2 * 6371.0087714 * asin(least(1, sqrt(pow(sin((radians({_LAT}) - radians(52.52)) / 2), 2) + cos(radians({_LAT})) * cos(radians(52.52)) * pow(sin((radians({_LON}) - radians(13.4)) / 2), 2))))"


def _places(spark, sf):
    k = F.col("_id")
    return _table(spark, sf, "customer", "c_custkey").withColumn("at", F.struct(((k * 13) % 1700 / F.lit(10.0) - 85).alias("lat"), ((k * 29) % 3600 / F.lit(10.0) - 180).alias("lon")))


@_register(f"SELECT c_custkey AS id FROM customer WHERE {_KM} <= 3000")
def filter_geo_distance(spark, sf):
    return _ids(_places(spark, sf), {"at": _f("geopoint")}, {"include": {"geo_distance": {"field": "at", "lat": 52.52, "lon": 13.4, "distance": "3000 km"}}})


@_register(f"SELECT c_custkey AS id FROM customer WHERE {_LAT} BETWEEN -30 AND 60 AND {_LON} BETWEEN -120 AND 90")
def filter_geo_box(spark, sf):
    return _ids(_places(spark, sf), {"at": _f("geopoint")}, {"include": {"geo_box": {"field": "at", "top_left": {"lat": 60, "lon": -120}, "bottom_right": {"lat": -30, "lon": 90}}}})


@_register(f"SELECT c_custkey AS id, c_name FROM customer ORDER BY {_KM}, c_custkey LIMIT 40")
def sort_geo_distance(spark, sf):
    s = _search(_places(spark, sf), {"at": _f("geopoint"), "c_name": _f("text")}, {"size": 40, "fields": ["c_name"], "sort": [{"at": {"lat": 52.52, "lon": 13.4}}]})
    return s.hits().select(F.col("_id").alias("id"), "c_name")


# ---- sorting -------------------------------------------------------------------------------------------------------
_GAPS = "(SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS gap FROM orders)"


def _sorted(spark, sf, sort):
    docs = _table(spark, sf, "orders", "o_orderkey").withColumn("gap", F.when(F.col("_id") % 7 != 0, F.col("o_totalprice")))
    return _search(docs, _ORDERS | {"gap": _f("double")}, {"size": 100, "sort": sort, "fields": ["gap"]}).hits().select(F.col("_id").alias("id"), "gap")


@_register(f"SELECT o_orderkey AS id, gap FROM {_GAPS} ORDER BY gap ASC NULLS FIRST, o_orderkey LIMIT 100")
def sort_asc_missing_first(spark, sf):
    return _sorted(spark, sf, [{"gap": {"order": "asc", "missing": "first"}}])


@_register(f"SELECT o_orderkey AS id, gap FROM {_GAPS} ORDER BY gap DESC NULLS LAST, o_orderkey LIMIT 100")
def sort_desc_missing_last(spark, sf):
    return _sorted(spark, sf, [{"gap": "desc"}])


@_register(f"SELECT o_orderkey AS id, gap FROM {_GAPS} ORDER BY o_orderstatus, o_orderpriority DESC, gap DESC NULLS LAST, o_orderkey LIMIT 100")
def sort_multi(spark, sf):
    return _sorted(spark, sf, ["o_orderstatus", {"o_orderpriority": "desc"}, {"gap": {"order": "desc"}}])


@_register("SELECT user_id AS id FROM events GROUP BY 1 ORDER BY min(event_type), max(ts) DESC, user_id LIMIT 60")
def sort_text_list_and_datetime(spark, sf):
    docs = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").alias("_id")).agg(F.collect_list("event_type").alias("kinds"), F.max("ts").alias("last"))
    fields = {"kinds": {"type": "text[]", "sort": True}, "last": {"type": "datetime", "sort": True}}
    return _search(docs, fields, {"size": 60, "sort": ["kinds", {"last": "desc"}]}).hits().select(F.col("_id").alias("id"))


@_register("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY CAST(o_orderdate AS DATE) DESC, o_totalprice > 150000, o_orderkey LIMIT 80")
def sort_date_and_bool(spark, sf):
    docs = _table(spark, sf, "orders", "o_orderkey").withColumn("day", F.to_date("o_orderdate")).withColumn("big", F.col("o_totalprice") > 150000)
    found = _search(docs, {"day": _f("date"), "big": {"type": "bool", "sort": True}}, {"size": 80, "fields": ["day"], "sort": [{"day": "desc"}, "big"]}).hits()
    return found.select(F.col("_id").alias("id"), F.date_format("day", "yyyy-MM-dd").alias("day"))


@_register("SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 150000 AND CAST(o_orderdate AS DATE) >= DATE '1995-06-01'")
def filter_term_bool_range_date(spark, sf):
    docs = _table(spark, sf, "orders", "o_orderkey").withColumn("day", F.to_date("o_orderdate")).withColumn("big", F.col("o_totalprice") > 150000)
    return _ids(docs, {"day": _f("date"), "big": {"type": "bool", "filter": True}}, {"include": {"and": [{"term": {"big": True}}, {"range": {"day": {"gte": "1995-06-01"}}}]}})


@_register("SELECT o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def sort_doc(spark, sf):
    docs = _table(spark, sf, "orders", "o_orderkey")
    return _search(docs, _ORDERS, {"size": 5, "fields": ["o_totalprice"], "sort": [{"_doc": "desc"}]}).hits().select(F.col("_id").alias("id"), F.col("o_totalprice").alias("score"))


# ---- facets --------------------------------------------------------------------------------------------------------
def _facet(docs, fields, agg, filters=None):
    s = _search(docs, fields, {"filters": filters or {}, "aggs": {"a": agg}})
    a = s.request.aggs["a"]
    return (aggs.term_counts if isinstance(a, dsl.TermAgg) else aggs.range_counts)(s.matches(), s.corpus.mapping, a)


@_register("SELECT p_brand AS term, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg_term_text(spark, sf):
    return _facet(_table(spark, sf, "part", "p_partkey"), _PART, {"term": {"field": "p_brand"}})


@_register("SELECT CAST(p_size AS VARCHAR) AS term, count(*) AS count FROM part GROUP BY p_size ORDER BY 2 DESC, p_size LIMIT 15")
def agg_term_int(spark, sf):
    return _facet(_table(spark, sf, "part", "p_partkey"), _PART, {"term": {"field": "p_size", "size": 15}})


@_register("SELECT strftime(o_orderdate, '%Y-%m-%d') AS term, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg_term_date(spark, sf):
    docs = _table(spark, sf, "orders", "o_orderkey").withColumn("day", F.to_date("o_orderdate"))
    return _facet(docs, {"day": _f("date")}, {"term": {"field": "day"}})


@_register("SELECT event_type AS term, count(DISTINCT user_id) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg_term_list(spark, sf):
    return _facet(_users(spark, sf), _USERS, {"term": {"field": "ts"}})


_RANGES = [{"lt": 1000}, {"gte": 500, "lt": 30000}, {"gte": 30000}, {"gt": 1e12}]


@_register("""SELECT 0 AS bucket, count(*) FILTER (l_extendedprice < 1000) AS count FROM lineitem UNION ALL SELECT 1, count(*) FILTER (l_extendedprice >= 500 AND l_extendedprice < 30000) FROM lineitem
UNION ALL SELECT 2, count(*) FILTER (l_extendedprice >= 30000) FROM lineitem UNION ALL SELECT 3, count(*) FILTER (l_extendedprice > 1e12) FROM lineitem""")
def agg_range_double(spark, sf):
    return _facet(_table(spark, sf, "lineitem", "l_orderkey"), {"l_extendedprice": _f("double")}, {"range": {"field": "l_extendedprice", "ranges": _RANGES}})


@_register("""SELECT 0 AS bucket, count(*) FILTER (ts < TIMESTAMP '2024-01-10') AS count FROM events UNION ALL SELECT 1, count(*) FILTER (ts >= TIMESTAMP '2024-01-10') FROM events""")
def agg_range_datetime(spark, sf):
    return _facet(_table(spark, sf, "events", "event_id"), {"ts": _f("datetime")}, {"range": {"field": "ts", "ranges": [{"lt": "2024-01-10"}, {"gte": "2024-01-10"}]}})


@_register("SELECT o_orderpriority AS term, count(*) AS count FROM orders WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg_filtered(spark, sf):
    return _facet(_table(spark, sf, "orders", "o_orderkey"), _ORDERS, {"term": {"field": "o_orderpriority"}}, {"include": {"range": {"o_totalprice": {"gt": 100000}}}})


@_register("SELECT CAST(round(l_discount, 2) AS VARCHAR) AS term, count(*) AS count FROM lineitem GROUP BY l_discount ORDER BY 2 DESC, l_discount LIMIT 12")
def agg_term_double(spark, sf):
    return _facet(_table(spark, sf, "lineitem", "l_orderkey"), {"l_discount": _f("double")}, {"term": {"field": "l_discount", "size": 12}})


@_register(f"""WITH {_bm25('a', 'part', 'p_partkey', 'p_name', ['red'])}, {_bm25('b', 'part', 'p_partkey', 'p_type', ['brass'])}, u AS (SELECT id FROM a UNION SELECT id FROM b)
SELECT p_brand AS term, count(*) AS count FROM u JOIN part ON p_partkey = id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def agg_of_fused_matches(spark, sf):
    q = {"rrf": {"retrieve": [{"match": {"p_name": "red"}}, {"match": {"p_type": "brass"}}], "rank_window_size": 30}}
    s = _search(_table(spark, sf, "part", "p_partkey"), _PART | {"p_type": _LEX}, {"query": q})
    return aggs.term_counts(s.matches(), s.corpus.mapping, dsl.TermAgg("p_brand"))


@_register(f"WITH {_bm25('m', 'documents', 'doc_id', 'text', ['license'])} SELECT source AS term, count(*) AS count FROM m JOIN documents ON doc_id = id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg_of_matches(spark, sf):
    s = _documents(spark, sf, {"query": {"match": {"text": "license"}}})
    return aggs.term_counts(s.matches(), s.corpus.mapping, dsl.TermAgg("source"))


# ---- suggestions ---------------------------------------------------------------------------------------------------
_NAMES = {"p_name": {"type": "text", "suggest": True}}
_PHRASES = f"""WITH t AS (SELECT {_TOKENS.format('p_name')} AS w FROM part),
g AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS text FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, (VALUES (1), (2), (3)) AS s(n) WHERE len(w) >= n)),"""


def _phrases(spark, sf):
    return suggest.candidates(_table(spark, sf, "part", "p_partkey"), Mapping.parse("q", {"fields": _NAMES}), "p_name")


@_register(_PHRASES.rstrip(",") + " SELECT text FROM g")
def suggest_candidates(spark, sf):
    return _phrases(spark, sf)


@_register(_PHRASES.rstrip(",") + " SELECT text FROM g WHERE starts_with(text, 're') ORDER BY text LIMIT 50")
def suggest_prefix(spark, sf):
    return suggest.lists(_phrases(spark, sf), "re", 50)[0]


@_register(_PHRASES.rstrip(",") + " SELECT text FROM g WHERE starts_with(text, 'b') AND (damerau_levenshtein(text[1:3], 'bleu') <= 1 OR damerau_levenshtein(text[1:4], 'bleu') <= 1 OR damerau_levenshtein(text[1:5], 'bleu') <= 1) ORDER BY text LIMIT 50")
def suggest_fuzzy(spark, sf):
    return suggest.lists(_phrases(spark, sf), "bleu", 50)[1]


@_register(_PHRASES.rstrip(",") + " SELECT text FROM g WHERE contains(lower(text), 'ed') ORDER BY text LIMIT 50")
def suggest_pattern(spark, sf):
    return suggest.lists(_phrases(spark, sf), "ed", 50)[3]


_CLOSE = " OR ".join(f"damerau_levenshtein(text[1:{n}], '@') <= 2" for n in range(2, 7))


@_register(_PHRASES.rstrip(",") + f" SELECT text FROM g WHERE starts_with(text, 'b') AND ({_CLOSE.replace('@', 'bleu')}) ORDER BY text LIMIT 50")
def suggest_fuzzy2(spark, sf):
    return suggest.lists(_phrases(spark, sf), "bleu", 50)[2]


_NEAR = " OR ".join(f"damerau_levenshtein(text[1:{n}], 'red') <= @" for n in range(1, 6))
_LISTS = ["starts_with(text, 'red')", f"starts_with(text, 'r') AND ({_NEAR.replace('@', '1')})", f"starts_with(text, 'r') AND ({_NEAR.replace('@', '2')})", "contains(lower(text), 'red')"]


@_register(_PHRASES + ", ".join(f"l{i} AS (SELECT text, 1 / (60.0::DOUBLE + row_number() OVER (ORDER BY text) - 1) AS part, {i} AS seen FROM g WHERE {w} ORDER BY text LIMIT 50)" for i, w in enumerate(_LISTS))
    + ", u AS (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(4)) + ") SELECT arg_min(text, seen) AS text, round(sum(part), 6) AS score FROM u GROUP BY lower(text) ORDER BY sum(part) DESC, lower(text) LIMIT 20")
def suggest_fused(spark, sf):
    r = dsl.parse_suggest({"query": "red", "fields": ["p_name"], "count": 20})
    found = suggest.suggest(_table(spark, sf, "part", "p_partkey"), Mapping.parse("q", {"fields": _NAMES}), r)
    return found.select("text", F.round("score", 6).alias("score"))


# ---- text, ingest, answers -----------------------------------------------------------------------------------------
@_register(f"SELECT doc_id AS id, array_to_string({_TOKENS.format('text')}, ' ') AS terms FROM documents")
def analyze_generic(spark, sf):
    return _table(spark, sf, "documents", "doc_id").select(F.col("_id").alias("id"), F.array_join(analyze(F.col("text")), " ").alias("terms"))


@_register("SELECT user_id AS id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def ingest_upsert_last_wins(spark, sf):
    """Through an index: some events, then all of them, staged as two batches of one version."""
    i = _index(spark, {"event_id": {"type": "long"}, "event_type": _f("text")})
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("_id"), "event_id", "event_type", F.col("event_id").alias("_order"))
    i.add_documents(e.where("event_type <> 'error'"))
    i.add_documents(e)
    i.flush()
    return i.docs().select(F.col("_id").cast("long").alias("id"), "event_id", "event_type")


def _index(spark, fields):
    from docquarry.engine import Index
    from docquarry.sources.store import scratch

    return Index(spark, Mapping.parse("q", {"fields": fields}), scratch(spark))


@_register("SELECT event_id AS id FROM events WHERE NOT coalesce(event_type = 'error' AND value > 10, false) AND event_id <> 5")
def ingest_delete_by_filter(spark, sf):
    i = _index(spark, {"event_type": _f("text"), "value": _f("double")})
    i.add_documents(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("string").alias("_id"), "event_type", "value"))
    i.flush()
    i.delete(where={"include": {"and": [{"term": {"event_type": "error"}}, {"range": {"value": {"gt": 10}}}]}})
    i.delete(ids=["5"])
    i.flush()
    return i.docs().select(F.col("_id").cast("long").alias("id"))


@_register(f"WITH {_bm25('m', 'documents', 'doc_id', 'text', ['license', 'the', 'of'])} SELECT id, round(score, 6) AS score FROM m ORDER BY m.score DESC, id LIMIT 40")
def index_match_top(spark, sf):
    """Through an index with postings: texts are analysed when it is written, the query reads its terms' row groups."""
    i = _index(spark, {"text": {"type": "text", "search": {"lexical": {"analyze": "generic"}}}})
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet")).select(F.col("doc_id").cast("string").alias("_id"), "text", F.col("doc_id").alias("_order"))
    i.add_documents(docs)
    i.flush()
    found = i.plan({"query": {"match": {"text": "license the of"}}, "size": 40}).hits()
    return found.select(F.col("_id").cast("long").alias("id"), F.round("_score", 6).alias("score"))


@_register("SELECT CAST(event_id AS VARCHAR) AS id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def flatten_nested(spark, sf):
    from docquarry.sources.readers import documents

    m = Mapping.parse("q", {"fields": {"props.k": {"type": "int"}}})
    lines = spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit('{"_id": '), F.col("event_id").cast("string"), F.lit(', "props": '), F.col("props"), F.lit("}")).alias("value"))
    return documents(lines, m).select(F.col("_id").alias("id"), F.col("`props.k`").alias("k"))


@_register(r"SELECT doc_id AS id, regexp_extract('source: ' || source || chr(10) || 'lang: ' || lang || chr(10) || 'text: ' || text, '^(?:\s*\S+){0,40}') AS context FROM documents")
def rag_prompt(spark, sf):
    s = _documents(spark, sf, {})
    return rag.context(s.matches(), s.corpus.mapping, ["source", "lang", "text"], 40).select(F.col("_id").alias("id"), "context")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked match under a filter, each hit with its source's facet count over all matches."""
    s = _documents(spark, sf_dir, {"query": {"match": {"text": "the and"}}, "filters": {"include": {"term": {"lang": "en"}}}, "fields": ["source"]})
    counts = aggs.term_counts(s.matches(), s.corpus.mapping, dsl.TermAgg("source", 100))
    return _scored(s.hits(), "source").join(counts.withColumnRenamed("term", "source"), "source")


@_register(f"""WITH {_bm25('m', 'documents', 'doc_id', 'text', ['the', 'and'])}, k AS (SELECT id, m.score, source FROM m JOIN documents ON doc_id = id WHERE lang = 'en'),
c AS (SELECT source, count(*) AS count FROM k GROUP BY 1), t AS (SELECT * FROM k ORDER BY score DESC, id LIMIT 10)
SELECT t.source, id, round(score, 6) AS score, c.count FROM t JOIN c ON c.source = t.source""")
def flagship_search(spark, sf):
    return flagship(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
