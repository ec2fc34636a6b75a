"""Words behind character 32,000 are searched, counted and suggested like all others."""

import duckdb
import pytest
from pyspark.sql import functions as F

from docquarry.engine import Index
from docquarry.functions.text import analyze, analyze_query
from docquarry.mapping import Mapping
from docquarry.operators import suggest
from docquarry.plans import catalogue
from tests.test_entry import _rows

NAMES = "match_or match_and match_filtered_top bool_must_should_not multi_match_best multi_match_most agg_of_matches analyze_generic flagship_search".split()
FAR = "plain filler words " * 2000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    tails = ["license version the of and", "license", "version the and", "of and the red", "html com title", ""]
    texts = [(FAR if far else "") + t for far in (True, False) for t in tails] + ["short and plain", None]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 2}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, f"http://x{i}.com/", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_whole_texts(spark, folder, name):
    """Against the registered SQL, on texts whose words stand far behind."""
    whole = catalogue.oracle_sql()[name]
    assert "substr" not in whole
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, want = catalogue.queries()[name](spark, folder).toPandas(), con.sql(whole).df()
    assert len(want) and sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_analyzers_on_long_texts(spark):
    texts = [FAR + "tail", "1.2'" * 60_000 + "3", "a" * 40_000 + " tail"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("generic", "english", "french"):
        assert [r[0] for r in df.select(analyze(F.col("t"), name)).collect()] == [analyze_query(t, name) for t in texts], name
    assert analyze_query(texts[0])[-1] == "tail" and len(analyze_query(texts[1])) == 1


def test_long_lists_and_suggestions(spark, tmp_path):
    """Every item of a list is searched to its end, and phrases behind a long text are suggested."""
    m = Mapping.parse("l", {"fields": {"many": {"type": "text[]", "search": {"lexical": {"analyze": "english"}}}, "one": {"type": "text", "suggest": {"expand": {"min-terms": 1, "max-terms": 2}}}}})
    i = Index(spark, m, f"file://{tmp_path}/l")
    i.add([{"_id": 1, "many": [FAR + "zebras", FAR, "walrus"], "one": FAR + "red panda"}, {"_id": 2, "many": ["short"], "one": "short"}])
    i.flush()
    for word in ("zebra", "walrus"):
        assert [h["_id"] for h in i.search({"query": {"match": {"many": word}}})["hits"]] in ([1], ["1"]), word
    docs = spark.createDataFrame([(FAR + "red panda",)], "one string")
    assert suggest.candidates(docs, m, "one").where("text = 'red panda'").count() == 1
