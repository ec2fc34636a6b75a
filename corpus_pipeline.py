"""The corpus pipeline: quality rules, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import ngram_join, packing, quality, secrets_scan
from docquarry.llm.common import remove, shared_dir, written

TOKENIZER = "byte_bpe_50k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with the columns they came with.

    A null or empty text is rejected. Texts of any length are judged whole, repeated rows each by itself, ids play no part, and an
    empty table gives an empty table.
    """
    judged = quality.quality_rules(docs)
    return judged.where("kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, with the columns it came with.

    A row is known by its id and text. Rows that repeat both are one document, of which one row stays (that whose other columns
    are the least, as JSON). Rows that share an id but not the text are documents of their own, each compared and kept or
    dropped by itself, and so are rows without an id; in a group they stand behind all that have an id to themselves, but for
    the smallest text of an id, which stands for the id. A null or empty text is like no other: each of its ids keeps a row.
    Texts of any length are compared whole, and an empty table gives an empty table.
    """
    folder = shared_dir(spark)
    again = written(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), folder, "repeated")
    if again.isEmpty():
        groups = written(ngram_join.jaccard_join(docs), folder, "groups")
        return ngram_join.without(docs, written(groups.where("doc_id <> component_id").select("doc_id"), folder, "dropped"), "doc_id")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    row = F.struct(F.col("doc_id"), F.col("text"), rest.alias("rest"))
    ids = again.select(F.struct("doc_id").alias("id"))  # a struct with a null field equals another one
    rows = docs.select(F.struct("doc_id").alias("id"), row.alias("row"))
    odd = rows.join(ids, "id", "left_semi").groupBy("id", F.struct("row.text").alias("text")).agg(F.min_by("row", F.coalesce(F.to_json("row.rest"), F.lit(""))).alias("row"))
    odd = written(odd.select("id", "row", F.monotonically_increasing_id().alias("place")), folder, "odd")
    # the smallest text of an id goes by the id, the others by numbers above all ids
    first = odd.where("id.doc_id is not null").groupBy("id").agg(F.min(F.struct("row.text", "place")).alias("first")).select("id", F.col("first.place").alias("place"), F.lit(True).alias("first"))
    above = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0] + 1
    key = F.when(F.col("first"), F.col("id.doc_id")).otherwise(above + F.col("place"))
    keyed = rows.join(ids, "id", "left_anti").select(F.col("row.doc_id").alias("key"), "row").union(odd.join(first, ["id", "place"], "left").select(key.alias("key"), "row"))
    keyed = written(keyed.select(F.col("key").cast("long").alias("key"), "row"), folder, "keyed")
    groups = written(ngram_join.jaccard_join(keyed.select("key", F.col("row.text").alias("text")), key="key"), folder, "groups")
    left = ngram_join.without(keyed, written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("key")), folder, "dropped"), "key")
    return left.select(*[F.col(f"row.{c}") if c in ("doc_id", "text") else F.col("row.rest").getField(c).alias(c) for c in docs.columns])


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; ``n_chars`` follows the text where there is one.

    A null or empty text stays as it is. Texts of any length are masked whole, repeated rows each, ids play no part, and an empty
    table gives an empty table.
    """
    model = secrets_scan.train(secrets_scan.labelled_samples(spark))
    masked = secrets_scan.redact(docs, model)
    if "n_chars" not in docs.columns:
        return masked
    size = F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Nulls, empty and long texts, repeated rows and empty tables: see ``packing.pack``.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("secret scans", secrets_stage), ("best-fit packing", packing_stage)]

#: Tokens and bins are beyond SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table goes when the next one's is there."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out, folder, f"stage-{k}")
            if k:
                remove(spark, f"{folder}/stage-{k - 1}")
        docs = out
    return docs
