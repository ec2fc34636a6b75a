"""Prompts of retrieval-augmented answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.mapping import Mapping
from docquarry.operators.filters import column


def _line(m: Mapping, name: str) -> Column:
    f = m.resolve(name)
    c = column(name)
    value = F.array_join(c, ", ") if f.is_list else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if f.type == "datetime" else c.cast("string")
    return F.concat(F.lit(f"{name}: "), value)


def context(hits: DataFrame, m: Mapping, fields: list[str], max_doc_length: int) -> DataFrame:
    """Hits with ``context``: ``name: value`` lines of a document, cut to so many white-space tokens.

    Ids, scores, points and lists of numbers are passed over.
    """
    told = [f for f in fields if (s := m.resolve(f)) and s.type not in ("id", "geopoint") and not (s.is_list and s.base != "text")]
    text = F.concat_ws("\n", *[_line(m, f) for f in told])
    cut = F.regexp_extract(text, rf"^(?:\s*\S+){{0,{max_doc_length}}}", 0)
    return hits.withColumn("context", cut)


def prompt(instruction: str, contexts: list[str], max_words: int | None = None) -> str:
    """The instruction, an empty line, then the documents, cut to the model's context."""
    text = instruction + "\n\n" + "\n\n".join(contexts)
    words = text.split(" ")
    return text if max_words is None or len(words) <= max_words else " ".join(words[:max_words])
