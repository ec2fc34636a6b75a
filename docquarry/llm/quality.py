"""Quality rules: a threshold table compiled into one projection (no shuffle, no user functions).

Every rule is a row (name, measure, least, most) of ``RULES``; ``compile_rules`` turns the table into one Boolean
expression over measures that are themselves plain column expressions, so the whole operator is a scan and a project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import SPACE, words_of

#: Frequent function words of the languages that the corpus holds.
STOP_WORDS = (
    "the of and to in is that for it with was on be by are this from "
    "der die und das den zu von mit ist ein eine im für auf auch es des "
    "el la los las de que y en por para con se del una un "
    "le les et des du est dans pour une sur qui par au avec il"
).split()

#: (rule, measure, least, most); None: no bound. A document is kept if every measure lies within its bounds.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("word_length", "mean_word_chars", 2.0, 15.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop_words", "stop_kinds", 2.0, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("shouting", "upper_ratio", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    ``windows``: the windows' 64-bit hashes. Their positions sorted by (hash, position) bring equal windows together; each
    repeated window then covers three words, less what the next repeated window (by position) covers.
    """
    tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)

    def repeated(s: Column) -> Column:
        pick = F.filter(
            s,
            lambda x, k: ((k > 0) & (F.try_element_at(s, k)["h"] == x["h"])) | ((k < n - 1) & (F.try_element_at(s, k + 2)["h"] == x["h"])),
        )
        return F.array_sort(F.transform(pick, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    # transform over a one-element array binds a value once, where a plain reuse of the expression would compute it anew
    once = F.transform(F.array(tagged), repeated)
    return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0)).otherwise(F.transform(once, covered)[0])


def measures(docs: DataFrame, text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """The input's rows as a struct ``_row`` (so no name of theirs can clash) with the measures, ``_q_...``, behind it."""
    stop = sorted({v for w in (stop_words or STOP_WORDS) for v in (w, w.capitalize())})
    t = F.col("_q_text")
    whole = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_q_text"))
    step1 = whole.withColumn("_q_words", words_of(t)).withColumn("_q_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w = F.col("_q_words")
    step2 = step1.withColumn(
        "_q_windows",
        F.when(
            F.size(w) >= 3,
            F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    found = F.struct(
        F.size(w).cast("long").alias("_q_n_words"),
        F.char_length(F.regexp_replace(t, SPACE + "+", "")).cast("long").alias("_q_word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("_q_n_symbols"),
        F.size("_q_lines").cast("long").alias("_q_n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("_q_n_dup_lines"),
        _repeat_words(w, F.col("_q_windows")).cast("long").alias("_q_n_repeat_words"),
        F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in stop]))).cast("long").alias("_q_stop_kinds"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("_q_upper"),
        F.regexp_count(t, F.lit(r"\p{Lu}|\p{Ll}")).cast("long").alias("_q_letters"),
    )
    # a generator of one row: without it the optimizer would push a filter on `kept` below, writing every measure out again
    # for every place in the condition that names it
    return step2.select("_row", F.inline(F.array(found)))


def compile_rules(rules=RULES) -> Column:
    """The threshold table as one Boolean expression over the measures."""
    n = F.greatest(F.col("_q_n_words"), F.lit(1))
    ratio = {
        "mean_word_chars": F.col("_q_word_chars") / n,
        "symbol_ratio": F.col("_q_n_symbols") / n,
        "stop_kinds": F.col("_q_stop_kinds").cast("double"),
        "dup_line_ratio": F.col("_q_n_dup_lines") / F.greatest(F.col("_q_n_lines"), F.lit(1)),
        "upper_ratio": F.col("_q_upper") / F.greatest(F.col("_q_letters"), F.lit(1)),
    }
    ok = F.lit(True)
    for _, measure, least, most in rules:
        if least is not None:
            ok = ok & (ratio[measure] >= least)
        if most is not None:
            ok = ok & (ratio[measure] <= most)
    return ok


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES, stop_words: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` with the measures, ``base_failed`` and ``kept``.

    Nulls: a null text has no words, so it fails the base rule; other columns, null or not, pass through untouched. Empty
    texts fail likewise. ``n_repeat_words`` compares 3-word windows by 64-bit hashes: two different windows of a text of a million
    words agree with a probability of about 3e-8. Texts of any length are judged whole. Repeated rows are judged one by one; an empty table gives an empty table. Columns named
    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed`` or ``kept`` in the
    input are replaced by the computed ones.
    """
    m = measures(docs, text, stop_words)
    failed = (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q_n_words"))
    new = {k: F.col(f"_q_{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    new |= {"base_failed": failed, "kept": ~failed & compile_rules(rules)}
    return m.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])
