"""Secret scans: fixed patterns plus character Markov models, all in column expressions (one scan, no shuffle).

Two first-order Markov models over ASCII characters, one of random strings and one of ordinary identifiers, are trained
from labelled samples by a grouped count of bigrams. A candidate token is a secret when its mean log-likelihood ratio per
bigram exceeds ``THRESHOLD``. The models travel as one literal array of 128 x 128 doubles, whatever the corpus holds.

Positions without user functions: ``split`` by a pattern gives the gaps between the matches that ``regexp_extract_all``
gives for it, so start and end are running sums of lengths, in blocks of blocks. Masking reads a text in blocks of signs, too. So
the work is in proportion to the text, however many matches it holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Tokens that the models judge: long, with a digit and a letter, and no UUID (an identifier, though its digits are random).
UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?!" + UUID + r"(?![A-Za-z0-9+/_=-]))(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Signs of a block in which masking reads a text.
SIGNS = 1024
#: Nats per bigram that the random model must be ahead by.
THRESHOLD = 0.4
#: Labelled rows of each class that ``labelled_samples`` makes: the documented bound of what the models are fitted on.
SAMPLES_PER_CLASS = 4000
_STEMS = (
    "get set is has make build create update delete remove insert find load save read write open close start stop run init "
    "user name value index count total size length width height key list map table row column field type class method "
    "request response client server session token handler manager factory service config option default parser reader "
    "writer buffer stream file path folder image button label window panel event action state status error message result "
    "order item price account customer product invoice payment address country language version number date time zone "
    "document section chapter paragraph sentence token word letter string integer double float boolean object array node "
    "tree graph edge vertex matrix vector query filter sort group join merge split batch worker thread process queue stack "
    "gesellschaft verwaltung schaltung fahrt dampf schiff rechnung entwicklung einheit nachricht kunde strasse "
    "développement fonction utilisateur chaîne fichier quelque toujours ordinateur désarrollo información usuario archivo palabra ciudad "
    "knowledge graphics wrapper justify physics rhythm yellow awkward vocabulary jukebox oxygen zebra quick"
).split()


#: Runs in the order of an alphabet or a keyboard: anything but random, though no words either.
_RUNS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01234567890123456789", "12345678901234567890", "qwertyuiopasdfghjklzxcvbnm", "zyxwvutsrqponmlkjihgfedcba", "98765432109876543210", "abcdef0123456789abcdef")


def labelled_samples(spark: SparkSession, per_class: int = SAMPLES_PER_CLASS) -> DataFrame:
    """(text, random): digests in several alphabets, bare and behind a prefix, against identifiers put together from ordinary
    words, paths, dates, versions and runs of an alphabet."""
    i = F.col("id")
    digest = F.unhex(F.concat(F.sha2(i.cast("string"), 256), F.sha2(F.concat(i.cast("string"), F.lit("b")), 256)))
    kinds = [
        F.substring(F.base64(digest), 1, 40), F.lower(F.substring(F.hex(digest), 1, 40)), F.substring(F.translate(F.base64(digest), "+/=", "xYz"), 1, 32),
        F.substring(F.hex(digest), 1, 32), F.concat(F.lit("sk_live_"), F.substring(F.translate(F.base64(digest), "+/=", "9aZ"), 3, 28)),
        F.concat(F.lit("ghp_"), F.substring(F.translate(F.base64(digest), "+/=", "q0R"), 5, 36)), F.substring(F.translate(F.base64(digest), "+/", "-_"), 7, 43),
    ]
    stems, runs = (F.array(*[F.lit(x) for x in words]) for words in (_STEMS, _RUNS))
    pick = lambda words, n, k: F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(n)) + 1).cast("int"))
    a, b, c = (pick(stems, len(_STEMS), k) for k in (1, 2, 3))
    part = lambda k: F.substr(pick(runs, len(_RUNS), k), F.pmod(F.xxhash64(i, F.lit(k + 1)), F.lit(6)).cast("int") + 1, F.lit(16))
    day = F.date_add(F.lit("2019-01-01").cast("date"), F.pmod(F.xxhash64(i), F.lit(2500)).cast("int"))
    plain = [
        F.concat_ws("_", a, b, c, (i % 100).cast("string")), F.concat(a, F.initcap(b), F.initcap(c), (i % 10).cast("string")),
        F.concat(a, F.lit("-"), b, F.lit("/"), c, F.lit("/"), (2000 + i % 30).cast("string")), F.concat(F.upper(a), F.lit("_"), F.upper(b), F.lit("_"), F.upper(c), (i % 10).cast("string")),
        F.concat(part(10), part(20)), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("_"), a, F.lit("_"), b, F.lit("-v"), (i % 10).cast("string"), F.lit("-"), (i % 7).cast("string")),
        F.concat(a, b, c, (i % 1000).cast("string")),
    ]
    choose = lambda xs: F.element_at(F.array(*xs), (i % len(xs) + 1).cast("int"))
    ids = spark.range(per_class)
    return ids.select(choose(kinds).alias("text"), F.lit(True).alias("random")).union(ids.select(choose(plain).alias("text"), F.lit(False).alias("random")))


def train(samples: DataFrame, smoothing: float = 0.5) -> np.ndarray:
    """Log-likelihood ratios, random against ordinary, of ASCII bigrams: 16,384 doubles, row-major.

    ``samples``: text, random (Boolean). Null texts and characters beyond ASCII are passed over. At most 2 x 16,384
    counts reach the driver.
    """
    codes = F.transform(F.split(F.regexp_replace(F.col("text"), r"[^\x01-\x7F]", ""), ""), lambda x: F.ascii(x))
    pairs = (
        samples.where("text is not null and random is not null")
        .select("random", codes.alias("c"))
        .select("random", F.explode(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.slice("c", 2, F.size("c")).alias("b"))).alias("p"))
        .where("p.a is not null and p.b is not null")
        .groupBy("random", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .count()
    )
    n = np.full((2, 128, 128), smoothing)
    for r in pairs.collect():
        n[int(r["random"]), r["a"], r["b"]] += r["count"]
    p = np.log(n / n.sum(axis=2, keepdims=True))
    return (p[1] - p[0]).ravel()


def _before(x: Column, depth: int, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What the elements before each element add up to (by ``op``), in blocks of 64, whose totals are added up likewise."""
    total = lambda a: F.aggregate(a, start, op)
    blocks = lambda p: F.transform(F.sequence(F.lit(0), (F.size(p) / 64).cast("int")), lambda b: total(F.slice(p, b * 64 + 1, 64)))

    def each(p: Column, bs: Column | None) -> Column:
        if bs is None:
            return F.transform(p, lambda _, k: total(F.slice(p, 1, k)))
        return F.transform(p, lambda _, k: op(F.get(bs, (k / 64).cast("int")), total(F.slice(p, (k / 64).cast("int") * 64 + 1, k % 64))))

    # one-element arrays bind a value once
    if depth == 0:
        return F.transform(F.array(x), lambda p: each(p, None))[0]
    return F.transform(F.array(x), lambda p: F.transform(F.array(_before(blocks(p), depth - 1, start, op)), lambda bs: each(p, bs))[0])[0]


def _prefix_sums(x: Column) -> Column:
    """Sums of the elements before each element."""
    return _before(x, 2, F.lit(0), lambda s, v: s + v)


def _find(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and non-overlapping: array of (start, end, text), code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
        sizes = F.transform(found, lambda m: F.char_length(m))

        def spans(g: Column) -> Column:
            steps = F.transform(sizes, lambda s, k: s + F.get(g, k))
            return F.transform(
                F.arrays_zip(_prefix_sums(steps).alias("before"), found.alias("text"), F.slice(g, 1, F.size(found)).alias("gap")),
                lambda z: F.struct(
                    (z["before"] + z["gap"]).alias("start"), (z["before"] + z["gap"] + F.char_length(z["text"])).alias("end"), z["text"].alias("text")
                ),
            )

        return F.when(F.size(found) == 0, none).otherwise(F.transform(F.array(gaps), spans)[0])

    return F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), place)[0]


def _llr(token: Column, model: np.ndarray) -> Column:
    """Mean log-likelihood ratio per bigram."""
    weights = F.split(F.lit(",".join(map(repr, model.tolist()))), ",").cast("array<double>")  # one literal: the optimizer folds it

    def score(c: Column) -> Column:
        at = lambda k: F.get(c, k)
        summed = F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0), lambda s, k: s + F.get(weights, at(k) * 128 + at(k + 1)))
        return F.when(F.size(c) < 2, F.lit(0.0)).otherwise(summed / (F.size(c) - 1))

    return F.transform(F.array(F.transform(F.split(token, ""), lambda x: F.ascii(x))), score)[0]


def scan(docs: DataFrame, model: np.ndarray, text: str = "text", threshold: float = THRESHOLD, out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: array of (start, end, kind), kind an index into ``KINDS``, sorted by start, then kind.

    Fixed patterns give kinds 0 to 2; the models add tokens (kind 3) that overlap none of those. Null and empty texts have no
    spans; a text of any length is scanned whole; repeated rows are scanned one by one; other columns pass through. A
    column named ``out`` in the input is replaced.
    """
    found = _scanned(docs, model, text, threshold)
    return found.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c != out], F.col("_spans").alias(out))


def _scanned(docs: DataFrame, model: np.ndarray, text: str, threshold: float) -> DataFrame:
    """``_row`` (the input's row as a struct, so no name of its can clash), ``_text`` (null as empty) and ``_spans``."""
    t, b = F.col("_text"), F.col("_base")
    value = lambda m: F.char_length(F.regexp_extract(m["text"], ASSIGN, 2))
    kind = lambda spans, k: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(k).alias("kind")))
    whole = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    base = whole.withColumn(
        "_base",
        F.array_sort(
            F.concat(
                kind(F.filter(_find(t, ASSIGN), lambda m: value(m) >= 6), 0),
                kind(F.filter(_find(t, ACCESS), lambda m: m["end"] - m["start"] >= 20), 1),
                kind(_find(t, HEX), 2),
            )
        ),
    )
    # struct order is start, end, kind; the result's is start, kind
    ordered = lambda a: F.array_sort(a, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["kind"] - y["kind"]))
    judged = F.filter(
        _find(t, TOKEN),
        lambda m: m["text"].rlike("[A-Za-z]")
        & ~F.exists(b, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
        & (_llr(m["text"], model) > threshold),
    )
    return base.select("_row", "_text", ordered(F.concat(b, kind(judged, 3))).alias("_spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key (as ``doc_id``), counts of the fixed kinds, digest of the fixed spans, all spans as text.

    A null or empty text has no spans; texts of any length are scanned whole; repeated rows are reported each; a null key stays
    null; an empty table gives an empty table; other columns play no part.
    """
    s = _scanned(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), model, "text", THRESHOLD)
    spans = F.col("_spans")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    return s.select(
        F.col("_row.doc_id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter(spans, lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def redact(docs: DataFrame, model: np.ndarray, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask``; overlapping spans are replaced together.

    Rows without a span come out unchanged (a null or empty text stays as it is); no row is dropped, repeated rows are masked each.
    Texts of any length are masked whole, an empty table gives an empty table, and all other columns pass through, whatever their
    names and types.
    """
    s = _scanned(docs, model, text, THRESHOLD)
    spans = F.col("_spans")
    reach = _before(F.transform(spans, lambda x: x["end"]), 2, F.lit(0), lambda s, v: F.greatest(s, v))  # of the spans before each
    def merged(r: Column) -> Column:
        heads = F.filter(F.transform(spans, lambda x, k: F.struct(x["start"].alias("start"), F.get(r, k).alias("reach"))), lambda x: x["start"] >= x["reach"])
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.transform(F.array(heads), lambda h: F.transform(h, lambda x, k: F.struct(x["start"].alias("start"), F.coalesce(F.get(h, k + 1)["reach"], last).alias("end"))))[0]

    # a stretch of the text is cut out of the few blocks that hold it
    blocks = F.regexp_extract_all(F.col("_text"), F.lit(f"(?s).{{1,{SIGNS}}}"), F.lit(0))

    def rebuilt(m: Column, bs: Column) -> Column:
        def stretch(a: Column, z: Column) -> Column:
            first = (a / SIGNS).cast("int")
            return F.substr(F.array_join(F.slice(bs, first + 1, (z / SIGNS).cast("int") - first + 1), ""), a % SIGNS + 1, z - a)

        end = lambda k: F.coalesce(F.get(m, k)["end"], F.lit(0))
        pieces = F.transform(m, lambda x, k: F.concat(stretch(end(k - 1), x["start"]), F.lit(mask)))
        return F.concat(F.array_join(pieces, ""), stretch(end(F.size(m) - 1), F.char_length("_text")))

    masked = F.transform(F.arrays_zip(F.array(F.transform(F.array(reach), merged)[0]).alias("m"), F.array(blocks).alias("b")), lambda z: rebuilt(z["m"], z["b"]))[0]
    new = F.when(F.size("_spans") == 0, F.col("_row").getField(text)).otherwise(masked)
    return s.select(*[(new if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])
