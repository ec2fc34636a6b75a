"""License scans with a positional rare-token index of license notices.

A notice counts as found where at least ``LEAST_SCORE`` of its words stand in order, in a stretch little longer than itself, with its
key phrases, word by word, near their places. So of its n words at most a quarter may be missing, and of any n / 4 + v words at least
v stand. The index keeps just that many positions of each notice (v grows with n), those whose words have the highest inverse
document frequencies among the notices. A file's words that it knows vote for (notice, file position - notice position); a
place with votes for enough positions, no further apart than the notice's slack allows, is verified. Tags that name an identifier
are read as they stand.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import ship
from docquarry.llm.license_texts import IDENTIFIERS, NOTICES

#: Words of a text in which A-Z are in lower case, as bytes of UTF-8: digits, letters and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrases that are counted wherever their words stand consecutively.
BASE = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))
#: Share of a notice's words that must stand in order; votes that a place needs at least, and one for so many words; a notice's slack
#: is one for so many words.
LEAST_SCORE, LEAST_VOTES, VOTE_SHARE, SLACK_SHARE = 0.75, 2, 12, 12


def words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def _stands(ws: list[bytes], phrase: list[bytes], low: int, high: int) -> bool:
    """Whether a phrase begins at a position from ``low`` to ``high``."""
    i, low = max(0, low), max(0, low)
    while True:
        try:
            i = ws.index(phrase[0], i, max(low, high + 1))
        except ValueError:
            return False
        if ws[i : i + len(phrase)] == phrase:
            return True
        i += 1


class Notice:
    """A notice with the masks of its words' positions."""

    def __init__(self, label: str, text: str, keys: tuple[tuple[str, ...], ...], never: tuple[str, ...]):
        self.label, self.words = label, words(text)
        self.n = len(self.words)
        self.slack = self.n // SLACK_SHARE
        self.never = [words(p) for p in never]
        self.keys = [[(p, o) for p in map(words, group) for o in self._places(p)] for group in keys]
        self.masks: dict[bytes, int] = defaultdict(int)
        for q, w in enumerate(self.words):
            self.masks[w] |= 1 << q

    def _places(self, phrase: list[bytes]) -> list[int]:
        at = [i for i in range(self.n) if self.words[i : i + len(phrase)] == phrase]
        if not at:
            raise ValueError(f"{self.label}: no {b' '.join(phrase)!r} in the notice")
        return at

    def share(self, ws: list[bytes], d: int) -> float:
        """Share of the notice's words that stand in order where the notice would begin at ``d``, within its slack.

        The longest common subsequence, by bits: a position's bit falls where a subsequence can grow by it.
        """
        v = full = (1 << self.n) - 1
        for w in ws[max(0, d - 2 * self.slack) : max(0, d + self.n + 3 * self.slack)]:
            if (m := self.masks.get(w)) is not None:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return (self.n - v.bit_count()) / self.n

    def verify(self, ws: list[bytes], d: int) -> float:
        """The share, if it is enough and the key phrases stand at their places and the others don't; else 0."""
        s = self.share(ws, d)
        if s < LEAST_SCORE:
            return 0.0
        low, high = d - 2 * self.slack, d + 3 * self.slack
        if not all(any(_stands(ws, p, low + o, high + o) for p, o in group) for group in self.keys):
            return 0.0
        return 0.0 if any(_stands(ws, p, low, high + self.n) for p in self.never) else s


class Index:
    """Notices, and the postings (notice, position) of each one's rarest words."""

    def __init__(self, notices=NOTICES):
        self.notices = [Notice(*x) for x in notices]
        held = Counter(w for x in self.notices for w in set(x.words))
        self.idf = {w: math.log(1 + len(self.notices) / n) for w, n in held.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        for k, x in enumerate(self.notices):
            missing = math.floor((1 - LEAST_SCORE) * x.n)
            self.need.append(min(max(LEAST_VOTES, x.n // VOTE_SHARE), x.n - missing))
            for q in sorted(range(x.n), key=lambda q: (-self.idf[x.words[q]], q))[: missing + self.need[-1]]:
                self.postings[x.words[q]].append((k, q))
        self.postings = dict(self.postings)
        self.vocabulary = frozenset(self.postings)
        self.identifiers = sorted(((words(i), i) for i in IDENTIFIERS), key=lambda x: -len(x[0]))
        # the notices that hold each fixed phrase, and where
        self.around = {phrase: [(x, o) for x in self.notices if _stands(x.words, p, 0, x.n) for o in x._places(p)[:1]] for phrase, _ in BASE for p in [[w.encode() for w in phrase]]}

    def matches(self, ws: list[bytes]) -> list[tuple[str, float]]:
        """(label, share) of every notice that is verified somewhere in the file, and (label, 1) of every tag."""
        out = dict(self._tags(ws))
        # notices of which enough positions could be voted for by words that the file has at all: for most files none
        known = self.vocabulary.intersection(ws)
        most = Counter(k for w in known for k, _ in self.postings[w])
        able = {k for k, n in most.items() if n >= self.need[k]}
        postings = {w: own for w in known if (own := [x for x in self.postings[w] if x[0] in able])}
        votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, w in enumerate(ws if postings else ()):
            if w in postings:
                for k, q in postings[w]:
                    votes[k].append((p - q, q))
        for k, found in votes.items():
            if len(found) < self.need[k]:
                continue
            x, best = self.notices[k], 0.0
            found.sort()
            inside: Counter = Counter()
            j, done = 0, -math.inf
            for d, q in found:
                while j < len(found) and found[j][0] <= d + 2 * x.slack:
                    inside[found[j][1]] += 1
                    j += 1
                # a place that was verified at most a slack before covers this one
                if len(inside) >= self.need[k] and d > done + x.slack and best < 1:
                    best, done = max(best, x.verify(ws, d)), d
                inside[q] -= 1
                if not inside[q]:
                    del inside[q]
            if best > out.get(x.label, 0):
                out[x.label] = best
        return sorted(out.items())

    def _tags(self, ws: list[bytes]) -> list[tuple[str, float]]:
        out, i, tag = [], -1, [b"spdx", b"license", b"identifier"]
        while True:
            try:
                i = ws.index(tag[0], i + 1)
            except ValueError:
                return out
            if ws[i : i + 3] == tag:
                rest = ws[i + 3 : i + 9]
                out += [(label, 1.0) for w, label in self.identifiers if rest[: len(w)] == w][:1]

    def near(self, ws: list[bytes], places: list[tuple[int, str]]) -> float:
        """The best share of a notice's words in order around fixed phrases, verified or not."""
        best = 0.0
        for at, label in places:
            for phrase, name in BASE:
                if name == label:
                    for x, o in self.around[phrase]:
                        best = max(best, x.share(ws, at - o))
                        if best == 1:
                            return best
        return best


@lru_cache(maxsize=1)
def index() -> Index:
    return Index()


def base_places(ws: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a fixed phrase stands."""
    out = []
    for phrase, label in BASE:
        p = [x.encode() for x in phrase]
        n, i = len(p), -1
        while True:
            try:
                i = ws.index(p[-1], i + 1)
            except ValueError:
                break
            if i >= n - 1 and ws[i - n + 1 : i + 1] == p:
                out.append((i - n + 1, label))
    return sorted(out)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``labels``: the fixed phrases' labels, and the identifiers of verified notices and of tags. ``score``: the best share of a
    notice's words that stand in order, of verified notices and of notices laid around the fixed phrases (below the least share of a
    verified one, if nothing but the phrase is there); 1 for a tag; else 0. A null or empty text has no words, places or labels
    (``first_word`` and ``last_word`` null, labels empty). Whole texts of any length are read, repeated rows each, an empty table
    gives an empty table, a null key stays null, and other columns play no part.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = index()
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(t or "")
                places = base_places(ws)
                base = {label for _, label in places}
                found = idx.matches(ws)
                starts = [i for i, _ in places]
                score = max((s for _, s in found), default=0.0)
                if score < 1 and places:
                    score = max(score, idx.near(ws, places))
                rows.append((k, len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})), score))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, SCHEMA)
