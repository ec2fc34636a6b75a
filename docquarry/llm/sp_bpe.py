"""SentencePiece merge-type encoding by backtracking, and decoding.

A chunk of text is encoded left to right. An Aho-Corasick automaton gives all pieces that match at each position, longest
first; a piece is taken if it is compatible with the piece before it, that is, if re-merging the two pieces' characters gives
just these two. Positions from which no continuation exists are marked in a bitfield and not tried again. A sequence whose
neighbours are all compatible is the one that merging gives: the first merge across one of its borders would also be the first
across that border when only the two neighbours are merged.

Pieces that hold the space mark anywhere but at their start don't exist in the supported models (this is checked), so a text is
cut before each run of marks and equal chunks are encoded once, in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import local_file, send_file, ship

MARK = "▁"
_CLOSING, _ONE = frozenset(".,;:!?"), [1]
CACHE_CHUNKS, CACHE_CHUNK_CHARS = 600_000, 64


class Model:
    """A merge-type model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        t, n = m.trainer_spec, m.normalizer_spec
        if t.model_type != 2 or not t.byte_fallback or n.name != "identity" or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces or t.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only merge models with byte fallback, identity normalisation and a dummy prefix are supported")
        if any(p.type in (4, 5) for p in m.pieces):
            raise ValueError(f"{path}: user-defined and unused pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError(f"{path}: a piece holds the space mark behind another sign")
        self.score = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.surface = [p.piece for p in m.pieces]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = m.trainer_spec.unk_surface or " ⁇ "
        self.control = {i for i, p in enumerate(m.pieces) if p.type == 3}
        self.unk = {i for i, p in enumerate(m.pieces) if p.type == 2}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in self.ids:
            self.automaton.add_word(p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.decimal = {p: str(i) for p, i in self.ids.items()}
        # entries of chunks, and those of the generation before: what is met again moves on, the rest goes
        self.chunks: dict[str, tuple[str, int, str, str]] = {}
        self.older: dict[str, tuple[str, int, str, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Merging as the library does it: the best-scored adjacent pair first, the leftmost of equals."""
        part = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(part) and (s := self.score.get(w := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, w))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, j, w = heapq.heappop(heap)
            if not part[i] or after[i] != j or part[i] + part[j] != w:
                continue
            part[i], part[j] = w, ""
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p]

    def _fits(self, a: str, b: str) -> bool:
        """Whether ``b`` may follow ``a`` (``""``: nothing): re-merging the signs of both gives just these two."""
        ok = self.merge(b) == [b] if not a else a + b not in self.ids and self.merge(a + b) == [a, b]
        if len(self.pairs) > CACHE_CHUNKS:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a chunk; signs outside the vocabulary are pieces of one sign."""
        n, pairs = len(text), self.pairs
        # for each position the lengths of the pieces that start there, shortest first, as the automaton meets them
        match: list[list[int] | None] = [None] * n
        for end, length in self.automaton.iter(text):
            start = end - length + 1
            if (m := match[start]) is None:
                match[start] = [1] if length == 1 else [1, length]
            else:
                m.append(length)
        failed: bytearray | None = None
        out: list[str] = []
        left: list[int] = []  # for each piece of `out`, how many shorter choices its position has
        at, last, choice = 0, "", -1
        while at < n:
            lengths = match[at] or _ONE
            choice = len(lengths) if choice < 0 else choice
            while choice:
                choice -= 1
                to = at + lengths[choice]
                if failed is not None and to < n and failed[to >> 3] >> (to & 7) & 1:
                    continue
                piece = text[at:to]
                if (ok := pairs.get((last, piece))) is None:
                    ok = self._fits(last, piece)
                if ok:
                    left.append(choice)
                    out.append(piece)
                    at, last, choice = to, piece, -1
                    break
            else:
                # compatible pieces up to a position are the only encoding of the text before it, so a dead end is the
                # position's own, whatever the way to it
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(out.pop())
                choice = left.pop()
                last = out[-1] if out else ""
        return out

    def _ids(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                ids.extend(self.bytes[b] for b in p.encode())
            else:
                ids.append(i)
        return ids

    _CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for c in self._CUT.findall(MARK + text.replace(" ", MARK)) for i in self._ids(self.backtrack(c))]

    def _chunk(self, chunk: str) -> tuple[str, int, str, str]:
        """A chunk's entry: ids as text, how many, what they decode to, the last piece ("" if it has none of its own).

        Where a closing sign follows, the rest's entry serves if the border is compatible.
        """
        x = self.chunks.get(chunk) or self.older.get(chunk)
        if x is None:
            sign, rest = chunk[-1], chunk[:-1]
            if sign in _CLOSING and len(rest) > 1 and sign in self.ids:
                ids, n, text, last = self._chunk(rest)
                if last and (self.pairs.get((last, sign)) or self._fits(last, sign)):
                    own = self.decimal[sign]
                    x = (f"{ids},{own}", n + 1, text + self.decode([int(own)], False), sign)
            if x is None:
                pieces = self.backtrack(chunk)
                try:
                    found = [self.decimal[p] for p in pieces]
                    x = (",".join(found), len(found), self.decode(list(map(int, found)), False), pieces[-1])
                except KeyError:
                    found = self._ids(pieces)
                    x = (",".join(map(str, found)), len(found), self.decode(found, False), "" if found[-1] in self.byte_of else self.surface[found[-1]])
        if len(chunk) <= CACHE_CHUNK_CHARS:
            self.chunks[chunk] = x
        return x

    def encode_text(self, text: str) -> tuple[str, int, str]:
        """(ids as decimal numbers joined by commas, how many, the text that they decode to)."""
        if not text:
            return "", 0, ""
        chunks = self._CUT.findall(MARK + text.replace(" ", MARK))
        known = self.chunks
        try:
            got = [known[c] for c in chunks]
        except KeyError:
            if len(known) > CACHE_CHUNKS:
                self.older, self.chunks = known, {}
            known = self.chunks
            got = [known.get(c) or self._chunk(c) for c in chunks]
        # a chunk begins with a whole sign and ends with one, so chunks decode one by one; the dummy prefix is the first mark
        return ",".join([x[0] for x in got]), sum([x[1] for x in got]), "".join([x[2] for x in got])[1:]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """As the library decodes: bytes joined to signs (invalid ones become U+FFFD), marks to spaces, the dummy prefix off."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
                first = False
            if i < 0 or i in self.control:
                continue
            if i in self.unk:
                out.append(self.unknown)
            else:
                s = self.surface[i]
                out.append((s[1:] if first and s.startswith(MARK) else s).replace(MARK, " "))
            first = False
        return "".join(out)


def _utf8(raw: bytes) -> str:
    """Each byte that begins no valid sign becomes one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each whole text. A null text counts as empty and has no ids; repeated rows are encoded each."""
    ship(docs.sparkSession)
    send_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(local_file(path))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                p = b.slice(lo, 256)
                ids = [[int(x) for x in s.split(",")] if s else [] for s, _, _ in (m.encode_text(t or "") for t in p.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_table(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the text that the ids of each row stand for. Null ids count as none and give an empty text."""
    ship(encoded.sparkSession)
    send_file(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(local_file(path))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                p = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([m.decode(x or []) for x in p.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(key).cast("long").alias("k"), F.col(ids).cast("array<int>").alias("i")).mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, where the ids are decoded again to give the last.

    A null or empty text has no ids and decodes to the empty text; texts of any length are encoded whole (a run without
    spaces is one chunk and needs about 170 bytes a sign in its worker); repeated rows are encoded each; a null key stays
    null; an empty table gives an empty table; other columns play no part.

    Chunks decode to the same text wherever they stand, but for the dummy prefix of the first; so the decoding of each
    distinct chunk is remembered with its ids.
    """
    ship(docs.sparkSession)
    send_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(local_file(path))
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, n, decoded = m.encode_text(t or "")
                rows.append((k, n, sha(ids.encode()), sha(decoded.encode())))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
