"""Encoders for byte-pair vocabularies in ``tokenizers`` JSON files, loaded once per Python worker.

``ByteEncoder`` reads a byte-level vocabulary without word ends into the rank table of ``tiktoken``. Both libraries merge the
adjacent pair of lowest rank first. They could differ only where a vocabulary entry can't be reached by its own merges; the
constructor checks that no such entry exists among the pairs that the merge list names, and the tests compare ids.

``WordEncoder`` serves vocabularies whose normalizer and splitter never look across white space: each distinct word is encoded
once by the ``tokenizers`` library itself and remembered in a table of bounded size.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

#: Words remembered per worker (both generations of the table), and the longest word that is remembered.
CACHE_WORDS, CACHE_WORD_CHARS = 400_000, 48


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def special_tokens(spec: dict) -> dict[str, int]:
    """Strings of a vocabulary file's added tokens; those that need more than a plain search are refused."""
    for x in spec.get("added_tokens", []):
        if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]:
            raise ValueError(f"{x['content']!r}: only added tokens that are searched as they stand are supported")
    return {x["content"]: x["id"] for x in spec.get("added_tokens", [])}


def splitter(special: dict[str, int]) -> Callable[[str], list[str]]:
    """Cuts a text at the strings of special tokens, leftmost first, the longest of those that start together."""
    if not special:
        return lambda t: [t]
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
    return lambda t: cut.split(t)


class ByteEncoder:
    """Ids of byte-level BPE.

    Strings of special tokens in a text give those tokens, as in the library by default; with ``plain`` they are ordinary
    text, as in the library with ``encode_special_tokens``.
    """

    def __init__(self, path: str, pattern: str | None = None, plain: bool = False):
        import tiktoken

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = special_tokens(spec)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][a + b] for a, b in merges]
        if order != sorted(order) or len(order) + 256 != len(ranks):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        ordinary = tiktoken.Encoding("docquarry", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token_bytes = {v: k for k, v in ranks.items()} | {v: k.encode() for k, v in special.items()}
        split, marks = splitter(special), tuple(special)

        def encode(text: str) -> list[int]:
            if not any(m in text for m in marks):
                return ordinary(text)
            return [i for part in split(text) for i in ([special[part]] if part in special else ordinary(part))]

        self.encode = ordinary if plain else encode


class WordEncoder:
    """Ids as little-endian 32-bit arrays, one word at a time, from a bounded table.

    Words of unaccented and Latin-1 letters, with or without a closing sign, go through a rank table in which the byte 0xFF,
    which no text holds, stands for the end of a word; all others, and texts with odd control signs, go to the library.
    Strings of special tokens are treated as by ``ByteEncoder``.
    """

    #: The library's white space doesn't hold these, Python's does; texts with them go to the library whole.
    _ODD = re.compile("[\x1c-\x1f]")
    _PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
    _END, _SUFFIX = b"\xff", "</w>"

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # what is left between special tokens
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {} if plain else special_tokens(spec)
        self._special = {k: array("I", [v]).tobytes() for k, v in special.items()}
        self._split, self._marks = splitter(special), tuple(special)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merges]
        if model["end_of_word_suffix"] != self._SUFFIX or order != sorted(order) or order[0] < 512:
            raise ValueError(f"{path}: ids don't follow the order of merges, or words have no end mark")
        alphabet = byte_alphabet()
        ends = lambda k: k.endswith(self._SUFFIX)
        spell = lambda k: bytes(alphabet[c] for c in (k[: -len(self._SUFFIX)] if ends(k) else k)) + self._END * ends(k)
        ranks = {spell(k): v for k, v in model["vocab"].items() if v < 512}
        ranks |= {spell(a + b): model["vocab"][a + b] for a, b in merges}
        self._piece = tiktoken.Encoding("docquarry-words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, letters: str) -> bytes:
        if (x := self.known.get(letters)) is None:
            x = array("I", self._piece(letters.encode() + self._END)).tobytes()
            if len(letters) <= CACHE_WORD_CHARS:
                self.known[letters] = x
        return x

    def _word(self, word: str) -> bytes:
        if (x := self.known.get(word)) is None:
            m = self._PLAIN.fullmatch(word)
            if m is None:
                x = self._library([word])[0]
            else:
                # splitting never joins a letter to a closing sign, so the two are encoded apart
                x = self._plain(m[1].lower()) + (self._plain(m[2]) if m[2] else b"")
            if len(word) <= CACHE_WORD_CHARS:
                self.known[word] = x
        return x

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, joined as little-endian unsigned 32-bit integers."""
        out = []
        for t in texts:
            if any(m in t for m in self._marks):
                parts = self._split(t)
                rest = iter(self.encode_batch([p for p in parts if p not in self._special]))
                out.append(b"".join([self._special.get(p) or next(rest) for p in parts]))
                continue
            if self._ODD.search(t):
                out.append(self._library([t])[0])
                continue
            known, words = self.known, t.split()
            try:
                out.append(b"".join([known[w] for w in words]))
            except KeyError:
                if len(known) > CACHE_WORDS:
                    known.clear()
                out.append(b"".join([self._word(w) for w in words]))
        return out


@lru_cache(maxsize=4)
def byte_encoder(path: str, plain: bool = False) -> ByteEncoder:
    return ByteEncoder(path, plain=plain)


@lru_cache(maxsize=4)
def word_encoder(path: str, plain: bool = False) -> WordEncoder:
    return WordEncoder(path, plain)
