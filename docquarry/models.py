"""Providers of model inference. Each is an interface with a deterministic stand-in that needs no weights; the ONNX and HTTP
providers are written against public interfaces and were not run against real models here."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import time
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np

from docquarry.errors import UserError

TASKS = ("document", "query", "raw")
#: Prompts by model family: (document, query).
PROMPTS = {"e5": ("passage: ", "query: "), "bge": ("", "Represent this sentence for searching relevant passages: "), "snowflake": ("", "Represent this sentence for searching relevant passages: "), "nomic": ("search_document: ", "search_query: ")}


class Embedder(Protocol):
    def embed(self, texts: list[str], task: str = "raw") -> np.ndarray: ...


class Ranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Completer(Protocol):
    def complete(self, prompt: str, max_tokens: int) -> str: ...


def pool(states: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """(batch, tokens, dims) -> (batch, dims): the mean over attended tokens, the first or the last attended token."""
    if how == "cls":
        return states[:, 0]
    if how == "last":
        return states[np.arange(len(states)), np.maximum(mask.sum(1).astype(int) - 1, 0)]
    if how != "mean":
        raise UserError(f"unknown pooling {how!r}")
    return (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def logits(x: float, how: str = "noop") -> float:
    if how == "noop":
        return x
    if how == "sigmoid":
        return 1 / (1 + math.exp(-x))
    raise UserError(f"unknown treatment of logits {how!r}")


@dataclass
class HashEmbedder:
    """Words hashed to signed dimensions; equal texts get equal unit vectors."""

    dim: int = 64

    def embed(self, texts: list[str], task: str = "raw") -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return unit(out)


@dataclass
class OnnxEmbedder:
    """A transformer in ONNX with its tokenizer; loaded once per worker."""

    model: str
    tokenizer: str
    pooling: str = "mean"
    normalize: bool = True
    family: str | None = None
    max_tokens: int = 512
    batch: int = 32
    _loaded: Any = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def embed(self, texts: list[str], task: str = "raw") -> np.ndarray:
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.tokenizer)
            t.enable_truncation(self.max_tokens)
            t.enable_padding()
            self._loaded = t, onnxruntime.InferenceSession(self.model)
        tok, session = self._loaded
        document, query = PROMPTS.get(self.family or "", ("", ""))
        prefix = {"document": document, "query": query}.get(task, "")
        wanted, out = {i.name for i in session.get_inputs()}, []
        for k in range(0, len(texts), self.batch):
            e = tok.encode_batch([prefix + t for t in texts[k : k + self.batch]])
            given = {"input_ids": [x.ids for x in e], "attention_mask": [x.attention_mask for x in e], "token_type_ids": [x.type_ids for x in e]}
            states = session.run(None, {n: np.array(v, np.int64) for n, v in given.items() if n in wanted})[0]
            out.append(pool(states, np.array(given["attention_mask"]), self.pooling))
        v = np.concatenate(out) if out else np.empty((0, 0))
        return unit(v) if self.normalize else v


@dataclass
class HttpEmbedder:
    """A REST embedding service; failed calls are repeated with doubled waits."""

    kind: str
    model: str
    endpoint: str
    key_env: str
    batch: int = 32
    retries: int = 4
    send: Callable[[str, dict, dict], dict] | None = None

    def _send(self, url: str, headers: dict, body: dict) -> dict:
        r = urllib.request.Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})  # noqa: S310
        with urllib.request.urlopen(r, timeout=60) as x:  # noqa: S310
            return json.load(x)

    def embed(self, texts: list[str], task: str = "raw") -> np.ndarray:
        send, out = self.send or self._send, []
        headers = {"Authorization": f"Bearer {os.environ.get(self.key_env, '')}"}
        for k in range(0, len(texts), self.batch):
            part = texts[k : k + self.batch]
            body: dict = {"model": self.model, "input": part} if self.kind == "openai" else {"model": self.model, "texts": part, "input_type": {"query": "search_query"}.get(task, "search_document"), "embedding_types": ["float"]}
            for attempt in range(self.retries + 1):
                try:
                    r = send(self.endpoint, headers, body)
                    break
                except OSError:
                    if attempt == self.retries:
                        raise
                    time.sleep(0.1 * 2**attempt)
            out += [x["embedding"] for x in sorted(r["data"], key=lambda x: x["index"])] if self.kind == "openai" else r["embeddings"]["float"]
        return np.array(out)


@dataclass
class CachedEmbedder:
    """Remembers the vectors of the texts that were asked for last, in each process by itself; each distinct text is embedded once."""

    model: Embedder
    most: int = 32_768
    known: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": OrderedDict()}

    def embed(self, texts: list[str], task: str = "raw") -> np.ndarray:
        todo = [t for t in dict.fromkeys(texts) if (task, t) not in self.known]
        fresh = dict(zip(todo, self.model.embed(todo, task), strict=True)) if todo else {}
        out = []
        for t in texts:
            v = fresh[t] if t in fresh else self.known[task, t]
            self.known[task, t] = v
            self.known.move_to_end((task, t))
            out.append(v)
        while len(self.known) > self.most:
            self.known.popitem(last=False)
        return np.array(out)


@dataclass
class OverlapRanker:
    """Share of the query's words that a text holds."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(re.findall(r"\w+", query.lower()))
        return [len(q & set(re.findall(r"\w+", t.lower()))) / max(1, len(q)) for t in texts]


@dataclass
class OnnxRanker:
    """A cross-encoder in ONNX: query and text as a pair, or put into a template."""

    model: str
    tokenizer: str
    template: str | None = None
    processor: str = "noop"
    max_tokens: int = 512
    _loaded: Any = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def score(self, query: str, texts: list[str]) -> list[float]:
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.tokenizer)
            t.enable_truncation(self.max_tokens)
            t.enable_padding()
            self._loaded = t, onnxruntime.InferenceSession(self.model)
        tok, session = self._loaded
        pairs = [self.template.replace("{query}", query).replace("{document}", x) for x in texts] if self.template else [(query, x) for x in texts]
        e = tok.encode_batch(pairs)
        wanted = {i.name for i in session.get_inputs()}
        given = {"input_ids": [x.ids for x in e], "attention_mask": [x.attention_mask for x in e], "token_type_ids": [x.type_ids for x in e]}
        out = session.run(None, {n: np.array(v, np.int64) for n, v in given.items() if n in wanted})[0]
        return [logits(float(x), self.processor) for x in np.asarray(out).reshape(len(texts), -1)[:, 0]]


@dataclass
class EchoCompleter:
    """The first words of the prompt's last line; deterministic."""

    def complete(self, prompt: str, max_tokens: int) -> str:
        return " ".join(prompt.strip().splitlines()[-1].split()[:max_tokens]) if prompt.strip() else ""


@dataclass
class HttpCompleter:
    """A model server that speaks the chat completions protocol; streamed answers arrive as server-sent events."""

    endpoint: str
    model: str
    key_env: str = ""
    timeout: float = 120.0

    def _open(self, prompt: str, max_tokens: int, stream: bool) -> Any:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, "temperature": 0, "stream": stream}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ.get(self.key_env, '')}"} if self.key_env else {})
        return urllib.request.urlopen(urllib.request.Request(self.endpoint, json.dumps(body).encode(), headers), timeout=self.timeout)  # noqa: S310

    def complete(self, prompt: str, max_tokens: int) -> str:
        with self._open(prompt, max_tokens, False) as r:
            return json.load(r)["choices"][0]["message"]["content"]

    def stream(self, prompt: str, max_tokens: int) -> Iterator[str]:
        """Parts of the answer as they arrive."""
        with self._open(prompt, max_tokens, True) as r:
            for line in r:
                data = line.decode().strip().removeprefix("data:").strip() if line.startswith(b"data:") else ""
                if data == "[DONE]":
                    return
                if data and (part := json.loads(data)["choices"][0].get("delta", {}).get("content")):
                    yield part


def streamed(model: Completer, prompt: str, max_tokens: int) -> Iterator[str]:
    """An answer in parts; in one where the model can't give parts."""
    if hasattr(model, "stream"):
        yield from model.stream(prompt, max_tokens)
    else:
        yield model.complete(prompt, max_tokens)


@dataclass
class Models:
    """Configured models by name."""

    embedding: dict[str, Embedder] = field(default_factory=dict)
    ranker: dict[str, Ranker] = field(default_factory=dict)
    completion: dict[str, Completer] = field(default_factory=dict)

    @staticmethod
    def parse(spec: dict | None) -> Models:
        """The ``inference`` section of a configuration."""
        spec = spec or {}
        if set(spec) - {"embedding", "ranker", "completion"}:
            raise UserError(f"unknown sections of inference: {sorted(set(spec) - {'embedding', 'ranker', 'completion'})}")
        make: dict[str, dict[str, Callable[..., Any]]] = {
            "embedding": {
                "hash": HashEmbedder, "onnx": OnnxEmbedder,
                "openai": lambda **k: HttpEmbedder("openai", **({"endpoint": "https://api.openai.com/v1/embeddings", "key_env": "OPENAI_KEY"} | k)),
                "cohere": lambda **k: HttpEmbedder("cohere", **({"endpoint": "https://api.cohere.com/v2/embed", "key_env": "COHERE_KEY"} | k)),
            },
            "ranker": {"overlap": OverlapRanker, "onnx": OnnxRanker},
            "completion": {"echo": EchoCompleter, "http": HttpCompleter},
        }
        out: dict[str, dict] = {}
        for section, kinds in make.items():
            out[section] = {}
            for name, s in (spec.get(section) or {}).items():
                s = dict(s)
                provider = s.pop("provider", next(iter(kinds)))
                if provider not in kinds:
                    raise UserError(f"unknown provider {provider!r} of {section} model {name!r}")
                cache = s.pop("cache", True) if section == "embedding" else False
                out[section][name] = kinds[provider](**s)
                if cache:
                    most = ((cache.get("inmem") or {}).get("max_size") if isinstance(cache, dict) else None) or CachedEmbedder.most
                    out[section][name] = CachedEmbedder(out[section][name], int(most))
        return Models(**out)

    def get(self, section: str, name: str) -> Any:
        x = getattr(self, section).get(name)
        if x is None:
            raise UserError(f"{section} model {name!r} is not configured")
        return x
