"""Where vectors come from: the offline hash, or an embedding service over HTTP.

A provider is plain data, so it travels to executors, which make their own requests.  Its
identity names the space its vectors live in: vectors of another identity are never mixed
with them.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass, fields

import numpy as np

from lodestone.operators import vectors

TIMEOUT = 300

#: Kind of a provider by its name, and for each kind the address, model, key
#: variables, texts in a request and reranker that it has if nothing else is set.
KINDS = {"cohere": "cohere", "openai": "http", "http": "http", "remote": "http"}
PRESETS = {
    "cohere": ("https://api.cohere.com/v2", "embed-v4.0", ("EMBED_API_KEY", "COHERE_API_KEY"), 96, "rerank-v3.5"),
    "http": ("https://api.openai.com/v1", "text-embedding-3-small", ("EMBED_API_KEY", "OPENAI_API_KEY"), 64, ""),
    "hash": ("", "hash", (), 4096, ""),
}
HASH_DIM = 256


class ProviderError(Exception):
    """A request that failed or was answered with something else than asked for."""


@dataclass(frozen=True)
class Options:
    """What a user sets; unset values come from EMBED_* variables, then from PRESETS."""

    provider: str | None = None
    model: str | None = None
    url: str | None = None
    key: str | None = None
    dim: int | None = None
    batch: int | None = None
    rerank_model: str | None = None


@dataclass(frozen=True)
class Provider:
    kind: str = "hash"
    url: str = ""
    model: str = "hash"
    key: str = ""
    dim: int = HASH_DIM
    batch: int = 4096
    rerank_model: str = ""

    @property
    def identity(self) -> str:
        return f"hash:{self.dim}" if self.kind == "hash" else f"{self.kind}:{self.model}@{self.url}"

    def embed(self, texts: list[str], query: bool = False) -> list[np.ndarray]:
        """Vectors of length one, in the order of the texts."""
        if self.kind == "hash":
            return list(vectors.embed(texts, self.dim))
        out: list[np.ndarray] = []
        for k in range(0, len(texts), max(1, self.batch)):
            part = texts[k : k + max(1, self.batch)]
            found = self._cohere(part, query) if self.kind == "cohere" else self._openai(part)
            if len(found) != len(part):
                raise ProviderError(f"sent {len(part)} texts, got {len(found)} vectors")
            for v in (np.asarray(v, np.float32) for v in found):
                length = float(np.linalg.norm(v))
                out.append(v / length if length else v)
        return out

    def embed_query(self, text: str) -> list[float]:
        return [float(x) for x in self.embed([text], query=True)[0]]

    def scores(self, query: str, texts: list[str]) -> list[tuple[int, float]]:
        """(index, relevance) of texts, best first, by the service's reranker."""
        reply = self._post("rerank", {"model": self.rerank_model, "query": query, "documents": texts})
        try:
            found = [(int(r["index"]), float(r["relevance_score"])) for r in reply["results"]]
        except (KeyError, TypeError, ValueError) as e:
            raise ProviderError(f"bad rerank response: {e}") from e
        return sorted(found, key=lambda x: -x[1])

    def _openai(self, texts: list[str]) -> list:
        reply = self._post("embeddings", {"model": self.model, "input": texts})
        try:
            return [d["embedding"] for d in sorted(reply["data"], key=lambda d: d.get("index", 0))]
        except (KeyError, TypeError) as e:
            raise ProviderError(f"bad embedding response: {e}") from e

    def _cohere(self, texts: list[str], query: bool) -> list:
        kind = "search_query" if query else "search_document"
        reply = self._post("embed", {"model": self.model, "texts": texts, "input_type": kind, "embedding_types": ["float"]})
        try:
            return list(reply["embeddings"]["float"])
        except (KeyError, TypeError) as e:
            raise ProviderError(f"bad embedding response: {e}") from e

    def _post(self, path: str, body: dict) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url}/{path}", json.dumps(body).encode(), head)
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as reply:
                return json.load(reply)
        except (OSError, ValueError) as e:
            raise ProviderError(f"{path} request failed: {e}") from e


def resolve(options: Options = Options(), env: Mapping[str, str] | None = None) -> tuple[Provider, str | None]:
    """The provider that options and environment ask for, and a notice if it isn't what
    they'd lead to: the service that is the default needs a key, and without one nothing
    should leave the machine unasked, so the offline hash takes its place."""
    env = os.environ if env is None else env
    asked = options.provider or env.get("EMBED_PROVIDER")
    found = _made(KINDS.get(asked or "cohere", "hash"), options, env)
    if not asked and not found.key:
        return _made("hash", options, env), "no key for an embedding service is set: vectors come from the offline hash"
    return found, None


def _made(kind: str, options: Options, env: Mapping[str, str]) -> Provider:
    url, model, keys, batch, reranker = PRESETS[kind]

    def number(set_: int | None, name: str, other: int) -> int:
        text = env.get(name, "")
        return set_ if set_ is not None else int(text) if text.isdigit() else other

    batch = number(options.batch, "EMBED_BATCH", batch)
    if kind == "hash":
        return Provider(dim=max(16, number(options.dim, "EMBED_DIM", HASH_DIM)), batch=batch)
    return Provider(
        kind,
        options.url or env.get("EMBED_URL") or url,
        options.model or env.get("EMBED_MODEL") or model,
        options.key or next((env[k] for k in keys if env.get(k)), ""),
        0,
        batch,
        (options.rerank_model or env.get("EMBED_RERANK_MODEL") or reranker) if reranker else "",
    )


def of_identity(identity: str, options: Options = Options()) -> Provider | None:
    """The offline provider of an identity; None for one that needs a service."""
    kind, _, dim = identity.partition(":")
    return Provider(dim=int(dim)) if kind == "hash" and dim.isdigit() else None


def option_names() -> list[str]:
    return [f.name for f in fields(Options)]
