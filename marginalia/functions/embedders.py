"""Embedders: anything that turns texts into vectors; a hashing one and a client for /v1/embeddings."""

from __future__ import annotations

import json
import math
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from hashlib import blake2b, sha256

from marginalia.functions import chunker, periodic

Embedder = Callable[[list[str]], list[list[float]]]
ATTEMPTS = 4


def identity(**parts) -> str:
    """A name for a vector space: backend, model, dimension, tokenizer and versions all count."""
    return sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def hashing(dim: int = 64) -> Embedder:
    """Signed counts of hashed words at length one; the same text gives the same vector anywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def http(url: str, model: str, key: str | None = None, dim: int | None = None, timeout: float = 30.0) -> Embedder:
    """A client for an endpoint with the common embeddings format; a few attempts with growing waits."""

    def embed(texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(url, json.dumps({"model": model, "input": texts}).encode(), headers)
        for attempt in range(1, ATTEMPTS + 1):
            try:
                with urllib.request.urlopen(request, timeout=timeout) as reply:
                    return parse_reply(json.load(reply), len(texts), dim)
            except urllib.error.HTTPError as e:
                if attempt == ATTEMPTS or e.code not in (408, 429) and e.code < 500:
                    raise
                wait = e.headers.get("Retry-After", "")
                time.sleep(max(periodic.retry_delay(attempt), float(wait) if wait.isdigit() else 0))
            except urllib.error.URLError:
                if attempt == ATTEMPTS:
                    raise
                time.sleep(periodic.retry_delay(attempt))
        raise AssertionError

    return embed


def parse_reply(reply: dict, expected: int, dim: int | None = None) -> list[list[float]]:
    """Vectors of a reply in the order of their indices, which must be 0 to expected - 1."""
    data = reply.get("data")
    if not isinstance(data, list) or sorted(d.get("index", -1) for d in data) != list(range(expected)):
        raise ValueError("the embedding reply doesn't have one vector for each input")
    vectors = [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]
    chunker.validate_vectors(vectors, expected, dim or (len(vectors[0]) if vectors else 0))
    return vectors


def in_batches(embed: Embedder, texts: list[str], max_items: int = 32, max_tokens: int = 8192, count: Callable[[str], int] = chunker.word_count) -> list[list[float]]:
    """Vectors of all texts, asked for in requests of bounded size."""
    out, sizes = [], [count(t) for t in texts]
    while len(out) < len(texts):
        n = chunker.plan_batch(sizes[len(out) :], max_items, max_tokens)
        got = embed(texts[len(out) : len(out) + n])
        chunker.validate_vectors(got, n, len(got[0]) if got else 0)
        out += got
    return out
