"""Embedding services over HTTP. Keys are read from the environment where the request is made, and never printed."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from loomtext.errors import ConfigError, EmptyEmbedding, HttpError
from loomtext.providers.base import Provider
from loomtext.providers.retry import Policy, TransportError, run


@dataclass(repr=False)
class _Http(Provider):
    model: str = ""
    base_url: str = ""
    key_variable: str = ""
    timeout: float = 30.0
    policy: Policy | None = field(default=None)

    PATH = "/embeddings"
    DIMENSIONS = {}
    OTHERWISE = 0

    def __repr__(self) -> str:
        return f"{type(self).__name__}(model={self.model!r}, base_url={self.base_url!r}, key=<redacted>)"

    def model_id(self) -> str:
        return self.model

    def dimension(self) -> int:
        return self.DIMENSIONS.get(self.model, self.OTHERWISE)

    def _post(self, body: dict) -> dict:
        key = os.environ.get(self.key_variable)
        if not key:
            raise ConfigError(f"{self.key_variable} is not set")
        headers = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
        request = urllib.request.Request(self.base_url.rstrip("/") + self.PATH, json.dumps(body).encode(), headers, method="POST")

        def send() -> tuple[int, dict[str, str], bytes]:
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
            except urllib.error.HTTPError as e:
                return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()
            except (urllib.error.URLError, OSError) as e:
                raise TransportError(str(e)) from e

        try:
            return json.loads(run(send, self.policy))
        except json.JSONDecodeError as e:
            raise HttpError("the answer is no JSON") from e

    def _vectors(self, found: list, texts: list[str]) -> list[list[float]]:
        if len(found) < len(texts):
            raise EmptyEmbedding
        return [[float(x) for x in v] for v in found]


@dataclass(repr=False)
class OpenAI(_Http):
    model: str = "text-embedding-3-small"
    base_url: str = "https://api.openai.com/v1"
    key_variable: str = "OPENAI_API_KEY"
    DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}
    OTHERWISE = 1536

    def embed(self, texts: list[str]) -> list[list[float]]:
        answer = self._post({"model": self.model, "input": texts})
        rows = sorted(answer.get("data", []), key=lambda d: d.get("index", 0))
        return self._vectors([d["embedding"] for d in rows], texts)


@dataclass(repr=False)
class Voyage(_Http):
    model: str = "voyage-3-lite"
    base_url: str = "https://api.voyageai.com/v1"
    key_variable: str = "VOYAGE_API_KEY"
    DIMENSIONS = {"voyage-3-lite": 512, "voyage-3": 1024, "voyage-large-2": 1536, "voyage-code-2": 1536}
    OTHERWISE = 1024

    def _embed(self, texts: list[str], kind: str) -> list[list[float]]:
        answer = self._post({"model": self.model, "input": texts, "input_type": kind})
        rows = sorted(answer.get("data", []), key=lambda d: d.get("index", 0))
        return self._vectors([d["embedding"] for d in rows], texts)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._embed(texts, "document")

    def embed_query(self, texts: list[str]) -> list[list[float]]:
        return self._embed(texts, "query")


@dataclass(repr=False)
class Cohere(_Http):
    model: str = "embed-english-v3.0"
    base_url: str = "https://api.cohere.com/v1"
    key_variable: str = "COHERE_API_KEY"
    PATH = "/embed"
    OTHERWISE = 1024

    def dimension(self) -> int:
        return 384 if "light" in self.model else self.OTHERWISE

    def _embed(self, texts: list[str], kind: str) -> list[list[float]]:
        answer = self._post({"model": self.model, "texts": texts, "input_type": kind})
        return self._vectors(answer.get("embeddings", []), texts)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._embed(texts, "search_document")

    def embed_query(self, texts: list[str]) -> list[list[float]]:
        return self._embed(texts, "search_query")
