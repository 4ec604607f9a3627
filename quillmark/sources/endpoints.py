"""Settings from the environment, and clients of model endpoints with an injected transport."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, MutableMapping
from dataclasses import dataclass, field

from ..operators import models

# The variables that configure each kind of endpoint: key, base URL and model.
VARIABLES = {
    "embedding": ("EMBEDDING_API_KEY", "EMBEDDING_BASE_URL", "EMBEDDING_MODEL"),
    "rerank": ("RERANK_API_KEY", "RERANK_BASE_URL", "RERANK_MODEL"),
    "llm": ("LLM_API_KEY", "LLM_BASE_URL", "LLM_MODEL"),
}
Post = Callable[[str, dict, dict, float], object]


class NotConfigured(RuntimeError):
    """Variables that an endpoint needs aren't set."""


class EndpointError(RuntimeError):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def load_env(path: str, env: MutableMapping[str, str] = os.environ) -> None:
    """Set the KEY=VALUE lines of a file, quotes off; what is set already stays. A missing file sets nothing."""
    if not os.path.exists(path):
        return
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, is_set, value = line.strip().partition("=")
            if is_set and key.strip() and not key.startswith("#"):
                env.setdefault(key.strip(), value.strip().strip("\"'"))


def tokens(env: MutableMapping[str, str] = os.environ, path: str | None = None) -> list[str]:
    """Host tokens: a file's lines, else GITHUB_TOKENS at its commas, else GITHUB_TOKEN. They stay on the driver and in transports."""
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            raw = f.read().splitlines()
    else:
        raw = (env.get("GITHUB_TOKENS") or env.get("GITHUB_TOKEN") or "").split(",")
    return [t.strip() for t in raw if t.strip()]


@dataclass(frozen=True)
class Endpoint:
    """Where a model answers; the key is in no printed form and no plan."""

    base_url: str
    model: str
    key: str = field(repr=False)
    input_type_field: str | None = None

    def url(self, path: str, versioned: bool = True) -> str:
        base = self.base_url.rstrip("/")
        return f"{base if versioned else base.removesuffix('/v1')}/{path}"


def endpoint(kind: str, env: MutableMapping[str, str] = os.environ) -> Endpoint:
    """The configured endpoint; an error that names all missing variables otherwise."""
    missing = [v for v in VARIABLES[kind] if not env.get(v)]
    if missing:
        raise NotConfigured(f"the {kind} endpoint needs {', '.join(missing)}")
    key, url, model = (env[v] for v in VARIABLES[kind])
    return Endpoint(url, model, key, env.get("EMBEDDING_INPUT_TYPE_FIELD") or None if kind == "embedding" else None)


def post_json(url: str, body: dict, headers: dict, timeout: float) -> object:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise EndpointError(f"{url} answers {e.code}", e.code) from e
    except (OSError, ValueError) as e:
        raise EndpointError(f"{url}: {e}") from e


def embedder(config: Endpoint, post: Post = post_json, input_type: str | None = None, timeout: float = 60) -> Callable[[list[str]], list[list[float]]]:
    """A client for index.embedded: the common protocol, or the plain one where the host doesn't know that."""

    def embed(texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        headers = {"Authorization": f"Bearer {config.key}"}
        extra = {config.input_type_field: input_type} if config.input_type_field and input_type else {}
        try:
            answer = post(config.url("embeddings"), {"model": config.model, "input": texts, **extra}, headers, timeout)
        except EndpointError as e:
            if e.status not in (404, 405):
                raise
            answer = post(config.url("embed", versioned=False), {"inputs": texts}, headers, timeout)
        return models.vectors_of(answer, len(texts))

    return embed


def embedded_query(embed: Callable[[list[str]], list[list[float]]], query: str) -> list[float]:
    if not query.strip():
        raise ValueError("an empty query has no embedding")
    return embed([query])[0]


def reranker(config: Endpoint, post: Post = post_json, timeout: float = 60) -> Callable[[str, list[str]], list[float]]:
    def rerank(query: str, documents: list[str]) -> list[float]:
        return models.scores_of(post(config.url("rerank", versioned=False), {"model": config.model, "query": query, "texts": documents}, {"Authorization": f"Bearer {config.key}"}, timeout), len(documents))

    return rerank


def chatter(config: Endpoint, system: str, post: Post = post_json, timeout: float = 600, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str]]:
    """A client for models.asked: temperature 0, JSON answers, some attempts for each prompt."""

    def ask(prompt: str) -> str:
        body = {"model": config.model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        for n in range(attempts):
            try:
                answer = post(config.url("chat/completions"), body, {"Authorization": f"Bearer {config.key}"}, timeout)
                return answer["choices"][0]["message"]["content"]
            except (KeyError, IndexError, TypeError) as e:
                raise models.ModelError("the answer has no message") from e
            except EndpointError:
                if n == attempts - 1:
                    raise
                sleep(2.0**n)
        raise EndpointError("no attempt was allowed")

    return lambda prompts: [ask(p) for p in prompts]
