"""Clients of model services over HTTP (S10, S12, E1): an address and a model name are all they need; nothing is sent unless called."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator


def _post(url: str, body: dict, seconds: float):
    data = json.dumps(body).encode()
    return urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=seconds)  # noqa: S310


def embedding_call(base: str, model: str, seconds: float = 120) -> Callable[[list[str]], list[list[float]]]:
    """For embedders.embed_with: vectors in the order of the texts."""

    def call(texts: list[str]) -> list[list[float]]:
        with _post(f"{base}/embeddings", {"model": model, "input": texts}, seconds) as r:
            rows = sorted(json.load(r)["data"], key=lambda d: d["index"])
        return [d["embedding"] for d in rows]

    return call


def reachable(base: str, seconds: float = 3) -> bool:
    """Whether a service answers."""
    try:
        with urllib.request.urlopen(f"{base}/models", timeout=seconds) as r:  # noqa: S310
            return r.status == 200
    except (OSError, ValueError):
        return False


def pieces(lines: Iterator[bytes]) -> Iterator[tuple[str, str]]:
    """(reasoning or content, text) of a streamed answer's lines up to [DONE]; lines that are no JSON are passed over."""
    for raw in lines:
        line = raw.decode("utf-8", "replace").strip()
        if not line.startswith("data:"):
            continue
        data = line.removeprefix("data:").strip()
        if data == "[DONE]":
            return
        try:
            delta = json.loads(data)["choices"][0]["delta"]
        except (ValueError, KeyError, IndexError, TypeError):
            continue
        for key, kind in (("reasoning_content", "reasoning"), ("content", "content")):
            if delta.get(key):
                yield kind, delta[key]


def generator(base: str, model: str, seconds: float = 600) -> Callable[[list[dict]], Iterator[tuple[str, str]]]:
    """For answers.events: a chat model's streamed pieces."""

    def generate(messages: list[dict]) -> Iterator[tuple[str, str]]:
        with _post(f"{base}/chat/completions", {"model": model, "messages": messages, "stream": True}, seconds) as r:
            yield from pieces(r)

    return generate
