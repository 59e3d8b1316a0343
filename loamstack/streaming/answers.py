"""Answer streams (S12, S16, W1): a generator's pieces as events, one retry, and their text form."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

Pieces = Callable[[list[dict]], Iterator[tuple[str, str]]]


def extract(messages: list[dict]) -> Iterator[tuple[str, str]]:
    """An offline generator: the first lines of the material, with the source tag of each block."""
    for block in messages[-1]["content"].split("\n\n"):
        head, _, body = block.partition("\n")
        if head.startswith("【") and body:
            yield "content", f"{body.splitlines()[0]} [来源：{head.strip('【】').split('】')[0]}]\n"


def events(messages: list[dict], generate: Pieces, finish: Callable[[str], dict], meta: dict | None = None) -> Iterator[tuple[str, dict]]:
    """meta, then reasoning and delta as they come, retry once after an error, done with what `finish` says, or error."""
    yield "meta", meta or {}
    for attempt in (1, 2):
        answer = ""
        try:
            for kind, text in generate(messages):
                if kind == "content":
                    answer += text
                yield "reasoning" if kind == "reasoning" else "delta", {"text": text}
            if not answer:
                raise RuntimeError("empty answer")
        except Exception as e:
            if attempt == 2:
                yield "error", {"message": str(e)}
                return
            yield "retry", {"message": str(e)}
            continue
        yield "done", {"answer": answer, **finish(answer)}
        return


def encode(stream: Iterator[tuple[str, dict]]) -> Iterator[str]:
    """Events as server-sent text."""
    for name, data in stream:
        yield f"event: {name}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"


def decode(text: str) -> Iterator[tuple[str, dict]]:
    """Events of server-sent text; pieces that are no JSON are passed over."""
    for part in text.split("\n\n"):
        fields = dict(line.split(": ", 1) for line in part.splitlines() if ": " in line)
        if fields.get("data", "") == "[DONE]":
            return
        try:
            yield fields.get("event", "message"), json.loads(fields.get("data", ""))
        except ValueError:
            continue
