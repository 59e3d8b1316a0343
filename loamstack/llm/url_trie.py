"""URL filter: a trie over reversed host labels, with a trie over path segments at each host."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Most rules that one broadcast trie may hold, about 300 MB of Python objects on an executor.
MAX_RULES = 1_000_000


class UrlTrie:
    """Longest-match allow and block rules.

    A rule is (host, path, action). It fits its host and all subdomains of it where the url's path starts with the
    rule's path. Of the rules that fit, the one with the most host labels wins, then the one with the longest path;
    of two rules with the same host and path, the blocking one.
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; a broadcast trie holds {MAX_RULES} at most")
        self.root: dict = {}
        for host, path, action in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            step = node.setdefault(None, {})  # None: the path trie that hangs at this host
            for segment in whole:
                step = step.setdefault(segment, {})
            ends = step.setdefault(None, {})  # None: partial last segments that end a rule
            if ends.get(last, (None, ""))[1] != "block":
                ends[last] = (host + path, action)

    @staticmethod
    def _path(step: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            ends = step.get(None)
            if ends:
                fits = [p for p in ends if segment.startswith(p)]
                if fits:
                    best = ends[max(fits, key=len)]
            step = step.get(segment)
            if step is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule string, action) of the winning rule, or None."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._path(node[None], segments) or best
        return best


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path). Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str, url_col: str, default: str = "allow") -> DataFrame:
    """Judge every url: id, host, path, rule, verdict.

    Rows without a fitting rule get a null rule and `default`. Null urls and urls without :// have an empty host and
    path, which no rule fits. Ids may be null or repeat; each row is judged by itself. An empty table gives an empty
    result. Other columns, whatever their names, are not read.
    """
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    src = small_batches(df).select(df[id_col], df[url_col])
    kind = src.schema[0].dataType

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            hits = [match(h, p) or (None, default) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], [r for r, _ in hits], [v for _, v in hits]))],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    return src.mapInArrow(judge, f"`{id_col}` {kind.simpleString()}, host string, path string, rule string, verdict string")
