"""Repeated byte strings by longest-previous-factor arrays over sorted suffixes, in blocks that content-defined anchors bring together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import BASE, BYTE, SPACE, U, in_pieces, mix, word_hashes
from .common import giving_back, id_bitmap, in_bitmap, join_counted, materialise, small_batches

#: Windows that one suffix sort takes, about; contexts of one anchor beyond which they are dealt out by finer anchors.
SORT_WINDOWS, HOT = 20_000, 300
#: Windows of a finer context, at each level; the last has one, so all equal contexts are one class there.
STEPS = (8, 1)
#: Symbols handled at once; longer texts are taken in overlapping parts.
PART = 1 << 18
#: Bytes of a symbol: a byte itself, or the hash of a word.
BYTES, WORDS = 1, 8
_INDEX = U((1 << 23) - 1)


def word_symbols(texts: list[bytes]) -> list[bytes]:
    """Each text's words, runs without white space with A-Z as a-z, as 8 bytes a word."""
    out = []
    for lo, hi in in_pieces(texts, 1 << 20):
        words, at = word_hashes(texts[lo:hi], SPACE)
        out += [words[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def window_hashes(h: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Polynomial hash of each window of the given sizes over values of symbols, by doubling: that of 2m is made from two of m."""
    m, r = 1, BASE
    got: dict[int, tuple[np.ndarray, int]] = {}
    while m <= max(sizes):
        for k in sizes:
            if k & m:
                if k in got:  # the m bytes come before those gathered so far
                    tail, size = got[k]
                    n = max(0, len(tail) - m)
                    got[k] = (h[:n] * U(pow(int(BASE), size, 1 << 64)) + tail[m : m + n], size + m)
                else:
                    got[k] = (h, m)
        n = max(0, len(h) - m)
        h = h[:n] * r + h[m : m + n]
        r, m = U(int(r) ** 2 % (1 << 64)), 2 * m
    return {k: x for k, (x, _) in got.items()}


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each run of w values."""
    m = 1
    while 2 * m <= w:
        n = max(0, len(x) - m)
        x = np.minimum(x[:n], x[m : m + n])
        m *= 2
    n = max(0, len(x) - (w - m))
    return np.minimum(x[:n], x[w - m : w - m + n])


def anchor_runs(texts: list[bytes], size: int, unit: int = BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, windows, first window counted from the anchor, anchor's hash, context's hash) of every run of windows with one anchor.

    A window of `size` symbols is anchored at the least hash of the about half as long strings in it, the first of equal ones.
    Equal windows have their anchors at the same place, and each window is in one run; a run's context is what its
    windows cover, fewer than twice `size`.
    """
    gram = max(1, size * 12 // 25)
    parts = [(i, at, t[at * unit : (at + PART + size - 1) * unit]) for i, t in enumerate(texts) for at in range(0, max(0, len(t) // unit - size + 1), PART)]
    for lo, hi in in_pieces([p for _, _, p in parts], 2 * PART * unit):
        own = parts[lo:hi]
        joined = b"".join(p for _, _, p in own)
        h = window_hashes(BYTE[np.frombuffer(joined, np.uint8)] if unit == BYTES else np.frombuffer(joined, np.uint64), [gram, size])
        g = mix(h[gram])
        anchor = (sliding_min((g & ~_INDEX) | np.arange(len(g), dtype=np.uint64), size - gram + 1) & _INDEX).astype(np.int64)
        lengths = np.array([len(p) // unit for _, _, p in own])
        base = np.cumsum(lengths) - lengths
        n = lengths - size + 1
        which = np.repeat(np.arange(len(own)), n)
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base[which]
        a = anchor[p]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (which[1:] != which[:-1])))
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate((first, [len(p)])))
        f, last = p[first], p[first] + count - 1
        w = h[size]
        ctx = mix(w[f] * U(0x9E3779B97F4A7C15) ^ mix(w[last]) ^ (count.astype(np.uint64) << U(32)) ^ (a[first] - f).astype(np.uint64))
        of = which[first]
        text = np.array([i for i, _, _ in own])[of]
        yield text, f - base[of] + np.array([at for _, at, _ in own])[of], count, f - a[first], g[a[first]].view(np.int64), ctx.view(np.int64)


def repeated_windows(contexts: list[tuple[bytes, int]], size: int, keep_first: bool, unit: int = BYTES, owners: list | None = None) -> list[np.ndarray]:
    """For each context (symbols, number of windows), in order of position: which of its windows have a factor of at least `size`
    symbols in common with another place, or with an earlier one, or with one of another owner.

    The windows' suffixes are sorted by their first `size` symbols. Where neighbours agree in all of them, their common prefix
    reaches the threshold; in such a stretch a suffix has a previous smaller position, and so a long enough previous factor,
    unless it holds the stretch's least position, and a next smaller one likewise.
    """
    counts = np.array([n for _, n in contexts])
    lengths = np.array([len(b) // unit for b, _ in contexts])
    buffer = np.frombuffer(b"".join(b for b, _ in contexts), np.uint8)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(np.cumsum(lengths) - lengths, counts)
    suffix = np.lib.stride_tricks.sliding_window_view(buffer, size * unit)[at * unit].view(f"S{size * unit}").ravel()
    order = np.argsort(suffix, kind="stable")
    first = np.concatenate(([True], suffix[order[1:]] != suffix[order[:-1]]))
    cut = np.flatnonzero(np.concatenate((first, [True])))
    n = np.diff(cut)
    long = np.repeat(n > 1, n)
    if owners is not None:
        number = {x: i for i, x in enumerate(dict.fromkeys(owners))}
        own = np.repeat(np.array([number[x] for x in owners]), counts)[order]
        long = np.repeat(np.minimum.reduceat(own, cut[:-1]) != np.maximum.reduceat(own, cut[:-1]), n)
    if keep_first:
        least = np.repeat(np.minimum.reduceat(order, cut[:-1]), n)
        long &= order != least
    marked = np.zeros(len(order), bool)
    marked[order] = long
    return np.split(marked, np.cumsum(counts)[:-1])


def stretches(marked: np.ndarray, size: int) -> list[tuple[int, int]]:
    """[start, end) of the bytes under each run of marked windows."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return [(int(a), int(b) + size - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _finer(step: int, size: int, unit: int):
    """Cut contexts into parts of `step` windows at places counted from the anchor. A part's key is the bytes that all windows
    of its cell share, which it holds even where its own run covers the cell in part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                out = []
                for key, kid, th, p, n, off, single, data in zip(*(c.to_pylist() for c in b.slice(lo, 64).columns), strict=True):
                    for cell in range(off // step, (off + n - 1) // step + 1):
                        whole = cell * step - off  # where the cell's first window would be; its run may begin later or end before
                        i, j = max(0, whole), min(n, whole + step)
                        core, part = data[(whole + step - 1) * unit : (whole + size) * unit], data[i * unit : (j + size - 1) * unit]
                        k = digest(core + key.to_bytes(8, "little", signed=True) + cell.to_bytes(4, "little", signed=True))
                        out.append((k, digest(part + (i - whole).to_bytes(4, "little") + k.to_bytes(8, "little", signed=True)), kid, th, p + i, j - i, off + i, single, part))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                names = ["gram", "ctx", "kid", "th", "p", "n", "off", "single", "data"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return giving_back(cut)


def _sort_blocks(rows: DataFrame, size: int, keep_first: bool, unit: int, across: bool) -> DataFrame:
    """(kid, th, s, e) from contexts, those of one key in one task."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(group: list[tuple]) -> pa.RecordBatch:
            out = []
            owners = [r[1:3] for r in group] if across else None
            for (_, kid, th, p, _, single, _), marked in zip(group, repeated_windows([(r[6], r[4]) for r in group], size, keep_first, unit, owners), strict=True):
                if single or keep_first:
                    out += [(kid, th, p + s, p + e) for s, e in stretches(marked, size)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kid", "th", "s", "e"])

        group, windows, now = [], 0, None
        for b in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != now and windows >= SORT_WINDOWS:
                    yield close(group)
                    group, windows = [], 0
                now = row[0]
                if not group or row[:4] != group[-1][:4]:  # rows of one id and text are one place
                    group.append(row)
                    windows += row[4]
        if group:
            yield close(group)

    ready = rows.select("gram", "kid", "th", "p", "n", "single", "data").repartition("gram").sortWithinPartitions("gram", "kid", "th", "p")
    return ready.mapInArrow(giving_back(solve), "kid long, th long, s long, e long")


def _classes(members: DataFrame, across: bool) -> tuple[DataFrame, DataFrame]:
    """(classes of equal contexts with their rows, copies and first member, keys with several classes and their number). Across
    documents, a class that stands in several has two copies and another one."""
    doc = F.struct("kid", "th")
    rows = F.count(F.lit(1))
    copies = F.when(F.min(doc) != F.max(doc), 2).otherwise(1) if across else rows
    c = members.groupBy("gram", "ctx").agg(rows.alias("rows"), copies.cast("long").alias("copies"), F.min(F.struct("kid", "th", "p", "n", "off")).alias("rep"))
    c = materialise(c, "contexts")
    return c, c.groupBy("gram").agg(rows.alias("classes")).filter("classes > 1")


def _covered(members: DataFrame, classes: DataFrame, size: int, keep_first: bool) -> DataFrame:
    """All members of classes with several, whole; or all but the first."""
    many = classes.filter("copies > 1").select("gram", "ctx", "rows", "rep")
    x = join_counted(members, many, ["gram", "ctx"], "rows", members.count())
    if keep_first:
        x = x.filter(F.struct("kid", "th", "p", "n", "off") != F.col("rep"))
    return x.select("kid", "th", F.col("p").alias("s"), (F.col("p") + F.col("n") + size - 1).alias("e"))


def find_repeats(df: DataFrame, id_col: str, text_col: str, size: int, keep_first: bool = False, unit: int = BYTES, across: bool = False) -> DataFrame:
    """(kid, th, s, e): stretches of symbols covered by repeated strings of `size` symbols; they may overlap. Symbols are bytes, or
    words by their hashes.

    kid is the id (the least long for null), th the text's hash. With keep_first, the first place of each string by id, text
    hash and position stays. With `across`, only strings that stand in two documents (ids with texts) count, and of each document
    that has any, at least one stretch is given. Runs of windows are compared by hash of their whole contexts first; contexts that share an
    anchor but differ are sorted as suffixes. Anchors with very many different contexts are dealt out by longer shared
    strings, down to single windows, so no group stands in one task.
    """
    src = _keyed(df, id_col, text_col).select("kid", "th", "raw").filter(F.length("raw") >= (size if unit == BYTES else 2 * size - 1))
    symbols = word_symbols if unit == WORDS else list

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            for text, p, n, off, gram, ctx in anchor_runs(symbols(b.column(2).to_pylist()), size, unit):
                at = pa.array(text)
                cols = [pa.array(gram), pa.array(ctx), b.column(0).take(at), b.column(1).take(at), pa.array(p), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["gram", "ctx", "kid", "th", "p", "n", "off"])

    runs = materialise(src.mapInArrow(giving_back(scan), "gram long, ctx long, kid long, th long, p long, n int, off int"), "runs")
    again = runs.groupBy("gram").agg(F.min(F.struct("kid", "th")).alias("a"), F.max(F.struct("kid", "th")).alias("b")).filter("a <> b") if across else runs.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    grams = materialise(again.select("gram"), "repeated-anchors")
    maybe, _ = in_bitmap(runs, "gram", id_bitmap(grams, "gram"))
    members = materialise(maybe, "repeated-runs")  # the few with an anchor of their own are classes by themselves
    classes, several = _classes(members, across)
    found = [_covered(members, classes, size, keep_first)]
    several = materialise(several, "open-anchors")
    todo = join_counted(classes, several, ["gram"], "classes", classes.count()).select("gram", "classes", (F.col("copies") == 1).alias("single"), "rep.*")
    by_doc = todo.groupBy("kid", "th").agg(F.collect_list(F.struct("gram", "p", "n", "off", "single", "classes")).alias("todo"))  # a document's own
    by_doc = materialise(by_doc, "open-contexts")
    docs, _ = in_bitmap(_keyed(df, id_col, text_col).select("kid", "th", "raw"), "kid", id_bitmap(by_doc, "kid"))
    if unit == WORDS:
        docs = docs.mapInArrow(giving_back(_to_words), "kid long, th long, raw binary")
    data = F.transform("todo", lambda c: F.struct(*(c[x].alias(x) for x in ("gram", "p", "n", "off", "single", "classes")), F.substring(F.col("raw"), (c["p"] * unit).cast("int") + 1, (c["n"] + size - 1) * unit).alias("data")))
    open_ = docs.join(by_doc, ["kid", "th"]).select("kid", "th", F.explode(data).alias("c")).select("kid", "th", "c.*")
    open_ = materialise(open_, "context-bytes")
    found.append(_sort_blocks(open_.filter(F.col("classes") <= HOT), size, keep_first, unit, across))
    hot = open_.filter(F.col("classes") > HOT)
    for step in STEPS:
        if not hot.limit(1).count():
            break
        parts = hot.select("gram", "kid", "th", "p", "n", "off", "single", "data").mapInArrow(_finer(step, size, unit), "gram long, ctx long, kid long, th long, p long, n int, off int, single boolean, data binary")
        parts = materialise(parts, "finer")
        classes, several = _classes(parts, across)
        found.append(_covered(parts if keep_first else parts.filter("single"), classes, size, keep_first))
        reps = classes.join(several, "gram").select("gram", "ctx", "classes", "copies", "rep.kid", "rep.th", "rep.p")
        rest = parts.join(reps, ["gram", "ctx", "kid", "th", "p"]).withColumn("single", F.col("single") & (F.col("copies") == 1))
        found.append(_sort_blocks(rest.filter(F.col("classes") <= HOT), size, keep_first, unit, across))
        hot = rest.filter(F.col("classes") > HOT)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(word_symbols(b.column(2).to_pylist()), pa.binary())], names=["kid", "th", "raw"])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(df[text_col], F.lit(""))
    return small_batches(df).select(df[id_col].alias("id"), F.coalesce(df[id_col].cast("long"), F.lit(-(2**63))).alias("kid"), F.xxhash64(text).alias("th"), text.cast("binary").alias("raw"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(df: DataFrame, id_col: str, text_col: str, size: int, keep_first: bool = False, passage_words: int = 0) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept): each text's UTF-8 bytes without those that repeated strings cover.

    A null text is empty. Texts shorter than `size` keep everything. Rows with one id are documents of their own; if their
    texts are equal too, they are copies of each other. Extra columns are not read; an empty table gives no row. Removal
    may cut a character of several bytes, so `kept` is binary.

    With `passage_words`, a last column `shares_passage` is 1 where so many words in a row stand in another document too, whatever
    their bytes, else 0. It removes nothing; rows with one id and text are one document there.
    """
    spans = find_repeats(df, id_col, text_col, size, keep_first)
    if passage_words:
        shared = find_repeats(df, id_col, text_col, passage_words, unit=WORDS, across=True).select("kid", "th").distinct()
        spans = spans.unionByName(shared.select("kid", "th", F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("e")))
    spans = materialise(spans.groupBy("kid", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    docs = _keyed(df, id_col, text_col)
    hit, clean = in_bitmap(docs, "kid", id_bitmap(spans, "kid"))
    hit = hit.join(spans, ["kid", "th"], "left").select("id", "raw", F.col("spans.s").alias("s"), F.col("spans.e").alias("e"))
    none = F.lit(None).cast("array<bigint>")
    kind = docs.schema["id"].dataType
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *(["shares_passage"] if passage_words else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, rows = b.slice(lo, 256), []
                for raw, s, e in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    shares = int(-1 in (s or []))
                    gone = merged([x for x in zip(s or [], e or [], strict=True) if x[0] >= 0])
                    kept = b"".join(raw[a:z] for a, z in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(raw)], strict=True)) if gone else raw
                    rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, shares)[: len(names) - 1])
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False))], names=names)

    fields = f"`{id_col}` {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary" + (", shares_passage long" if passage_words else "")
    rows = hit.unionByName(clean.select("id", "raw", none.alias("s"), none.alias("e")))
    return rows.mapInArrow(giving_back(cut), fields)
