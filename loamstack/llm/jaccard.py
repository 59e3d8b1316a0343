"""Exact Jaccard join on word shingles: blocks from shared rare shingles, a count-vector R-tree in each block, exact checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import BASE, SPACE, U, in_pieces, mix, shingles, word_hashes
from .common import components, giving_back, id_bitmap, in_bitmap, join_counted, materialise, small_batches

#: Coordinates of a count vector, members of a leaf and children of a node of the R-tree.
GROUPS, LEAF, FAN = 16, 16, 16
#: Shingles that one bucket counts, about, and bytes of sets in one side of a tile.
BUCKET_TOKENS, TILE_BYTES = 250_000, 24 << 20
#: Least and greatest number of cells of a set's counts. Classes of one side of a tile where counts meet; groups up to so many are compared
#: at once, larger ones by a tree.
CELLS, TILE_COUNTS, AT_ONCE = (16, 4096), 4096, 64
#: Shingles of fewer classes than 2 to this power are grouped by the list of their classes.
FEW = 5


@dataclass(frozen=True)
class Rule:
    """Sets of k-word shingles link when den * intersection >= num * union."""

    k: int = 5
    num: int = 4
    den: int = 5

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def needed(self, a: int, b: np.ndarray) -> np.ndarray:
        """The least intersection with which sets of a and b shingles link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        """So many shingles of a set of n, first in any order that all sets share, hold one of any set that it links with."""
        return n - -(-self.num * n // self.den) + 1

    @property
    def watched(self) -> int:
        """Of 65536, the shingles whose frequency is counted, by hash: somewhat more than a prefix."""
        return min(65536, int(65536 * 1.7 * (self.den - self.num) / self.den))


def sets_of(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, words are runs without space and \\t to \\r. A text of
    fewer words has its whole sequence as the one shingle; without words the set is empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for lo, hi in in_pieces(raw, 1 << 20):
        words, at = word_hashes(raw[lo:hi], SPACE)
        h = shingles(words, k)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(h[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                x = U(b - a)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        x = x * BASE + w
                yield mix(np.array([x], np.uint64))
            else:
                yield np.empty(0, np.uint64)


class CountTree:
    """R-tree over count vectors. A node keeps the largest count of each coordinate and the least size below it, so the sum
    of coordinate minima bounds the overlap with anything in it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rule: Rule):
        self.points, self.sizes, self.rule = points, sizes, rule
        # sort-tile: slabs by size, then by the first coordinates within a slab
        rank = np.argsort(np.argsort(sizes, kind="stable"), kind="stable")
        slab = rank // max(LEAF, int(np.sqrt(len(sizes) * LEAF)))
        self.order = np.lexsort((points[:, 1], points[:, 0], slab))
        self.levels = []
        top, least = points[self.order], sizes[self.order]
        width = LEAF
        while len(top) > 1:
            cut = np.arange(0, len(top), width)
            top, least = np.maximum.reduceat(top, cut), np.minimum.reduceat(least, cut)
            self.levels.append((top, least, width))
            width = FAN
        self.levels.reverse()

    def near(self, i: int, alive: np.ndarray) -> np.ndarray:
        """Living members whose overlap with member i may suffice."""
        p, n = self.points[i], int(self.sizes[i])
        nodes = np.arange(len(self.levels[0][0])) if self.levels else np.arange(len(self.order))
        for depth, (top, least, width) in enumerate(self.levels):
            nodes = nodes[np.minimum(top[nodes], p).sum(axis=1) >= self.rule.needed(n, least[nodes])]
            below = len(self.levels[depth + 1][0]) if depth + 1 < len(self.levels) else len(self.order)
            nodes = (nodes[:, None] * width + np.arange(width)).ravel()
            nodes = nodes[nodes < below]
        m = self.order[nodes]
        m = m[alive[m]]
        return m[np.minimum(self.points[m], p).sum(axis=1) >= self.rule.needed(n, self.sizes[m])]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


class Overlaps:
    """Sizes of intersections of one set with many others. Shingles that an eighth of the sets hold are bits of a row for each set, others
    that several hold have lists of their sets."""

    def __init__(self, sets: list[np.ndarray]):
        who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens, who = tokens[order], who[order]
        first = np.concatenate((np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1]))
        at = np.flatnonzero(np.concatenate((first, [True])))
        held, of = np.diff(at), np.cumsum(first) - 1
        dense = held >= max(2, len(sets) / 8)
        mine = dense[of]
        bit = (np.cumsum(dense) - 1)[of[mine]]
        self.bits = np.zeros((len(sets), int(dense.sum()) // 64 + 1), np.uint64)
        np.bitwise_or.at(self.bits, (who[mine], bit >> 6), U(1) << (bit & 63).astype(np.uint64))
        self.who, rare = who, (held[of] > 1) & ~mine
        owner = np.argsort(who[rare], kind="stable")
        self.lists, self.start, self.held = of[rare][owner], at, held
        self.own = np.searchsorted(who[rare][owner], np.arange(len(sets) + 1))

    def of(self, i: int, js: np.ndarray) -> np.ndarray:
        both = np.bitwise_count(self.bits[js] & self.bits[i]).sum(axis=1, dtype=np.int64)
        lists = self.lists[self.own[i] : self.own[i + 1]]
        if len(lists):
            n = self.held[lists]
            at = np.repeat(self.start[lists] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both += np.bincount(self.who[at], minlength=len(self.bits))[js]
        return both


def spanning(n: int, near: Callable[[int, np.ndarray], list[int]]) -> list[tuple[int, int]]:
    """Pairs that connect just what all pairs connect; `near` gives a member's partners among those not yet reached."""
    alive, out = np.ones(n, bool), []
    for seed in range(n):
        front = [seed] if alive[seed] else []
        alive[front] = False
        while front:
            i = front.pop()
            found = near(i, alive)
            alive[found] = False
            out += [(i, j) for j in found]
            front += found
    return out


def spanning_links(sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links that connect just what all links connect. A member is checked against those not yet reached: pairs that are
    connected already need no check, so a group of copies costs about one check a member."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tree = CountTree(np.stack([np.bincount((s & U(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets]), sizes, rule)
    overlaps = Overlaps(sets)

    def near(i: int, alive: np.ndarray) -> list[int]:
        js = tree.near(i, alive)
        return js[overlaps.of(i, js) >= rule.needed(len(sets[i]), sizes[js])].tolist()

    return spanning(len(sets), near)


def cell_counts(s: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each cell by their last bits; a power of two of cells, one for some 8 to 16 shingles."""
    cells = min(CELLS[1], max(CELLS[0], 1 << (len(s) // 16).bit_length()))
    return np.bincount((s & U(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint16 if len(s) < 65536 else np.uint32)


def folded(counts: np.ndarray, cells: int) -> np.ndarray:
    """The same counts over fewer cells."""
    return counts.reshape(-1, cells).sum(axis=0, dtype=np.int64)


def spanning_candidates(counts: list[np.ndarray], sizes: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Pairs that connect just what all pairs connect whose counts leave room for a link: the sum of the minima of their cells,
    over as many cells as both have, bounds the overlap."""
    order, out = np.argsort(sizes, kind="stable"), []
    n = sizes[order]
    gaps = (np.flatnonzero(rule.den * n[:-1] < rule.num * n[1:]) + 1).tolist()  # no link over such a step of sizes
    for a, e in zip([0, *gaps], [*gaps, len(n)], strict=True):
        if e - a < 2:
            continue
        own, size = [counts[i] for i in order[a:e]], n[a:e]
        cells = len(own[0])
        points = np.stack([folded(c, cells) for c in own])
        if e - a <= AT_ONCE:
            room = np.stack([np.minimum(points, p).sum(axis=1) >= rule.needed(int(x), size) for p, x in zip(points, size, strict=True)])
            first = lambda i, alive, room=room: np.flatnonzero(room[i] & alive).tolist()
        else:
            first = lambda i, alive, tree=CountTree(points, size, rule): tree.near(i, alive).tolist()

        def fits(i: int, j: int, own=own, size=size, cells=cells) -> bool:
            both = min(len(own[i]), len(own[j]))
            return both == cells or np.minimum(folded(own[i], both), folded(own[j], both)).sum() >= rule.needed(int(size[i]), size[j])

        found = spanning(e - a, lambda i, alive, first=first, fits=fits: [j for j in first(i, alive) if fits(i, j)])
        out += [(int(order[a + i]), int(order[a + j])) for i, j in found]
    return out


def class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order; 0 for the empty set."""
    if not len(s):
        return 0, 0
    return tuple(int((mix(s * U(m) + U(1)).sum(dtype=np.uint64) ^ U(len(s))).view(np.int64)) for m in (1, 0xD6E8FEB86659FD93))


def _sketches(df: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """For each row: set size, class key (equal sets, equal keys), prefix length, watched shingles and, where they are fewer than
    the prefix, further shingles in hash order; counts of all shingles by cell."""
    src = small_batches(df).select(df[id_col].cast("long"), df[text_col])
    watched = U(rule.watched)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows = []
                for s in sets_of(part.column(1).to_pylist(), rule.k):
                    w = s[(s & U(0xFFFF)) < watched]
                    p = rule.prefix(len(s)) if len(s) else 0
                    more = s[(s & U(0xFFFF)) >= watched][: p - len(w)] if len(w) < p else s[:0]
                    rows.append((len(s), *class_key(s), p, len(w), w.tobytes(), more.tobytes(), cell_counts(s).tobytes()))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "n", "key", "key2", "p", "nw", "watched", "more", "counts"])

    return src.mapInArrow(giving_back(sketch), "id long, n long, key long, key2 long, p int, nw int, watched binary, more binary, counts binary")


#: Of a shingle's hash its first 56 bits travel, of a class's key 48. Hashes or keys that agree so far by chance count as equal there,
#: which only lets more sets meet.
_SHORT_KEY = (1 << 48) - 1


def _packed(tokens: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """13 bytes for each pair."""
    out = np.empty((len(tokens), 13), np.uint8)
    out[:, :7] = tokens.view(np.uint8).reshape(-1, 8)[:, 1:]
    out[:, 7:] = keys.view(np.uint8).reshape(-1, 8)[:, :6]
    return out


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 13)
    tokens, keys = np.zeros((len(x), 8), np.uint8), np.zeros((len(x), 8), np.uint8)
    tokens[:, 1:], keys[:, :6] = x[:, :7], x[:, 7:]
    return tokens.view(np.uint64).ravel(), keys.view(np.int64).ravel()


def _shared_tokens(sketches: DataFrame, tokens: int) -> DataFrame:
    """(rank, key) of watched shingles that at least two classes have. A rank is the logarithm of the shingle's frequency, then
    its hash. Hashes travel packed and sorted, in ranges of about equal size; a task sends those of a class once, however many
    copies of it there are."""
    buckets = max(8, -(-tokens // BUCKET_TOKENS))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        keys: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            t, k = np.concatenate(parts), np.concatenate(keys)
            order = np.argsort(t)
            x = _packed(t[order], k[order])
            to = (((t[order] >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)
            cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True])))
            blobs = [x[a:e].tobytes() for a, e in zip(cut[:-1], cut[1:], strict=True)]
            parts.clear()
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(to[cut[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        size = 0
        for b in batches:
            for key, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key not in seen and blob:
                    seen.add(key)
                    parts.append(np.frombuffer(blob, np.uint64))
                    keys.append(np.full(len(blob) // 8, key, np.int64))
                    size += len(blob) // 8
                    if size >= 1_000_000:
                        yield flush()
                        size = 0
        if parts:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            t, k = _unpacked(blobs)
            order = np.argsort(t, kind="stable")
            t, k = t[order], k[order]
            first = np.concatenate(([True], t[1:] != t[:-1]))
            n = np.diff(np.flatnonzero(np.concatenate((first, [True]))))
            many = np.repeat(n > 1, n)
            t, k = t[many], k[many]
            order = np.lexsort((k, t))  # a class may have come from several tasks
            t, k = t[order], k[order]
            once = np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]))) if len(t) else np.empty(0, bool)
            t, k = t[once], k[once]
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1], [True]))) if len(t) else np.zeros(1, np.int64)
            n = np.diff(first)
            df = np.repeat(n, n)
            rank = (np.log2(df[df > 1]).astype(np.int64) << 56) | (t[df > 1] >> U(8)).view(np.int64)
            k = k[df > 1]
            for a in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (rank, k)], names=["rank", "key"])

        held, now = [], None
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield from close(held)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield from close(held)

    packed = sketches.select("key", "watched").mapInArrow(giving_back(scatter), "bucket int, blob binary")
    return packed.repartition(max(8, buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(count), "rank long, key long")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(id, n_shingles, component_id): component_id is the least id reachable by links.

    Equal sets, by keys of 128 bits, are one class. Classes that can link share a shingle among their rarest (a prefix in the order: watched
    shingles by frequency, then the others by hash). Where classes share one, their sizes and counts by cell tell which pairs have no
    room for a link; components of the others are blocks that lose no link (classes whose short keys agree by chance share a block).
    Without that, sharing by accident joins more of a larger table into one block, until most of it is. In a
    block the R-tree proposes and exact intersections decide; a large block is cut into parts, and every two parts meet
    in a task. Null and empty texts have no shingles and no links. Ids may repeat, also with other texts, and then share
    components; rows with a null id link nothing and have a null component. An empty table gives an empty result.
    """
    s = materialise(_sketches(df, id_col, text_col, rule), "sketches")
    full = s.filter("n > 0 AND id IS NOT NULL")
    both = ["key", "key2"]
    classes = materialise(full.groupBy(*both).agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("p").alias("p"), F.min("nw").alias("nw"), F.count(F.lit(1)).alias("copies"), F.min("more").alias("more"), F.min("counts").alias("counts")), "classes")
    tokens = s.agg(F.coalesce(F.sum("nw"), F.lit(0))).first()[0]
    shared = _shared_tokens(full, tokens).groupBy("key").agg(F.sort_array(F.collect_list("rank")).alias("shared"))  # a set's own shingles
    short = F.col("key").bitwiseAND(F.lit(_SHORT_KEY))
    rare = classes.select(short.alias("key"), "p", "nw", F.when(F.length("more") > 0, F.col("more")).alias("more")).join(shared, "key", "left")
    want = F.col("p") - (F.col("nw") - F.coalesce(F.size("shared"), F.lit(0)))
    rare = rare.withColumn("want", F.when(F.col("shared").isNull(), F.lit(0)).otherwise(F.greatest(want, F.lit(0)))).filter("want > 0 OR more IS NOT NULL")
    known = rare.filter("want > 0").select("key", F.explode(F.slice("shared", F.lit(1), F.col("want"))).alias("token"))
    unknown = rare.filter("more IS NOT NULL").select("key", "more").mapInArrow(giving_back(_unpack), "key long, token long")
    known = known.withColumn("few", F.shiftright("token", 56) < FEW)  # a rank begins with the logarithm of the frequency
    at = materialise(known.unionByName(unknown.withColumn("few", F.lit(False))), "rare-shingles")
    blocks = components(_candidates(at, classes.select(short.alias("key"), "n", "counts"), rule), "a", "b")
    members = materialise(classes.join(blocks, short == blocks["id"]).select("rep", *both, "n", F.col("root").alias("block")), "members")
    sized = members.groupBy("block").agg(F.ceil(F.sum(F.col("n") * 8) / TILE_BYTES).cast("int").alias("parts"))
    members = members.join(sized, "block").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    docs, _ = in_bitmap(df.select(df[id_col].cast("long").alias("rep"), df[text_col].alias("text")), "rep", id_bitmap(members, "rep"))
    sets = docs.join(members, "rep").select("block", "parts", "part", "rep", *both, "text")
    k = rule.k

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                blobs = [x.tobytes() for x in sets_of(part.column(6).to_pylist(), k)]
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(blobs, pa.binary())], names=["block", "parts", "part", "rep", *both, "blob"])

    sets = sets.mapInArrow(giving_back(to_sets), "block long, parts int, part int, rep long, key long, key2 long, blob binary")
    tiles = _tiles(sets).select("block", "ti", "tj", "rep", *both, "blob")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(group: dict[tuple[int, int], tuple[int, np.ndarray]]) -> pa.RecordBatch:
            reps = [r for r, _ in group.values()]
            found = spanning_links([x for _, x in group.values()], rule)
            return pa.RecordBatch.from_arrays([pa.array([reps[i] for i, _ in found], pa.int64()), pa.array([reps[j] for _, j in found], pa.int64())], names=["a", "b"])

        now, group = None, {}
        for b in batches:
            for block, ti, tj, rep, key, key2, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block, ti, tj) != now:
                    if len(group) > 1:
                        yield close(group)
                    now, group = (block, ti, tj), {}
                x = np.frombuffer(blob, np.uint64)
                if class_key(x) == (key, key2):  # not another text of the same id
                    group[key, key2] = (rep, x)
        if len(group) > 1:
            yield close(group)

    dealt = tiles.repartition("block", "ti", "tj").sortWithinPartitions("block", "ti", "tj", "rep")
    links = components(dealt.mapInArrow(giving_back(resolve), "a long, b long"), "a", "b")
    roots = classes.join(links, classes["rep"] == links["id"], "left").select(*both, "copies", F.coalesce("root", "rep").alias("root"))
    mine = s.select("id", "n", *both)
    linked = join_counted(mine.filter("n > 0 AND id IS NOT NULL"), materialise(roots, "roots"), both, "copies", s.count())
    alone = mine.filter("NOT (n > 0 AND id IS NOT NULL)").withColumn("root", F.col("id"))
    out = linked.select("id", "n", "root").unionByName(alone.select("id", "n", "root")).select("id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
    return out.withColumnRenamed("id", id_col)


def _tiles(df: DataFrame) -> DataFrame:
    """Each row of a block's part once for each of the block's parts: every two parts, and each with itself, are a tile (ti, tj)."""
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return df.withColumns({"ti": F.least("part", "other"), "tj": F.greatest("part", "other")})


def _candidates(at: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): keys of classes that share a rare shingle and have room for a link, as many as connect all of them. Few classes
    often share many shingles, so each list of classes is looked at once; shingles of many classes are looked at one by one."""
    lists = at.filter("few").groupBy("token").agg(F.sort_array(F.collect_set("key")).alias("keys")).filter(F.size("keys") > 1)  # under 2 ** FEW keys
    lists = lists.groupBy("keys").agg(F.min("token").alias("block")).select("block", F.explode("keys").alias("key"), F.lit(1).alias("parts"))
    many = at.filter("NOT few").select(F.col("token").alias("block"), "key")
    sized = many.groupBy("block").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    many = many.join(sized, "block").select("block", "key", F.ceil(F.col("size") / TILE_COUNTS).cast("int").alias("parts"))
    met = lists.unionByName(many).join(classes, "key").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = _tiles(met).select("block", "ti", "tj", "key", "n", "counts").repartition("block", "ti", "tj").sortWithinPartitions("block", "ti", "tj", "key")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []

        def close(group: list[tuple[int, int, bytes]]) -> None:
            keys, sizes = [k for k, _, _ in group], np.array([n for _, n, _ in group], np.int64)
            counts = [np.frombuffer(c, np.uint16 if n < 65536 else np.uint32) for _, n, c in group]
            root, least = {}, {}
            for i, j in spanning_candidates(counts, sizes, rule):  # i is reached before j
                root[j] = root.setdefault(i, i)
            for i, r in root.items():
                least[r] = min(least.get(r, keys[i]), keys[i])
            found.extend((least[r], keys[i]) for i, r in root.items())  # to the least key, so that many shingles of one group give the same pairs

        def flush() -> pa.RecordBatch:
            pairs = np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        now, group = None, []
        for b in batches:
            for block, ti, tj, key, n, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block, ti, tj) != now:
                    if len(group) > 1:
                        close(group)
                    now, group = (block, ti, tj), []
                    if len(found) >= 50_000:
                        yield flush()
                group.append((key, n, counts))
        if len(group) > 1:
            close(group)
        yield flush()

    return dealt.mapInArrow(giving_back(propose), "a long, b long")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        if parts:
            keys = np.repeat(b.column(0).to_numpy(), [len(x) for x in parts])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(parts))], names=["key", "token"])
