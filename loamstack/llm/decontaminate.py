"""Benchmark decontamination by spaced seeds: fixed masks find every place that may hold an overlap, hits are verified with substitutions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import PUNCT, in_pieces, mix, word_hashes
from .common import giving_back, small_batches

#: Fixed masks: a 1 is a word that must agree, a 0 one that may differ. Of n words, n // 5 may differ and cut the others into
#: n // 5 + 1 runs, one of which has three words, for all n from 6 on. From 10 words on, such a place has two hits at least.
MASKS = ("111",)
#: Masks for items of five words, wherever one differs.
FIVE = ("1111", "10111", "11011", "11101")
#: Words that an overlap needs (or the whole item, if shorter), and the share of them that must agree.
MIN_WORDS, MIN_SAME = 10, 0.8
#: Items with fewer words are too common to count.
MIN_ITEM = 5
#: Words of benchmark items that are broadcast at once; more items are taken in blocks.
BLOCK_WORDS = 2_000_000
#: Hits of seeds that are expanded at once.
HITS_AT_ONCE = 1 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(99))
_WEIGHTS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the agreeing words of each window of the mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            h += words[j : j + n] * _WEIGHTS[j]
    return mix(h)


def best_overlap(same: np.ndarray, need: int) -> tuple[int, int, int]:
    """(start, end, agreeing words) of the longest run of at least `need` positions of which MIN_SAME agree, without the
    differing words at its ends as far as `need` allows; zeros where there is none."""
    gain = np.where(same, 1 - MIN_SAME, -MIN_SAME)
    total = np.concatenate(([0.0], np.cumsum(gain))) + 1e-9 * np.arange(len(gain) + 1)
    low = np.minimum.accumulate(total)
    # for each end, the earliest start from which the run keeps the wanted share
    starts = np.searchsorted(-low, -total, side="left")
    size = np.arange(len(total)) - starts
    end = int(size.argmax())
    start = int(starts[end])
    hits = np.flatnonzero(same[start:end])
    if end - start < need or not len(hits):
        return 0, 0, 0
    first, last = start + int(hits[0]), start + int(hits[-1]) + 1
    last = min(end, max(last, first + need))
    return min(first, last - need), last, len(hits)


class Seeds:
    """All seeds of a block of items: sorted hashes with item and place, and a bit table that turns most words away."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        words, at = word_hashes([t for _, t in items], PUNCT) if items else (np.empty(0, np.uint64), np.zeros(1, np.int64))
        self.words = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.hits_needed = np.array([2 if len(w) >= MIN_WORDS else 1 for w in self.words])
        self.tables = []
        for mask in [*MASKS, *FIVE]:
            h, item, place = [], [], []
            for i, w in enumerate(self.words):
                if len(w) > MIN_ITEM if mask in MASKS else len(w) == MIN_ITEM:
                    s = seed_hashes(w, mask)
                    h.append(s)
                    item.append(np.full(len(s), i))
                    place.append(np.arange(len(s)))
            if not sum(map(len, h)):
                continue
            hs = np.concatenate(h)
            order = np.argsort(hs, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(hs >> _U(44)).astype(np.int64)] = True
            self.tables.append((mask, hs[order], np.concatenate(item)[order], np.concatenate(place)[order], bits))

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, first word of the item in `words`) of all places with as many seed hits as an overlap has. Seeds that the
        benchmark repeats give many hits; they are counted in rounds of bounded size."""
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        width = len(words) + max((len(w) for w in self.words), default=0) + 1
        for mask, hs, item, place, bits in self.tables:
            h = seed_hashes(words, mask)
            maybe = np.flatnonzero(bits[(h >> _U(44)).astype(np.int64)])
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(hs, h[maybe], "left"), np.searchsorted(hs, h[maybe], "right")
            end = np.cumsum(hi - lo)
            cut = [0, *np.searchsorted(end, np.arange(HITS_AT_ONCE, end[-1], HITS_AT_ONCE)).tolist(), len(maybe)]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                n = hi[a:z] - lo[a:z]
                if not n.sum():
                    continue
                at = np.repeat(lo[a:z], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                # an item may begin before the words do
                new, c = np.unique(item[at] * width + np.repeat(maybe[a:z], n) - place[at] + width - len(words) - 1, return_counts=True)
                keys, where = np.unique(np.concatenate((keys, new)), return_inverse=True)
                counts = np.bincount(where, np.concatenate((counts, c))).astype(np.int64)
        item, place = np.divmod(keys, width)
        keep = counts >= self.hits_needed[item] if len(keys) else np.zeros(0, bool)
        return np.stack([item[keep], place[keep] - (width - len(words) - 1)], axis=1)


def overlaps(texts: list[bytes], seeds: Seeds) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, first word, words, agreeing words, item's words) of the best overlap of each text with each item that it holds."""
    words, at = word_hashes(texts, PUNCT)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, d in seeds.hits(words).tolist():
        item = seeds.words[i]
        # the windows of a block of texts run on; the text that holds the middle of the item's place counts
        for t in range(int(np.searchsorted(at, max(d, 0), "right")) - 1, int(np.searchsorted(at, min(d + len(item), int(at[-1])), "left"))):
            lo, hi = max(d, int(at[t])), min(d + len(item), int(at[t + 1]))
            if hi - lo < MIN_ITEM:
                continue
            s, e, n = best_overlap(words[lo:hi] == item[lo - d : hi - d], min(MIN_WORDS, len(item)))
            if n and (n, -lo - s) > best.get((t, i), (0, 0, 0))[:2]:
                best[t, i] = (n, -lo - s, e - s)
    for (t, i), (n, start, size) in best.items():
        yield t, i, -start - int(at[t]), size, n, len(seeds.words[i])


def find_overlaps(df: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, keep_text: bool = False) -> DataFrame:
    """(id, item_id, first_word, words, same_words, item_words) for each document and item that overlap.

    Words are runs of ASCII letters, digits and bytes beyond ASCII of the lower-cased text. An overlap is a run of words of the
    item, at one place of the document, with at least MIN_WORDS words (or all of a shorter item) of which MIN_SAME agree.
    Null and empty texts have no words; items under MIN_ITEM words never match. Repeated rows and ids give rows each; equal items
    each match; of equally good places the first counts. Extra columns, also of the results' names, are not read; without documents or
    items there is no row. Items are broadcast in blocks of bounded size, each against all documents.
    """
    sized = items.select(F.col(item_id).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = sized.agg(F.coalesce(F.sum(F.length("t") / 2), F.lit(0.0))).first()[0]
    blocks = max(1, int(-(-total // BLOCK_WORDS)))
    src = small_batches(df).select(df[id_col], df[text_col])
    out = None
    for k in range(blocks):
        part = sized if blocks == 1 else sized.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        got = part.toArrow()
        rows = sorted(zip(got.column("i").to_pylist(), got.column("t").to_pylist(), strict=True), key=str)
        shared = df.sparkSession.sparkContext.broadcast(Seeds([(i, t.lower().encode("utf-8", "surrogatepass")) for i, t in rows]))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = shared.value
            for b in batches:
                texts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
                for lo, hi in in_pieces(texts, 1 << 20):
                    got = [(lo + t, seeds.ids[i], *rest) for t, i, *rest in overlaps(texts[lo:hi], seeds)]
                    if got:
                        t, *cols = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(t)), *(pa.array(c, pa.int64()) for c in cols)], names=[id_col, "item_id", "first_word", "words", "same_words", "item_words"]
                        )

        hits = src.mapInArrow(giving_back(find), f"`{id_col}` {src.schema[0].dataType.simpleString()}, item_id long, first_word long, words long, same_words long, item_words long")
        out = hits if out is None else out.unionByName(hits)
    return out
