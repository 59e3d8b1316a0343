"""Best-fit packing of token sequences: dominance reduction on the histogram of lengths, then best fit decreasing."""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import in_pieces
from .common import giving_back, materialise, small_batches

CAPACITY = 4096
#: Id that ends every document.
END_ID = 1
#: Slots that are broadcast at once (40 bytes each); more are dealt with in blocks.
MAX_SLOTS = 1_000_000
#: Words that a worker remembers the ids of at most, and their greatest length.
CACHE_WORDS, CACHE_LENGTH = 250_000, 40
#: Rows that one ranking task orders, about.
RANK_ROWS = 200_000
#: More than any rank; a length and a rank make one number.
RANKS = 1 << 50
_GAPS = re.compile(r"[ \t\n\r]+")
#: Plain texts are ASCII and the letters of Latin-1, without apostrophes and what may be a special token. There, letter runs
#: and all else are cut apart, as the vocabulary does.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_RUNS = re.compile(f"[{_LETTERS}]+|[^ \\t\\n\\r{_LETTERS}]+")
_PLAIN_WORD = re.compile(f"[{_LETTERS}]+")
_PLAIN_BYTES = bytes(b for b in range(256) if b < 128 or (b >= 0xC0 and b not in (0xD7, 0xF7))).replace(b"'", b"")


def is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN_BYTES) and "<|" not in text
    except UnicodeEncodeError:
        return False


def cut_words(text: str) -> list[str]:
    """Parts of a text whose ids, one after another, are the text's ids."""
    return _RUNS.findall(text.lower()) if is_plain(text) else _GAPS.split(text)


class WordIds:
    """Ids as little-endian bytes, word by word. The tokenizer drops white space and never joins across it, so texts are cut
    at plain white space and each distinct word is encoded once. Plain texts are lower-cased and cut at letter runs too, which leaves fewer words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        # the same model without normalisation: plain words are normal already, and are given in the model's byte alphabet
        self.words_only = Tokenizer(self.encoder.model)
        self.words_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {}  # bytes of the letters at hand in the model's byte alphabet
        for c in [" ", *map(chr, range(97, 123)), *map(chr, range(0xDF, 0x100))]:
            shown |= dict(zip(c.encode(), letters.pre_tokenize_str(c)[0][0], strict=True))
        self.alphabet = "".join(" " if b == 32 else shown.get(b, "\ufffe") for b in range(256))
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def of(self, texts: list[str]) -> list[bytes]:
        split = [cut_words(t) for t in texts]
        known = self.known
        new = set().union(*split).difference(known)
        extra: dict[str, bytes] = {}
        plain = [w for w in new if _PLAIN_WORD.fullmatch(w)]
        if plain:  # as one text: such a word is one unit of the vocabulary, whose last id, and no other, ends a word
            joined = codecs.charmap_decode(" ".join(plain).encode(), "strict", self.alphabet)[0]
            ids = np.array(self.words_only.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            extra = {w: raw[x:y] for w, x, y in zip(plain, [0, *cuts[:-1]], cuts, strict=True)}
        other = list(new.difference(extra))
        for w, e in zip(other, self.encoder.encode_batch(other, add_special_tokens=False), strict=True):
            extra[w] = np.array(e.ids, "<u4").tobytes()
        for w in extra if len(known) < CACHE_WORDS else ():
            if len(w) <= CACHE_LENGTH:
                known[w] = extra[w]
        extra = {w: i for w, i in extra.items() if w not in known}
        if not extra:
            return [b"".join(map(known.__getitem__, words)) for words in split]
        return [b"".join([known[w] if w in known else extra[w] for w in words]) for words in split]


def cut_into_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids and the end id; only documents beyond the capacity are cut."""
    src = small_batches(df).select(df[id_col], df[text_col])
    step = 4 * capacity
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in in_pieces(texts, 1 << 20):
                rows: list[tuple] = []
                for i, ids in enumerate(words.of(texts[lo:hi]), lo):
                    ids += end
                    rows += [(i, p, at // 4, (min(len(ids), at + step) - at) // 4, zlib.crc32(ids[at : at + step])) for p, at in enumerate(range(0, len(ids), step))]
                i, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(i)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    return src.mapInArrow(giving_back(cut), f"`{id_col}` {src.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Sequences for a histogram of lengths. A slot (length, first, count, sequence, offset) says: of the items of this
    length, those ranked first to first+count-1 stand at `offset` of the sequences numbered from `sequence` on."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left = capacity, Counter({k: n for k, n in histogram.items() if n})
        if any(not 0 < k <= capacity for k in self.left):
            raise ValueError("lengths must be from 1 to the capacity")
        self.used: Counter[int] = Counter()
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.slots.append((length, self.used[length], count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count

    def _open(self, lengths: list[int], count: int) -> None:
        at = 0
        for x in lengths:
            self._place(x, count, self.sequences, at)
            at += x
        self.sequences += count

    def _reduce(self) -> None:
        """Martello and Toth's dominance, for the longest items first: a set with the item that no other set with it can beat
        is fixed for good, for as many equal sets as there are. Such sets are: the item alone, if no other item fits; the
        item with the longest that fits, if that fills the sequence, if no two others fit, or if no three fit and no two
        others that fit together are longer than it."""
        for j in sorted(self.left, reverse=True):
            while self.left[j] > 0:
                room = self.capacity - j
                have = np.array(sorted(k for k, n in self.left.items() if n > (k == j)), np.int64)
                fits = have[have <= room]
                if not len(fits):
                    n = self.left[j]
                    self._open([j], n)
                    self.fixed += n
                    continue
                k = int(fits[-1])
                many = [int(x) for x in fits[:3] for _ in range(min(3, self.left[int(x)] - (x == j)))][:3]
                two, three = (sum(many[:m]) if len(many) >= m else room + 1 for m in (2, 3))
                best = k == room or two > room
                if not best and three > room:
                    mate = fits[np.maximum(np.searchsorted(fits, room - fits, side="right") - 1, 0)]
                    pairs = (fits + mate)[fits + mate <= room]  # may pair an item with itself, which only asks for more
                    best = not len(pairs) or pairs.max() <= k
                if not best:
                    break
                n = self.left[j] // 2 if k == j else min(self.left[j], self.left[k])
                self._open([j, k], n)
                self.fixed += n

    def _best_fit(self) -> None:
        """Longest first, each into the fullest sequence with room; equal sequences are handled together."""
        room: dict[int, list[tuple[int, int]]] = {}
        for x in sorted((k for k, n in self.left.items() if n), reverse=True):
            while n := self.left[x]:
                r = min((r for r in room if r >= x), default=0)
                if not r:
                    opened = -(-n // (self.capacity // x))
                    room[self.capacity] = [(self.sequences, opened)]
                    self.sequences += opened
                    continue
                first, count = room[r].pop()
                if not room[r]:
                    del room[r]
                each = r // x  # the sequence just made fuller stays the fullest with room
                full = min(count, n // each)
                rest = n - full * each if full < count else 0
                for j in range(each):
                    if full:
                        self._place(x, full, first, self.capacity - r + j * x)
                for j in range(rest):
                    self._place(x, 1, first + full, self.capacity - r + j * x)
                if r > each * x and full:
                    room.setdefault(r - each * x, []).append((first, full))
                if rest:
                    room.setdefault(r - rest * x, []).append((first + full, 1))
                if full + bool(rest) < count:
                    room.setdefault(r, []).append((first + full + bool(rest), count - full - bool(rest)))


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. `pieces` must be stored (its rows are read several times).

    The histogram, at most `capacity` rows, is planned on the driver. Ranks among pieces of one length are made in salted
    groups, so that a length which a third of all pieces have is ordered by many tasks.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(histogram, capacity)
    salts = max(16, -(-sum(histogram.values()) // RANK_ROWS))
    p = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = p.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_salt").orderBy(*order)
    p = p.withColumn("_in", F.row_number().over(inside)).join(base, ["length", "_salt"])
    p = p.withColumn("_rank", (F.col("_base") + F.col("_in") - 1).cast("long")).select(*pieces.columns, "_rank")
    slots = np.array(sorted(plan.slots), np.int64).reshape(-1, 5)
    blocks = [slots[i : i + MAX_SLOTS] for i in range(0, len(slots), MAX_SLOTS)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    names = [*pieces.columns, "sequence_id", "offset"]
    at_length, at_rank = pieces.columns.index("length"), len(pieces.columns)
    spark, parts = pieces.sparkSession, []
    for i, block in enumerate(blocks):
        rows = p
        if len(blocks) > 1:  # ranges of (length, rank), each with its own slots
            key = F.col("length") * RANKS + F.col("_rank")
            low, high = (F.lit(int(b[0, 0]) * RANKS + int(b[0, 1])).cast("long") for b in (block, blocks[(i + 1) % len(blocks)]))
            rows = rows.filter(key >= low) if i + 1 == len(blocks) else rows.filter((key >= low) & (key < high))
        shared = spark.sparkContext.broadcast(block)

        def place(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = shared.value
            key = s[:, 0] * RANKS + s[:, 1]
            for b in batches:
                length, rank = b.column(at_length).to_numpy(), b.column(at_rank).to_numpy()
                hit = s[np.searchsorted(key, length * RANKS + rank, side="right") - 1]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])], names=names)

        parts.append(rows.mapInArrow(giving_back(place), fields))
    if not parts:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of the end id alone. Repeated rows and ids, also null ones, are documents of
    their own. Extra columns are not read; an empty table gives no row.
    """
    pieces = materialise(cut_into_pieces(df, id_col, text_col, tokenizer_path, capacity), "pieces")
    return pack(pieces, [id_col, "piece", "length", "ids_crc32"], capacity)
