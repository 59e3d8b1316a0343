"""Language identification by mixture inference: EM over n-gram likelihoods, the language set chosen by penalised likelihood."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, small_batches

#: Hashed trigram buckets of a model.
BUCKETS = 1 << 15
#: Documents that a model is fitted on at most (a random sample by hashed id, of the rows allowed for training).
TRAIN_DOCS = 20_000
#: Languages that a model holds at most; the model is broadcast, 128 KB for each.
MAX_LANGS = 256
#: Penalty for each language of the set, in units of half the logarithm of the number of trigrams, times this.
PENALTY = 8.0

_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _table
    if _table is None:
        _table = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _table


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each letter trigram of the whole text: lower-cased, runs of other characters as one space, a space at both
    ends. Empty where the text has no letters."""
    if not text:
        return np.empty(0, np.uint32)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _letters()[cp]
    if not keep.any():
        return np.empty(0, np.uint32)
    c = np.where(keep, cp, np.uint32(32))
    c = c[keep | np.concatenate(([True], keep[:-1]))]
    space = np.array([32], np.uint32)
    c = np.concatenate((space if c[0] != 32 else space[:0], c, space if c[-1] != 32 else space[:0]))
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(17)


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, counts)."""
    if len(h) < 4096:
        return np.unique(h, return_counts=True)
    n = np.bincount(h, minlength=BUCKETS)
    u = np.flatnonzero(n)
    return u, n[u]


@dataclass
class Model:
    """Trigram probabilities of each language: langs, and an array of BUCKETS x languages."""

    langs: list[str]
    p: np.ndarray

    @staticmethod
    def of(langs: list[str], counts: np.ndarray) -> Model:
        c = counts.T.astype(np.float64) + 0.05
        return Model(langs, (c / c.sum(axis=0)).astype(np.float32))

    def _em(self, p: np.ndarray, c: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        pi = np.full(p.shape[1], 1.0 / p.shape[1])
        n = c.sum()
        for _ in range(rounds if p.shape[1] > 1 else 0):
            new = pi * ((c / (p @ pi)) @ p) / n
            done = np.abs(new - pi).max() < 1e-3
            pi = new
            if done:
                break
        return pi, float(c @ np.log(p @ pi))

    def predict(self, text: str | None) -> tuple[str, float, str]:
        """(language, its share, all languages of the chosen set with shares); `und`, 0 and nothing for texts without letters."""
        return self.judge(text)[:3]

    def judge(self, text: str | None) -> tuple[str, float, str, bool]:
        """As `predict`, and whether the text is in those languages: not if it has no letters, or if even trigrams explain it better
        and, as one more component of the mixture, have more than half of it. A short text with a long key in it still is."""
        u, c = counted(trigrams(text))
        if not len(u):
            return "und", 0.0, "", False
        p, c = self.p[u].astype(np.float64), c.astype(np.float64)
        pi, _ = self._em(p, c, 12)
        order = np.lexsort((np.arange(len(pi)), -pi))
        best = None
        for k in range(1, len(order) + 1):
            chosen = order[:k]
            share, ll = self._em(p[:, chosen], c, 12)
            score = ll - PENALTY * k * 0.5 * np.log(c.sum() + 1)
            if best is not None and score <= best[0]:
                break
            best = score, chosen, share, ll
        _, chosen, share, ll = best
        known = ll >= -np.log(BUCKETS) * c.sum()
        if not known:
            known = self._em(np.concatenate([p, np.full((len(p), 1), 1 / BUCKETS)], axis=1), c, 50)[0][-1] <= 0.5
        ranked = sorted(zip((-share).tolist(), [self.langs[i] for i in chosen], strict=True))
        return ranked[0][1], float(min(1.0, max(0.0, -ranked[0][0]))), ",".join(f"{lang}:{-s:.3f}" for s, lang in ranked), bool(known)


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, allowed: Column, sample_docs: int = TRAIN_DOCS) -> Model:
    """Fit on a sample of at most about `sample_docs` of the allowed rows with a non-null language, over their whole texts.

    Without any such row the model has no language but `und`, of even likelihood.
    """
    rows = small_batches(df).filter(allowed & F.col(lang_col).isNotNull())
    n = rows.select(id_col).count()
    share = min(1.0, sample_docs / n) if n else 1.0
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in seen:
                    seen[lang] = np.zeros(BUCKETS, np.int64)
                u, c = counted(trigrams(text))
                seen[lang][u] += c
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"])

    sums = rows.mapInArrow(giving_back(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # languages x BUCKETS rows at most
    langs = sorted(set(got.column("lang").to_pylist()))
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages; a model holds {MAX_LANGS} at most")
    if not langs:
        return Model.of(["und"], np.zeros((1, BUCKETS)))
    counts = np.zeros((len(langs), BUCKETS))
    at = {lang: i for i, lang in enumerate(langs)}
    counts[[at[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return Model.of(langs, counts)


def identify(df: DataFrame, model: Model, id_col: str, text_col: str, keep_known: bool = False) -> DataFrame:
    """id, lang_pred, score, languages for each row, from its whole text only.

    Null texts and texts without letters are `und` with score 0. Equal texts get equal results; ids may repeat or be
    null; extra columns are not read; an empty table gives an empty result. `keep_known` adds the
    column `known` of `Model.judge`. Where the id is a struct that holds the text, text_col is `id.text`, and texts cross to
    Python once.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    held = text_col.partition(".")[2] if text_col.startswith(f"{id_col}.") else None
    src = small_batches(df).select(df[id_col]) if held else small_batches(df).select(df[id_col], df[text_col])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.judge(t) for t in (b.column(0).field(held) if held else b.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.string()), pa.array([g[3] for g in got], pa.bool_())],
                names=[id_col, "lang_pred", "score", "languages", "known"],
            )

    out = src.mapInArrow(giving_back(predict), f"`{id_col}` {src.schema[0].dataType.simpleString()}, lang_pred string, score double, languages string, known boolean")
    return out if keep_known else out.drop("known")
