"""Embedders (S10, S11, E1): a service in batches if one is given and reachable, hashed vectors otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 16


def key(text: Column | str) -> Column:
    """Under which a text's vector is kept."""
    return F.substring(F.sha1((F.col(text) if isinstance(text, str) else text).cast("binary")), 1, 16)


def embed_with(texts: DataFrame, key: str, text: str, call: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, vector): `call` gets BATCH texts at a time on the executors; its errors are raised with a hint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                try:
                    vectors = call(part.column(1).to_pylist())
                except Exception as e:
                    raise RuntimeError("the embedding service failed; check that it runs, or use hashed vectors") from e
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=[key, "vector"])

    return texts.select(key, F.col(text)).mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, vector array<double>")


def choose(available: Callable[[], bool] | None) -> str:
    """`service` or `hashed`."""
    try:
        return "service" if available is not None and available() else "hashed"
    except OSError:
        return "hashed"
