"""From raw documents to packed sequences: each stage reads what its predecessor kept, all of it, from Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.llm import decontaminate, jaccard, langid, packing, pii
from loamstack.llm.common import id_bitmap, in_bitmap, materialise, table
from loamstack.llm.queries import tokenizer_path

#: Near duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 or more.
NEAR = jaccard.Rule(k=5, num=4, den=5)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among `ids`; only those that may be are shuffled."""
    ids = materialise(ids.select("doc_id").distinct(), "gone")
    maybe, sure = in_bitmap(docs, "doc_id", id_bitmap(ids, "doc_id"))
    return maybe.join(ids, "doc_id", "left_anti").select(*docs.columns).unionByName(sure)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which mixture inference finds a language, also those in several; null texts, texts without letters and
    texts mostly of trigrams that no language explains have none. The model is fitted on a bounded sample of the
    rows with a language."""
    model = langid.fit(docs, "doc_id", "text", "lang", F.lit(True))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    judged = langid.identify(rows, model, "row", "row.text", keep_known=True)
    return judged.filter((F.col("lang_pred") != "und") & F.col("known")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each group; of rows with one id and text, one."""
    groups = jaccard.near_duplicates(docs, "doc_id", "text", NEAR)
    kept = _without(docs, groups.filter("doc_id <> component_id"))
    again = materialise(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id"), "repeated-ids")
    maybe, once = in_bitmap(kept, "doc_id", id_bitmap(again, "doc_id"))
    return maybe.dropDuplicates(["doc_id", "text"]).unionByName(once)


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no passage of the benchmark, also not with some words replaced."""
    hits = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return _without(docs, hits)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text is replaced by the kind, and n_chars follows."""
    rows = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "text")
    new = {"text": F.col("redacted"), "n_chars": F.when(F.col("spans") == "", F.col("row.n_chars")).otherwise(F.char_length("redacted").cast("long"))}
    found = pii.find_pii(rows, "row", "text")
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place there."""
    return packing.pack_documents(docs, "doc_id", "text", tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_overlaps", benchmark_overlaps),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL cannot express these stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
