"""Quality assessment (A1 to A10): numbering, reviews, lengths, references, coverage, score, gold cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Clauses below so many characters are listed; weights of coverage, numbering, references and structure.
SHORT_CLAUSE = 25
WEIGHTS = (40, 25, 15, 20)


def numbering(df: DataFrame, group: list[str], number: str) -> DataFrame:
    """A1: (group, highest, missing, repeated): numbers absent between 1 and the highest, and numbers that occur again."""
    n = df.groupBy(*group, F.col(number).cast("int").alias("_n")).agg(F.count(F.lit(1)).alias("_c"))
    g = n.groupBy(*group).agg(F.max("_n").alias("highest"), F.sort_array(F.collect_list("_n")).alias("have"), F.sort_array(F.collect_list(F.when(F.col("_c") > 1, F.col("_n")))).alias("repeated"))
    want = F.when(F.col("highest") >= 1, F.sequence(F.lit(1), F.greatest(F.col("highest"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return g.select(*group, "highest", F.array_except(want, "have").alias("missing"), "repeated")


def review_reasons(nodes: DataFrame) -> DataFrame:
    """A2: reviews by reason."""
    return nodes.filter("status = 'need_review'").groupBy("status_reason").agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """A3: least, median, mean and greatest length."""
    n = F.char_length(text)
    return df.groupBy(*(by or [])).agg(F.min(n).alias("min_len"), F.median(n).alias("median_len"), F.round(F.avg(n), 1).alias("mean_len"), F.max(n).alias("max_len"), F.count_if(n < SHORT_CLAUSE).alias("short"))


def dangling(refs: DataFrame, targets: DataFrame, ref: str, target: str) -> DataFrame:
    """A4: references whose target is missing."""
    return refs.join(targets.select(F.col(target).alias(ref)).distinct(), ref, "left_anti")


def ref_totals(nodes: DataFrame) -> DataFrame:
    """A4: references in all, in scope, out of scope."""
    r = nodes.select(F.explode("refs").alias("r"))
    return r.agg(F.count(F.lit(1)).alias("refs"), F.count_if("r.in_scope").alias("inside"), F.count_if(~F.col("r.in_scope")).alias("outside"))


def coverage(nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A5: tables with number, figures with an image (present, if `files` (path) is given), formulas with variables, nodes without their parent."""
    n = nodes
    image = F.col("body.image_path").isNotNull()
    if files is not None:
        n = n.join(files.select(F.col("path").alias("_f")).distinct(), F.col("body.image_path") == F.col("_f"), "left")
        image = F.col("_f").isNotNull()
    kind = lambda k: F.col("type") == k
    numbered = F.col("num").isNotNull()
    return n.agg(
        F.count_if(kind("table")).alias("tables"), F.count_if(kind("table") & numbered).alias("numbered_tables"), F.count_if(kind("figure")).alias("figures"), F.count_if(kind("figure") & image).alias("figures_with_image"),
        F.count_if(kind("formula")).alias("formulas"), F.count_if(kind("formula") & (F.size(F.coalesce("body.variables", F.array())) > 0)).alias("explained_formulas"), F.count_if((F.col("level") > 1) & F.col("parent_id").isNull()).alias("orphans"))


def reconcile(source: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """(key, side): missing from what was parsed, or extra in it."""
    a, b = source.select(key).distinct(), parsed.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def source_clauses(pages: DataFrame) -> DataFrame:
    """(num, page, quoted): clause numbers at the head of a page's lines; quoted ones look like references."""
    lines = pages.select("page", F.explode(F.split("text", "\n")).alias("line"))
    num = F.regexp_extract("line", r"(?U)^\s*(\d+\.\d+\.\d+)(?!\d)", 1)
    return lines.withColumn("num", num).filter("num <> ''").select("num", "page", F.col("line").rlike(r"(?U)^\s*\d+\.\d+\.\d+\s*[条）)、。；：，]").alias("quoted"))


def score(covered: Column, numbered: Column, linked: Column, structured: Column) -> Column:
    """0 to 100 from four shares."""
    parts = (F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * w for x, w in zip((covered, numbered, linked, structured), WEIGHTS, strict=True))
    total = F.lit(0.0)
    for p in parts:
        total = total + p
    return F.round(total, 1)


def check_cases(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, missing, absent): evidence nodes that do not exist and parts of the answer that no evidence holds. Cases that list
    everything (enum) need no evidence."""
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    e = cases.select("id", "type", F.explode_outer("evidence").alias("node_id")).join(nodes.select("node_id", squeeze(F.col("content")).alias("content")), "node_id", "left")
    e = e.groupBy("id", "type").agg(F.sort_array(F.collect_list(F.when(F.col("node_id").isNotNull() & F.col("content").isNull(), F.col("node_id")))).alias("missing"), F.array_join(F.collect_list("content"), "\n").alias("held"))
    x = cases.select("id", X.answer_tokens("answer_gold").alias("tokens")).join(e, "id")
    absent = F.when(F.col("type") == "enum", F.array().cast("array<string>")).otherwise(F.filter("tokens", lambda t: ~F.contains(F.col("held"), t)))
    return x.select("id", "missing", absent.alias("absent"))


def distribution(cases: DataFrame) -> DataFrame:
    """A10: cases by type, difficulty and whether they can be answered."""
    return cases.groupBy("type", "difficulty", "answerable").agg(F.count(F.lit(1)).alias("n"))
