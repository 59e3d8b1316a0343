"""Assessment of parsed nodes (A1 to A8, S7): a few aggregates over any number of nodes, and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import quality, structure
from ..sources.io import ascii_table

#: Entries of each list in a report; the counts beside them are of all.
SHOWN = 10


def _first(df: DataFrame, *order: str) -> list[tuple]:
    return [tuple(r) for r in df.orderBy(*order).limit(SHOWN).collect()]


def assess(nodes: DataFrame, pages: DataFrame | None = None, files: DataFrame | None = None) -> dict:
    """Counts and first examples of each check; `pages` (page, text) of the source are compared with the clauses, `files` (path) with
    the figures' images. The score takes the share of the source's clauses that were found (valid nodes, without a source), of sections without gaps, of
    references in scope and of valid nodes."""
    clauses = nodes.filter("type = 'clause'")
    cut = r"^(.*)\.(\d+)$"
    numbered = clauses.select("standard_id", F.regexp_extract("num", cut, 1).alias("section_no"), F.regexp_extract("num", cut, 2).try_cast("int").alias("no")).filter("section_no <> '' AND no IS NOT NULL")
    gaps = quality.numbering(numbered, ["standard_id", "section_no"], "no").withColumn("bad", (F.size("missing") > 0) | (F.size("repeated") > 0))
    wrong = nodes.select("node_id", F.array_join(structure.problems(), "；").alias("problems")).filter("problems <> ''")
    refs = quality.ref_totals(nodes).first()
    lost = nodes.select("node_id", F.explode("refs").alias("r")).filter(F.col("r.target_type").isin(V.REFERENCE_KINDS[:-1]) & ~F.coalesce("r.in_scope", F.lit(False))).select("node_id", "r.target_display")
    out = {
        "standards": sorted(r[0] for r in nodes.select("standard_id").distinct().collect()),  # as many as there are books
        "types": {r["type"]: r["n"] for r in nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()},
        "invalid": wrong.count(), "invalid_first": _first(wrong, "node_id"),
        "reviews": {r["status_reason"]: r["n"] for r in quality.review_reasons(nodes).collect()},
        "sections": gaps.count(), "gaps": gaps.filter("bad").count(), "gaps_first": _first(gaps.filter("bad").select("standard_id", "section_no", "missing", "repeated"), "standard_id", "section_no"),
        "lengths": quality.length_stats(clauses, "content").first().asDict(), "refs": refs.asDict(), "dangling": lost.count(), "dangling_first": _first(lost, "node_id", "target_display"), "coverage": quality.coverage(nodes, files).first().asDict(),
    }
    out["nodes"] = sum(out["types"].values())
    valid = 1 - out["invalid"] / max(1, out["nodes"])
    found = valid
    if pages is not None:
        source = quality.source_clauses(pages).filter("NOT quoted")
        sides = quality.reconcile(source.select("num"), clauses.filter(F.col("num").rlike(r"^\d")).select("num"), "num")
        by = {r["side"]: r["n"] for r in sides.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
        out["source"] = {"clauses": source.select("num").distinct().count(), "missing": by.get("missing", 0), "extra": by.get("extra", 0)}
        out["missing_first"] = _first(sides.filter("side = 'missing'").select("num"), "num")
        found = 1 - out["source"]["missing"] / max(1, out["source"]["clauses"])
    shares = (found, 1 - out["gaps"] / max(1, out["sections"]), (refs["inside"] or 0) / max(1, refs["refs"]) if refs["refs"] else 1.0, valid)
    out["score"] = nodes.sparkSession.range(1).select(quality.score(*(F.lit(float(x)) for x in shares))).first()[0]
    return out


def render(r: dict, title: str) -> str:
    """The assessment as Markdown."""
    rows = [["项", "数"], ["节点", r["nodes"]], *([f"　{k}", n] for k, n in sorted(r["types"].items())), ["结构不通过", r["invalid"]], ["待复核", sum(r["reviews"].values())], *([f"　{k}", n] for k, n in sorted(r["reviews"].items())), ["节", r["sections"]], ["跳号或重号的节", r["gaps"]], ["引用", r["refs"]["refs"]], ["　范围内", r["refs"]["inside"]], ["　悬空", r["dangling"]], *([k, n] for k, n in r["coverage"].items()), *([f"原文 {k}", n] for k, n in r.get("source", {}).items())]
    lists = [("结构", r["invalid_first"]), ("条号", r["gaps_first"]), ("悬空引用", r["dangling_first"]), ("原文有而未见", r.get("missing_first", []))]
    told = "\n".join(f"- {name}：" + "；".join(" ".join(map(str, x)) for x in found) for name, found in lists if found)
    return f"# {title}\n\n{'、'.join(r['standards'])}，综合分 {r['score']} / 100\n\n```\n{ascii_table([[str(c) for c in row] for row in rows])}\n```\n\n{told}\n"
