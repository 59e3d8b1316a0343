"""Order-dependent layout operators (L1, L5, L10, L11): one small group, a page or a cell, at a time in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V

LINE = "doc_id string, page int, seq int, text string, x0 double, x1 double, top double, bottom double"


def page_lines(chars: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """L1: lines of each page: characters by vertical centre, then x0; a new line begins where a centre is further than
    `tolerance` from the running mean of the line's centres. Glyphs are repaired, empty lines go; lines are numbered by (top, x0)."""
    chars = chars.withColumn("text", X.fix_glyphs("text"))

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(mid=(pdf["top"] + pdf["bottom"]) / 2).sort_values(["mid", "x0"], kind="stable")
        label, mean, count, labels = -1, 0.0, 0, []
        for mid in pdf["mid"]:
            if count and abs(mid - mean) <= tolerance:
                count += 1
                mean += (mid - mean) / count
            else:
                label, mean, count = label + 1, mid, 1
            labels.append(label)
        rows = []
        for _, g in pdf.assign(line=labels).sort_values(["line", "x0"], kind="stable").groupby("line"):
            text = "".join(g["text"].fillna("")).strip()
            if text:
                rows.append((text, g["x0"].min(), g["x1"].max(), g["top"].min(), g["bottom"].max()))
        out = pd.DataFrame(rows, columns=["text", "x0", "x1", "top", "bottom"]).sort_values(["top", "x0"], kind="stable")
        return out.assign(doc_id=pdf["doc_id"].iloc[0], page=pdf["page"].iloc[0], seq=range(len(out)))[["doc_id", "page", "seq", "text", "x0", "x1", "top", "bottom"]]

    return chars.groupBy("doc_id", "page").applyInPandas(lines, LINE)


def cell_text(chars: DataFrame, cells: DataFrame, pad: float = 0.6, row_gap: float = 5.0, space: float = 9.0) -> DataFrame:
    """(doc_id, page, table_no, r, c, v): characters whose box lies in the cell (±pad), glyphs repaired, each in the first row whose
    first centre is within `row_gap`; a gap beyond `space` is a blank, rows are joined by ` / `."""
    b = cells.select("doc_id", "page", "table_no", "r", "c", F.col("x0").alias("cx0"), F.col("x1").alias("cx1"), F.col("top").alias("ct"), F.col("bottom").alias("cb"))
    within = (F.col("x0") >= F.col("cx0") - pad) & (F.col("x1") <= F.col("cx1") + pad) & (F.col("top") >= F.col("ct") - pad) & (F.col("bottom") <= F.col("cb") + pad)
    held = b.join(chars, ["doc_id", "page"]).filter(within).withColumn("text", X.fix_glyphs("text"))

    def text(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(mid=(pdf["top"] + pdf["bottom"]) / 2).sort_values(["mid", "x0"], kind="stable")
        rows: list[tuple[float, list]] = []
        for ch in pdf.itertuples():
            row = next((r for centre, r in rows if abs(ch.mid - centre) <= row_gap), None)
            if row is None:
                row = []
                rows.append((ch.mid, row))
            row.append((ch.x0, ch.x1, ch.text))
        out = []
        for _, row in rows:
            parts, end = [], None
            for x0, x1, t in sorted(row):
                parts += [" "] if end is not None and x0 - end > space else []
                parts.append(t)
                end = x1
            out.append(re.sub(r"\s{2,}", " ", "".join(parts)).strip())
        return pdf.iloc[:1][["doc_id", "page", "table_no", "r", "c"]].assign(v=" / ".join(x for x in out if x))

    filled = held.groupBy("doc_id", "page", "table_no", "r", "c").applyInPandas(text, "doc_id string, page int, table_no int, r int, c int, v string")
    key = ["doc_id", "page", "table_no", "r", "c"]
    return cells.select(*key).join(filled, key, "left").withColumn("v", F.coalesce("v", F.lit("")))


def graphic_clusters(graphics: DataFrame, pages: DataFrame, gap: float = 14.0, least: float = 60.0) -> DataFrame:
    """Boxes around graphics that are nearer than `gap`. Graphics without extent and those of over 80 % of the page are left out; by
    x0, each joins the first cluster that it is near to, or starts one. Clusters of `least` a side or less go."""
    g = graphics.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    wide, high = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    g = g.filter((wide > 0) & (high > 0) & (wide * high <= 0.8 * F.col("width") * F.col("height")))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[list[float]] = []
        for x0, top, x1, bottom in pdf.sort_values(["x0", "top", "x1", "bottom"], kind="stable")[["x0", "top", "x1", "bottom"]].to_numpy():
            home = next((c for c in found if x0 - gap <= c[2] and x1 + gap >= c[0] and top - gap <= c[3] and bottom + gap >= c[1]), None)
            if home is None:
                found.append([x0, top, x1, bottom])
            else:
                home[:] = min(home[0], x0), min(home[1], top), max(home[2], x1), max(home[3], bottom)
        out = pd.DataFrame([c for c in found if c[2] - c[0] > least and c[3] - c[1] > least], columns=["x0", "top", "x1", "bottom"], dtype=float).round(2)
        return out.assign(doc_id=pdf["doc_id"].iloc[0], page=pdf["page"].iloc[0], cluster=range(len(out)))[["doc_id", "page", "cluster", "x0", "top", "x1", "bottom"]]

    return g.groupBy("doc_id", "page").applyInPandas(cluster, "doc_id string, page int, cluster int, x0 double, top double, x1 double, bottom double")


def group_figures(clusters: DataFrame, lines: DataFrame, tables: DataFrame | None = None, reach: float = 140.0, legend: float = 30.0) -> DataFrame:
    """(doc_id, page, num, title, x0, top, x1, bottom, art_top, part_count, sub_labels, legend): each cluster that is no table's
    box goes to the first caption at most `reach` under it. The box covers all parts, the caption and the legend's lines, which stand
    within `legend` under the caption; art_top is the top of the parts."""
    caps = lines.filter(F.col("text").rlike(X.UNI + V.FIGURE_TITLE)).select("doc_id", "page", F.col("seq").alias("cap"), *(F.col(c).alias(f"cap_{c}") for c in ("x0", "top", "x1", "bottom")), F.regexp_replace(F.regexp_extract("text", X.UNI + V.FIGURE_TITLE, 1), r"(?U)\s+", "").alias("num"),
        F.concat(F.lit("图"), F.regexp_extract("text", X.UNI + V.FIGURE_TITLE, 1), F.lit(" "), X.strip(F.regexp_extract("text", X.UNI + V.FIGURE_TITLE, 2))).alias("title"))
    free = clusters
    if tables is not None:
        t = tables.select("doc_id", "page", F.col("x0").alias("_tx"), F.col("top").alias("_ty"))
        free = clusters.join(t, [clusters["doc_id"] == t["doc_id"], clusters["page"] == t["page"], F.abs(clusters["x0"] - t["_tx"]) < 3, F.abs(clusters["top"] - t["_ty"]) < 3], "left_anti")
    near = free.join(caps, ["doc_id", "page"]).filter((F.col("bottom") <= F.col("cap_top") + 3) & (F.col("cap_top") - F.col("bottom") <= reach))
    first = near.groupBy("doc_id", "page", "cluster", "x0", "top", "x1", "bottom").agg(F.min(F.struct("cap_top", "cap", "cap_x0", "cap_x1", "cap_bottom", "num", "title")).alias("k"))
    box = first.groupBy("doc_id", "page", *(F.col(f"k.{c}").alias(c) for c in ("cap", "cap_top", "cap_x0", "cap_x1", "cap_bottom", "num", "title"))).agg(F.min("x0").alias("x0"), F.min("top").alias("art_top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    l = lines.select("doc_id", "page", F.col("seq").alias("_s"), F.col("text").alias("_t"), F.struct("x0", "top", "x1", "bottom").alias("_b"))
    x = box.join(l, ["doc_id", "page"], "left")
    under = (F.col("_b.top") > F.col("cap_top")) & (F.col("_b.top") < F.col("cap_top") + legend) & F.col("_t").rlike(X.UNI + V.LEGEND)
    sub = F.col("_t").rlike(r"(?U)[（(]?\s*[ab]\s*[）)]") & (F.col("_b.top") > F.col("art_top") - 40) & (F.col("_b.top") < F.col("cap_top"))
    listed = lambda cond, text: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("_s", "_t")))), lambda v: text(v["_t"]))
    edge = lambda f, c: f(F.when(under, F.col(f"_b.{c}")))
    got = x.groupBy("doc_id", "page", "cap", "num", "title", "art_top", "cap_x0", "cap_x1", "cap_bottom", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("bottom").alias("_y1")).agg(
        listed(under, X.normalise_dashes).alias("legend"), listed(sub, lambda v: v).alias("sub_labels"), edge(F.min, "x0").alias("_lx0"), edge(F.max, "x1").alias("_lx1"), edge(F.max, "bottom").alias("_ly1"))
    return got.select("doc_id", "page", "num", "title", F.least("_x0", "cap_x0", "_lx0").alias("x0"), F.col("art_top").alias("top"), F.greatest("_x1", "cap_x1", "_lx1").alias("x1"), F.greatest("_y1", "cap_bottom", "_ly1").alias("bottom"),
        "art_top", F.greatest(F.size("sub_labels"), F.lit(1)).alias("part_count"), "sub_labels", "legend")


def highlight_band(boxes: DataFrame, margin: float = 90.0) -> DataFrame:
    """The part of a page to show around highlighted boxes."""
    return boxes.groupBy("doc_id", "page").agg(F.greatest(F.min("top") - margin, F.lit(0.0)).alias("from_top"), (F.max("bottom") + margin).alias("to_bottom"))
