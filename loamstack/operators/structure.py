"""Ordered operators on lines and nodes (L2 to L9, L12 to L15, P1 to P10, K1 to K6): windows over an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V


def run_id(df: DataFrame, group: list[str], order: list[str], start: Column, name: str = "run") -> DataFrame:
    """Number the runs that `start` begins, in each group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(start, 1).otherwise(0)).over(w))


def islands(df: DataFrame, group: list[str], order: list[str], same: str) -> DataFrame:
    """`island` numbers maximal runs of one value, from 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = df.withColumn("_new", (F.row_number().over(w) == 1) | ~F.col(same).eqNullSafe(F.lag(same).over(w)))
    return run_id(marked, group, order, F.col("_new"), "island").drop("_new")


def merged_text(df: DataFrame, group: list[str], order: list[str], text: str, sep: str = "\n") -> DataFrame:
    """Texts of each group in order; groups are runs of neighbours."""
    s = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return df.groupBy(*group).agg(F.array_join(s["_t"], sep).alias(text), F.count(F.lit(1)).alias("parts"))


def without_page_numbers(lines: DataFrame) -> DataFrame:
    """L2: lines of one to three digits in the last 80 points of a page go. Needs text, top, height."""
    return lines.filter(~(X.strip("text").rlike(r"^\d{1,3}$") & (F.col("top") > F.col("height") - 80)))


def repair_broken_lines(lines: DataFrame) -> DataFrame:
    """L3: a line that ends in an open （图, （表 or （式 goes on in the next, if that starts with a number and ）. Chains join."""
    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    broken = F.lag("text").over(w).rlike(X.UNI + r"[（(][图表式]$") & F.col("text").rlike(r"^[A-Z]?\.?\d+(?:\.\d+)*(?:-\d+)?\s?[）)]")
    x = run_id(lines.withColumn("_new", ~F.coalesce(broken, F.lit(False))), ["doc_id", "page"], ["seq"], F.col("_new"))
    s = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return x.groupBy("doc_id", "page", "run").agg(F.min("seq").alias("seq"), F.array_join(s["text"], "").alias("text"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "top"), (F.max, "bottom")))).drop("run")


def union_boxes(df: DataFrame, group: list[str]) -> DataFrame:
    """L4: the box around all boxes of each group."""
    return df.groupBy(*group).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def inside(a: str, b: str, pad: float = 2.0) -> Column:
    """L4: box a lies in box b, widened by `pad`; both are struct columns."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return (x("x0") >= y("x0") - pad) & (x("x1") <= y("x1") + pad) & (x("top") >= y("top") - pad) & (x("bottom") <= y("bottom") + pad)


def mask_lines(lines: DataFrame, boxes: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Lines outside all boxes of their page, and unlike any title, note or legend there. Needs struct column box on both."""
    b = boxes.select("doc_id", "page", F.col("box").alias("area"))
    out = lines.join(b, [lines["doc_id"] == b["doc_id"], lines["page"] == b["page"], inside("box", "area")], "left_anti")
    return out if titles is None else out.join(titles.select("doc_id", "page", "text"), ["doc_id", "page", "text"], "left_anti")


def real_tables(tables: DataFrame) -> DataFrame:
    """Tables with at least two filled cells and six characters."""
    filled = F.filter(F.flatten("rows"), lambda v: X.strip(F.coalesce(v, F.lit(""))) != "")
    chars = F.aggregate(filled, F.lit(0), lambda a, v: a + F.char_length(X.strip(v)))
    return tables.filter((F.size(filled) >= 2) & (chars >= 6))


def nearest_title(tables: DataFrame, titles: DataFrame, above: float = 50, below: float = 10) -> DataFrame:
    """Each table's title: of the title lines of its page from `above` over to `below` under its top, the lowest."""
    t = titles.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("top").alias("_top"), F.col("text").alias("title"), F.col("seq").alias("title_seq"))
    x = tables.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & F.col("_top").between(F.col("top") - above, F.col("top") + below), "left")
    w = Window.partitionBy("doc_id", "page", "table_no").orderBy(F.desc_nulls_last("_top"), F.desc("title_seq"))
    return x.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_d", "_p", "_top", "_i")


def table_notes(tables: DataFrame, lines: DataFrame, reach: float = 130) -> DataFrame:
    """(doc_id, page, table_no, notes): lines from 注： up to the next heading, within `reach` under the table."""
    t = tables.select("doc_id", "page", "table_no", F.col("bottom").alias("_b"))
    near = lines.join(t, ["doc_id", "page"]).filter((F.col("top") > F.col("_b")) & (F.col("top") <= F.col("_b") + reach))
    w = Window.partitionBy("doc_id", "page", "table_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("text").rlike(r"^注[：:]")
    begun = F.max(opens).over(w)
    stop = ~opens & ( F.col("text").rlike(X.UNI + V.CLAUSE) | F.col("text").rlike(X.UNI + V.SECTION) | F.col("text").rlike(X.UNI + V.TABLE_TITLE) | F.col("text").rlike(X.UNI + V.FIGURE_TITLE))
    x = near.withColumn("_on", begun).withColumn("_stop", F.max(stop & begun).over(w)).filter("_on AND NOT _stop")
    return x.groupBy("doc_id", "page", "table_no").agg(F.sort_array(F.collect_list(F.struct("seq", "text")))["text"].alias("notes"))


def merge_across_pages(tables: DataFrame) -> DataFrame:
    """A table that ends a page below 720 goes on in the first of the next page, if that starts above 120, has no title and the same sides (±6)."""
    page = Window.partitionBy("doc_id", "page").orderBy("top")
    t = tables.withColumn("_first", F.row_number().over(page) == 1).withColumn("_last", F.lead("top").over(page).isNull())
    w = Window.partitionBy("doc_id").orderBy("page", "top")
    prev = lambda c: F.lag(c).over(w)
    goes_on = F.col("_first") & prev("_last") & (prev("page") == F.col("page") - 1) & (prev("bottom") > 720) & (F.col("top") < 120) & F.col("title").isNull() & (F.abs(prev("x0") - F.col("x0")) <= 6) & (F.abs(prev("x1") - F.col("x1")) <= 6)
    x = run_id(t.withColumn("_new", ~F.coalesce(goes_on, F.lit(False))), ["doc_id"], ["page", "top"], F.col("_new"))
    parts = F.sort_array(F.collect_list(F.struct("page", "top", "table_no", "title", "rows")))
    return x.groupBy("doc_id", "run").agg(parts.alias("s")).select(
        "doc_id", F.col("s")[0]["table_no"].alias("table_no"), F.col("s")[0]["title"].alias("title"), F.flatten(F.col("s.rows")).alias("rows"), F.col("s.page").alias("pages"), F.when(F.size("s") > 1, F.size(F.col("s")[0]["rows"])).alias("first_part_rows"))


def formula_regions(lines: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, seq, last, text, num, box) of each formula in a group's lines (a page, or a segment). Lines that end in an equation
    number, and narrow ones without ideographs, belong to formulas, titles and legends never do; each number ends a region, and what
    stands after the last number of its run joins the region before."""
    group = group or ["doc_id", "page"]
    ends = F.col("text").rlike(X.UNI + V.EQUATION_END)
    bare = ~F.col("text").rlike("[一-鿿]") & (F.col("x1") - F.col("x0") < 300)
    other = F.col("text").rlike(X.UNI + V.TABLE_TITLE) | F.col("text").rlike(X.UNI + V.FIGURE_TITLE) | F.col("text").rlike(X.UNI + V.LEGEND)
    x = islands(lines.withColumn("_f", (bare | ends) & ~other), group, ["seq"], "_f").filter("_f").withColumn("_e", ends.cast("int"))
    done = F.coalesce(F.sum("_e").over(Window.partitionBy(*group).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum("_e").over(Window.partitionBy(*group, "island").orderBy("seq").rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("_k", F.when(ahead > 0, done).otherwise(done - 1)).filter("_k >= 0")
    s = F.sort_array(F.collect_list(F.struct("seq", "text")))
    numbered = F.max(F.when(F.col("_e") == 1, F.col("text")))
    box = F.struct(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")) if {"top", "bottom"} <= set(lines.columns) else F.lit(None)
    return x.groupBy(*group, "_k").agg(F.min("seq").alias("seq"), F.max("seq").alias("last"), F.array_join(s["text"], "\n").alias("text"), X.first_group(numbered, V.EQUATION).alias("num"), box.alias("box")).drop("_k")


def explanation_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page): from the first page of fewer than 800 characters with a short line that holds 条文说明."""
    p = lines.groupBy("doc_id", "page").agg(F.sum(F.char_length("text")).alias("n"), F.bool_or((F.char_length(X.strip("text")) <= 12) & F.regexp_replace("text", r"(?U)\s+", "").contains("条文说明")).alias("hit"))
    first = p.filter("hit AND n < 800").groupBy("doc_id").agg(F.min("page").alias("_start"))
    return p.join(first, "doc_id").filter(F.col("page") >= F.col("_start")).select("doc_id", "page")


def body_size(chars: DataFrame) -> DataFrame:
    """The median size of a page's characters."""
    return chars.groupBy("doc_id", "page").agg(F.coalesce(F.median("size"), F.lit(10.0)).alias("body_size"))


def segments(lines: DataFrame) -> DataFrame:
    """(doc_id, page, segment, kind, num, text): a heading or clause line starts a segment, contents lines go, masked lines end it."""
    kind = X.line_class("text")
    x = lines.withColumn("kind", kind).filter("kind <> 'toc'")
    starts = F.col("kind").isin("clause", "appendix_clause", "appendix") | X.heading_kind("text", "x0").isNotNull() | F.col("masked")
    x = run_id(x.withColumn("_s", starts), ["doc_id", "page"], ["seq"], F.col("_s"), "segment").filter("NOT masked")
    s = F.sort_array(F.collect_list(F.struct("seq", "kind", "text")))
    return x.groupBy("doc_id", "page", "segment").agg(s.alias("s"), F.min("top").alias("top")).select("doc_id", "page", "segment", "top", F.col("s")[0]["kind"].alias("kind"), X.clause_number(F.col("s")[0]["text"]).alias("num"), F.array_join("s.text", "\n").alias("text"))


def elements(*parts: DataFrame) -> DataFrame:
    """Segments, tables and figures (doc_id, page, top, what, ...) as one list with `seq`, ties in the order given."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_o", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "top", "_o")).cast("long")).drop("_o")


def merge_continuations(segs: DataFrame) -> DataFrame:
    """A segment without a number, or with the number of the clause before it, joins that clause. Needs doc_id, seq, page, num, text."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    before = F.last("num", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("num").isNotNull() & ~F.col("num").eqNullSafe(before)
    x = run_id(segs.withColumn("_same", F.col("num").isNotNull() & F.col("num").eqNullSafe(before)).withColumn("_new", fresh), ["doc_id"], ["seq"], F.col("_new"), "clause_no")
    s = F.sort_array(F.collect_list(F.struct("seq", "text")))
    reason = F.when(F.bool_or("_same"), "split_by_table").when(F.count_distinct("page") > 1, "cross_page_clause")
    return x.groupBy("doc_id", "clause_no").agg(F.first("num", ignorenulls=True).alias("num"), F.min("seq").alias("seq"), F.array_join(s["text"], "\n").alias("text"), F.sort_array(F.collect_set("page")).alias("pages"), reason.alias("status_reason")).withColumn("status", F.when(F.col("status_reason").isNull(), "ok").otherwise("need_review"))


ITEM_LINE = "struct<text:string,page:int,box:struct<x0:double,top:double,x1:double,bottom:double>,head:boolean>"


def item_lists(lines: Column) -> Column:
    """(n, lines) of a clause's numbered items, from its lines after the first, in order (text, page, box, head; `head` says that
    a line is of the segment that opens the clause). Numbers follow on from 1, a clause's number is no item; only the opening segment
    begins a list, and other lines join the item before."""
    empty = F.array().cast(f"array<struct<n:int,lines:array<{ITEM_LINE}>>>")

    def step(acc: Column, line: Column) -> Column:
        text = X.strip(line["text"])
        num = F.regexp_extract(text, X.UNI + V.ITEM, 1).try_cast("int")
        clause = text.rlike(X.UNI + V.CLAUSE) | text.rlike(X.UNI + V.APPENDIX_CLAUSE)
        opens = (num == F.size(acc) + 1) & ~clause & (line["head"] | (F.size(acc) > 0))
        last = F.element_at(acc, -1)
        new = F.concat(acc, F.array(F.struct(num.alias("n"), F.array(line).alias("lines"))))
        more = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["n"].alias("n"), F.concat(last["lines"], F.array(line)).alias("lines"))))
        return F.when(F.coalesce(opens, F.lit(False)), new).when(F.size(acc) > 0, more).otherwise(acc)

    return F.aggregate(lines, empty, step)


def announces_list(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).rlike("下列|应包括")


def items(x: Column | str) -> Column:
    """(n, text) of the items of a clause that stands in one segment."""
    t = F.col(x) if isinstance(x, str) else x
    no_box = F.lit(None).cast("struct<x0:double,top:double,x1:double,bottom:double>")
    line = lambda v: F.struct(v.alias("text"), F.lit(None).cast("int").alias("page"), no_box.alias("box"), F.lit(True).alias("head"))
    all_lines = F.split(t, "\n")
    rest = F.transform(F.slice(all_lines, F.lit(2), F.greatest(F.size(all_lines) - 1, F.lit(0))), line)
    found = F.transform(item_lists(rest), lambda i: F.struct(i["n"].alias("n"), F.array_join(F.transform(i["lines"], lambda v: X.normalise(v["text"])), "\n").alias("text")))
    return F.when(announces_list(t), found).otherwise(F.array().cast("array<struct<n:int,text:string>>"))


def formula_variables(formulas: DataFrame, clauses: DataFrame) -> DataFrame:
    """(node_id, variables): a clause's only 式中 block goes to all of its formulas, as many blocks as formulas go one to one, else they keep their own."""
    f = formulas.withColumn("_i", F.row_number().over(Window.partitionBy("parent_id").orderBy("seq"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("parent_id")))
    b = clauses.select(F.col("node_id").alias("_p"), X.where_blocks("content").alias("_b"))
    pick = F.when(F.size("_b") == 1, F.get("_b", F.lit(0))).when(F.size("_b") == F.col("_n"), F.get("_b", F.col("_i") - 1)).otherwise(F.col("variables"))
    return f.join(b, F.col("parent_id") == F.col("_p"), "left").select("node_id", pick.alias("variables"))


def context_columns(els: DataFrame) -> DataFrame:
    """Chapter, section and clause in force at each element; a section ends with its chapter."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    x = els.withColumn("_ch", last(F.when(F.col("kind").isin("chapter", "appendix"), F.struct("seq", "text")))).withColumn("_se", last(F.when(F.col("kind") == "section", F.struct("seq", "text")))).withColumn("_cl", last(F.when(F.col("kind").isin("clause", "appendix_clause"), F.struct("seq", "num"))))
    newer = F.col("_ch").isNull() | (F.col("_se.seq") > F.col("_ch.seq"))
    return x.withColumn("chapter", F.col("_ch.text")).withColumn("section", F.when(newer, F.col("_se.text"))).withColumn("clause", F.col("_cl.num")).drop("_ch", "_se", "_cl")


def build_nodes(els: DataFrame, standard_id: str, code: str, name: str, version: str) -> DataFrame:
    """P10: nodes of all types from elements with kind, num, text, chapter, section, pages and bboxes; `body` keeps its struct."""
    kind = F.when(F.col("kind") == "appendix_clause", "clause").otherwise(F.col("kind"))
    level = F.create_map(*(F.lit(v) for kv in V.LEVELS.items() for v in kv))[F.col("type")]
    num = F.nullif(F.col("num"), F.lit(""))
    return els.withColumn("type", kind).select(
        X.node_id(F.lit(standard_id), "type", num, F.concat(F.lit("seq"), F.lpad(F.col("seq").cast("string"), 4, "0"))).alias("node_id"), F.lit(standard_id).alias("standard_id"), F.lit(code).alias("standard_code"), F.lit(name).alias("standard_name"),
        "doc_id", F.lit(version).alias("version"), "type", level.alias("level"), num.alias("num"), "chapter", "section", F.nullif(F.concat_ws(" / ", "chapter", "section"), F.lit("")).alias("path"), "pages", "bboxes", F.col("text").alias("content"), "body",
        X.references("text", F.lit(standard_id)).alias("refs"), X.modality("text").alias("modality"), X.structural_keywords("num", F.coalesce("section", F.lit(""))).alias("keywords"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("status_reason"), "seq",
    ).withColumn("keywords_source", F.when(F.size("keywords") > 0, "structural"))


def parents(nodes: DataFrame, part: str = "doc_id", order: str = "seq", holds: list[str] | None = None, floats: list[str] | None = None) -> DataFrame:
    """K1: parent_id by level: the nearest open ancestor of a smaller level. Every node closes levels from its own on, only
    `holds` types stay open; `floats` types hang on the last clause and close nothing."""
    holds, floats = holds or ["chapter", "section", "clause", "appendix"], floats or ["table", "figure", "formula"]
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    top = max(V.LEVELS.values())
    x = nodes
    for k in range(1, top):
        seen = F.when((F.col("level") <= k) & ~F.col("type").isin(floats), F.struct("node_id", "level", "type"))
        x = x.withColumn(f"_m{k}", F.last(seen, ignorenulls=True).over(w))
    x = x.withColumn("_clause", F.last(F.when(F.col("type") == "clause", F.col("node_id")), ignorenulls=True).over(w))
    held = [F.when((F.col("level") > k) & (F.col(f"_m{k}.level") == k) & F.col(f"_m{k}.type").isin(holds), F.col(f"_m{k}.node_id")) for k in range(top - 1, 0, -1)]
    return x.withColumn("parent_id", F.when(F.col("type").isin(floats), F.col("_clause")).otherwise(F.coalesce(*held))).drop("_clause", *(f"_m{k}" for k in range(1, top)))


def children(nodes: DataFrame) -> DataFrame:
    """K2: (node_id, child_ids) in order, each once."""
    c = nodes.filter("parent_id IS NOT NULL").groupBy("parent_id", "node_id").agg(F.min("seq").alias("seq"))
    return c.groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("seq", "node_id")))["node_id"].alias("child_ids")).withColumnRenamed("parent_id", "node_id")


def resolve_refs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K3: ((node_id, refs with in_scope), (node_id, referenced_by))."""
    r = nodes.select("node_id", F.posexplode("refs").alias("i", "ref"))
    known = nodes.select(F.col("node_id").alias("_t")).distinct()
    r = r.join(known, F.col("ref.target_node_id") == F.col("_t"), "left").withColumn("ref", F.col("ref").withField("in_scope", F.col("_t").isNotNull()))
    out = r.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("i", "ref")))["ref"].alias("refs"))
    back = r.filter("_t IS NOT NULL").groupBy("_t").agg(F.sort_array(F.collect_set("node_id")).alias("referenced_by")).withColumnRenamed("_t", "node_id")
    return out, back


def link_explanations(nodes: DataFrame) -> DataFrame:
    """K4: (explanation_id, clause_id) by number, ranges written out; of clauses with one number the last counts."""
    last = Window.partitionBy("standard_id", "num").orderBy(F.desc("seq"))
    clauses = nodes.filter("type = 'clause'").withColumn("_i", F.row_number().over(last)).filter("_i = 1").select("standard_id", F.col("num").alias("target"), F.col("node_id").alias("clause_id"))
    named = X.explanation_targets("content")
    targets = F.when(F.size(named) > 0, named).otherwise(F.array_compact(F.array("num")))
    e = nodes.filter("type = 'explanation'").select("standard_id", F.col("node_id").alias("explanation_id"), F.explode(targets).alias("target"))
    return e.join(clauses, ["standard_id", "target"]).select("explanation_id", "clause_id").distinct()


def problems() -> Column:
    """K5, K6: what is wrong with a node, as a list of messages."""
    c = F.col
    text = X.strip(F.coalesce("content", F.lit("")))
    level = F.create_map(*(F.lit(v) for kv in V.LEVELS.items() for v in kv))[c("type")]
    box = F.exists("bboxes", lambda b: b.isNull() | b["x0"].isNull() | b["top"].isNull() | b["x1"].isNull() | b["bottom"].isNull())
    rules = [
        (~c("type").isin(list(V.LEVELS)), "type"), (~level.eqNullSafe(c("level")), "level"), (c("num").isNotNull() & (c("node_id") != X.node_id("standard_id", "type", "num")), "node_id"), (text == "", "content empty"),
        ((text != "") & (c("type") == "clause") & (F.char_length("content") < 12), "clause short"), ((text != "") & (c("type") == "item") & (F.char_length("content") < 6), "item short"), (F.size("pages") == 0, "pages empty"),
        (F.size("pages") != F.size("bboxes"), "pages and bboxes"), (F.coalesce(box, F.lit(False)), "bbox"), (F.exists("refs", lambda r: r["target_type"].isNull() | r["target_num"].isNull()), "ref"),
        (c("modality").isNotNull() & ~c("modality").isin(V.MODALITIES), "modality"), (~c("status").isin(V.STATUSES), "status"), ((c("status") == "need_review") & c("status_reason").isNull(), "no reason"),
        ((c("status") == "ok") & c("status_reason").isNotNull(), "reason without review"), ((F.size("keywords") > 0) & c("keywords_source").isNull(), "no source"), ((F.size("keywords") == 0) & c("keywords_source").isNotNull(), "source without keywords"),
        (c("child_ids").isNull(), "child_ids"), (c("referenced_by").isNull() | c("explains").isNull() | c("explained_by").isNull(), "links"),
    ]
    return F.array_compact(F.array(*(F.when(rule, F.lit(msg)) for rule, msg in rules)))


def summary(nodes: DataFrame) -> DataFrame:
    """K7: (what, name, n): nodes by type, reviews by reason, references all and in scope."""
    refs = nodes.select(F.explode("refs").alias("r"))
    return (
        nodes.groupBy(F.lit("type").alias("what"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        .unionByName(nodes.filter("status = 'need_review'").groupBy(F.lit("review").alias("what"), F.col("status_reason").alias("name")).agg(F.count(F.lit(1)).alias("n")))
        .unionByName(refs.agg(F.lit("refs").alias("what"), F.lit("all").alias("name"), F.count(F.lit(1)).alias("n"))).unionByName(refs.agg(F.lit("refs").alias("what"), F.lit("in_scope").alias("name"), F.count_if("r.in_scope").alias("n")))
    )
