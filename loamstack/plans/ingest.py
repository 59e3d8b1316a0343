"""From characters to linked nodes (L, P, K as one plan): lines, tables and figures of pages become the typed nodes of a standard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import layout, structure, tables
from ..sources.io import BODY_TYPE, NODE_TYPES, REFS_TYPE, stored

BOX = "struct<x0:double,top:double,x1:double,bottom:double>"
KEY = ["doc_id", "page", "table_no"]


@dataclass(frozen=True)
class Standard:
    """What is known of a standard beforehand; `offset` is added to a file's pages."""

    id: str
    code: str
    name: str
    version: str
    offset: int = 0


def _box(*prefix: str) -> Column:
    return F.struct(*(F.col(f"{prefix[0] if prefix else ''}{c}").cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")))


def _around(boxes: Column) -> Column:
    """The box around an array of boxes."""
    side = lambda f, c: f(F.transform(boxes, lambda b: b[c])).alias(c)
    return F.struct(side(F.array_min, "x0"), side(F.array_min, "top"), side(F.array_max, "x1"), side(F.array_max, "bottom"))


def read_tables(chars: DataFrame, cells: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, x0, top, x1, bottom, rows, num, title, notes, note_texts, units, header_rows, fill_down, blocked,
    cross_page, gone) of all real tables; `gone` ones went on in the next page's first table and are part of it."""
    grid = layout.cell_text(chars, cells)
    rows = grid.groupBy(*KEY, "r").agg(F.sort_array(F.collect_list(F.struct("c", "v")))["v"].alias("row"))
    rows = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("r", "row")))["row"].alias("rows"))
    t = rows.join(structure.union_boxes(cells, KEY), KEY)
    t = structure.real_tables(t)
    titles = lines.filter(F.col("text").rlike(X.UNI + V.TABLE_TITLE) | F.col("text").rlike(X.UNI + V.BARE_TABLE_TITLE))
    boxes = lines.select("doc_id", "page", F.col("seq").alias("title_seq"), _box().alias("_tb"))
    t = structure.nearest_title(t, titles).withColumnRenamed("title", "line").join(boxes, ["doc_id", "page", "title_seq"], "left")
    part = lambda g: F.coalesce(X.first_group("line", V.TABLE_TITLE, g), X.first_group("line", V.BARE_TABLE_TITLE, g))
    num = F.regexp_replace(part(1), r"(?U)\s+", "")
    t = t.withColumn("num", num).withColumn("title", F.when(num.isNotNull(), X.strip(F.concat(F.lit("表"), num, F.lit(" "), X.strip(part(2))))).otherwise(F.lit("")))
    notes = structure.table_notes(t, lines)
    named = notes.select(*KEY, F.explode("notes").alias("text")).join(lines.select("doc_id", "page", "text", _box().alias("_nb")), ["doc_id", "page", "text"]).groupBy(*KEY).agg(F.collect_list("_nb").alias("_nbs"))
    t = t.join(notes, KEY, "left").join(named, KEY, "left")
    no_box = F.array().cast(f"array<{BOX}>")
    blocked = _around(F.concat(F.array(_box()), F.coalesce(F.array_compact(F.array("_tb")), no_box), F.coalesce("_nbs", no_box)))
    head = tables.header_rows("rows")
    t = t.withColumn("blocked", blocked).withColumn("header_rows", head).withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
    t = t.withColumn("units", X.guess_units(F.coalesce("line", F.lit("")), F.array_join(F.get("rows", F.lit(0)), "\n")))
    t = stored(t.select(*KEY, "x0", "top", "x1", "bottom", "rows", "num", "title", "notes", "units", "header_rows", "blocked"))
    long = tables.cells(t.withColumn("_k", F.struct(*KEY)), "_k").join(t.select(F.struct(*KEY).alias("_k"), "header_rows"), "_k")
    filled = tables.fill_down(long, "_k", F.col("header_rows"))
    back = filled.groupBy("_k", "r").agg(F.sort_array(F.collect_list(F.struct("c", "v")))["v"].alias("row")).groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("r", "row")))["row"].alias("_rows"))
    t = t.join(back.select("_k.*", "_rows"), KEY).withColumn("fill_down", F.col("rows") != F.col("_rows")).withColumn("rows", F.col("_rows")).drop("_rows")
    return continued(t)


def continued(t: DataFrame) -> DataFrame:
    """The last table of a page that reaches its foot, and the next page's first, if that begins at the head, has the same sides
    and no title, are one: up to three filled rows are its header, more are the body's first half."""
    page = Window.partitionBy("doc_id", "page").orderBy("top", "table_no")
    w = Window.partitionBy("doc_id").orderBy("page", "top", "table_no")
    t = t.withColumn("_first", F.row_number().over(page) == 1).withColumn("_last", F.lead("top").over(page).isNull())
    before = lambda c: F.lag(c).over(w)
    goes_on = F.col("_first") & before("_last") & (before("page") == F.col("page") - 1) & (before("bottom") > 720) & (F.col("top") < 120) & (F.col("title") == "") & (F.abs(before("x0") - F.col("x0")) < 6) & (F.abs(before("x1") - F.col("x1")) < 6)
    x = structure.run_id(t.withColumn("_new", ~F.coalesce(goes_on, F.lit(False))), ["doc_id"], ["page", "top", "table_no"], F.col("_new"), "_run")
    whole = Window.partitionBy("doc_id", "_run").orderBy("page", "top", "table_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = F.collect_list(F.struct("page", "rows", "header_rows", "num", "title", "notes")).over(whole)
    x = x.withColumn("_p", parts).withColumn("gone", F.lead("page").over(Window.partitionBy("doc_id", "_run").orderBy("page", "top", "table_no")).isNotNull())
    filled = F.filter(F.col("_p")[0]["rows"], lambda r: F.exists(r, lambda v: X.strip(v) != ""))
    several, short = F.size("_p") > 1, F.size(filled) <= 3
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    first = F.when(short, F.transform(filled, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))).otherwise(F.col("_p")[0]["rows"])
    rest = F.flatten(F.transform(F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))), lambda p: p["rows"]))
    some = lambda c, full: F.get(F.filter(F.transform("_p", lambda p: p[c]), full), F.lit(0))
    return x.select(
        *KEY, "x0", "top", "x1", "bottom", F.when(several, F.concat(first, rest)).otherwise(F.col("rows")).alias("rows"), F.when(several, some("num", lambda v: v.isNotNull())).otherwise(F.col("num")).alias("num"),
        F.when(several, F.coalesce(some("title", lambda v: v != ""), F.lit(""))).otherwise(F.col("title")).alias("title"), F.when(several & (F.size("notes") == 0), F.coalesce(some("notes", lambda v: F.size(v) > 0), F.array().cast("array<string>"))).otherwise(F.col("notes")).alias("notes"), "units",
        F.when(several & short, F.size(filled)).when(several, F.col("_p")[0]["header_rows"]).otherwise(F.col("header_rows")).cast("int").alias("header_rows"), "fill_down", "blocked",
        F.when(several, F.array(F.col("_p")[F.size("_p") - 2]["page"], F.col("page"))).alias("cross_page"), "gone")


def cut_segments(lines: DataFrame, blocked: DataFrame, skip: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, page, segment, kind, notes, num, top, box, text, lines). Lines in a blocked box or of a skipped text end a
    segment and go; lines of a table of contents go; headings, clauses and appendices start one. In the explanations, which
    begin at a page of `notes`, a clause's number may stand before any mark."""
    shut = lines.select("doc_id", "page", "seq", "text", _box().alias("box")).join(blocked.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("blocked").alias("area")), (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & structure.inside("box", "area"), "left_semi")
    x = lines.join(shut.select("doc_id", "page", "seq", F.lit(True).alias("_in")), ["doc_id", "page", "seq"], "left").withColumn("_norm", X.normalise("text"))
    x = x.join(skip.select("doc_id", "page", F.col("text").alias("_norm"), F.lit(True).alias("_named")).distinct(), ["doc_id", "page", "_norm"], "left")
    x = x.join(notes.withColumn("notes", F.lit(True)), ["doc_id", "page"], "left").withColumn("notes", F.coalesce("notes", F.lit(False)))
    masked = F.coalesce("_in", F.lit(False)) | F.coalesce("_named", F.lit(False))
    x = x.withColumn("masked", masked).filter(F.col("masked") | ~F.col("text").rlike(X.UNI + V.TOC_LINE))
    clause = F.when(F.col("notes"), F.col("text").rlike(X.UNI + V.NOTE_CLAUSE)).otherwise(F.col("text").rlike(X.UNI + V.CLAUSE)) | F.col("text").rlike(X.UNI + V.APPENDIX_CLAUSE)
    kind = F.coalesce(X.heading_kind("text", "x0"), F.when(clause, "clause").when(F.col("text").rlike(X.UNI + V.APPENDIX_TITLE), "appendix"))
    x = x.withColumn("kind", F.when(~F.col("masked"), kind))
    after = F.coalesce(F.lag("masked").over(Window.partitionBy("doc_id", "page").orderBy("seq")), F.lit(False))
    x = structure.run_id(x, ["doc_id", "page"], ["seq"], F.col("masked") | F.col("kind").isNotNull() | after, "segment").filter("NOT masked")
    s = F.sort_array(F.collect_list(F.struct("seq", "text", "kind", _box().alias("box"))))
    g = x.groupBy("doc_id", "page", "segment", "notes").agg(s.alias("lines"))
    return g.select("doc_id", "page", "segment", "notes", F.coalesce(F.col("lines")[0]["kind"], F.lit("continuation")).alias("kind"), F.array_join("lines.text", "\n").alias("text"), _around(F.col("lines.box")).alias("box"), F.array_min("lines.box.top").alias("top"), "lines")


def _pages(parts: Column) -> tuple[Column, Column]:
    """(pages, boxes) of parts with page and box: each page once, in order of appearance, with the box around its parts."""
    pages = F.array_distinct(F.transform(parts, lambda p: p["page"]))
    return pages, F.transform(pages, lambda n: _around(F.transform(F.filter(parts, lambda p: p["page"] == n), lambda p: p["box"])))


def clause_nodes(els: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, segments with their head) of the text elements of documents.

    A segment without a number, or with the number of the clause in force, joins that clause; after a heading there is none, and
    text without a number is a preamble. The last part that joined gives the reason for a review.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    first = F.col("lines")[0]["text"]
    target = F.get(X.explanation_targets("text"), F.lit(0))
    num = F.when(F.col("kind") == "clause", F.when(F.col("notes"), F.coalesce(target, X.clause_number(first), F.lit(""))).otherwise(F.coalesce(X.clause_number(first), F.lit(""))))
    head = X.split_heading(first)
    letter = F.struct(X.first_group(first, V.APPENDIX_TITLE, 1).alias("num"), X.strip(X.first_group(first, V.APPENDIX_TITLE, 2)).alias("title"))
    x = els.withColumn("num", num).withColumn("_h", F.when(F.col("kind") == "appendix", letter).when(F.col("kind").isin("chapter", "section"), head))
    mark = F.when(F.col("kind").isin("chapter", "section", "appendix"), F.struct(F.lit(None).cast("string").alias("num"))).when(F.col("kind") == "clause", F.struct("num"))
    force = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))["num"]
    same = (F.col("kind") == "clause") & ~F.col("notes") & F.col("num").eqNullSafe(force)
    joins = F.coalesce(same | ((F.col("kind") == "continuation") & force.isNotNull()), F.lit(False))
    x = structure.run_id(x.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("_joins", joins), ["doc_id"], ["seq"], ~F.col("_joins"), "run")
    title = F.concat_ws(" ", F.when(F.col("kind") == "appendix", F.concat(F.lit("附录"), F.col("_h.num"))).otherwise(F.col("_h.num")), F.col("_h.title"))
    title = X.strip(title)
    last = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_ch", last(F.when(F.col("kind").isin("chapter", "appendix"), F.struct("seq", title.alias("t"))))).withColumn("_se", last(F.when(F.col("kind") == "section", F.struct("seq", title.alias("t")))))
    # a new chapter keeps the section in force until the next one
    x = stored(x.withColumn("chapter", F.col("_ch.t")).withColumn("section", F.col("_se.t")).withColumn("title", title))
    part = F.struct("seq", "kind", "page", "box", "text", "lines", "_same", "notes")
    g = x.groupBy("doc_id", "run").agg(F.min("seq").alias("seq"), F.sort_array(F.collect_list(part)).alias("p"), *(F.min_by(c, "seq").alias(c) for c in ("kind", "notes", "num", "title", "_h", "chapter", "section")))
    g = g.filter("NOT (notes AND kind IN ('chapter', 'section'))")
    tail = F.element_at("p", -1)
    reason = F.when(F.size("p") > 1, F.when(tail["_same"] | (tail["page"] == F.col("p")[0]["page"]), "split_by_table").otherwise("cross_page_clause"))
    pages, boxes = _pages(F.col("p"))
    kind = F.when(F.col("kind") == "continuation", "preamble").when((F.col("kind") == "clause") & F.col("notes"), "explanation").otherwise(F.col("kind"))
    content = F.when(F.col("kind").isin("chapter", "section", "appendix"), F.col("title")).otherwise(F.array_join(F.transform("p", lambda v: X.normalise(v["text"])), "\n"))
    number = F.when(F.col("kind").isin("chapter", "section", "appendix"), F.col("_h.num")).when(F.col("kind") == "clause", F.col("num"))
    nodes = g.select("doc_id", "run", "seq", F.lit(0).alias("sub"), kind.alias("type"), number.alias("num"), "chapter", "section", pages.alias("pages"), boxes.alias("bboxes"), content.alias("content"), reason.alias("status_reason"), "p")
    clause = nodes.filter("type = 'clause'")
    opening = F.col("p")[0]
    line = lambda v, s, head: F.struct(v["text"].alias("text"), s["page"].cast("int").alias("page"), v["box"].alias("box"), F.lit(head).alias("head"))
    own = F.transform(F.slice(opening["lines"], F.lit(2), F.greatest(F.size(opening["lines"]) - 1, F.lit(0))), lambda v: line(v, opening, True))
    after = F.flatten(F.transform(F.filter("p", lambda s: s["kind"] == "continuation"), lambda s: F.transform(s["lines"], lambda v: line(v, s, False))))
    listed = clause.filter(structure.announces_list(opening["text"])).select("doc_id", "run", "seq", "num", "chapter", "section", F.explode(structure.item_lists(F.concat(own, after))).alias("i"))
    pages, boxes = _pages(F.col("i.lines"))
    items = listed.select("doc_id", "run", "seq", F.col("i.n").alias("sub"), F.lit("item").alias("type"), F.concat_ws("-", "num", F.col("i.n").cast("string")).alias("num"), "chapter", "section", pages.alias("pages"), boxes.alias("bboxes"),
        F.array_join(F.transform("i.lines", lambda v: X.normalise(v["text"])), "\n").alias("content"), F.lit(None).cast("string").alias("status_reason"))
    return nodes.drop("p").unionByName(items), x


def formula_nodes(segments: DataFrame) -> DataFrame:
    """Formulas of clauses, explanations and what goes on in them; variables come from the 式中 that follows in the segment."""
    s = segments.filter("kind IN ('clause', 'continuation') AND NOT _same")
    lines = s.select("doc_id", F.col("seq").alias("eseq"), F.explode("lines").alias("l")).select("doc_id", "eseq", "l.seq", "l.text", "l.box.*")
    found = structure.formula_regions(lines, ["doc_id", "eseq"])
    x = found.withColumnRenamed("text", "linear").withColumnRenamed("seq", "at").withColumnRenamed("box", "fbox").join(s.select("doc_id", F.col("seq").alias("eseq"), "page", "lines", "chapter", "section"), ["doc_id", "eseq"])
    rest = F.transform(F.filter("lines", lambda v: v["seq"] > F.col("last")), lambda v: v["text"])
    x = x.withColumn("_rest", rest)
    begin = F.array_position(F.transform("_rest", lambda v: v.startswith("式中")), F.lit(True)).cast("int")
    x = x.withColumn("_block", F.when(begin > 0, F.slice("_rest", F.greatest(begin, F.lit(1)), F.size("_rest"))).otherwise(F.array().cast("array<string>")))
    stop = F.array_position(F.transform("_block", lambda v: v.rlike(X.UNI + V.CLAUSE)), F.lit(True)).cast("int")
    blob = F.array_join(F.slice("_block", F.lit(1), F.when(stop > 0, stop).otherwise(F.size("_block"))), "")
    return x.select("doc_id", F.lit(None).cast("long").alias("run"), F.col("eseq").alias("seq"), (F.lit(100_000) + F.col("at")).cast("int").alias("sub"), F.lit("formula").alias("type"), "num", "chapter", "section", F.array(F.col("page")).alias("pages"), F.array("fbox").alias("bboxes"),
        F.lit(None).cast("string").alias("content"), F.lit("formula_linear_only").alias("status_reason"), X.normalise("linear").alias("linear_text"), X.variables(blob).alias("variables"))


def body(**fields: Column) -> Column:
    """A node's body with these fields; the others are null."""
    kinds = dict(f.split(":", 1) for f in _fields(BODY_TYPE))
    return F.struct(*(fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))


def _fields(kind: str) -> list[str]:
    """The fields of a struct type, cut at its own commas."""
    out, depth, at = [], 0, len("struct<")
    for i, c in enumerate(kind[:-1]):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 1:
            out.append(kind[at:i].strip())
            at = i + 1
    return [*out, kind[at:-1].strip()]


def parse(chars: DataFrame, pages: DataFrame, cells: DataFrame, graphics: DataFrame, standard: Standard) -> DataFrame:
    """Linked nodes of the documents of one standard, in the columns of a node file with `seq`.

    chars: doc_id, page, text, x0, x1, top, bottom, size. pages: doc_id, page, width, height. cells: doc_id, page, table_no, r, c and
    box, of each cell of each table that a page reader proposes. graphics: doc_id, page and box of curves, lines and images.
    """
    lines = layout.page_lines(chars).join(pages.select("doc_id", "page", "height"), ["doc_id", "page"])
    lines = stored(structure.repair_broken_lines(structure.without_page_numbers(lines)))
    found = stored(read_tables(chars, cells, lines))
    figures = stored(layout.group_figures(layout.graphic_clusters(graphics, pages), lines, found))
    blocked = found.select("doc_id", "page", "blocked").unionByName(figures.select("doc_id", "page", _box().alias("blocked")))
    named = F.array_compact(F.concat(F.array(F.nullif("title", F.lit(""))), "notes"))
    skip = found.select("doc_id", "page", F.explode(named).alias("text")).unionByName(figures.select("doc_id", "page", F.explode(F.concat(F.array("title"), "legend", "sub_labels")).alias("text"))).withColumn("text", X.normalise("text"))
    segs = cut_segments(lines, blocked, skip, structure.explanation_pages(lines))
    tabs = found.filter("NOT gone").select("doc_id", "page", "top", F.lit("table").alias("kind"), F.struct("rows", "num", "title", "notes", "units", "header_rows", "fill_down", "cross_page", _box().alias("box")).alias("table"))
    figs = figures.select("doc_id", "page", "top", F.lit("figure").alias("kind"), F.struct("num", "title", "legend", "sub_labels", "part_count", _box().alias("box")).alias("figure"))
    els = stored(structure.elements(segs, tabs, figs))
    texts, segments = clause_nodes(els.filter("lines IS NOT NULL"))
    none = lambda t: F.lit(None).cast(t)
    context = segments.select("doc_id", "seq", F.struct("chapter", "section").alias("c"))
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    others = els.join(context, ["doc_id", "seq"], "left").withColumn("c", F.last("c", ignorenulls=True).over(w)).withColumn("chapter", F.col("c.chapter")).withColumn("section", F.col("c.section")).filter("lines IS NULL")
    return link(assemble(texts, others, formula_nodes(segments), standard))


def assemble(texts: DataFrame, others: DataFrame, formulas: DataFrame, standard: Standard) -> DataFrame:
    """P10: nodes of all types with their bodies, contents, keywords and reviews."""
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    text = texts.withColumn("body", F.lit(None).cast(BODY_TYPE)).withColumn("content", X.strip("content"))
    section = F.coalesce("section", F.lit(""))
    words = F.when(F.col("type") == "clause", X.structural_keywords("num", section)).when(F.col("type") == "item", F.array("num", F.substring_index("num", "-", 1))).when(F.col("type") == "explanation", F.array(F.col("num"), F.concat(F.lit("第"), F.col("num"), F.lit("条")), F.lit("条文说明"))).otherwise(empty)
    text = text.withColumn("keywords", words)
    t = others.filter("kind = 'table'").select("doc_id", "page", "seq", "chapter", "section", "table.*")
    long = tables.cells(t.withColumn("_k", F.struct("doc_id", "seq")), "_k").join(t.select(F.struct("doc_id", "seq").alias("_k"), "header_rows"), "_k")
    names = tables.flat_header(long, "_k").groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("c", "name")))["name"].alias("names"))
    t = stored(t.join(names.select("_k.*", "names"), ["doc_id", "seq"], "left").withColumn("names", F.coalesce("names", empty)))
    data = F.slice("rows", F.col("header_rows") + 1, F.greatest(F.size("rows") - F.col("header_rows"), F.lit(0)))
    noted = F.array_join(F.transform("notes", X.strip), " ")
    notes = F.when(F.size("notes") > 0, F.concat(F.lit("\n"), F.when(noted.startswith("注"), noted).otherwise(F.concat(F.lit("注："), noted)))).otherwise("")
    plain = F.concat(tables.proxy_text(F.col("title"), F.when(F.size("names") > 0, F.concat(F.array("names"), data)).otherwise(F.col("rows"))), notes)
    raw = F.concat(tables.proxy_text(F.col("title"), F.col("rows")), notes)
    kind = F.when(F.char_length(raw) >= 800, tables.table_kind("title", "rows")).otherwise("grid")
    t = t.withColumn("_kind", F.when(kind != "grid", kind)).withColumn("content", plain)
    look = t.filter("_kind = 'lookup'").withColumn("node_id", F.concat_ws("|", "doc_id", F.col("seq").cast("string"))).select("node_id", F.lit(standard.id).alias("standard_id"), F.col("node_id").alias("num"), F.col("seq"), F.struct("title", "rows").alias("body"), F.lit("table").alias("type"))
    brief = brief_texts(look)
    numbered = F.col("num").isNotNull()
    t = t.withColumn("node_id", F.concat_ws("|", "doc_id", F.col("seq").cast("string"))).join(brief, "node_id", "left")
    content = F.when(F.col("_kind") == "template", F.concat_ws("\n", F.nullif("title", F.lit("")), F.lit(V.TEMPLATE_NOTE))).otherwise(F.coalesce(F.concat_ws("\n", F.nullif("title", F.lit("")), "brief"), F.col("content")))
    content = F.when(F.col("_kind").isNull() | ((F.col("_kind") == "lookup") & F.col("brief").isNull()), F.col("content")).otherwise(content)
    reason = F.when(~numbered, "table_title_missing").when(F.col("cross_page").isNotNull(), "cross_page_table_header")
    table = t.select("doc_id", F.lit(None).cast("long").alias("run"), "seq", F.lit(0).alias("sub"), F.lit("table").alias("type"), "num", "chapter", "section", F.array("page").alias("pages"), F.array("box").alias("bboxes"), content.alias("content"), reason.alias("status_reason"),
        body(table_id=F.col("num"), title=F.col("title"), rows=F.col("rows"), header_rows=F.col("header_rows"), header_flat=F.col("names"), notes=F.col("notes"), units=F.col("units"), markdown=X.markdown("rows"), markdown_flat=X.markdown_flat("names", data), cross_page=F.col("cross_page"), tool_kind=F.col("_kind"), fill_down=F.col("fill_down")).alias("body"),
        F.when(numbered, F.array(F.concat(F.lit("表"), F.col("num")), F.col("num"))).otherwise(F.array(F.lit("未编号表"))).alias("keywords"))
    f = others.filter("kind = 'figure'").select("doc_id", "page", "seq", "chapter", "section", "figure.*")
    figure = f.select("doc_id", F.lit(None).cast("long").alias("run"), "seq", F.lit(0).alias("sub"), F.lit("figure").alias("type"), "num", "chapter", "section", F.array("page").alias("pages"), F.array("box").alias("bboxes"), F.array_join(F.concat(F.array("title"), "legend"), " ").alias("content"),
        F.when(F.size("sub_labels") > 1, "figure_multi_part").alias("status_reason"), body(figure_id=F.col("num"), title=F.col("title"), legend=F.col("legend"), sub_labels=F.col("sub_labels"), part_count=F.col("part_count")).alias("body"), F.array(F.concat(F.lit("图"), F.col("num")), F.col("num")).alias("keywords"))
    formula = formulas.withColumn("content", X.formula_text("num", "variables")).withColumn("body", body(equation_id=F.col("num"), linear_text=F.col("linear_text"), variables=F.col("variables"))).withColumn("keywords", F.array(F.concat(F.lit("式（"), F.col("num"), F.lit("）")), F.col("num"))).drop("linear_text", "variables")
    every = text.unionByName(table).unionByName(figure).unionByName(formula)
    order = Window.partitionBy("doc_id").orderBy("seq", "sub")
    every = every.withColumn("seq", F.row_number().over(order).cast("long"))
    level = F.create_map(*(F.lit(v) for kv in V.LEVELS.items() for v in kv))[F.col("type")]
    nameless = F.sum(F.when(F.coalesce("num", F.lit("")) == "", 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("seq"))
    free = F.col("type").isin("clause", "item")
    refs = F.when(free, X.references("content", F.lit(standard.id))).otherwise(F.array().cast(REFS_TYPE))
    path = F.concat_ws(" / ", F.nullif("chapter", F.lit("")), F.nullif("section", F.lit("")))
    return stored(every.select(
        X.node_id(F.lit(standard.id), "type", "num", F.concat(F.lit("seq"), F.lpad(nameless.cast("string"), 4, "0"))).alias("node_id"), F.lit(standard.id).alias("standard_id"), F.lit(standard.code).alias("standard_code"), F.lit(standard.name).alias("standard_name"), "doc_id", F.lit(standard.version).alias("version"),
        "type", level.alias("level"), F.nullif("num", F.lit("")).alias("num"), "chapter", "section", path.alias("path"), F.transform("pages", lambda p: (p + standard.offset).cast("int")).alias("pages"), F.col("bboxes").cast(f"array<{BOX}>").alias("bboxes"), "content", "body", refs.alias("refs"),
        F.when(free, X.modality("content")).alias("modality"), "keywords", F.when(F.size("keywords") > 0, "structural").alias("keywords_source"), F.when(F.col("status_reason").isNull(), "ok").otherwise("need_review").alias("status"), F.col("status_reason").alias("status_reason"), "seq"))


def brief_texts(look: DataFrame) -> DataFrame:
    """(node_id, brief) of lookup tables that are digit grids."""
    long = stored(tables.cells(look.select("node_id", F.col("body.rows").alias("rows")), "node_id"))
    names = long.filter("r = 0").select("node_id", "c", X.strip(F.coalesce("v", F.lit(""))).alias("name"))
    return tables.brief(tables.digit_grid(long.filter("r > 0"), names, "node_id"), "node_id").select("node_id", F.col("text").alias("brief"))


def link(nodes: DataFrame) -> DataFrame:
    """Parents, children, references both ways, explanations both ways, formulas' variables. Of nodes with one id the last
    is what others link to."""
    empty = F.array().cast("array<string>")
    n = stored(structure.parents(nodes))
    refs, back = structure.resolve_refs(n)
    told = stored(structure.link_explanations(n))
    listed = lambda by, what, name: told.groupBy(F.col(by).alias("node_id")).agg(F.sort_array(F.collect_set(what)).alias(name))
    better = structure.formula_variables(n.filter("type = 'formula'").withColumn("variables", F.col("body.variables")), n.filter("type = 'clause'")).withColumnRenamed("variables", "_v")
    out = n.drop("refs")
    for part in (refs, back, structure.children(n), listed("explanation_id", "clause_id", "explains"), listed("clause_id", "explanation_id", "explained_by"), better):
        out = out.join(part.dropDuplicates(["node_id"]), "node_id", "left")
    out = out.withColumn("refs", F.coalesce("refs", F.array().cast(REFS_TYPE)))
    for c in ("referenced_by", "child_ids", "explains", "explained_by"):
        out = out.withColumn(c, F.coalesce(c, empty))
    mine = F.col("type") == "formula"
    out = out.withColumn("body", F.when(mine & F.col("_v").isNotNull(), F.col("body").withField("variables", F.col("_v"))).otherwise(F.col("body")))
    out = out.withColumn("content", F.when(mine, X.formula_text("num", F.col("body.variables"))).otherwise(F.col("content")))
    return out.select(*(F.col(c).cast(t).alias(c) for c, t in NODE_TYPES.items()), "seq")
