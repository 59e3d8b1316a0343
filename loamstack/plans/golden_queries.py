"""Driver queries on small fixed inputs whose results are known by hand: ingest, text functions, table tools, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context, graph, layout, quality, structure, tables
from ..sources import io
from ..sources.io import stored
from . import ingest
from .engine import Engine, badges, boxes_by_page

QUERIES, SQL = {}, {}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def golden(columns: str, expected: list[tuple]):
    """Register a query with its known rows as SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in expected)}) v({columns})"
        return f

    return add


#: Lines of the pages of a made-up standard, with their left side; None stands for the table.
CENTRE, LEFT = 250.0, 70.0
PAGES = [
    [("目次", CENTRE), ("5 结构设计 ............ 13", LEFT), ("附录B 取值 ……………… 40", LEFT)],
    [("前言部分的说明文字没有编号", LEFT), ("5 结构设计", CENTRE), ("5.1 一般规定", CENTRE), ("5.1.1 立杆的计算应符合下列规定：", LEFT), ("1 应按第5.1.2条计算", LEFT), ("并应符合表5.1.2的要求；", LEFT), ("3 不是第二款的行", LEFT), ("2 必须设置斜杆。", LEFT), ("12", CENTRE)],
    [("3 跨页续接的第三款。", LEFT), ("5.1.2 稳定性应按下式计算（图", LEFT), ("6.2.4）的规定采用：", LEFT), ("N/φA≤f", 200.0), ("（5.1.2-1）", 400.0), ("式中：φ——稳定系数；N——轴力（kN）；", LEFT), ("表5.1.2 承载力", CENTRE), None, ("注：表中数值可内插。", LEFT), ("5.1.2 续表之后的条文应继续执行。", LEFT)],
    [("图1 立杆构造", CENTRE), ("1—立杆；2－斜杆", LEFT), ("5.2 构造要求", CENTRE), ("5.2.1 严禁拆除斜杆，详见附录B和GB 50009。", LEFT), ("附录B 立杆取值", CENTRE), ("B.0.1 系数应按本条给出的数值采用。", LEFT)],
    [("附：条文说明", CENTRE)],
    [("5 结构设计", CENTRE), ("5.1.1~5.1.2 这两条明确了计算方法。", LEFT), ("5.2.1条给出的是引用。", LEFT), ("5.2.1、对拆除的限制。", LEFT)],
]
TABLE = [["类别", "承载力（kN）", ""], ["", "单排", "双排"], ["A型", "10", "20"], ["", "30", "40"]]
BOX = "x0 double, x1 double, top double, bottom double"


def page_inputs(spark):
    """(characters, pages, cells, graphics) of the made-up standard."""
    chars, cells = [], []
    for page, lines in enumerate(PAGES, 1):
        y = 100.0
        for line in lines:
            if line is None:
                for r, row in enumerate(TABLE):
                    for c, v in enumerate(row):
                        x, top = 80.0 + 150 * c, y + 20 * r
                        cells.append(("d", page, 0, r, c, x, x + 150, top, top + 20))
                        chars += [("d", page, ch, x + 4 + 8 * i, x + 12 + 8 * i, top + 5, top + 15, 10.0) for i, ch in enumerate(v)]
                y += 20 * len(TABLE) + 8
                continue
            text, x = line
            top = 780.0 if text == "12" else y
            chars += [("d", page, ch, x + 14 * i, x + 14 * i + 13, top, top + 12, 14.0) for i, ch in enumerate(text)]
            y += 25
    size = spark.createDataFrame([("d", i, 595.0, 842.0) for i in range(1, len(PAGES) + 1)], "doc_id string, page int, width double, height double")
    drawn = [("d", 4, 240.0, 20.0, 300.0, 95.0), ("d", 4, 310.0, 20.0, 340.0, 95.0), ("d", 4, 0.0, 0.0, 595.0, 842.0)]
    graphics = spark.createDataFrame(drawn, "doc_id string, page int, x0 double, top double, x1 double, bottom double")
    return spark.createDataFrame(chars, io.CHAR), size, spark.createDataFrame(cells, f"doc_id string, page int, table_no int, r int, c int, {BOX}"), graphics


def parsed(spark, standard: str = "S", code: str = "JGJ/T 1-2020"):
    return ingest.parse(*page_inputs(spark), ingest.Standard(standard, code, "规范", "2020", 10))


@golden("node_id, parent_id, pages, status_reason, modality, content", [
    ("S:preamble:seq0001", None, "11", None, None, "目次"),
    ("S:preamble:seq0002", None, "12", None, None, "前言部分的说明文字没有编号"),
    ("S:chapter:5", None, "12", None, None, "5 结构设计"),
    ("S:section:5.1", "S:chapter:5", "12", None, None, "5.1 一般规定"),
    ("S:clause:5.1.1", "S:section:5.1", "12,13", "cross_page_clause", "必须", "5.1.1 立杆的计算应符合下列规定：\n1 应按第5.1.2条计算\n并应符合表5.1.2的要求；\n3 不是第二款的行\n2 必须设置斜杆。\n3 跨页续接的第三款。"),
    ("S:item:5.1.1-1", "S:clause:5.1.1", "12", None, "应", "1 应按第5.1.2条计算\n并应符合表5.1.2的要求；\n3 不是第二款的行"),
    ("S:item:5.1.1-2", "S:clause:5.1.1", "12", None, "必须", "2 必须设置斜杆。"),
    ("S:item:5.1.1-3", "S:clause:5.1.1", "13", None, None, "3 跨页续接的第三款。"),
    ("S:clause:5.1.2", "S:section:5.1", "13", "split_by_table", "应", "5.1.2 稳定性应按下式计算（图6.2.4）的规定采用：\nN/φA≤f\n（5.1.2-1）\n式中：φ——稳定系数；N——轴力（kN）；\n5.1.2 续表之后的条文应继续执行。"),
    ("S:formula:5.1.2-1", "S:clause:5.1.2", "13", "formula_linear_only", None, "式（5.1.2-1） φ=稳定系数；N=轴力（kN）"),
    ("S:table:5.1.2", "S:clause:5.1.2", "13", None, None, "表5.1.2 承载力\n类别=A型；承载力（kN）-单排=10；承载力（kN）-双排=20\n类别=A型；承载力（kN）-单排=30；承载力（kN）-双排=40\n注：表中数值可内插。"),
    ("S:figure:1", "S:clause:5.1.2", "14", None, None, "图1 立杆构造 1—立杆；2—斜杆"),
    ("S:section:5.2", "S:chapter:5", "14", None, None, "5.2 构造要求"),
    ("S:clause:5.2.1", "S:section:5.2", "14", None, "严禁", "5.2.1 严禁拆除斜杆，详见附录B和GB 50009。"),
    ("S:appendix:B", None, "14", None, None, "附录B 立杆取值"),
    ("S:clause:B.0.1", "S:appendix:B", "14,15", "cross_page_clause", "应", "B.0.1 系数应按本条给出的数值采用。\n附：条文说明"),
    ("S:explanation:5.1.1", "S:appendix:B", "16", None, None, "5.1.1~5.1.2 这两条明确了计算方法。\n5.2.1条给出的是引用。"),
    ("S:explanation:5.2.1", "S:appendix:B", "16", None, None, "5.2.1、对拆除的限制。"),
])
def parse_standard(spark, sf_dir):
    """Characters, cells and graphics of six pages to nodes (L, P, K1, N1 to N18)."""
    return parsed(spark).select("node_id", "parent_id", F.array_join("pages", ",").alias("pages"), "status_reason", "modality", "content")


@golden("node_id, what, value", [
    ("S:appendix:B", "children", "S:clause:B.0.1,S:explanation:5.1.1,S:explanation:5.2.1"), ("S:chapter:5", "children", "S:section:5.1,S:section:5.2"),
    ("S:clause:5.1.1", "children", "S:item:5.1.1-1,S:item:5.1.1-2,S:item:5.1.1-3"), ("S:clause:5.1.2", "children", "S:formula:5.1.2-1,S:table:5.1.2,S:figure:1"), ("S:section:5.1", "children", "S:clause:5.1.1,S:clause:5.1.2"), ("S:section:5.2", "children", "S:clause:5.2.1"),
    ("S:clause:5.1.1", "refs", "第5.1.2条+,表5.1.2+"), ("S:item:5.1.1-1", "refs", "第5.1.2条+,表5.1.2+"), ("S:clause:5.1.2", "refs", "图6.2.4-"), ("S:clause:5.2.1", "refs", "附录B+,GB 50009-"),
    ("S:appendix:B", "referenced_by", "S:clause:5.2.1"), ("S:clause:5.1.2", "referenced_by", "S:clause:5.1.1,S:item:5.1.1-1"), ("S:table:5.1.2", "referenced_by", "S:clause:5.1.1,S:item:5.1.1-1"),
    ("S:explanation:5.1.1", "explains", "S:clause:5.1.1,S:clause:5.1.2"), ("S:explanation:5.2.1", "explains", "S:clause:5.2.1"),
    ("S:clause:5.1.1", "explained_by", "S:explanation:5.1.1"), ("S:clause:5.1.2", "explained_by", "S:explanation:5.1.1"), ("S:clause:5.2.1", "explained_by", "S:explanation:5.2.1"),
    ("S:clause:5.1.1", "keywords", "5.1.1,第5.1.1条,5.1"), ("S:clause:5.1.2", "keywords", "5.1.2,第5.1.2条,5.1"), ("S:clause:5.2.1", "keywords", "5.2.1,第5.2.1条,5.2"), ("S:clause:B.0.1", "keywords", "B.0.1,第B.0.1条,5.2"),
    ("S:explanation:5.1.1", "keywords", "5.1.1,第5.1.1条,条文说明"), ("S:explanation:5.2.1", "keywords", "5.2.1,第5.2.1条,条文说明"), ("S:figure:1", "keywords", "图1,1"), ("S:formula:5.1.2-1", "keywords", "式（5.1.2-1）,5.1.2-1"),
    ("S:item:5.1.1-1", "keywords", "5.1.1-1,5.1.1"), ("S:item:5.1.1-2", "keywords", "5.1.1-2,5.1.1"), ("S:item:5.1.1-3", "keywords", "5.1.1-3,5.1.1"), ("S:table:5.1.2", "keywords", "表5.1.2,5.1.2"),
])
def linked_standard(spark, sf_dir):
    """Links and keywords of the parsed nodes."""
    ref = F.transform("refs", lambda r: F.concat(r["target_display"], F.when(r["in_scope"], "+").otherwise("-")))
    parts = {"children": F.col("child_ids"), "refs": ref, **{c: F.col(c) for c in ("referenced_by", "explains", "explained_by", "keywords")}}
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.array_join(c, ",").alias("value")) for n, c in parts.items())))
    return parsed(spark).select("node_id", listed.alias("p")).select("node_id", "p.what", "p.value").filter("value <> ''")


@golden("what, name, n", [
    ("type", "preamble", 2), ("type", "chapter", 1), ("type", "section", 2), ("type", "clause", 4), ("type", "item", 3), ("type", "formula", 1), ("type", "table", 1), ("type", "figure", 1), ("type", "appendix", 1), ("type", "explanation", 2),
    ("review", "cross_page_clause", 2), ("review", "split_by_table", 1), ("review", "formula_linear_only", 1), ("refs", "all", 7), ("refs", "in_scope", 5),
    ("reasons", "cross_page_clause", 2), ("reasons", "split_by_table", 1), ("reasons", "formula_linear_only", 1), ("problems", "content short", 0), ("nodes", "nodes", 18), ("totals", "refs", 7), ("totals", "inside", 5), ("totals", "outside", 2),
    ("coverage", "tables", 1), ("coverage", "numbered_tables", 1), ("coverage", "figures", 1), ("coverage", "figures_with_image", 0), ("coverage", "formulas", 1), ("coverage", "explained_formulas", 1), ("coverage", "orphans", 0), ("boxes", "pages", 20),
])
def standard_report(spark, sf_dir):
    """What a parse report counts."""
    n = parsed(spark)
    row = lambda d, what, names: d.select(F.explode(F.array(*(F.struct(F.lit(what).alias("what"), F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in names))).alias("s")).select("s.*")
    cover = ["tables", "numbered_tables", "figures", "figures_with_image", "formulas", "explained_formulas", "orphans"]
    bad = n.select(F.explode(structure.problems()).alias("p")).filter("p <> 'content empty'").agg(F.count(F.lit(1)).alias("content short"))
    out = structure.summary(n).unionByName(quality.review_reasons(n).select(F.lit("reasons").alias("what"), F.col("status_reason").alias("name"), "n"))
    for part in (row(bad, "problems", ["content short"]), row(n.agg(F.count(F.lit(1)).alias("nodes")), "nodes", ["nodes"]), row(quality.ref_totals(n), "totals", ["refs", "inside", "outside"]), row(quality.coverage(n), "coverage", cover), row(boxes_by_page(n).agg(F.count(F.lit(1)).alias("pages")), "boxes", ["pages"])):
        out = out.unionByName(part)
    return out


def _text_cases():
    s = lambda c: F.array_join(c, "|")
    pairs = lambda c, *names: s(F.transform(c, lambda v: F.concat_ws(":", *(F.coalesce(v[n], F.lit("-")) for n in names))))
    size = lambda c: F.concat(F.lit(""), c.cast("string"))
    return [
        ("fix_symbols", X.fix_glyphs, "λ1", "λ1"), ("norm_text", X.normalise, "a  b\r\n\n 中 文 x ", "a b\n中文 x"), ("norm_dash", X.normalise_dashes, "3－中 4–文 5-六", "3—中 4—文 5-六"), ("units", X.guess_units, "长度（某）（ mm ）（kN）", "mm"),
        ("header_cell", X.clean_header, "搭设 / 高 度", "搭设高度"), ("modality", X.modality, "不宜相应必须", "必须"), ("label", lambda x: X.label(F.lit("clause"), x), "A.0.1", "附录A.0.1"), ("label", lambda x: X.label(F.lit("formula"), x), "5.1.1-2", "式（5.1.1-2）"),
        ("display", lambda x: X.display(F.lit("appendix"), x), "C", "附录C"), ("node_id", lambda x: X.node_id(F.lit("J"), F.lit("table"), x), "4.3.1", "J:table:4.3.1"), ("node_id", lambda x: X.node_id(F.lit("J"), F.lit("table"), x), "", "J:table:unknown"),
        ("references", lambda x: pairs(X.references(x, F.lit("J")), "target_type", "target_num"), "按第 5.3.3 条、式（5.3.3-1）、GB/T50009，附录 B，表5.1.9，第5.3.3条", "clause:5.3.3|table:5.1.9|appendix:B|formula:5.3.3-1|external_standard:GB/T50009"),
        ("heading", lambda x: X.heading_kind(x, F.lit(250.0)), "5.1 一般规定", "section"), ("heading", lambda x: X.heading_kind(x, F.lit(250.0)), "0.9 ×1.5", None), ("heading", lambda x: X.heading_kind(x, F.lit(70.0)), "5.1 一般规定", None), ("heading", lambda x: X.heading_kind(x, F.lit(250.0)), "5 结构设计", "chapter"),
        ("split_heading", lambda x: F.concat_ws(":", X.split_heading(x)["num"], X.split_heading(x)["title"]), "5.1 一般规定", "5.1:一般规定"), ("clause_num", X.clause_number, "A.0.1 风压", "A.0.1"), ("clause_num", X.clause_number, "7.4.11 立杆", "7.4.11"),
        ("line", X.line_class, "附录A 规格 ......... 37", "toc"), ("line", X.line_class, "7.2.3-2 荷载取值", "clause"), ("line", X.line_class, "图6.2.4可调托撑", "figure_title"), ("line", X.line_class, "表 5.1.9 承载力", "table_title"), ("line", X.line_class, "λ=l/i （5.3.3-2）", "equation"),
        ("targets", lambda x: s(X.explanation_targets(x)), "7.4.1~7.4.3 明确了", "7.4.1|7.4.2|7.4.3"), ("targets", lambda x: s(X.explanation_targets(x)), "7.4.11、7.4.12 明确。5.1.1", "7.4.11|7.4.12"),
        ("variables", lambda x: pairs(X.variables(x), "symbol", "meaning", "unit"), "φ——稳定系数；N——轴力（kN）；A——面积（约）", "φ:稳定系数:-|N:轴力（kN）:kN|A:面积（约）:-"), ("where", lambda x: size(F.size(X.where_blocks(x))), "a 式中：φ——x；式中 b 式中: 无 式中：i——r", "2"),
        ("keywords", lambda x: s(X.structural_keywords(x, F.lit("5.3 受压构件"))), "5.3.3", "5.3.3|第5.3.3条|5.3"), ("keys", lambda x: s(X.key_candidates(x)), "型号 Z-LG-500 在2021年 λ=100 的 62", "Z-LG-500|500|100|62"), ("overlap", lambda x: size(X.title_overlap(x, F.lit("稳定系数 φ表"))), "稳定系数φ取值", "3"),
        ("answer_tokens", lambda x: s(X.answer_tokens(x)), "间距650 mm，共3.5", "650mm|650|3.5"), ("refusal", lambda x: F.when(X.is_refusal(x), "yes").otherwise("no"), "材料中未规定", "yes"), ("refusal", lambda x: F.when(X.is_refusal(x), "yes").otherwise("no"), "应设置", "no"),
        ("mentions", lambda x: pairs(X.mentions(x), "type", "num"), "表5.1.9 和 5.4.2 附录B", "appendix:B|clause:5.4.2|table:5.1.9"), ("number_key", lambda x: s(F.transform(X.number_key(x), lambda v: v.cast("string"))), "5.a.10", "5|999|10"),
        ("tokens", lambda x: s(X.tokens(x)), "立杆间距 550mm 可 7.1.2-1 表B.2", "7.1.2-1|7.1|表b.2|mm|b|550mm|立杆|杆间|间距|可"), ("expand", X.expand_query, "盘扣架的斜撑和立柱", "盘扣架的斜撑和立柱 斜杆 竖向斜杆 立杆"), ("strictness", lambda x: X.strictness(x).cast("string"), "不宜", "3"),
        ("tex", X.tex_to_text, r"$\frac{a}{b}\leqslant\lambda x\left(\text{m}\right)$", "a/b≤λ x(m)"), ("escape", X.escape_html, "a<b>&c", "a&lt;b&gt;&amp;c"), ("highlight", X.highlight, "**x** [来源：第5.1.1条]", '<b>x</b> <span class="cite">[来源：第5.1.1条]</span>'),
        ("code", lambda x: X.standard_code(x), "JGJ / T 231", "JGJ/T231"), ("template", lambda x: X.template_text(F.array(F.array(x, F.lit("1")), F.array(x, F.lit("2")), F.array(F.lit("搭设 / 部位"))), F.lit("无")), "项目", "（表单模板，原表为空白记录表）\n表中栏目与检查项：项目、搭设/部位"),
    ]


@golden("i, name, value", [(i, name, want) for i, (name, _, _, want) in enumerate(_text_cases())])
def text_functions(spark, sf_dir):
    """One row for each text function on a literal."""
    one = spark.range(1)
    rows = [F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), f(F.lit(given)).alias("value")) for i, (name, f, given, _) in enumerate(_text_cases())]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _grid_rows():
    return [["λ", *map(str, range(10))]] + [[str(10 * t), *(f"{1 - (10 * t + u) / 1000:.3f}" if t < 25 or u == 0 else "—" for u in range(10))] for t in range(26)]


@golden("name, value", [
    ("header_rows", "2"), ("flat_header", "类别|连墙件布置-2步3跨|连墙件布置-3步3跨"), ("proxy", "表5.4.1\n类别=双排架；连墙件布置-2步3跨=1.45；连墙件布置-3步3跨=1.70"), ("turned", "搭设高度H(m)：βH=1.00（H≤8）；1.05（8<H≤16）；1.10（16<H≤24）；1.20（H＞24）"),
    ("kinds", "template|lookup|grid"), ("brief", "按λ取值（λ 范围 0~250，共 251 个值）\nλ=0 → φ=1.000；λ=62 → φ=0.938；λ=125 → φ=0.875；λ=250 → φ=0.750\n（全表已转为可查询结构，非示例值需按精确参数查表）"),
    ("rows", "Z-LG-1000.重=6.65|Z-LG-500.重=3.80"), ("useless", "0"), ("useless", "3"), ("probe", "2:t:62:0.938:true"), ("registered", "new"), ("described", "C.0.1（λ）"), ("real", "kept"), ("store", "a=2"), ("found_rows", "双排架:1"),
])
def table_tools(spark, sf_dir):
    """Tables as tools on literals."""
    grid = lambda rows, key="t": spark.createDataFrame([(key, rows)], "tab string, rows array<array<string>>")
    merged = grid([["类别", "连墙件布置", ""], ["", "2步3跨", "3步3跨"], ["双排架", "1.45", "1.70"]])
    long = tables.cells(merged, "tab").withColumn("header_rows", F.lit(2))
    names = tables.flat_header(long, "tab").groupBy("tab").agg(F.sort_array(F.collect_list(F.struct("c", "name")))["name"].alias("names"))
    row = lambda name, d: d.toDF("x").select(F.lit(name).alias("name"), F.col("x").cast("string").alias("value"))
    flat = F.concat(F.array("names"), F.slice("rows", F.lit(3), F.lit(1)))
    turned = grid([["搭设高度H(m)", "H≤8", "8<H≤16", "16<H≤24", "H＞24"], ["βH", "1.00", "1.05", "1.10", "1.20"]])
    kind = lambda title, rows: tables.table_kind(F.lit(title), F.array(*(F.array(*map(F.lit, r)) for r in rows)))
    kinds = [kind("验收记录表", [["a"]]), kind("x", [["λ", "0"], ["0", "1"], ["10", "2"], ["20", "3"]]), kind("x", [["n", "v"], ["a", "1"], ["b", "2"], ["c", "3"]])]
    cells = tables.cells(grid(_grid_rows()), "tab")
    digit = stored(tables.digit_grid(cells.filter("r > 0"), cells.filter("r = 0").select("tab", "c", F.col("v").alias("name")), "tab"))
    parts = tables.cells(grid([["名称", "型号", "重", ""], ["立杆", "Z-LG-500", "3.75", "x"], ["", "Z-LG-1000", "6.65", "y"], ["立杆", "Z-LG-500", "3.80", "z"]]), "tab")
    body, heads = parts.filter("r > 0"), parts.filter("r = 0").select("tab", "c", F.col("v").alias("name"))
    looked = tables.row_lookup(body, heads, "tab").select(F.concat("k", F.lit("."), "attr", F.lit("="), "value").alias("x")).agg(F.array_join(F.sort_array(F.collect_list("x")), "|").alias("x"))
    asked = spark.createDataFrame([(1, "Q235 长细比 62 轴心受压稳定系数"), (2, "Q355 长细比 62 轴心受压稳定系数")], "q_id long, question string")
    titles = spark.createDataFrame([("t", 1, "Q355 钢管轴心受压构件稳定系数")], "node_id string, seq int, title string")
    values = digit.select(F.col("tab").alias("node_id"), F.col("k").cast("string").alias("k_text"), "value", F.lit("digit_grid").alias("layout"))
    hit = tables.probe(asked, titles, values).select(F.concat_ws(":", F.col("q_id").cast("string"), "node_id", "key", "value", F.col("exact").cast("string")).alias("x"))
    twice = spark.createDataFrame([("old", "J", "5.1.1", 1), ("new", "J", "5.1.1", 2)], "node_id string, standard_id string, num string, seq int").withColumn("type", F.lit("table"))
    mixed = spark.createDataFrame([("kept", [["承载力设计值", "12.5"]]), ("false", [["", "x"]])], "name string, rows array<array<string>>")
    kept = "struct<title:string,rows:array<array<string>>,header_rows:int,header_flat:array<string>,notes:array<string>,markdown_flat:string>"
    stored_rows = tables.store_rows(spark.createDataFrame([("n", "1", [3], ("t", [["a", "b", "a"], ["1", "", "2"]], 1, ["a", "b", "a"], [], ""))], f"node_id string, num string, pages array<int>, body {kept}"))[0]
    rows_at = spark.createDataFrame([("n", "t", 0, "类别=双排架；系数=1.45"), ("n", "t", 1, "类别=单排架；值=1.70")], "node_id string, title string, row_index int, row_text string")
    best = tables.rows_for(rows_at, spark.createDataFrame([(1, "双排")], "q_id long, question string"), 1)
    out = [
        row("header_rows", merged.select(tables.header_rows("rows"))), row("flat_header", names.select(F.array_join("names", "|"))), row("proxy", names.join(merged, "tab").select(tables.proxy_text(F.lit("表5.4.1"), flat))), row("turned", turned.select(tables.proxy_text(F.lit(""), "rows"))),
        row("kinds", spark.range(1).select(F.concat_ws("|", *kinds))), row("brief", tables.brief(digit, "tab").select("text")), row("rows", looked), row("useless", tables.useless_columns(body, heads, "tab").select("c")), row("probe", hit), row("registered", tables.registry(twice).select("node_id")),
        row("described", tables.describe(spark.createDataFrame([("C.0.1", "λ")], "num string, key_name string"))), row("real", structure.real_tables(mixed).select("name")), row("store", stored_rows.select("row_text")), row("found_rows", best.select(F.concat(F.lit("双排架:"), F.col("score").cast("string")))),
    ]
    first = out[0]
    for d in out[1:]:
        first = first.unionByName(d)
    return first


@golden("q_id, what, value", [
    (1, "top", "S:clause:5.2.1"), (2, "top", "S:table:5.1.2"), (3, "top", "T:clause:养护"), (1, "cited", "clause 5.2.1 S"), (1, "invalid", "clause 8.0.7 -"), (1, "secondary", "appendix B -"), (2, "cited", "table 5.1.2 -"), (2, "invalid", "clause 1.0.1 -"),
    (1, "badges", "1 1 1 false"), (2, "badges", "1 0 1 false"), (3, "badges", "0 0 0 true"), (0, "standards", "DB11/T 2-2023,JGJ/T 1-2020"), (2, "rows", "类别=A型；承载力（kN）-单排=10；承载力（kN）-双排=20"),
])
def engine_answers(spark, sf_dir):
    """Search, contexts and checked answers over two standards."""
    one = stored(parsed(spark))
    other = one.filter("node_id = 'S:clause:5.2.1'")
    empty = F.array().cast("array<string>")
    other = other.withColumn("node_id", F.lit("T:clause:养护")).withColumn("num", F.lit("养护")).withColumn("standard_id", F.lit("T")).withColumn("standard_code", F.lit("DB11/T 2-2023")).withColumn("content", F.lit("混凝土养护时间不应少于七天。")).withColumn("keywords", empty).withColumn("refs", F.array().cast(io.REFS_TYPE)).withColumn("parent_id", F.lit(None).cast("string")).withColumn("child_ids", empty).withColumn("doc_id", F.lit("e")).withColumn("seq", F.col("seq") + F.lit(1 << 32))
    e = Engine(one.unionByName(other))
    q = spark.createDataFrame([(1, "5.2.1 怎么规定"), (2, "表5.1.2 的承载力"), (3, "混凝土养护时间")], "q_id long, question string")
    hits = e.search(q)
    blocks = e.contexts(hits)
    a = spark.createDataFrame([(1, "严禁拆除 JGJ/T 1-2020 [来源：第5.2.1条] 另见 GB 1-2000 [来源：第8.0.7条]"), (2, "取10 [来源：表5.1.2] [来源：第1.0.1条]"), (3, "材料中未规定")], "q_id long, answer string")
    a = a.withColumn("answer", F.when(F.col("q_id") == 1, F.concat(F.lit("[来源：附录B]"), "answer")).otherwise(F.col("answer")))
    verdicts = e.verify(a, blocks.filter("node_id <> 'S:appendix:B'"))
    top = hits.filter("rank = 1").select("q_id", F.lit("top").alias("what"), F.col("node_id").alias("value"))
    v = verdicts.select("q_id", F.col("verdict").alias("what"), F.concat_ws(" ", "type", "num", F.coalesce("standard_id", F.lit("-"))).alias("value"))
    b = badges(verdicts, a).select("q_id", F.lit("badges").alias("what"), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("cited", "secondary", "invalid", "refused"))).alias("value"))
    s = context.standards(e.nodes).agg(F.array_join(F.sort_array(F.collect_list("standard_code")), ",").alias("value")).select(F.lit(0).cast("long").alias("q_id"), F.lit("standards").alias("what"), "value")
    r = e.rows(spark.createDataFrame([(2, "A型承载力 10")], "q_id long, question string"), 1).select("q_id", F.lit("rows").alias("what"), F.col("row_text").alias("value"))
    return top.unionByName(v).unionByName(b).unionByName(s).unionByName(r)


@golden("q_id, id, via", [(1, "b", "h1"), (1, "d", "h2"), (1, "c", "h1"), (1, "f", "h2"), (2, "d", "h2"), (2, "f", "h2")])
def closure_rounds(spark, sf_dir):
    """Two hits take turns; a hit's targets only, no sections, nothing that is held."""
    hits = spark.createDataFrame([(1, "h1", 1, "clause"), (1, "h2", 2, "table"), (1, "s", 3, "section"), (2, "h2", 1, "table")], "q_id long, id string, rank int, type string")
    e = [("h1", "b", "clause"), ("h1", "c", "table"), ("h1", "h2", "clause"), ("h2", "b", "clause"), ("h2", "d", "appendix"), ("x", "h1", "clause"), ("s", "y", "clause"), ("h1", "z", "clause"), ("h2", "f", "contains")]
    types = [("b", "clause"), ("c", "table"), ("d", "appendix"), ("x", "clause"), ("y", "clause"), ("z", "section"), ("f", "formula"), ("h1", "clause"), ("h2", "table"), ("s", "section")]
    kept = [r for r in e if r[:2] != ("h2", "b")]
    return graph.closure(hits, spark.createDataFrame(kept, "src string, dst string, type string"), spark.createDataFrame(types, "id string, type string"), ["clause", "table", "appendix"])


@golden("q_id, place, node_id", [(1, 1, "c1"), (1, 2, "c2"), (1, 3, "t1"), (1, 4, "p1")])
def context_choice(spark, sf_dir):
    """Direct hits by type and score, those of half the first one's at least; a parent follows, an item of a clause that is in and a block
    that does not fit go (C1 to C6)."""
    nodes = spark.createDataFrame([("c1", "clause", "s", 1), ("c2", "clause", "s", 2), ("c3", "clause", "s", 3), ("t1", "table", "c2", 4), ("i1", "item", "c1", 5), ("f1", "formula", "p1", 6), ("p1", "clause", "s", 7), ("s", "section", None, 8)], "node_id string, type string, parent_id string, seq long")
    hits = spark.createDataFrame([(1, "c1", 0.03, 1), (1, "c2", 0.02, 2), (1, "t1", 0.016, 3), (1, "c3", 0.01, 4), (1, "s", 0.02, 5), (1, "i1", 0.0, 6), (1, "f1", 0.0, 7)], "q_id long, node_id string, score double, rank int")
    placed = context.core_and_rest(context.with_parents(hits, nodes))
    texts = spark.createDataFrame([("c1", "x" * 50), ("c2", "x" * 20), ("t1", "x" * 10), ("p1", "x" * 10), ("f1", "x" * 200), ("i1", "x")], "node_id string, text string")
    return context.fill(placed.join(texts, "node_id"), 100).select("q_id", "place", "node_id")


@golden("name, value", [("page_numbers", "正文"), ("explanations", "2,3"), ("body_size", "14.0"), ("clusters", "0-100"), ("source", "5.1.1:false|5.1.2:true"), ("cases", "c1:x:|c2::650mm"), ("distribution", "fact:易:是:2"), ("band", "10.0:290.0"), ("continued", "6.2.4"), ("notes", "注：可内插。|续行")])
def page_rules(spark, sf_dir):
    """Rules of pages and of gold sets on literals."""
    row = lambda name, d: d.toDF("x").agg(F.array_join(F.sort_array(F.collect_list(F.col("x").cast("string"))), "|" if name in ("source", "cases", "notes") else ",").alias("value")).select(F.lit(name).alias("name"), "value")
    lines = spark.createDataFrame([("12", 790.0, 842.0), ("正文", 100.0, 842.0)], "text string, top double, height double")
    notes = spark.createDataFrame([("d", 1, "附：条文说明 ........ 30"), ("d", 2, "条 文 说 明"), ("d", 3, "5.1.1 说明")], "doc_id string, page int, text string")
    chars = spark.createDataFrame([("d", 1, s) for s in (10.0, 14.0, 14.0)], "doc_id string, page int, size double")
    box = "x0 double, top double, x1 double, bottom double"
    drawn = spark.createDataFrame([("d", 1, 0.0, 0.0, 50.0, 80.0), ("d", 1, 60.0, 0.0, 100.0, 80.0), ("d", 1, 300.0, 0.0, 340.0, 80.0)], f"doc_id string, page int, {box}")
    page = spark.createDataFrame([("d", 1, 595.0, 842.0)], "doc_id string, page int, width double, height double")
    text = spark.createDataFrame([(1, "5.1.1 立杆\n5.1.2）引用")], "page int, text string")
    cases = spark.createDataFrame([("c1", "fact", "易", "是", "无数字", ["x"]), ("c2", "fact", "易", "是", "间距650mm", ["n"])], "id string, type string, difficulty string, answerable string, answer_gold string, evidence array<string>")
    nodes = spark.createDataFrame([("n", "不大于500mm，共650根")], "node_id string, content string")
    broken = spark.createDataFrame([("d", 1, 0, "长度（图", 1.0, 2.0, 1.0, 2.0), ("d", 1, 1, "6.2.4）不应", 1.0, 3.0, 3.0, 4.0)], layout.LINE)
    table = spark.createDataFrame([("d", 1, 0, 200.0)], "doc_id string, page int, table_no int, bottom double")
    under = spark.createDataFrame([("d", 1, i, t, 210.0 + 20 * i) for i, t in enumerate(["正文", "注：可内插。", "续行", "5.1.3 条文", "注：别的"])], "doc_id string, page int, seq int, text string, top double")
    checked = quality.check_cases(cases, nodes)
    parts = [
        ("page_numbers", structure.without_page_numbers(lines).select("text")), ("explanations", structure.explanation_pages(notes).select("page")), ("body_size", structure.body_size(chars).select("body_size")), ("clusters", layout.graphic_clusters(drawn, page).select(F.concat(F.col("x0").cast("int"), F.lit("-"), F.col("x1").cast("int")))),
        ("source", quality.source_clauses(text).select(F.concat_ws(":", "num", F.col("quoted").cast("string")))), ("cases", checked.select(F.concat_ws(":", "id", F.array_join("missing", ","), F.array_join("absent", ",")))), ("distribution", quality.distribution(cases).select(F.concat_ws(":", "type", "difficulty", "answerable", F.col("n").cast("string")))),
        ("band", layout.highlight_band(spark.createDataFrame([("d", 1, 100.0, 200.0)], "doc_id string, page int, top double, bottom double")).select(F.concat_ws(":", F.col("from_top").cast("string"), F.col("to_bottom").cast("string")))), ("continued", structure.repair_broken_lines(broken).select(F.regexp_extract("text", r"（图([0-9.]+)）", 1))), ("notes", structure.table_notes(table, under).select(F.array_join("notes", "|"))),
    ]
    out = None
    for name, d in parts:
        r = row(name, d)
        out = r if out is None else out.unionByName(r)
    return out
