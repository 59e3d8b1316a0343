"""A small standard from characters to linked nodes, and an engine over two standards."""

import random

import pytest
from pyspark.sql import functions as F

from loamstack.operators import graph, structure
from loamstack.plans import ingest
from loamstack.plans.engine import Engine
from loamstack.sources import io

CENTRE, LEFT = 250.0, 70.0
PAGES = [
    [("目次", CENTRE), ("5 结构设计 ............ 13", LEFT), ("附录B 取值 ……………… 40", LEFT)],
    [("前言部分的说明文字没有编号", LEFT), ("5 结构设计", CENTRE), ("5.1 一般规定", CENTRE), ("5.1.1 立杆的计算应符合下列规定：", LEFT), ("1 应按第5.1.2条计算", LEFT), ("并应符合表5.1.2的要求；", LEFT), ("3 不是第二款的行", LEFT), ("2 必须设置斜杆。", LEFT), ("12", CENTRE)],
    [("3 跨页续接的第三款。", LEFT), ("5.1.2 稳定性应按下式计算（图", LEFT), ("6.2.4）的规定采用：", LEFT), ("N/φA≤f", 200.0), ("（5.1.2-1）", 400.0), ("式中：φ——稳定系数；N——轴力（kN）；", LEFT), ("表5.1.2 承载力", CENTRE), None, ("注：表中数值可内插。", LEFT), ("5.1.2 续表之后的条文应继续执行。", LEFT)],
    [("5.2 构造要求", CENTRE), ("5.2.1 严禁拆除斜杆，详见附录B和GB 50009。", LEFT), ("1—立杆；2－斜杆", LEFT), ("附录B 立杆取值", CENTRE), ("B.0.1 系数应按本条给出的数值采用。", LEFT)],
    [("附：条文说明", CENTRE)],
    [("5 结构设计", CENTRE), ("5.1.1~5.1.2 这两条明确了计算方法。", LEFT), ("5.2.1条给出的是引用。", LEFT), ("5.2.1、对拆除的限制。", LEFT)],
]
TABLE = [["类别", "承载力（kN）", ""], ["", "单排", "双排"], ["A型", "10", "20"], ["", "30", "40"]]


def page_chars():
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
    return chars, cells


@pytest.fixture(scope="module")
def nodes(spark):
    chars, cells = page_chars()
    random.Random(1).shuffle(chars)
    box = "x0 double, x1 double, top double, bottom double"
    c = spark.createDataFrame(chars, io.CHAR).repartition(5)
    p = spark.createDataFrame([("d", i, 595.0, 842.0) for i in range(1, len(PAGES) + 1)], "doc_id string, page int, width double, height double")
    g = spark.createDataFrame([], "doc_id string, page int, x0 double, top double, x1 double, bottom double")
    k = spark.createDataFrame(cells, f"doc_id string, page int, table_no int, r int, c int, {box}")
    return ingest.parse(c, p, k, g, ingest.Standard("S", "JGJ/T 1-2020", "规范", "2020", 10)).cache()


def test_nodes_of_pages(nodes):
    got = [(r["node_id"], r["parent_id"], r["pages"], r["status_reason"]) for r in nodes.orderBy("seq").collect()]
    # text without a number joins the clause in force, so the title page of the explanations does too
    assert got == [
        ("S:preamble:seq0001", None, [11], None), ("S:preamble:seq0002", None, [12], None), ("S:chapter:5", None, [12], None), ("S:section:5.1", "S:chapter:5", [12], None),
        ("S:clause:5.1.1", "S:section:5.1", [12, 13], "cross_page_clause"), ("S:item:5.1.1-1", "S:clause:5.1.1", [12], None), ("S:item:5.1.1-2", "S:clause:5.1.1", [12], None), ("S:item:5.1.1-3", "S:clause:5.1.1", [13], None),
        ("S:clause:5.1.2", "S:section:5.1", [13], "split_by_table"), ("S:formula:5.1.2-1", "S:clause:5.1.2", [13], "formula_linear_only"), ("S:table:5.1.2", "S:clause:5.1.2", [13], None),
        ("S:section:5.2", "S:chapter:5", [14], None), ("S:clause:5.2.1", "S:section:5.2", [14], None), ("S:appendix:B", None, [14], None), ("S:clause:B.0.1", "S:appendix:B", [14, 15], "cross_page_clause"),
        ("S:explanation:5.1.1", "S:appendix:B", [16], None), ("S:explanation:5.2.1", "S:appendix:B", [16], None),
    ]
    assert nodes.select("node_id", F.explode(structure.problems()).alias("p")).filter("node_id NOT LIKE '%preamble%'").collect() == []


def test_contents_and_links(nodes):
    n = {r["node_id"]: r for r in nodes.collect()}
    assert n["S:clause:5.1.1"]["content"] == "5.1.1 立杆的计算应符合下列规定：\n1 应按第5.1.2条计算\n并应符合表5.1.2的要求；\n3 不是第二款的行\n2 必须设置斜杆。\n3 跨页续接的第三款。"
    assert n["S:item:5.1.1-1"]["content"] == "1 应按第5.1.2条计算\n并应符合表5.1.2的要求；\n3 不是第二款的行" and n["S:item:5.1.1-1"]["keywords"] == ["5.1.1-1", "5.1.1"]
    assert n["S:clause:5.1.2"]["content"].startswith("5.1.2 稳定性应按下式计算（图6.2.4）的规定采用：") and n["S:clause:5.1.2"]["content"].endswith("\n5.1.2 续表之后的条文应继续执行。")
    formula = n["S:formula:5.1.2-1"]["body"]
    assert (formula["linear_text"], [tuple(v) for v in formula["variables"]]) == ("N/φA≤f\n（5.1.2-1）", [("φ", "稳定系数", None), ("N", "轴力（kN）", "kN")])
    assert n["S:formula:5.1.2-1"]["content"] == "式（5.1.2-1） φ=稳定系数；N=轴力（kN）"
    table = n["S:table:5.1.2"]["body"]
    assert (table["title"], table["header_rows"], table["header_flat"], table["rows"][3], table["fill_down"], table["notes"], table["units"]) == ("表5.1.2 承载力", 2, ["类别", "承载力（kN）-单排", "承载力（kN）-双排"], ["A型", "30", "40"], True, ["注：表中数值可内插。"], "kN")
    assert n["S:table:5.1.2"]["content"].startswith("表5.1.2 承载力\n类别=A型；承载力（kN）-单排=10；承载力（kN）-双排=20")
    assert n["S:clause:5.2.1"]["modality"] == "严禁" and n["S:clause:5.2.1"]["keywords"] == ["5.2.1", "第5.2.1条", "5.2"]
    assert [(r["target_display"], r["in_scope"]) for r in n["S:clause:5.2.1"]["refs"]] == [("附录B", True), ("GB 50009", False)]
    assert n["S:clause:5.1.2"]["referenced_by"] == ["S:clause:5.1.1", "S:item:5.1.1-1"] and n["S:appendix:B"]["child_ids"] == ["S:clause:B.0.1", "S:explanation:5.1.1", "S:explanation:5.2.1"]
    assert n["S:explanation:5.1.1"]["explains"] == ["S:clause:5.1.1", "S:clause:5.1.2"] and n["S:clause:5.1.2"]["explained_by"] == ["S:explanation:5.1.1"]
    assert n["S:explanation:5.1.1"]["content"] == "5.1.1~5.1.2 这两条明确了计算方法。\n5.2.1条给出的是引用。"
    assert (n["S:clause:5.2.1"]["chapter"], n["S:clause:5.2.1"]["section"], n["S:clause:5.2.1"]["path"]) == ("5 结构设计", "5.2 构造要求", "5 结构设计 / 5.2 构造要求")


def test_two_standards(spark, nodes, tmp_path):
    """Equal numbers in two standards stay apart, files keep their order, a bare number means the first standard."""
    other = nodes.withColumn("content", F.when(F.col("type") == "clause", F.concat(F.lit("混凝土养护"), F.col("content"))).otherwise(F.col("content")))
    for c in ("node_id", "parent_id"):
        other = other.withColumn(c, F.regexp_replace(c, "^S:", "T:"))
    other = other.withColumn("standard_id", F.lit("T")).withColumn("standard_code", F.lit("DB11/T 2-2023")).withColumn("doc_id", F.lit("e"))
    ref = F.transform("refs", lambda r: r.withField("target_node_id", F.regexp_replace(r["target_node_id"], "^S:", "T:")))
    other = other.withColumn("refs", ref).withColumn("child_ids", F.transform("child_ids", lambda c: F.regexp_replace(c, "^S:", "T:")))
    paths = [f"file://{tmp_path}/{x}" for x in "ab"]
    for path, d in zip(paths, (nodes, other), strict=True):
        io.write_nodes(d.repartition(4), path)
    back = io.read_nodes(spark, *paths)
    want = [r["node_id"] for d in (nodes, other) for r in d.orderBy("seq").collect()]
    assert [r["node_id"] for r in back.orderBy("seq").collect()] == want and back.select("seq").distinct().count() == len(want)
    e = Engine(back)
    q = spark.createDataFrame([(1, "5.2.1 怎么规定"), (2, "混凝土养护")], "q_id long, question string")
    hits = e.search(q).collect()
    ranked = {i: [r["node_id"] for r in sorted((r for r in hits if r["q_id"] == i and r["rank"]), key=lambda r: r["rank"])] for i in (1, 2)}
    assert ranked[1][0] == "S:clause:5.2.1" and all(len(v) == len(set(v)) <= 10 for v in ranked.values())
    assert all(x.startswith("T:") for x in ranked[2][:3])
    assert sorted(r["rank"] for r in hits if r["q_id"] == 1 and r["rank"]) == list(range(1, len(ranked[1]) + 1))
    assert e.health()["standards"] == ["DB11/T 2-2023", "JGJ/T 1-2020"]
    by = {r["node_id"]: r["via_graph"] for r in hits if r["via_graph"]}
    assert all(v in ranked[1] + ranked[2] for v in by.values())
    with pytest.raises(ValueError):
        Engine(back.withColumn("seq", F.lit(1)))
    vectors = Engine(back, embed=lambda texts: [[float("混凝土" in t), float("严禁" in t), 1.0] for t in texts])
    top = vectors.search(q.filter("q_id = 2")).filter("vector_rank = 1").first()
    assert top["node_id"].startswith("T:clause") and vectors.cache.count() > 0
    rows = e.rows(spark.createDataFrame([(1, "A型双排承载力是多少")], "q_id long, question string")).orderBy("rank").collect()
    assert rows and "A型" in rows[0]["row_text"]


def replay(hits, edges, types, kinds, budget, held):
    """The rounds on plain lists."""
    seeds = [h for h, t in hits if t not in ("chapter", "section")]
    out, went = [], True
    while went and len(out) < budget:
        went = False
        for s in seeds:
            free = sorted(d for a, d, k in edges if a == s and k in kinds and d not in held and types.get(d) not in ("chapter", "section", None))
            if free and len(out) < budget:
                out.append((free[0], s))
                held = held | {free[0]}
                went = True
    return out


def test_closure_like_rounds(spark):
    r = random.Random(5)
    for _ in range(6):
        types = {f"n{i}": r.choice(["clause", "clause", "table", "appendix", "section"]) for i in range(25)}
        edges = {(a, b): r.choice(["clause", "table", "contains", "appendix"]) for a, b in ((f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(60)) if a != b}
        edges = [(a, b, k) for (a, b), k in edges.items()]
        hits = [(n, types[n]) for n in r.sample(sorted(types), 6)]
        held = {n for n, _ in hits}
        first = replay(hits, edges, types, {"clause", "table", "appendix"}, 5, held)
        want = first + replay(hits, edges, types, {"contains"}, 4, held | {x for x, _ in first})
        h = spark.createDataFrame([(1, n, i + 1, t) for i, (n, t) in enumerate(hits)], "q_id long, id string, rank int, type string")
        got = graph.closure(h, spark.createDataFrame(edges, "src string, dst string, type string"), spark.createDataFrame(list(types.items()), "id string, type string"), ["clause", "table", "appendix"])
        assert sorted((x["id"], x["via"]) for x in got.collect()) == sorted(want)


def test_assessment(spark, nodes):
    from loamstack.plans.assess import assess, render

    pages = spark.createDataFrame([(12, "5.1.1 立杆\n5.1.2 稳定性"), (14, "5.2.1 严禁\n5.2.2 漏切的条文\n5.1.1条引用")], "page int, text string")
    r = assess(nodes, pages)
    assert (r["nodes"], r["types"]["clause"], r["types"]["item"], r["invalid"], r["sections"], r["gaps"]) == (17, 4, 3, 0, 3, 0)
    assert r["reviews"] == {"cross_page_clause": 2, "split_by_table": 1, "formula_linear_only": 1} and r["source"] == {"clauses": 4, "missing": 1, "extra": 0}
    assert (r["dangling"], r["dangling_first"]) == (1, [("S:clause:5.1.2", "图6.2.4")]) and r["refs"] == {"refs": 7, "inside": 5, "outside": 2}
    assert r["score"] == round(40 * 0.75 + 25 + 15 * 5 / 7 + 20, 1) and r["missing_first"] == [("5.2.2",)]
    assert "综合分" in render(r, "解析质量") and "5.2.2" in render(r, "解析质量")
    gap = assess(nodes.filter("node_id <> 'S:clause:5.1.1'"))
    assert gap["gaps"] == 1 and gap["gaps_first"][0][:3] == ("S", "5.1", [1]) and "source" not in gap
