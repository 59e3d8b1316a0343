"""Operators on literals: tables, structure, graph, context, citations, layout, sources and the engine."""

import pytest
from pyspark.sql import functions as F

from loamstack.functions import text as X
from loamstack.operators import context, graph, layout, quality, ranking, structure, tables
from loamstack.plans.engine import Engine, badges, boxes_by_page, compare_rankings
from loamstack.sources import embedders, io, services
from loamstack.streaming import answers


def grid(spark, rows, key="t"):
    return spark.createDataFrame([(key, rows)], "tab string, rows array<array<string>>")


def test_header_rows_flat_and_fill(spark):
    d = grid(spark, [["类别", "连墙件布置", ""], ["", "2步3跨", "3步3跨"], ["双排架", "1.45", "1.70"], ["", "1.5", ""]])
    assert d.select(tables.header_rows("rows")).first()[0] == 2
    long = tables.cells(d.withColumn("h", F.lit(2)), "tab").withColumn("header_rows", F.lit(2))
    assert [r["name"] for r in tables.flat_header(long, "tab").orderBy("c").collect()] == ["类别", "连墙件布置-2步3跨", "连墙件布置-3步3跨"]
    filled = {(r["r"], r["c"]): r["v"] for r in tables.fill_down(long, "tab", 2).collect()}
    assert (filled[3, 0], filled[3, 2], filled[3, 1]) == ("双排架", "1.70", "1.5")


def test_proxy_text(spark):
    d = grid(spark, [["类别", "a", "b"], ["双排架", "1.45", "1.70"]])
    assert d.select(tables.proxy_text(F.lit("表"), "rows")).first()[0] == "表\n类别=双排架；a=1.45；b=1.70"
    d = grid(spark, [["搭设高度H(m)", "H≤8", "8<H≤16"], ["βH", "1.00", "1.05"]])
    assert d.select(tables.proxy_text(F.lit(""), "rows")).first()[0] == "搭设高度H(m)：βH=1.00（H≤8）；1.05（8<H≤16）"


def test_table_kinds(spark):
    kind = lambda title, rows: grid(spark, rows).select(tables.table_kind(F.lit(title), "rows")).first()[0]
    assert kind("验收记录表", [["a"]]) == "template"
    assert kind("x", [["λ", "0"], ["0", "1"], ["10", "2"], ["20", "3"]]) == "lookup"
    assert kind("x", [["n", "v"], ["a", "1"], ["b", "2"], ["c", "3"]]) == "grid"


def test_digit_grid_brief_and_nearest(spark):
    rows = [["λ", *map(str, range(10))]] + [[str(10 * t), *(f"{1 - (10 * t + u) / 1000:.3f}" if t < 25 or u == 0 else "—" for u in range(10))] for t in range(26)]
    long = tables.cells(grid(spark, rows), "tab")
    names = long.filter("r = 0").select("tab", "c", F.col("v").alias("name"))
    got = tables.digit_grid(long.filter("r > 0"), names, "tab").cache()
    assert got.count() == 251
    text = tables.brief(got, "tab").first()["text"]
    assert text.startswith("按λ取值（λ 范围 0~250，共 251 个值）\nλ=0 → φ=1.000；λ=62 → φ=0.938；λ=125 → φ=0.875；λ=250 → φ=0.750")


def test_lookup_nearest_range(spark):
    lookup = spark.createDataFrame([("t", k, str(k)) for k in (0, 10, 20)], "tab string, k int, value string")
    asked = spark.createDataFrame([("t", w) for w in (0, 5, 16, 25, 26, -5, -6)], "tab string, want int")
    got = {r["want"]: (r["k"], r["exact"]) for r in tables.lookup_nearest(lookup, asked, "tab").collect()}
    assert got == {0: (0, True), 5: (0, False), 16: (20, False), 25: (20, False), -5: (0, False)}


def test_row_lookup(spark):
    rows = [["名称", "型号", "重", ""], ["立杆", "Z-LG-500", "3.75", "x"], ["", "Z-LG-1000", "6.65", "y"], ["立杆", "Z-LG-500", "3.80", "z"]]
    long = tables.cells(grid(spark, rows), "tab")
    names = long.filter("r = 0").select("tab", "c", F.col("v").alias("name"))
    got = {(r["k"], r["attr"]): r["value"] for r in tables.row_lookup(long.filter("r > 0"), names, "tab").collect()}
    assert got == {("Z-LG-500", "重"): "3.80", ("Z-LG-1000", "重"): "6.65"}


def test_grade_gate(spark):
    q = spark.createDataFrame([(1, "Q235 长细比 62 轴心受压稳定系数"), (2, "Q355 长细比 62 轴心受压稳定系数")], "q_id long, question string")
    t = spark.createDataFrame([("n", 1, "Q355 钢管轴心受压构件稳定系数")], "node_id string, seq int, title string")
    lookup = spark.createDataFrame([("n", "62", "0.81", "digit_grid"), ("n", "63", "0.8", "digit_grid")], "node_id string, k_text string, value string, layout string")
    assert [(r["q_id"], r["key"], r["value"], r["exact"]) for r in tables.probe(q, t, lookup).collect()] == [(2, "62", "0.81", True)]


def test_store_rows_last_of_equal_names(spark):
    body = "struct<title:string,rows:array<array<string>>,header_rows:int,header_flat:array<string>,notes:array<string>,markdown_flat:string>"
    d = spark.createDataFrame([("n", "1", [3], ("t", [["a", "b", "a"], ["1", "", "2"]], 1, ["a", "b", "a"], [], ""))], f"node_id string, num string, pages array<int>, body {body}")
    r = tables.store_rows(d)[0].first()
    assert r["cells"] == {"a": "2", "b": ""} and r["row_text"] == "a=2"


def test_items_follow_on(spark):
    f = lambda s: [tuple(i) for i in spark.createDataFrame([(s,)], "t string").select(structure.items("t")).first()[0]]
    assert f("应符合下列规定：\n1 第一\n续\n3 不是\n2 第二") == [(1, "1 第一\n续\n3 不是"), (2, "2 第二")]
    assert f("1.0.3 应符合下列规定：\n1 第一\n2.0.1 条文\n2 第二") == [(1, "1 第一\n2.0.1 条文"), (2, "2 第二")]
    assert f("没有列表\n1 第一") == []


def test_parents_like_a_stack(spark):
    import random

    level = {"preamble": 0, "chapter": 1, "section": 2, "clause": 3, "item": 4, "table": 3, "figure": 3, "formula": 3, "explanation": 3, "appendix": 1}
    r, rows, want = random.Random(3), [], {}
    for doc in range(12):
        stack, clause = [], None
        for seq in range(40):
            kind = r.choice(sorted(level))
            nid = f"{doc}:{seq}"
            if kind in ("table", "figure", "formula"):
                want[nid] = clause
            else:
                while stack and stack[-1][1] >= level[kind]:
                    stack.pop()
                want[nid] = stack[-1][0] if stack else None
                if kind in ("chapter", "section", "clause", "appendix"):
                    stack.append((nid, level[kind]))
                clause = nid if kind == "clause" else clause
            rows.append((str(doc), seq, nid, kind, level[kind]))
    d = spark.createDataFrame(rows, "doc_id string, seq int, node_id string, type string, level int").repartition(7)
    assert {x["node_id"]: x["parent_id"] for x in structure.parents(d).collect()} == want


def test_broken_lines_join(spark):
    d = spark.createDataFrame([("d", 1, 0, "长度（图", 1.0, 2.0, 1.0, 2.0), ("d", 1, 1, "6.2.4）不应", 1.0, 3.0, 3.0, 4.0), ("d", 1, 2, "下一行", 1.0, 2.0, 5.0, 6.0)], layout.LINE)
    assert [r["text"] for r in structure.repair_broken_lines(d).orderBy("seq").collect()] == ["长度（图6.2.4）不应", "下一行"]


def test_merge_across_pages(spark):
    rows = [("d", 1, 1, "表1", 50.0, 300.0, 600.0, 740.0, [["a"]]), ("d", 2, 2, None, 52.0, 301.0, 60.0, 200.0, [["b"]]), ("d", 2, 3, None, 52.0, 301.0, 300.0, 400.0, [["c"]])]
    d = spark.createDataFrame(rows, "doc_id string, page int, table_no int, title string, x0 double, x1 double, top double, bottom double, rows array<array<string>>")
    got = structure.merge_across_pages(d).orderBy("table_no").collect()
    assert [(r["table_no"], r["rows"], r["pages"]) for r in got] == [(1, [["a"], ["b"]], [1, 2]), (3, [["c"]], [2])]


def test_continuations(spark):
    rows = [("d", 1, 1, "5.1.1", "a"), ("d", 2, 2, None, "b"), ("d", 3, 2, "5.1.1", "c"), ("d", 4, 2, "5.1.2", "e")]
    got = structure.merge_continuations(spark.createDataFrame(rows, "doc_id string, seq int, page int, num string, text string")).orderBy("seq").collect()
    assert [(r["num"], r["text"], r["status_reason"]) for r in got] == [("5.1.1", "a\nb\nc", "split_by_table"), ("5.1.2", "e", None)]


def test_layout_lines_cells_and_figures(spark):
    chars = [("d", 1, c, 10.0 * i, 10.0 * i + 8, 100.0 + d, 110.0 + d, 10.0) for i, (c, d) in enumerate([("图", 0), ("1", 1), ("架", -1)])] + [("d", 1, "x", 0.0, 8.0, 130.0, 140.0, 10.0)]
    c = spark.createDataFrame(chars, io.CHAR).repartition(3)
    lines = layout.page_lines(c)
    assert [r["text"] for r in lines.orderBy("seq").collect()] == ["图1架", "x"]
    cells = spark.createDataFrame([("d", 1, 0, 0, 0, 0.0, 40.0, 95.0, 145.0)], "doc_id string, page int, table_no int, r int, c int, x0 double, x1 double, top double, bottom double")
    assert layout.cell_text(c, cells).first()["v"] == "图1架 / x"
    g = spark.createDataFrame([("d", 1, 0.0, 0.0, 50.0, 80.0), ("d", 1, 55.0, 0.0, 100.0, 80.0)], "doc_id string, page int, x0 double, top double, x1 double, bottom double")
    p = spark.createDataFrame([("d", 1, 600.0, 800.0)], "doc_id string, page int, width double, height double")
    figure = layout.group_figures(layout.graphic_clusters(g, p), lines).first()
    assert (figure["num"], figure["title"], figure["part_count"], figure["x1"], figure["top"], figure["bottom"]) == ("1", "图1 架", 1, 100.0, 0.0, 111.0)
    box = spark.createDataFrame([("d", 1, 1.0, 2.0)], "doc_id string, page int, x0 double, top double")
    assert layout.group_figures(layout.graphic_clusters(g, p), lines, box).count() == 0
    # the third touches the first cluster only, which was closed to the second; nothing merges clusters
    far = spark.createDataFrame([("d", 1, 0.0, 0.0, 100.0, 80.0), ("d", 1, 5.0, 200.0, 100.0, 280.0), ("d", 1, 10.0, 80.0, 60.0, 190.0), ("d", 1, 20.0, 30.0, 20.0, 90.0)], "doc_id string, page int, x0 double, top double, x1 double, bottom double")
    assert [(r["top"], r["bottom"]) for r in layout.graphic_clusters(far, p).orderBy("cluster").collect()] == [(0.0, 190.0), (200.0, 280.0)]
    # a character that sticks out of the cell is not in it; a row is found again after a character of another
    cell = spark.createDataFrame([("d", 1, 0, 0, 0, 0.0, 27.0, 95.0, 145.0)], "doc_id string, page int, table_no int, r int, c int, x0 double, x1 double, top double, bottom double")
    assert layout.cell_text(c, cell).first()["v"] == "图1 / x"
    assert layout.highlight_band(g).first()["to_bottom"] == 170.0


def test_take_in_rounds(spark):
    d = spark.createDataFrame([([["a", "b"], ["a", "c"], ["d"]], ["d"])], "l array<array<string>>, h array<string>")
    assert d.select(graph.take_in_rounds(F.col("l"), 3, F.col("h"))).first()[0] == ["a", "c", "b"]


def test_budget_skips(spark):
    assert spark.range(1).select(context.within_budget(F.array(*(F.lit(x).cast("long") for x in (5, 9, 4, 1))), 10)).first()[0] == [True, False, True, True]


def test_citations_and_verdicts(spark):
    a = spark.createDataFrame([(1, "见 JGJ/T 231-2021 规定 [来源：第8.0.7条] 另 DB11/T 2100-2023 [来源：第8.0.7条、表5.1.9] GB 50009-2012 [来源：第1.1.1条] [来源：条文说明4.4.4]")], "q_id long, answer string")
    codes = spark.createDataFrame([("JGJ/T 231-2021", "J"), ("DB11/T 2100-2023", "D")], "standard_code string, standard_id string")
    cites = context.attributed(context.citations(a), a, codes)
    lists = spark.createDataFrame([(1, "J", "clause", "8.0.7"), (1, "D", "table", "5.1.9")], "q_id long, standard_id string, type string, num string")
    got = {(r["standard_id"], r["type"], r["num"]): r["verdict"] for r in context.verdicts(cites, lists.filter("type = 'clause'"), lists.filter("type = 'table'")).collect()}
    assert got == {("J", "clause", "8.0.7"): "cited", ("D", "clause", "8.0.7"): "invalid", ("D", "table", "5.1.9"): "secondary", (None, "clause", "1.1.1"): "invalid", (None, "explanation", "4.4.4"): "invalid"}


def test_numbering_and_cases(spark):
    n = quality.numbering(spark.createDataFrame([("a", 1), ("a", 3), ("a", 3)], "g string, n int"), ["g"], "n").first()
    assert (n["missing"], n["repeated"]) == ([2], [3])
    cases = spark.createDataFrame([("c1", "fact", "间距650mm", ["x"]), ("c2", "enum", "9", [])], "id string, type string, answer_gold string, evidence array<string>")
    nodes = spark.createDataFrame([("x", "不大于650 mm")], "node_id string, content string")
    assert {r["id"]: (r["missing"], r["absent"]) for r in quality.check_cases(cases, nodes).collect()} == {"c1": ([], []), "c2": ([], [])}


def sample_nodes(spark):
    rows = [("chapter", "5", "结构设计计算规定"), ("section", "5.1", "一般规定与基本要求"), ("clause", "5.1.1", "立杆稳定性应按附录B的规定计算，并应符合第5.1.2条的要求。"), ("clause", "5.1.2", "立杆间距不应大于650mm，斜杆应按规定布置。"), ("appendix", "B", "附录B 立杆稳定系数的规定与取值"), ("clause", "B.0.1", "稳定系数应按长细比采用本条给出的数值。")]
    els = spark.createDataFrame([("d", i, k, n, t) for i, (k, n, t) in enumerate(rows)], "doc_id string, seq int, kind string, num string, text string")
    els = structure.context_columns(els).withColumn("pages", F.array(F.lit(1))).withColumn("bboxes", F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("bottom")))).withColumn("body", F.lit(None).cast(io.BODY_TYPE))
    n = structure.parents(structure.build_nodes(els, "S", "JGJ/T 1-2020", "规范", "v1"))
    refs, back = structure.resolve_refs(n)
    empty = F.array().cast("array<string>")
    n = n.drop("refs").join(refs, "node_id", "left").withColumn("refs", F.coalesce("refs", F.array().cast(io.REFS_TYPE))).join(back, "node_id", "left").withColumn("referenced_by", F.coalesce("referenced_by", empty))
    return n.join(structure.children(n), "node_id", "left").withColumn("child_ids", F.coalesce("child_ids", empty)).withColumn("explains", empty).withColumn("explained_by", empty)


def test_nodes_are_valid_and_engine_answers(spark, tmp_path):
    nodes = io.stored(sample_nodes(spark))
    assert nodes.select(F.explode(structure.problems())).collect() == []
    assert {r["node_id"]: r["parent_id"] for r in nodes.collect()}["S:clause:5.1.1"] == "S:section:5.1"
    assert structure.summary(nodes).filter("what = 'refs' AND name = 'in_scope'").first()["n"] == 3
    path = f"file://{tmp_path}/nodes"
    assert io.write_nodes(nodes.select(*io.NODE_TYPES), path) == 6 == io.count_nodes(spark, path)
    back = io.read_nodes(spark, path)
    assert back.count() == 6
    nodes = back.cache()  # as an engine gets them: from files
    e = Engine(nodes)
    q = spark.createDataFrame([(1, "立杆稳定性怎么计算"), (2, "5.1.2 的间距")], "q_id long, question string")
    hits = e.search(q)
    got = [(r["q_id"], r["node_id"], r["via_graph"]) for r in hits.orderBy("q_id", F.col("rank").asc_nulls_last()).collect()]
    assert (1, "S:clause:5.1.1") in [x[:2] for x in got] and [x for x in got if x[0] == 2][0][1] == "S:clause:5.1.2"
    blocks = e.contexts(hits)
    assert blocks.filter("q_id = 1").count() >= 2
    a = spark.createDataFrame([(1, "应计算 [来源：第5.1.1条] [来源：第9.9.9条]")], "q_id long, answer string")
    v = e.verify(a, blocks)
    assert {r["num"]: r["verdict"] for r in v.collect()} == {"5.1.1": "cited", "9.9.9": "invalid"}
    assert badges(v, a).first()["invalid"] == 1
    assert e.health()["nodes"] == 6 and e.node("S:clause:5.1.1")["modality"] == "应"
    assert compare_rankings(e, q).filter("method = 'hybrid'").count() > 0
    got = dict(e.ask("立杆稳定性怎么计算"))
    assert "S:clause:5.1.1" in got["meta"]["blocks"] and {c["verdict"] for c in got["done"]["citations"]} == {"cited"}
    assert boxes_by_page(nodes).count() == 6


def test_answer_stream():
    calls = []

    def flaky(messages):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("x")
        yield from answers.extract(messages)

    got = list(answers.decode("".join(answers.encode(answers.events([{"content": "【第5.1.1条】\n应计算。"}], flaky, lambda a: {"n": len(a)})))))
    assert [n for n, _ in got] == ["meta", "retry", "delta", "done"] and "第5.1.1条" in got[-1][1]["answer"]
    assert [n for n, _ in answers.events([{"content": ""}], answers.extract, lambda a: {})] == ["meta", "retry", "error"]


def test_sources(spark, tmp_path):
    t = spark.createDataFrame([("a",), ("a",), ("b",)], "content string")
    key = t.select(F.substring(F.sha1(F.col("content").cast("binary")), 1, 16).alias("key")).filter(F.lit(True)).limit(1)
    assert io.missing_embeddings(t, key).count() == 1
    assert embedders.embed_with(t, "content", "content", lambda x: [[float(len(v))] for v in x]).count() == 3
    assert embedders.choose(None) == "hashed" and embedders.choose(lambda: True) == "service"
    assert io.ascii_table([["列", "b"], ["1", "2"]]).splitlines()[1] == "| 列 | b |"
    assert "| a" in io.report("x", t.groupBy("content").count())
    (tmp_path / "m.json").write_text('{"standards": [{"standard_id": "J", "node_count": 3}]}')
    assert io.read_manifest(spark, f"file://{tmp_path}/m.json").first()["node_count"] == 3
    cases = spark.createDataFrame([("c", ["x", "y"])], "id string, evidence array<string>")
    io.write_cases(cases, f"file://{tmp_path}/cases")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/cases/csv").first()["evidence"] == "x;y"


def test_formulas(spark):
    lines = [("d", 1, 0, "按下式计算", 50.0, 500.0), ("d", 1, 1, "N/φA≤f", 50.0, 200.0), ("d", 1, 2, "(5.3.3-1)", 400.0, 450.0), ("d", 1, 3, "λ=l/i (5.3.3-2)", 50.0, 200.0)]
    got = structure.formula_regions(spark.createDataFrame(lines, "doc_id string, page int, seq int, text string, x0 double, x1 double")).orderBy("seq").collect()
    assert [(r["num"], r["text"]) for r in got] == [("5.3.3-1", "N/φA≤f\n(5.3.3-1)"), ("5.3.3-2", "λ=l/i (5.3.3-2)")]
    f = spark.createDataFrame([("f1", "c", 1), ("f2", "c", 2)], "node_id string, parent_id string, seq int").withColumn("variables", F.array().cast("array<struct<symbol:string,meaning:string,unit:string>>"))
    c = spark.createDataFrame([("c", "式中：N——轴力；\n式中：λ——长细比；")], "node_id string, content string")
    assert {r["node_id"]: r["variables"][0]["symbol"] for r in structure.formula_variables(f, c).collect()} == {"f1": "N", "f2": "λ"}
    assert spark.range(1).select(X.formula_text(F.lit("1"), F.array(F.struct(F.lit("N").alias("symbol"), F.lit("轴力").alias("meaning"))))).first()[0] == "式（1） N=轴力"


def test_tools_of_nodes(spark):
    grid_rows = [["λ", *map(str, range(10))]] + [[str(10 * t), *(f"0.{100 + 10 * t + u}" for u in range(10))] for t in range(5)]
    list_rows = [["名称", "型号", "重", ""]] + [["立杆" if i % 2 else "", f"Z-LG-{i}", f"{i}.5", "x"] for i in range(25)]
    body = "struct<title:string,rows:array<array<string>>>"
    d = spark.createDataFrame([("a", "S", "C.0.1", 1, ("Q235 稳定系数", grid_rows)), ("b", "S", "A.0.1", 2, ("规格", list_rows)), ("c", "S", "D.0.1", 3, ("验收记录表", list_rows))], f"node_id string, standard_id string, num string, seq int, body {body}").withColumn("type", F.lit("table"))
    got = {(r["node_id"], r["k_text"]): (r["layout"], r["key_name"], r["value"]) for r in tables.tools(d, 10).collect()}
    assert got["a", "42"] == ("digit_grid", "λ", "0.142") and len([k for k in got if k[0] == "a"]) == 50
    assert got["b", "Z-LG-7"] == ("row", "型号", "重=7.5") and not [k for k in got if k[0] == "c"]


def test_streamed_pieces():
    lines = [b'data: {"choices": [{"delta": {"reasoning_content": "r"}}]}', b"", b"data: {bad", b'data: {"choices": [{"delta": {"content": "c"}}]}', b"data: [DONE]", b'data: {"choices": [{"delta": {"content": "x"}}]}']
    assert list(services.pieces(iter(lines))) == [("reasoning", "r"), ("content", "c")]
    assert not services.reachable("http://127.0.0.1:9", 0.2)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("n_queries", "block", "at_once"), [(7, 16_384, 1 << 21), (7, 3, 5), (600, 16_384, 50)])
def test_bm25_like_brute_force(spark, monkeypatch, n_queries, block, at_once):
    import math
    import random
    from collections import Counter, defaultdict

    monkeypatch.setattr(ranking, "QUERY_BLOCK", block)
    monkeypatch.setattr(ranking, "AT_ONCE", at_once)
    r = random.Random(n_queries)
    say = lambda n: " ".join(r.choice("abcdefghij") + r.choice("xyz") for _ in range(n))
    texts = [(i % 35 if i % 7 else i, say(r.randrange(12))) for i in range(60)] + [(100, None), (101, "")]  # some keys stand twice
    asked = [(i, say(r.randrange(6))) for i in range(n_queries)] + [(n_queries, "nowhere"), (n_queries + 1, "")]
    docs = spark.createDataFrame(texts, "d long, text string").repartition(3)
    q = spark.createDataFrame(asked, "q long, text string")
    got = ranking.bm25(docs, q, "d", "q", ranking.latin_words("text"), ranking.latin_words("text"), 4)
    assert "HashAggregate" not in plan(got)  # the sums of all pairs of document and query are never held
    tf = defaultdict(Counter)
    for d, text in texts:
        tf[d].update((text or "").split())
    dl = {d: c.total() for d, c in tf.items()}
    df, mean, want = Counter(w for c in tf.values() for w in c), sum(dl.values()) / len(texts), []
    for i, text in asked:
        s = {d: sum(math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * dl[d] / mean)) for w in text.split() if c[w]) for d, c in tf.items()}
        best = sorted((-round(v, 6), d) for d, v in s.items() if v > 0)[:4]
        want += [(i, d, at + 1) for at, (_, d) in enumerate(best)]
    assert sorted((x["q"], x["d"], x["rank"]) for x in got.collect()) == sorted(want)


def test_hashed_vectors_like_brute_force(spark, monkeypatch):
    import hashlib
    from collections import Counter, defaultdict

    monkeypatch.setattr(ranking, "AT_ONCE", 3)
    texts = [(i % 5, " ".join("ab cd ef ab gh é".split()[: i % 7])) for i in range(9)] + [(20, ""), (21, None), (22, "zz zz ab")]
    docs = spark.createDataFrame(texts, "d long, text string").repartition(2)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    want = defaultdict(Counter)
    for d, text in texts:
        want[d].update(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in (text or "").split())
    want = {(d, b): n / sum(m * m for m in c.values()) ** 0.5 for d, c in want.items() for b, n in c.items()}
    assert {(x["d"], x["bucket"]): x["value"] for x in ranking.hashed(docs, "d", words, 16).collect()} == pytest.approx(want)
    one = ranking.hashed_vectors(docs.filter("d > 10"), "d", words, 16)
    assert "hashpartitioning" not in plan(one) and "HashAggregate" not in plan(one)  # a text is counted where it is read
    assert [(x["d"], sorted(x["vector"])) for x in one.collect()] == [(22, pytest.approx([5**-0.5, 2 * 5**-0.5]))]
