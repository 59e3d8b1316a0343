"""Text functions on literals."""

import time

import pytest
from pyspark.sql import functions as F

from loamstack.functions import text as X


def one(spark, f, *values):
    kinds = {str: "string", list: "array<array<string>>", float: "double"}
    d = spark.createDataFrame([values], ", ".join(f"c{i} {kinds[type(v)]}" for i, v in enumerate(values)))
    return d.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("r")).first()["r"]


@pytest.mark.parametrize(("f", "given", "want"), [
    (X.fix_glyphs, "1", "γ≤1"), (X.normalise, "a  b\r\n\n 中 文 x ", "a b\n中文 x"), (X.normalise_dashes, "3－中 4–文", "3—中 4—文"), (X.guess_units, "长度（某）（ mm ）", "mm"),
    (X.clean_header, "搭设 / 高 度", "搭设高度"), (X.modality, "相应不宜", "应"), (X.modality, "无", None), (X.line_class, "7.4.11 立杆", "clause"), (X.line_class, "附录A 规格 ......... 37", "toc"),
    (X.line_class, "图6.2.4可调托撑", "figure_title"), (X.line_class, "表 5.1.9 承载力", "table_title"), (X.clause_number, "7.4.11 立杆", "7.4.11"), (X.clause_number, "A.0.1 风压", "A.0.1"), (X.clause_number, "5.3.3、应", None),
    (X.explanation_targets, "7.4.1~7.4.3 本条。", ["7.4.1", "7.4.2", "7.4.3"]), (X.explanation_targets, "7.4.11、7.4.12 说明", ["7.4.11", "7.4.12"]), (X.explanation_targets, "4.1.2~4 与5.2.1有关", ["4.1.2", "4.1.3", "4.1.4", "5.2.1"]),
    (X.key_candidates, "型号 Z-LG-500 在2021年 λ=100 的 62", ["Z-LG-500", "500", "100", "62"]), (X.expand_query, "盘扣架的斜撑怎么布置", "盘扣架的斜撑怎么布置 斜杆 竖向斜杆"), (X.expand_query, "无", "无"),
    (X.tokens, "表5.1.9", ["5.1.9", "5.1", "表5.1.9"]), (X.tokens, "立杆间距 550mm 可 2m 7", ["mm", "m", "550mm", "立杆", "杆间", "间距", "可"]), (X.number_key, "5.a.10", [5, 999, 10]), (X.is_refusal, "材料中未规定", True),
    (X.tex_to_text, r"$\frac{a}{b}\leqslant\lambda_{x}\left(\eta\right)$", "a/b≤lambdax(eta)"), (X.highlight, "**x** [来源：第5.1.1条]", '<b>x</b> <span class="cite">[来源：第5.1.1条]</span>'), (X.answer_tokens, "间距650 mm，共3.5", ["650mm", "650", "3.5"]),
])
def test_function(spark, f, given, want):
    assert one(spark, f, given) == want


def test_references(spark):
    got = one(spark, lambda x: X.references(x, F.lit("S")), "按第 5.3.3 条、第5.3.3条和式（5.3.3-1），附录 B，GB50009")
    assert [(r["target_type"], r["target_num"], r["target_node_id"], r["target_display"]) for r in got] == [
        ("clause", "5.3.3", "S:clause:5.3.3", "第5.3.3条"), ("appendix", "B", "S:appendix:B", "附录B"), ("formula", "5.3.3-1", "S:formula:5.3.3-1", "式（5.3.3-1）"), ("external_standard", "GB 50009", None, "GB 50009")]


def test_mentions_mask_typed_numbers(spark):
    assert [tuple(m) for m in one(spark, X.mentions, "表5.1.9 和 5.4.2 附录B")] == [("appendix", "B"), ("clause", "5.4.2"), ("table", "5.1.9")]


def test_variables(spark):
    assert [tuple(v) for v in one(spark, X.variables, "φ——稳定系数；N——轴力（kN）；")] == [("φ", "稳定系数", None), ("N", "轴力（kN）", "kN")]
    assert [[tuple(v) for v in b] for b in one(spark, X.where_blocks, "a 式中：φ——x；式中 b 式中: 无 式中：i——回转半径（约）")] == [[("φ", "x", None)], [("i", "回转半径（约）", None)]]


def test_markdown(spark):
    assert one(spark, X.markdown, [["a", "b|c"], ["1"]]) == "| a | b/c |\n| --- | --- |\n| 1 |  |"


def test_heading_kind(spark):
    f = lambda t, x0=250.0: one(spark, X.heading_kind, t, x0)
    assert [f("5.1 一般规定"), f("5 结构设计"), f("5.1.1 应按下列"), f("5.1 应符合规定。"), f("5.1 一般规定", 200.0), f("0.9 ×1.5"), f("3 规定、")] == ["section", "chapter", None, None, None, None, "chapter"]
    assert [tuple(one(spark, X.split_heading, t)) for t in (" 5.1 一般规定", "5 结构设计", "前言")] == [("5.1", "一般规定"), ("5", "结构设计"), ("", "前言")]


def test_labels_and_prompt(spark):
    d = spark.createDataFrame([("clause", "A.0.1"), ("clause", "5.1.1"), ("table", "3"), ("section", "5.1")], "type string, num string")
    assert [r[0] for r in d.select(X.label("type", "num")).collect()] == ["附录A.0.1", "第5.1.1条", "表3", "第5.1节"]
    assert "标准号" in X.system_prompt([("a", "b"), ("c", "d")]) and "标准号" not in X.system_prompt([("a", "b")])


def test_bigrams_are_linear_and_whole(spark):
    for given, keep in (("a\n中𝒳b𝒳b", "(?!)"), ("aB-1a B", "[^0-9A-Za-z]"), ("x", "(?!)"), ("", "(?!)")):
        kept = given.replace("-", "").replace(" ", "") if keep != "(?!)" else given
        assert one(spark, lambda x, keep=keep: X.bigrams(x, keep), given) == list(dict.fromkeys(a + b for a, b in zip(kept, kept[1:], strict=False)))
    d = spark.range(1).select(F.concat(F.repeat(F.lit("ab9"), 200_000), F.lit("é")).alias("c"))  # by substring() at each place this takes minutes
    began = time.time()
    assert d.select(X.title_overlap(F.lit("9ab"), "c")).first()[0] == 2
    assert time.time() - began < 30
