"""Text functions (N1 to N29): Column in, Column out, no Python on the data path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

#: Unicode classes, and only \n as a line end.
UNI = "(?U)(?d)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def all_matches(x: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(UNI + pattern), F.lit(group))


def first_group(x: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing matches."""
    return F.when(_c(x).rlike(UNI + pattern), F.regexp_extract(_c(x), UNI + pattern, group))


def fix_glyphs(x: Column | str) -> Column:
    """Private-use glyphs as the symbols they show; null becomes empty."""
    return F.coalesce(F.translate(_c(x), V.GLYPHS, V.GLYPH_TEXT), F.lit(""))


def normalise(x: Column | str, collapse: bool = True) -> Column:
    """Glyphs, one line end, single spaces, none between ideographs, stripped non-empty lines."""
    t = F.regexp_replace(fix_glyphs(x), "\r\n?", "\n")
    if collapse:
        t = F.regexp_replace(t, "[ \t\u3000]{2,}", " ")
        t = F.regexp_replace(t, "(?<=[\u4e00-\u9fff])[ \u3000](?=[\u4e00-\u9fff])", "")
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), strip), lambda v: v != ""), "\n")


def normalise_dashes(x: Column | str) -> Column:
    """Wide, en and em dashes between a digit and an ideograph become em dashes."""
    dash = "[\uff0d\u2013\u2014]"
    return F.regexp_replace(_c(x), f"(?<=[0-9])\\s*{dash}\\s*(?=[\u4e00-\u9fff])", "—")


def guess_units(*texts: Column | str) -> Column:
    """The first short bracketed part that holds a unit."""
    parts = F.flatten(F.array(*(F.coalesce(all_matches(t, r"[（(]([^（()）]{1,20})[)）]", 1), F.array().cast("array<string>")) for t in texts)))
    return F.get(F.filter(F.transform(parts, strip), lambda p: p.rlike("|".join(V.UNITS))), F.lit(0))


def clean_header(x: Column | str) -> Column:
    """A header cell without line marks, spaces between ideographs and runs of spaces."""
    t = F.regexp_replace(F.replace(F.coalesce(_c(x), F.lit("")), F.lit(" / "), F.lit("")), r"(?U)(?<=[\u4e00-\u9fff])\s+(?=[\u4e00-\u9fff])", "")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def modality(x: Column | str, words: list[str] | None = None) -> Column:
    """The first obligation word, in order of strictness, that the text holds."""
    return F.coalesce(*(F.when(_c(x).contains(w), F.lit(w)) for w in words or V.MODALITIES))


def strictness(word: Column | str) -> Column:
    return F.create_map(*(F.lit(v) for kv in V.STRICTNESS.items() for v in kv))[_c(word)]


def standard_code(x: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", ""), "(?i)^(GB|JGJ|JG)/?T", "$1/T")
    return F.regexp_replace(t, r"^(GB|JGJ|JG)(\d)", "$1 $2")


def display(kind: Column, num: Column) -> Column:
    """How a reference is written."""
    out = F.lit(None).cast("string")
    for k, (a, b) in V.REF_TEXT.items():
        out = F.when(kind == k, F.concat(F.lit(a), num, F.lit(b))).otherwise(out)
    return out


def node_id(standard: Column | str, kind: Column | str, num: Column | str, fallback: Column | None = None) -> Column:
    """Standard:type:number."""
    return F.concat_ws(":", _c(standard), _c(kind), F.coalesce(F.nullif(_c(num), F.lit("")), *([fallback] if fallback is not None else []), F.lit("unknown")))


def _reference(kind: str, standard: Column | str):
    target = (lambda n: F.lit(None).cast("string")) if kind == "external_standard" else (lambda n: node_id(standard, F.lit(kind), n))
    return lambda n: F.struct(
        F.lit(kind).alias("target_type"), n.alias("target_num"), target(n).alias("target_node_id"), display(F.lit(kind), n).alias("target_display"), F.lit(None).cast("boolean").alias("in_scope")
    )


def references(x: Column | str, standard: Column | str) -> Column:
    """References in order of kind, then place, each once."""
    found = []
    for kind, pattern in V.REFERENCES:
        bare = (lambda n: standard_code(n)) if kind == "external_standard" else (lambda n: F.regexp_replace(n, r"(?U)\s+", ""))
        nums = F.array_distinct(F.transform(F.coalesce(all_matches(x, pattern, 1), F.array().cast("array<string>")), bare))
        found.append(F.transform(nums, _reference(kind, standard)))
    return F.flatten(F.array(*found))


def label(kind: Column | str, num: Column | str) -> Column:
    """How a block of material is named; a clause of an appendix by the appendix."""
    k, n = _c(kind), _c(num)
    return (
        F.when(k == "table", F.concat(F.lit("表"), n)).when(k == "figure", F.concat(F.lit("图"), n)).when(k == "formula", F.concat(F.lit("式（"), n, F.lit("）")))
        .when(k.isin("clause", "item"), F.when(n.rlike(r"^[A-Z]\."), F.concat(F.lit("附录"), n)).otherwise(F.concat(F.lit("第"), n, F.lit("条"))))
        .when(k == "appendix", F.concat(F.lit("附录"), n)).when(k == "explanation", F.concat(F.lit("条文说明 "), n)).otherwise(F.concat(F.lit("第"), n, F.lit("节")))
    )


def heading_kind(text: Column | str, x0: Column | str) -> Column:
    """Chapter or section heading, else null: centred (beyond 200), no clause, table or figure title, no closing mark, at most 30
    characters, the title begins with an ideograph."""
    t = strip(text)
    no = t.rlike(UNI + V.CLAUSE) | t.rlike(UNI + V.TABLE_TITLE) | t.rlike(UNI + V.FIGURE_TITLE) | t.rlike("[。；，：;,]$") | (F.char_length(t) > 30) | (_c(x0) <= 200)
    han = "^[\u4e00-\u9fff]"
    section, chapter = first_group(t, V.SECTION, 2), first_group(t, V.CHAPTER, 2)
    return F.when(no, F.lit(None)).when(strip(section).rlike(han), "section").when(strip(chapter).rlike(han) & (F.char_length(t) <= 25), "chapter")


def split_heading(text: Column | str) -> Column:
    """(num, title) of a heading; without a number, all of it is the title."""
    t = strip(text)
    part = lambda g: F.coalesce(first_group(t, V.SECTION, g), first_group(t, V.CHAPTER, g))
    return F.struct(F.coalesce(part(1), F.lit("")).alias("num"), strip(F.coalesce(part(2), t)).alias("title"))


def clause_number(text: Column | str) -> Column:
    """5.3.3 or A.0.1 at the head of a line."""
    return F.coalesce(first_group(text, V.CLAUSE), F.when(_c(text).rlike(UNI + V.APPENDIX_CLAUSE), F.regexp_extract(_c(text), r"^([A-Z]\.\d+\.\d+)", 1)))


def line_class(text: Column | str) -> Column:
    """The first class whose pattern the line fits."""
    t, out = _c(text), F.lit("text")
    for name, pattern in reversed([
        ("toc", V.TOC_LINE), ("clause", V.CLAUSE), ("appendix_clause", V.APPENDIX_CLAUSE), ("appendix", V.APPENDIX_TITLE), ("table_title", V.TABLE_TITLE), ("bare_table_title", V.BARE_TABLE_TITLE),
        ("figure_title", V.FIGURE_TITLE), ("equation", V.EQUATION_END), ("section", V.SECTION), ("chapter", V.CHAPTER), ("legend", V.LEGEND), ("item", V.ITEM),
    ]):
        out = F.when(t.rlike(UNI + pattern), F.lit(name)).otherwise(out)
    return out


def explanation_targets(x: Column | str) -> Column:
    """Clause numbers that the head of an explanation names, ranges written out; ranges first, then all numbers, each once."""
    head = F.substring(F.split(_c(x), "[。\n]")[0], 1, 60)
    pattern = r"(\d+\.\d+)\.(\d+)\s*[~～]\s*(?:\d+\.\d+\.)?(\d+)"
    part = lambda s, g: F.regexp_extract(s, UNI + pattern, g)
    first, last = (lambda s: part(s, 2).cast("int")), (lambda s: part(s, 3).cast("int"))
    ranges = F.transform(all_matches(head, pattern, 0), lambda s: F.when(
        first(s) <= last(s), F.transform(F.sequence(first(s), F.greatest(first(s), last(s))), lambda i: F.concat(part(s, 1), F.lit("."), i.cast("string"))),
    ).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(F.flatten(ranges), all_matches(head, r"\d+\.\d+\.\d+")))


def variables(x: Column | str) -> Column:
    """Symbol, meaning and unit of each `symbol——meaning；`. The unit is what the meaning's first brackets hold, if that is one."""
    pattern = r"([A-Za-z\u0370-\u03ff][A-Za-z0-9\u0370-\u03ff]*)\s*——\s*([^；;]+)"
    bracket = lambda m: first_group(m, r"[（(]([^（()）]{1,12})[)）]")
    found = F.transform(all_matches(x, pattern, 0), lambda s: F.struct(F.regexp_extract(s, UNI + pattern, 1).alias("symbol"), strip(F.regexp_extract(s, UNI + pattern, 2)).alias("meaning")))
    return F.transform(found, lambda v: F.struct(v["symbol"].alias("symbol"), v["meaning"].alias("meaning"), F.when(bracket(v["meaning"]).rlike("|".join(V.VARIABLE_UNITS)), bracket(v["meaning"])).alias("unit")))


def where_blocks(x: Column | str) -> Column:
    """The variables of each part after 式中：, without parts that name none."""
    parts = F.slice(F.split(_c(x), UNI + r"式中\s*[：:]"), F.lit(2), F.greatest(F.lit(1), F.char_length(_c(x))))
    return F.filter(F.transform(parts, variables), lambda v: F.size(v) > 0)


def formula_text(num: Column | str, found: Column | str) -> Column:
    """式（n） and its variables."""
    v = F.array_join(F.transform(_c(found), lambda s: F.concat(s["symbol"], F.lit("="), s["meaning"])), "；")
    return F.concat(F.lit("式（"), _c(num), F.lit("）"), F.when(v != "", F.concat(F.lit(" "), v)).otherwise(""))


def structural_keywords(num: Column | str, section: Column | str) -> Column:
    """Number, 第n条, the section's first word."""
    n = F.nullif(_c(num), F.lit(""))
    return F.array_compact(F.array(n, F.concat(F.lit("第"), n, F.lit("条")), F.nullif(F.split(strip(F.coalesce(_c(section), F.lit(""))), r"(?U)\s+")[0], F.lit(""))))


def key_candidates(x: Column | str) -> Column:
    """Model codes, then numbers that are no years, longest first; each once."""
    nums = F.filter(all_matches(x, V.NUMBER_KEY), lambda n: ~n.rlike(r"^(19|20)\d\d$"))
    ranked = F.array_sort(F.transform(nums, lambda n, i: F.struct((-F.char_length(n)).alias("l"), i.alias("i"), n.alias("n"))))
    return F.array_distinct(F.concat(all_matches(x, V.MODEL_KEY), F.transform(ranked, lambda s: s["n"])))


def bigrams(x: Column | str, keep: str = r"[^0-9A-Za-z\u4e00-\u9fff]") -> Column:
    """Distinct pairs of neighbouring kept characters, in one pass: substring() walks to its place from the start each time."""
    t = F.regexp_replace(F.coalesce(_c(x), F.lit("")), keep, "")
    return F.array_distinct(F.regexp_extract_all(t, F.lit("(?s)(?=(..))."), F.lit(1)))


def title_overlap(a: Column | str, b: Column | str) -> Column:
    """Bigrams in common."""
    return F.size(F.array_intersect(bigrams(a), bigrams(b)))


def answer_tokens(x: Column | str) -> Column:
    """Numbers with units, quoted text, bare numbers; each once."""
    unit = r"\d+(?:\.\d+)?\s?(?:mm|cm|m2|m3|kN|kPa|MPa|kg|%|°|m|t|d|h)"
    parts = F.concat(all_matches(x, unit), all_matches(x, "[“\"「]([^”\"」]{2,})[”\"」]", 1), all_matches(x, r"(?<![\d.])\d+(?:\.\d+)*"))
    return F.array_distinct(F.transform(parts, lambda v: F.regexp_replace(v, r"(?U)\s+", "")))


def is_refusal(x: Column | str) -> Column:
    """Any sign of a refusal."""
    return F.coalesce(_c(x).rlike("|".join(V.REFUSALS)), F.lit(False))


def expand_query(x: Column | str, synonyms: dict[str, str] | None = None) -> Column:
    """The question, then the standard's words for the everyday words in it, each once."""
    q = _c(x)
    words = F.array_distinct(F.flatten(F.array(*(F.when(q.contains(k), F.split(F.lit(v), " ")).otherwise(F.array().cast("array<string>")) for k, v in (synonyms or V.SYNONYMS).items()))))
    return F.when(F.size(words) > 0, F.concat(q, F.lit(" "), F.array_join(words, " "))).otherwise(q)


def mentions(x: Column | str) -> Column:
    """(type, num) that a question names; what a typed mention covers is no bare clause. Sorted, each once."""
    q = _c(x)
    named = lambda k: lambda n: F.struct(F.lit(k).alias("type"), F.regexp_replace(n, r"(?U)\s+", "").alias("num"))
    typed = [F.transform(all_matches(q, p, 1), named(k)) for k, p in V.MENTIONS]
    rest = reduce(lambda t, kp: F.regexp_replace(t, UNI + kp[1], "\u0001"), V.MENTIONS, q)
    bare = F.transform(all_matches(rest, V.BARE_CLAUSE, 1), lambda n: F.struct(F.lit("clause").alias("type"), n.alias("num")))
    return F.array_sort(F.array_distinct(F.concat(*typed, bare)))


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def _padded(row: Column, n: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(n - F.size(row), F.lit(0))))


def _cell(v: Column) -> Column:
    return F.replace(F.replace(F.coalesce(v, F.lit("")), F.lit("|"), F.lit("/")), F.lit(" / "), F.lit("<br>"))


def markdown(rows: Column | str) -> Column:
    """A table; the first row is the header, short rows are filled up."""
    r = _c(rows)
    n = _width(r)
    lines = F.transform(r, lambda x: _row(F.transform(_padded(x, n), _cell)))
    rule = _row(F.array_repeat(F.lit("---"), n))
    return F.when(F.size(r) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))), "\n")).otherwise(F.lit(""))


def markdown_flat(header: Column | str, rows: Column | str) -> Column:
    """A table under a flat header, blank rows left out."""
    body = F.filter(_c(rows), lambda r: F.exists(r, lambda v: strip(F.coalesce(v, F.lit(""))) != ""))
    return markdown(F.concat(F.array(_c(header)), body))


def number_key(num: Column | str) -> Column:
    """Dotted numbers in natural order; other parts come last."""
    return F.transform(F.split(_c(num), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)))


def template_text(rows: Column | str, fallback: Column | str) -> Column:
    """What a form asks for: its distinct short first cells."""
    cell = lambda r: F.regexp_replace(F.replace(strip(F.regexp_replace(F.coalesce(F.get(r, F.lit(0)), F.lit("")), r"(?U)\s+", " ")), F.lit(" / "), F.lit("/")), "^/+|/+$", "")
    items = F.array_distinct(F.filter(F.transform(_c(rows), cell), lambda v: (v != "") & (F.char_length(v) <= 40)))
    return F.when(F.size(items) > 0, F.concat(F.lit("（表单模板，原表为空白记录表）\n表中栏目与检查项："), F.array_join(items, "、"))).otherwise(_c(fallback))


def block_text(with_standard: bool = False) -> Column:
    """A node as material: heading, body by type, and a notice of references out of scope. Reads the node's columns."""
    n = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = label("type", "num")
    head = F.concat(F.lit("【"), *([n("standard_code"), F.lit(" ")] if with_standard else []), name, F.lit("】"))
    head = F.concat(
        head, F.when(n("section") != "", F.concat(F.lit("（"), n("section"), F.lit("）"))).otherwise(""),
        F.when(F.col("modality").isNotNull(), F.concat(F.lit("［用词："), F.col("modality"), F.lit("，严格程度 "), strictness("modality").cast("string"), F.lit("/4］"))).otherwise(""))
    b = F.col("body")
    notes = F.when(F.size(F.coalesce(b["notes"], F.array())) > 0, F.concat(F.lit("\n注："), F.array_join(b["notes"], " "))).otherwise("")
    grid = F.coalesce(F.nullif(b["markdown_flat"], F.lit("")), F.nullif(b["markdown"], F.lit("")), n("content"))
    table = F.concat(F.when(b["tool_kind"] == "template", template_text(b["rows"], n("content"))).otherwise(grid), notes)
    figure = F.concat(F.coalesce(b["title"], F.lit("")), F.lit("\n图注："), F.array_join(F.coalesce(b["legend"], F.array().cast("array<string>")), "；"))
    found = F.array_join(F.transform(b["variables"], lambda v: F.concat(v["symbol"], F.lit("——"), v["meaning"])), "；")
    formula = F.concat(F.lit("式（"), F.coalesce(b["equation_id"], F.lit("")), F.lit("）线性形式："), F.coalesce(F.nullif(b["linear_text"], F.lit("")), F.lit("（未识别）")), F.when(F.size(F.coalesce(b["variables"], F.array())) > 0, F.concat(F.lit("\n式中："), found)).otherwise(""))
    text = F.when(F.col("type") == "table", table).when(F.col("type") == "figure", figure).when(F.col("type") == "formula", formula).otherwise(n("content"))
    out = F.transform(F.filter(F.col("refs"), lambda r: F.coalesce(~r["in_scope"], F.lit(False))), lambda r: r["target_display"])
    notice = F.when(F.size(out) > 0, F.concat(F.lit("\n（注：本条引用的 "), F.array_join(out, "、"), F.lit(" 不在本次材料范围内）"))).otherwise("")
    return F.concat(head, F.lit("\n"), text, notice)


def system_prompt(standards: list[tuple[str, str]], detail: str = "brief") -> str:
    """Instructions for a generator; with several standards, each citation must name its own."""
    several = len(standards) > 1
    size = "回答不超过250字" if detail == "brief" else "回答500至1200字，按要点展开"
    named = "；".join(f"{code}《{name}》" for code, name in standards)
    tag = "[来源：标准号 条号]" if several else "[来源：条号]"
    rules = ["只依据给出的材料作答，材料没有的内容回答“材料中未规定”", f"每个结论后标注 {tag}", "数值与单位照原文引用，不换算不取整", size]
    if several:
        rules.append("各标准的规定不一致时分别列出，不得混用")
    return f"你是规范问答助手，依据：{named}。\n" + "\n".join(f"{i}. {r}" for i, r in enumerate(rules, 1))


def escape_html(x: Column | str) -> Column:
    """Markup characters as entities."""
    out = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: Commands of formulas and what is shown for them, in order.
TEX = [
    (r"\$\$?([^$]+)\$\$?", "$1"), (r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "$1/$2"), (r"\\(?:varphi|phi)\b", "φ"), (r"\\lambda\b", "λ"), (r"\\beta\b", "β"), (r"\\mu\b", "μ"), (r"\\gamma\b", "γ"),
    (r"\\sum\b", "∑"), (r"\\times\b", "×"), (r"\\cdot\b", "·"), (r"\\leqslant|\\leq\b|\\le\b", "≤"), (r"\\geqslant|\\geq\b", "≥"), (r"\\text\{([^{}]*)\}", "$1"), (r"\\mathrm\{([^{}]*)\}", "$1"),
    (r"\\left|\\right", ""), (r"\\([a-zA-Z]+)", "$1"), (r"_\{([^{}]+)\}", "$1"), (r"\^\{([^{}]+)\}", "^$1"),
]


def tex_to_text(x: Column | str) -> Column:
    """Formulas as plain text; other commands keep their names."""
    out = _c(x)
    for a, b in TEX:
        out = F.regexp_replace(out, a, b)
    return out


def highlight(x: Column | str) -> Column:
    """Source tags and bold text as markup."""
    t = F.regexp_replace(escape_html(x), UNI + V.SOURCE_TAG, '<span class="cite">$0</span>')
    return F.regexp_replace(t, r"\*\*([^*]+)\*\*", "<b>$1</b>")


def tokens(x: Column | str) -> Column:
    """B1: structural tokens in order of pattern, then ideograph bigrams of what they leave; single ideographs stay."""
    t = strip(F.coalesce(_c(x), F.lit("")))
    parts = [F.transform(all_matches(t, p), lambda v: F.lower(F.regexp_replace(v, r"(?U)\s+", ""))) for p in V.TOKENS]
    # patterns run over the whole text, so what any of them covers is blanked in one pass with the widest first
    rest = F.regexp_replace(t, UNI + "|".join(V.TOKENS[i] for i in (2, 5, 0, 1, 3, 4)), " ")
    runs = all_matches(rest, "[\u4e00-\u9fff]+")
    grams = F.flatten(F.transform(runs, lambda s: F.when(F.char_length(s) == 1, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))))
    return F.concat(*parts, grams)
