"""Table operators (T1 to T18): cells in long form, or a table's rows as array<array<string>>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..sources.io import stored


def blank(v: Column) -> Column:
    return X.strip(F.coalesce(v, F.lit(""))) == ""


def clean(v: Column | str) -> Column:
    """A cell, empty where it holds only a mark for none."""
    s = X.strip(F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit("")))
    return F.when(s.isin(V.EMPTY_CELLS), "").otherwise(s)


def cells(tables: DataFrame, key: str, rows: str = "rows") -> DataFrame:
    """(key, r, c, v): long form of each table."""
    t = tables.select(key, F.posexplode(rows).alias("r", "_row"))
    return t.select(key, "r", F.posexplode("_row").alias("c", "v"))


def header_rows(rows: Column | str) -> Column:
    """Leading rows whose first cell is empty (the first row always counts), three at most, fewer than all rows."""
    r = F.col(rows) if isinstance(rows, str) else rows
    n = F.size(r)
    full = F.array_position(F.transform(F.slice(r, F.lit(2), F.greatest(n, F.lit(1))), lambda x: ~blank(F.get(x, F.lit(0)))), F.lit(True)).cast("int")
    lead = F.when(full > 0, full).otherwise(n)
    return F.when(n > 0, F.greatest(F.lit(1), F.least(lead, F.lit(3), n - 1))).otherwise(F.lit(0))


def fill_down(long: DataFrame, key: str, first: Column | int = 1) -> DataFrame:
    """An empty cell from row `first` on takes the value above it in its column; the row before `first` may be the source."""
    start = F.lit(first) if isinstance(first, int) else first
    w = Window.partitionBy(key, "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    v = F.when(F.col("r") >= start - 1, F.when(~blank(F.col("v")), F.col("v")))
    filled = F.last(v, ignorenulls=True).over(w)
    return long.withColumn("v", F.when((F.col("r") >= start) & (F.col("r") > 0), F.coalesce(filled, F.col("v"))).otherwise(F.col("v")))


def flat_header(long: DataFrame, key: str, header: str = "header_rows") -> DataFrame:
    """(key, c, name): each header row is carried to the right, then a column's different parts are joined from the top."""
    h = long.filter(F.col("r") < F.col(header))
    w = Window.partitionBy(key, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    part = X.clean_header(F.last(F.when(~blank(F.col("v")), F.col("v")), ignorenulls=True).over(w))
    parts = h.withColumn("p", part).groupBy(key, "c").agg(F.sort_array(F.collect_list(F.struct("r", "p"))).alias("ps"))
    names = F.array_distinct(F.filter(F.col("ps.p"), lambda p: p != ""))
    return parts.select(key, "c", F.array_join(names, "-").alias("name"))


def proxy_text(title: Column | str, rows: Column | str, notes: Column | str | None = None) -> Column:
    """T4: a table as text to search, one line a row under a flat header; rows that a symbol leads turn round."""
    r = F.filter(F.col(rows) if isinstance(rows, str) else rows, lambda x: F.exists(x, lambda v: ~blank(v)))
    tidy = lambda v: X.strip(F.replace(F.coalesce(v, F.lit("")), F.lit("\n"), F.lit(" ")))
    grid = F.transform(r, lambda x: F.transform(x, tidy))
    head = F.coalesce(F.get(grid, F.lit(0)), F.array().cast("array<string>"))
    name = lambda i: F.coalesce(F.get(head, i), F.lit(""))

    def line(x: Column) -> Column:
        lead = F.get(x, F.lit(0))
        pairs = F.array_compact(F.transform(x, lambda v, i: F.when((i > 0) & (v != "") & (name(i) != ""), F.concat(v, F.lit("（"), name(i), F.lit("）")))))
        turned = F.concat(F.when(name(F.lit(0)) != "", F.concat(name(F.lit(0)), F.lit("："))).otherwise(""), lead, F.lit("="), F.array_join(pairs, "；"))
        plain = F.array_compact(F.transform(x, lambda v, i: F.when(v != "", F.concat(F.when(name(i) != "", name(i)).otherwise(F.concat(F.lit("列"), (i + 1).cast("string"))), F.lit("="), v))))
        return F.when(F.coalesce(lead, F.lit("")) == "", F.lit(None)).when(lead.rlike(r"^[A-Za-zͰ-Ͽ][A-Za-z0-9Ͱ-Ͽ']*$"), turned).otherwise(F.array_join(plain, "；"))

    lines = F.array_compact(F.transform(F.slice(grid, F.lit(2), F.greatest(F.size(grid), F.lit(1))), line))
    head_line = F.nullif(X.strip(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))), F.lit(""))
    tail = F.lit(None).cast("string")
    if notes is not None:
        joined = F.array_join(F.transform(F.col(notes) if isinstance(notes, str) else notes, X.strip), " ")
        tail = F.when(F.size(notes) > 0, F.when(joined.startswith("注"), joined).otherwise(F.concat(F.lit("注："), joined)))
    return F.when(F.size(r) == 0, F.coalesce(head_line, F.lit(""))).otherwise(F.array_join(F.array_compact(F.concat(F.array(head_line), lines, F.array(tail))), "\n"))


def table_kind(title: Column | str, rows: Column | str) -> Column:
    """T5: template, lookup or grid, from the title, the share of numeric first cells and the number of rows."""
    t = F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))
    r = F.filter(F.col(rows) if isinstance(rows, str) else rows, lambda x: F.exists(x, lambda v: ~blank(v)))
    first = F.transform(r, lambda x: X.strip(F.coalesce(F.get(x, F.lit(0)), F.lit(""))))
    keys = F.filter(F.slice(first, F.lit(2), F.greatest(F.size(first), F.lit(1))), lambda v: v != "")
    numeric = F.size(F.filter(keys, lambda v: v.rlike(r"^\d+(?:\.\d+)?$")))
    named = reduce(lambda a, w: a | t.contains(w), V.TEMPLATE_WORDS[1:], t.contains(V.TEMPLATE_WORDS[0]))
    small = (F.size(r) < 3) | (F.coalesce(F.get(first, F.lit(0)), F.lit("")) == "") | (F.size(keys) < 3)
    return F.when(named, "template").when(small, "grid").when((numeric >= F.size(keys) * 0.8) | (F.size(r) >= 20), "lookup").otherwise("grid")


def useless_columns(body: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, c) of columns without a name or with at most one different value."""
    n = body.withColumn("x", F.nullif(clean("v"), F.lit(""))).groupBy(key, "c").agg(F.count_distinct("x").alias("n"))
    return n.join(names, [key, "c"], "left").filter((clean("name") == "") | (F.col("n") <= 1)).select(key, "c")


def key_column(body: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, c): the first column named as a key with two values or more, else the one with most values, the first of equals."""
    n = body.withColumn("x", F.nullif(clean("v"), F.lit(""))).groupBy(key, "c").agg(F.count_distinct("x").alias("n"))
    hint = reduce(lambda a, w: a | F.col("name").contains(w), V.KEY_WORDS[1:], F.col("name").contains(V.KEY_WORDS[0])) & (F.col("n") >= 2)
    x = n.join(names, [key, "c"], "left").withColumn("hint", F.coalesce(hint, F.lit(False)))
    w = Window.partitionBy(key).orderBy(F.desc("hint"), F.when(F.col("hint"), F.col("c")), F.desc("n"), "c")
    return x.withColumn("i", F.row_number().over(w)).filter("i = 1").select(key, "c")


def digit_grid(body: DataFrame, names: DataFrame, key: str, least: int = 20) -> DataFrame:
    """(key, k, value): rows of tens under columns of digits, unpivoted; the last of equal keys counts. Only whole grids with `least` values."""
    digits = names.filter("c > 0").groupBy(key).agg(F.bool_and(F.col("name").rlike(r"^\d$")).alias("d"))
    rows = body.filter("c = 0").select(key, "r", X.strip(F.coalesce("v", F.lit(""))).alias("base")).filter("base <> ''")
    whole = rows.groupBy(key).agg(F.bool_and(F.col("base").rlike(r"^\d+$")).alias("w")).filter("w").join(digits.filter("d"), key).select(key)
    x = body.filter("c > 0").join(rows, [key, "r"]).join(names, [key, "c"]).join(whole, key, "left_semi").withColumn("value", clean("v")).filter("value <> ''")
    x = x.select(key, (F.col("base").cast("int") + F.col("name").cast("int")).alias("k"), "value", "r", "c")
    last = Window.partitionBy(key, "k").orderBy(F.desc("r"), F.desc("c"))
    x = x.withColumn("i", F.row_number().over(last)).filter("i = 1")
    big = x.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return x.join(big, key, "left_semi").select(key, "k", "value")


def row_lookup(body: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, k, attr, value): each row's attributes by its key; rows with one key are merged, the later value counts."""
    drop = useless_columns(body, names, key)
    b, n = body.join(drop, [key, "c"], "left_anti"), names.join(drop, [key, "c"], "left_anti")
    kc = key_column(b, n, key).withColumnRenamed("c", "kc")
    ks = b.join(kc, key).filter("c = kc").select(key, "r", clean("v").alias("k")).filter("k <> ''")
    attr = F.when(clean("name") != "", F.col("name")).otherwise(F.concat(F.lit("列"), (F.col("c") + 1).cast("string")))
    x = b.join(kc, key).filter("c <> kc").join(ks, [key, "r"]).join(n, [key, "c"], "left").select(key, "k", attr.alias("attr"), clean("v").alias("value"), "r", "c").filter("value <> ''")
    last = Window.partitionBy(key, "k", "attr").orderBy(F.desc("r"), F.desc("c"))
    return x.withColumn("i", F.row_number().over(last)).filter("i = 1").select(key, "k", "attr", "value")


def brief(lookup: DataFrame, key: str, key_name: str = "λ", value_name: str = "φ") -> DataFrame:
    """(key, text) of a digit grid: its range, size and the values at its quartiles."""
    s = lookup.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("s"))  # one table's values
    n = F.size("s")
    at = lambda i: F.concat(F.lit(f"{key_name}="), F.element_at("s", i)["k"].cast("string"), F.lit(f" → {value_name}="), F.element_at("s", i)["value"])
    picks = F.concat_ws("；", at(F.lit(1)), at((n / 4).cast("int") + 1), at((n / 2).cast("int") + 1), at(n))
    k = lambda i: F.element_at("s", i)["k"].cast("string")
    return s.select(key, F.concat(F.lit(f"按{key_name}取值（{key_name} 范围 "), k(F.lit(1)), F.lit("~"), k(F.lit(-1)), F.lit("，共 "), n.cast("string"), F.lit(" 个值）\n"), picks, F.lit("\n（全表已转为可查询结构，非示例值需按精确参数查表）")).alias("text"))


def lookup_nearest(lookup: DataFrame, asked: DataFrame, key: str, slack: int = 5) -> DataFrame:
    """(asked's columns, k, value, exact): the equal key, else the nearest if at most `slack` beyond the range; of two as near, the smaller.

    `asked` has the table's key and `want` (int). The nearest key is a neighbour in the sorted union of both, so two window
    functions find it without pairing keys and questions.
    """
    cols = asked.columns
    both = lookup.select(key, F.col("k").alias("x"), F.lit(0).alias("q"), F.struct("k", "value").alias("hit"), *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in cols if c != key)).unionByName(
        asked.select(key, F.col("want").alias("x"), F.lit(1).alias("q"), F.lit(None).cast(f"struct<k:{lookup.schema['k'].dataType.simpleString()},value:{lookup.schema['value'].dataType.simpleString()}>").alias("hit"), *(c for c in cols if c != key)))
    w = Window.partitionBy(key).orderBy("x", "q")
    low = F.last("hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = both.withColumn("low", low).withColumn("high", high).filter("q = 1")
    dl, dh = F.col("x") - F.col("low.k"), F.col("high.k") - F.col("x")
    pick = F.when(F.col("high").isNull() | (dl <= dh), F.col("low")).otherwise(F.col("high"))
    x = x.withColumn("hit", pick).filter(F.col("hit").isNotNull())
    inside = F.col("low").isNotNull() & F.col("high").isNotNull()
    return x.filter(inside | (F.abs(F.col("x") - F.col("hit.k")) <= slack)).select(*cols, F.col("hit.k").alias("k"), F.col("hit.value").alias("value"), (F.col("hit.k") == F.col("x")).alias("exact"))


def registry(nodes: DataFrame) -> DataFrame:
    """The latest table of each standard and number."""
    w = Window.partitionBy("standard_id", "num").orderBy(F.desc("seq"))
    return nodes.filter((F.col("type") == "table") & (F.coalesce("num", F.lit("")) != "")).withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")


def find_rows(rows: DataFrame, key: str, text: str, phrase: list[str], k: int) -> DataFrame:
    """The k rows with most occurrences of the phrase's longer words, each word as often as it is named."""
    words = [w for w in phrase if len(w) > 1]
    count = lambda w: F.floor((F.char_length(text) - F.char_length(F.replace(F.col(text), F.lit(w), F.lit("")))) / len(w)).cast("long")
    scored = rows.withColumn("score", reduce(lambda a, b: a + b, map(count, words), F.lit(0).cast("long"))).filter("score > 0")
    best = scored.orderBy(F.desc("score"), key).limit(k)  # a top k: partial sorts, then one small merge
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


def rows_for(rows: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """(q_id, node_id, title, row_index, row_text, score, rank) for questions (q_id, question): stored rows with most occurrences of
    the question's tokens of two characters and more. A row meets only tokens whose first two characters stand in it."""
    words = questions.select("q_id", F.explode(F.filter(X.tokens("question"), lambda w: F.char_length(w) > 1)).alias("w")).groupBy("q_id", "w").agg(F.count(F.lit(1)).alias("n"))
    grams = rows.select("node_id", "title", "row_index", "row_text", F.explode(X.bigrams("row_text", "(?!)")).alias("g"))
    met = grams.join(words.withColumn("g", F.substring("w", 1, 2)), "g")
    times = F.floor((F.char_length("row_text") - F.char_length(F.replace(F.col("row_text"), F.col("w"), F.lit("")))) / F.char_length("w"))
    scored = met.groupBy("q_id", "node_id", "title", "row_index", "row_text").agg(F.sum(F.col("n") * times).alias("score")).filter("score > 0")
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "node_id", "row_index")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def row_text(columns: list[str]) -> Column:
    """name=value of the non-empty cells."""
    return F.concat_ws("；", *(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{c}="), F.col(c))) for c in columns))


def store_rows(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table_rows, tables) of table nodes with body.rows, header_rows and header_flat; the last of equal names counts."""
    t = tables.select("node_id", F.col("num").alias("table_id"), F.col("body.title").alias("title"), F.coalesce(F.element_at("pages", 1), F.lit(0)).alias("page"), F.col("body.header_flat").alias("names"), F.col("body.rows").alias("rows"), F.col("body.header_rows").alias("h"), F.col("body.notes").alias("notes"), "pages", F.col("body.markdown_flat").alias("markdown_flat"))
    body = t.select("node_id", "table_id", "title", "page", "names", F.posexplode(F.slice("rows", F.col("h") + 1, F.greatest(F.size("rows") - F.col("h"), F.lit(0)))).alias("row_index", "row"))
    pairs = F.filter(F.arrays_zip("names", "row"), lambda p: F.coalesce(p["names"], F.lit("")) != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["names"] == p["names"]))
    full = F.filter(last, lambda p: ~blank(p["row"]))
    rows = body.select("node_id", "table_id", "title", "page", "row_index", F.array_join(F.transform(full, lambda p: F.concat(p["names"], F.lit("="), p["row"])), "；").alias("row_text"), F.map_from_entries(F.transform(last, lambda p: F.struct(p["names"], p["row"]))).alias("cells"))
    return rows, t.select("node_id", "table_id", "title", F.col("names").alias("header_flat"), "notes", "pages", "markdown_flat")


def probe(questions: DataFrame, tables: DataFrame, lookup: DataFrame, chosen: DataFrame | None = None, limit: int = 3) -> DataFrame:
    """(q_id, node_id, key, value, exact): for each question and lookup table the first of the question's keys that the
    table has. Grades must agree where both name one, titles must share two bigrams. With `chosen` (q_id, node_id), tables already
    in use are left out and `limit` tables stay, in order of registration (seq)."""
    q = questions.select("q_id", "question", X.key_candidates("question").alias("keys")).filter(F.size("keys") > 0)
    grade = lambda c: F.array_compact(F.array(*(F.when(F.col(c).contains(g), F.lit(g)) for g in V.GRADES)))
    # questions are a stated set; each meets tables through shared title bigrams, not all pairs
    qg = q.withColumn("g", F.explode(X.bigrams("question")))
    tg = tables.select("node_id", "seq", "title").withColumn("g", F.explode(X.bigrams("title")))
    pairs = qg.join(tg, "g").groupBy("q_id", "question", "keys", "node_id", "seq", "title").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    pairs = pairs.filter((F.size(grade("title")) == 0) | (F.size(grade("question")) == 0) | F.arrays_overlap(grade("title"), grade("question")))
    if chosen is not None:
        pairs = pairs.join(chosen, ["q_id", "node_id"], "left_anti")
    tried = pairs.select("q_id", "node_id", "seq", F.posexplode("keys").alias("i", "want_text"))
    exact = tried.join(lookup.filter("k_text IS NOT NULL"), (tried["node_id"] == lookup["node_id"]) & (tried["want_text"] == lookup["k_text"])).select(tried["q_id"], tried["node_id"], "seq", "i", F.col("k_text").alias("key"), "value", F.lit(True).alias("exact"))
    grids = lookup.filter("layout = 'digit_grid'").select("node_id", F.col("k_text").cast("int").alias("k"), "value")
    wanted = tried.withColumn("want", F.col("want_text").try_cast("double").cast("int")).filter("want IS NOT NULL")
    near = lookup_nearest(grids, wanted, "node_id").select("q_id", "node_id", "seq", "i", F.col("k").cast("string").alias("key"), "value", "exact")
    both = exact.unionByName(near).groupBy("q_id", "node_id", "seq").agg(F.min(F.struct("i", (~F.col("exact")).alias("miss"), "key", "value", "exact")).alias("h"))
    w = Window.partitionBy("q_id").orderBy("seq", "node_id")
    out = both.withColumn("_n", F.row_number().over(w))
    if chosen is not None:
        out = out.filter(F.col("_n") <= limit)
    return out.select("q_id", "node_id", F.col("h.key").alias("key"), F.col("h.value").alias("value"), F.col("h.exact").alias("exact"))


def describe(lookup: DataFrame) -> DataFrame:
    """One line that names every lookup table with its key."""
    one = lookup.select("num", "key_name").distinct()
    listed = one.agg(F.sort_array(F.collect_list(F.struct("num", "key_name"))).alias("s"))  # one entry a table
    return listed.select(F.when(F.size("s") > 0, F.array_join(F.transform("s", lambda x: F.concat(x["num"], F.lit("（"), x["key_name"], F.lit("）"))), "；")).otherwise("（无查值表）").alias("text"))


def tools(nodes: DataFrame, least_chars: int = 800) -> DataFrame:
    """(node_id, num, layout, key_name, k_text, value) of all lookup tables whose text is long enough: digit grids by
    number, other tables by their key column with all attributes of a key as one text."""
    rows = F.filter(F.col("body.rows"), lambda r: F.exists(r, lambda v: ~blank(v)))
    t = registry(nodes).select("node_id", "num", F.col("body.title").alias("title"), rows.alias("rows"), F.char_length(proxy_text(F.col("body.title"), rows)).alias("n"))
    t = t.filter((table_kind("title", "rows") == "lookup") & (F.col("n") >= least_chars))
    long = stored(cells(t, "node_id"))  # a long plan: it goes on from stored tables
    names = long.filter("r = 0").select("node_id", "c", X.strip(F.coalesce("v", F.lit(""))).alias("name"))
    body = long.filter("r > 0")
    drop = stored(useless_columns(body, names, "node_id"))
    digit = stored(digit_grid(body.join(drop, ["node_id", "c"], "left_anti"), names.join(drop, ["node_id", "c"], "left_anti"), "node_id"))
    grids = digit.join(names.filter("c = 0").select("node_id", F.coalesce(F.nullif("name", F.lit("")), F.lit("λ")).alias("key_name")), "node_id")
    grids = grids.select("node_id", F.lit("digit_grid").alias("layout"), "key_name", F.col("k").cast("string").alias("k_text"), "value")
    other = digit.select("node_id").distinct()
    body, names = body.join(other, "node_id", "left_anti"), names.join(other, "node_id", "left_anti")
    kept = [x.join(drop, ["node_id", "c"], "left_anti") for x in (body, names)]
    keyed = key_column(*kept, "node_id").join(names, ["node_id", "c"], "left").select("node_id", F.coalesce(F.nullif("name", F.lit("")), F.lit("键")).alias("key_name"))
    attrs = row_lookup(body, names, "node_id").groupBy("node_id", "k").agg(F.sort_array(F.collect_list(F.concat("attr", F.lit("="), "value"))).alias("a"))
    by_row = attrs.join(keyed, "node_id").select("node_id", F.lit("row").alias("layout"), "key_name", F.col("k").alias("k_text"), F.array_join("a", "；").alias("value"))
    return grids.unionByName(by_row).join(t.select("node_id", "num"), "node_id")
