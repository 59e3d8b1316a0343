"""Driver queries on tables, structure, graphs and quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context, graph, quality, structure, tables
from .search_queries import t

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _brand_lookup(spark, sf_dir):
    p = t(spark, sf_dir, "part").filter("p_size % 3 <> 0 AND p_size > 8")
    return p.groupBy("p_brand", F.col("p_size").alias("k")).agg(F.max("p_retailprice").cast("string").alias("value"))


@query("""
WITH l AS (SELECT p_brand, p_size AS k, max(p_retailprice) AS value FROM part WHERE p_size % 3 <> 0 AND p_size > 8 GROUP BY ALL),
a AS (SELECT DISTINCT p_brand, p_size AS want FROM part), r AS (SELECT p_brand, min(k) AS lo, max(k) AS hi FROM l GROUP BY 1),
c AS (SELECT a.p_brand, want, k, value, row_number() OVER (PARTITION BY a.p_brand, want ORDER BY abs(k - want), k) AS i FROM a JOIN l ON a.p_brand = l.p_brand JOIN r ON r.p_brand = a.p_brand WHERE want BETWEEN lo - 5 AND hi + 5)
SELECT p_brand, want, k, round(value, 2) AS value, k = want AS exact FROM c WHERE i = 1""")
def lookup_exact_nearest(spark, sf_dir):
    asked = t(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("want")).distinct()
    return tables.lookup_nearest(_brand_lookup(spark, sf_dir), asked, "p_brand").withColumn("value", F.round(F.col("value").cast("double"), 2))


@query("""SELECT p_brand, p_size AS k, CAST(count(*) AS VARCHAR) AS value FROM part
WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_size) >= 20) GROUP BY ALL""")
def digit_grid_unpivot(spark, sf_dir):
    """Counts by size, laid out as a grid of tens and digits for each brand and read back."""
    p = t(spark, sf_dir, "part").withColumn("tens", F.floor(F.col("p_size") / 10).cast("int")).withColumn("digit", F.col("p_size") % 10)
    grid = p.groupBy("p_brand", "tens").pivot("digit", list(range(10))).agg(F.count(F.lit(1)))
    row = F.array((F.col("tens") * 10).cast("string"), *(F.col(str(i)).cast("string") for i in range(10)))
    body = grid.select("p_brand", F.col("tens").alias("r"), F.posexplode(row).alias("c", "v"))
    names = grid.select("p_brand").distinct().select("p_brand", F.posexplode(F.array(F.lit("size"), *(F.lit(str(i)) for i in range(10)))).alias("c", "name"))
    return tables.digit_grid(body, names, "p_brand")


@query("""
WITH n AS (SELECT 'part' AS tab, * FROM (VALUES (0, 'p_partkey', (SELECT count(DISTINCT p_partkey) FROM part)), (1, 'p_name', (SELECT count(DISTINCT p_name) FROM part)), (2, 'p_brand', (SELECT count(DISTINCT p_brand) FROM part)),
  (3, 'p_type', (SELECT count(DISTINCT p_type) FROM part))) v(c, name, n) UNION ALL SELECT 'supplier', * FROM (VALUES (0, 's_suppkey', (SELECT count(DISTINCT s_suppkey) FROM supplier)), (1, 's_name 编号', (SELECT count(DISTINCT s_name) FROM supplier)), (2, 's_nationkey', (SELECT count(DISTINCT s_nationkey) FROM supplier))) v(c, name, n)),
w AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY (contains(name, '编号') AND n >= 2) DESC, CASE WHEN contains(name, '编号') AND n >= 2 THEN c END, n DESC, c) AS i FROM n)
SELECT tab, c FROM w WHERE i = 1""")
def key_column_choice(spark, sf_dir):
    p, s = t(spark, sf_dir, "part"), t(spark, sf_dir, "supplier")
    long = lambda d, tab, cols: d.select(F.lit(tab).alias("tab"), F.posexplode(F.array(*(F.col(c).cast("string") for c in cols))).alias("c", "v"))
    body = long(p, "part", ["p_partkey", "p_name", "p_brand", "p_type"]).unionByName(long(s, "supplier", ["s_suppkey", "s_name", "s_nationkey"]))
    spark_names = [("part", i, n) for i, n in enumerate(["p_partkey", "p_name", "p_brand", "p_type"])] + [("supplier", i, n) for i, n in enumerate(["s_suppkey", "s_name 编号", "s_nationkey"])]
    return tables.key_column(body, spark.createDataFrame(spark_names, "tab string, c int, name string"), "tab")


@query("""
WITH k AS (SELECT p_brand || CASE WHEN p_brand LIKE '%1' THEN ' 验收记录表' ELSE '' END AS tab, count(DISTINCT p_size) AS n, true AS num FROM part GROUP BY p_brand
  UNION ALL SELECT 'region ' || n_regionkey, count(*), false FROM nation GROUP BY n_regionkey UNION ALL SELECT 'nation ' || s_nationkey, count(*), false FROM supplier GROUP BY s_nationkey)
SELECT tab, CASE WHEN contains(tab, '记录表') THEN 'template' WHEN n < 3 THEN 'grid' WHEN num OR n + 1 >= 20 THEN 'lookup' ELSE 'grid' END AS kind FROM k""")
def table_classify(spark, sf_dir):
    """T5 on tables of sizes for each brand and of names for each region and nation."""
    row = lambda key: F.array(F.col(key).cast("string"), F.lit("x"))
    grid = lambda d, tab, key: d.groupBy(tab.alias("tab")).agg(F.concat(F.array(F.array(F.lit("key"), F.lit("value"))), F.sort_array(F.collect_set(row(key)))).alias("rows"))
    brand = F.concat("p_brand", F.when(F.col("p_brand").endswith("1"), F.lit(" 验收记录表")).otherwise(""))
    named = lambda what, c: F.concat(F.lit(f"{what} "), F.col(c).cast("string"))
    every = grid(t(spark, sf_dir, "part"), brand, "p_size").unionByName(grid(t(spark, sf_dir, "nation"), named("region", "n_regionkey"), "n_name")).unionByName(grid(t(spark, sf_dir, "supplier"), named("nation", "s_nationkey"), "s_name"))
    return every.select("tab", tables.table_kind("tab", "rows").alias("kind"))


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS v FROM events)
SELECT user_id, event_id, CASE WHEN r > 0 THEN coalesce(last_value(nullif(v, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') ELSE v END AS v FROM e""")
def fill_down(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    long = e.select("user_id", "event_id", "r", F.lit(0).alias("c"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("v"))
    return tables.fill_down(long, "user_id").select("user_id", "event_id", "v")


MODAL = ["only", "nicht", "und", "para", "con", "pour", "that", "the"]


@query(f"SELECT doc_id, CASE {' '.join(f'''WHEN contains(text, '{w}') THEN '{w}' ''' for w in MODAL)} END AS modality FROM documents")
def modality_tag(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.modality("text", MODAL).alias("modality"))


PARTS = "SELECT p_partkey, (p_partkey % 9 + 1) || '.' || (p_size % 7 + 1) || '.' || (p_partkey % 11 + 1) AS clause, (p_size % 7 + 1) || '.' || (p_partkey % 11 + 1) AS tab, chr(CAST(65 + p_size % 5 AS INTEGER)) AS letter, p_size, p_partkey % 8 AS form FROM part"


def _numbers(spark, sf_dir):
    """Numbers of clauses, tables and appendices from each part's key and size."""
    n = lambda c, k: (F.col(c) % k + 1).cast("string")
    clause, tab = F.concat_ws(".", n("p_partkey", 9), n("p_size", 7), n("p_partkey", 11)), F.concat_ws(".", n("p_size", 7), n("p_partkey", 11))
    return t(spark, sf_dir, "part").select("p_partkey", clause.alias("clause"), tab.alias("tab"), F.char((F.lit(65) + F.col("p_size") % 5).cast("long")).alias("letter"), "p_size", (F.col("p_partkey") % 8).alias("form"))


@query(f"""SELECT p_partkey, 'clause 第' || clause || '条 S:clause:' || clause || ',table 表' || tab || ' S:table:' || tab || ',appendix 附录' || letter || ' S:appendix:' || letter || ',external_standard GB ' || p_size || ' -' AS codes FROM ({PARTS})""")
def extract_codes(spark, sf_dir):
    """N7, N8, N9 on a sentence that names a clause, a table, an appendix and another standard."""
    said = F.concat(F.lit("见附录"), "letter", F.lit("和表 "), "tab", F.lit("，按第 "), "clause", F.lit(" 条、第"), "clause", F.lit("条及GB"), F.col("p_size").cast("string"), F.lit("。"))
    shown = F.transform(X.references(said, F.lit("S")), lambda r: F.concat_ws(" ", r["target_type"], r["target_display"], F.coalesce(r["target_node_id"], F.lit("-"))))
    return _numbers(spark, sf_dir).select("p_partkey", F.array_join(shown, ",").alias("codes"))


@query(r"""
WITH n AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?') AS xs, regexp_extract_all(text, '[A-Z]{1,3}-[A-Z]{1,4}-[0-9]+(?:\.[0-9]+)?') AS ms FROM documents),
u AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM n UNION ALL SELECT doc_id, unnest(ms), unnest(range(len(ms))) - 1000000 FROM n),
f AS (SELECT doc_id, x, min(CASE WHEN i < 0 THEN i ELSE -length(x) * 0 + i END) AS i, min(CASE WHEN i < 0 THEN -1000 ELSE -length(x) END) AS l FROM u WHERE i < 0 OR NOT regexp_full_match(x, '(19|20)[0-9][0-9]') GROUP BY ALL)
SELECT d.doc_id, coalesce(string_agg(x, ',' ORDER BY l, i), '') AS keys FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def key_candidates(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(X.key_candidates("text"), ",").alias("keys"))


@query(r"""
WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]{2,}', ' ', 'g') AS x FROM documents)
SELECT doc_id, array_to_string([trim(l) FOR l IN string_split(x, chr(10)) IF trim(l) <> ''], chr(10)) AS text FROM n""")
def normalize_text(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.normalise("text").alias("text"))


@query(f"""SELECT p_partkey, CASE form WHEN 0 THEN 'clause' WHEN 1 THEN 'section' WHEN 2 THEN 'chapter' WHEN 3 THEN 'table_title' WHEN 4 THEN 'figure_title' WHEN 5 THEN 'equation' WHEN 6 THEN 'toc' ELSE 'text' END AS kind,
  CASE WHEN form = 0 THEN clause END AS num FROM ({PARTS})""")
def toc_like_lines(spark, sf_dir):
    """N12, N13 on lines of eight forms."""
    forms = [F.concat("clause", F.lit(" 立杆应设置")), F.concat("tab", F.lit(" 一般规定")), F.concat(F.substring_index("clause", ".", 1), F.lit(" 总则")), F.concat(F.lit("表"), "tab", F.lit(" 荷载")), F.concat(F.lit("图"), "tab", F.lit("构造")), F.concat(F.lit("x=y（"), "clause", F.lit("-1）")), F.concat("clause", F.lit(" 规定 ......... "), F.col("p_size").cast("string")), F.lit("一般文字")]
    line = F.coalesce(*(F.when(F.col("form") == i, f) for i, f in enumerate(forms)))
    return _numbers(spark, sf_dir).withColumn("line", line).select("p_partkey", X.line_class("line").alias("kind"), F.when(F.col("form") == 0, X.clause_number("line")).alias("num"))


@query("""
WITH r AS (SELECT n_regionkey, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line, n_nationkey FROM nation)
SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY n_nationkey) AS md FROM r GROUP BY n_regionkey""")
def markdown_table(spark, sf_dir):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.array(s["n_nationkey"].cast("string"), s["n_name"]))
    n = t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(rows.alias("rows"))
    return n.select("n_regionkey", X.markdown_flat(F.array(F.lit("key"), F.lit("name")), "rows").alias("md"))


EDGES = """
WITH all_e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'contains' AS type, 1 AS seq FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains', 2 FROM customer
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'clause', 3 FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'table', 4 FROM supplier),
e AS (SELECT src, dst, arg_max(type, seq) AS type FROM all_e GROUP BY ALL)
"""


def _edges(spark, sf_dir):
    n, c, s = (t(spark, sf_dir, x) for x in ("nation", "customer", "supplier"))
    e = lambda d, a, x, b, y, kind, seq: d.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("type"), F.lit(seq).alias("seq"))
    contains = e(n, "r", "n_regionkey", "n", "n_nationkey", "contains", 1).unionByName(e(c, "n", "c_nationkey", "c", "c_custkey", "contains", 2))
    refs = e(c.filter("c_acctbal > 5000"), "n", "c_nationkey", "c", "c_custkey", "clause", 3).unionByName(e(s, "n", "s_nationkey", "s", "s_suppkey", "table", 4))
    return graph.edges(refs, contains)


@query(EDGES + "SELECT src, dst, type FROM e")
def ref_graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(EDGES + """, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT DISTINCT 'r' || r_regionkey AS start FROM region),
h1 AS (SELECT DISTINCT start, dst AS id FROM s JOIN b ON src = start WHERE dst <> start), h2 AS (SELECT DISTINCT start, dst AS id FROM h1 JOIN b ON src = id WHERE dst <> start AND (start, dst) NOT IN (SELECT start, id FROM h1))
SELECT start, id, 1 AS depth FROM h1 UNION ALL SELECT start, id, 2 FROM h2""")
def graph_khop(spark, sf_dir):
    start = t(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start"))
    return graph.neighbours(start, _edges(spark, sf_dir), hops=2)


@query(None)
def closure_round_robin(spark, sf_dir):
    """Closure from three nations a region; the rounds are a fold that SQL does not express."""
    n = t(spark, sf_dir, "nation")
    hits = n.select(F.col("n_regionkey").alias("q_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("rank"), F.lit("clause").alias("type")).filter("rank <= 3")
    e = _edges(spark, sf_dir)
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    kind = F.when(F.col("id").startswith("r"), "chapter").otherwise("clause")
    return graph.closure(hits, e, ids.withColumn("type", kind), ["clause", "table"])


CONV = """WITH m AS (SELECT conv_id, turn, conv_id || ':' || turn AS node_id, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, CASE role WHEN 'system' THEN 'chapter' WHEN 'user' THEN 'section' ELSE 'clause' END AS type FROM conversations),
l AS (SELECT *, last_value(CASE WHEN level <= 1 THEN {'i': node_id, 'l': level} END IGNORE NULLS) OVER w AS m1, last_value(CASE WHEN level <= 2 THEN {'i': node_id, 'l': level} END IGNORE NULLS) OVER w AS m2 FROM m
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT conv_id, turn, node_id, CASE WHEN level > 2 AND m2.l = 2 THEN m2.i WHEN level > 1 AND m1.l = 1 THEN m1.i END AS parent_id FROM l)
"""


def _tree(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "chapter").when(F.col("role") == "user", "section").otherwise("clause")
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    nodes = c.select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node_id"), level.alias("level"), kind.alias("type"), F.col("turn").alias("seq"))
    return structure.parents(nodes, "conv_id", "turn")


@query(CONV + "SELECT node_id, parent_id FROM p")
def parent_assignment(spark, sf_dir):
    return _tree(spark, sf_dir).select("node_id", "parent_id")


@query(CONV + "SELECT parent_id AS node_id, string_agg(node_id, ',' ORDER BY turn) AS child_ids FROM p WHERE parent_id IS NOT NULL GROUP BY ALL")
def child_lists(spark, sf_dir):
    return structure.children(_tree(spark, sf_dir)).withColumn("child_ids", F.array_join("child_ids", ","))


@query("""
WITH s AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM s)
SELECT conv_id, CAST(island AS BIGINT) AS island, any_value(role) AS role, min(turn) AS first_turn, count(*) AS parts, string_agg(text, chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, island""")
def continuation_merge(spark, sf_dir):
    x = structure.islands(t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    first = x.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.min("turn").alias("first_turn"))
    return structure.merged_text(x, ["conv_id", "island"], ["turn"], "text").join(first, ["conv_id", "island"])


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
s AS (SELECT *, sum(CASE WHEN length(line) <= 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS segment FROM l)
SELECT doc_id, CAST(segment AS BIGINT) AS segment, count(*) AS parts, CAST(sum(length(line)) AS BIGINT) AS chars, min(i) AS first_line FROM s GROUP BY doc_id, segment""")
def segment_documents(spark, sf_dir):
    lines = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    x = structure.run_id(lines, ["doc_id"], ["i"], F.char_length("line") <= 12, "segment")
    return x.groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.char_length("line")).cast("long").alias("chars"), F.min("i").cast("long").alias("first_line"))


@query("""
WITH s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM s)
SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM i GROUP BY user_id, island""")
def formula_islands(spark, sf_dir):
    x = structure.islands(t(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")
    return x.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("""
WITH a AS (SELECT event_id AS table_no, user_id AS page, value AS top FROM events WHERE event_type = 'error'), b AS (SELECT event_id AS title_seq, user_id AS page, value AS t FROM events WHERE event_type = 'view'),
j AS (SELECT table_no, a.page, title_seq, t, row_number() OVER (PARTITION BY table_no ORDER BY t DESC NULLS LAST, title_seq DESC) AS i FROM a LEFT JOIN b ON a.page = b.page AND t BETWEEN top - 50 AND top + 10)
SELECT table_no, page, title_seq FROM j WHERE i = 1""")
def band_title_match(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.lit(0).alias("doc_id"), F.col("user_id").alias("page"), F.col("event_id").alias("seq"), F.col("value").alias("top"), "event_type", "props")
    boxes = e.filter("event_type = 'error'").select("doc_id", "page", "top", F.col("seq").alias("table_no"))
    titles = e.filter("event_type = 'view'").select("doc_id", "page", "top", "seq", F.col("props").alias("text"))
    return structure.nearest_title(boxes, titles).select("table_no", "page", "title_seq")


@query("""
SELECT c.user_id, c.event_id, (SELECT max(v.event_id) FROM events v WHERE v.user_id = c.user_id AND v.event_type = 'view' AND v.event_id < c.event_id) AS view_id FROM events c WHERE c.event_type = 'click'""")
def asof_standard(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    views = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("view_id"))
    clicks = e.filter("event_type = 'click'").select("user_id", "event_id")
    return context.as_of(clicks, views, "user_id", "event_id", "at", "view_id").select("user_id", "event_id", "view_id")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND l.l_quantity >= p.p_size - 2 AND l.l_quantity <= p.p_size + 12)""")
def containment_mask(spark, sf_dir):
    line = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).alias("doc_id"), F.col("l_partkey").alias("page"), F.struct(F.col("l_quantity").alias("x0"), F.col("l_quantity").alias("x1"), F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom")).alias("box"))
    area = t(spark, sf_dir, "part").select(F.lit(0).alias("doc_id"), F.col("p_partkey").alias("page"), F.struct(F.col("p_size").alias("x0"), (F.col("p_size") + 10).alias("x1"), F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom")).alias("box"))
    return structure.mask_lines(line, area).select("l_orderkey", "l_linenumber")


@query("""
WITH g AS (SELECT l_orderkey, max(l_linenumber) AS highest, list_sort(list_distinct(list(l_linenumber))) AS have FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS repeated FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)
SELECT l_orderkey, highest, array_to_string([i FOR i IN range(1, highest + 1) IF NOT list_contains(have, CAST(i AS INTEGER))], ',') AS missing, coalesce(repeated, '') AS repeated FROM g LEFT JOIN r USING (l_orderkey)""")
def numbering_gaps(spark, sf_dir):
    n = quality.numbering(t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return n.select("l_orderkey", "highest", join("missing").alias("missing"), join("repeated").alias("repeated"))


@query("SELECT md5(text) AS text_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_hash"), "doc_id")
    return d.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("""SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def coverage_reconcile(spark, sf_dir):
    return quality.reconcile(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT 'orders' AS src, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def dangling_refs(spark, sf_dir):
    o = quality.dangling(t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("id"))
    return o.unionByName(quality.dangling(t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "part").filter("p_size > 5"), "l_partkey", "p_partkey").select(F.lit("lineitem").alias("src"), F.col("l_orderkey").alias("id")))


@query("""SELECT lang, CAST(min(length(text)) AS INTEGER) AS min_len, median(length(text)) AS median_len, round(avg(length(text)), 1) AS mean_len, CAST(max(length(text)) AS INTEGER) AS max_len, count(*) FILTER (length(text) < 25) AS short FROM documents GROUP BY lang""")
def length_stats(spark, sf_dir):
    return quality.length_stats(t(spark, sf_dir, "documents"), "text", ["lang"])


@query("""WITH x AS (SELECT CASE WHEN quality = 0 THEN 'cross_page_clause' WHEN toxic = 1 THEN 'split_by_table' END AS status_reason FROM labels)
SELECT status_reason, count(*) AS n FROM x WHERE status_reason IS NOT NULL GROUP BY ALL""")
def review_reasons(spark, sf_dir):
    """A2 on labels as reviews."""
    reason = F.when(F.col("quality") == 0, "cross_page_clause").when(F.col("toxic") == 1, "split_by_table")
    x = t(spark, sf_dir, "labels").withColumn("status_reason", reason).withColumn("status", F.when(reason.isNull(), "ok").otherwise("need_review"))
    return quality.review_reasons(x)


@query("""
WITH p AS (SELECT p_partkey AS id, [x FOR x IN [CASE WHEN p_size % 10 = 0 THEN 'type' END, CASE WHEN p_size % 7 = 0 OR p_size % 10 = 0 THEN 'level' END, CASE WHEN p_size % 9 = 0 OR p_size % 10 = 0 THEN 'node_id' END, CASE WHEN p_size % 5 = 0 THEN 'content empty' END,
  CASE WHEN p_size % 5 = 1 THEN 'clause short' END, CASE WHEN p_size % 4 = 0 THEN 'pages empty' END, CASE WHEN p_size % 4 = 0 THEN 'pages and bboxes' END, CASE WHEN p_size % 8 = 3 THEN 'bbox' END, CASE WHEN p_size % 3 = 1 THEN 'modality' END,
  CASE WHEN p_size % 6 = 0 THEN 'status' END, CASE WHEN p_size % 6 = 1 THEN 'no reason' END, CASE WHEN p_size % 6 = 2 THEN 'reason without review' END, CASE WHEN p_size % 11 = 0 THEN 'no source' END] IF x IS NOT NULL] AS problems FROM part)
SELECT id, array_to_string(problems, ';') AS problems FROM p WHERE len(problems) > 0""")
def validate_rows(spark, sf_dir):
    """K5, K6 on nodes with planted faults."""
    at = lambda k, r: F.col("p_size") % k == r
    empty, box = F.array().cast("array<string>"), F.struct(F.lit(1.0).alias("x0"), F.lit(1.0).alias("top"), F.when(~at(8, 3), 2.0).alias("x1"), F.lit(2.0).alias("bottom"))
    num = F.col("p_partkey").cast("string")
    n = t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lit("S").alias("standard_id"), F.when(at(10, 0), "odd").otherwise("clause").alias("type"), F.when(at(7, 0), 2).otherwise(3).alias("level"), num.alias("num"), F.concat(F.lit("S:clause:"), num, F.when(at(9, 0), F.lit("x")).otherwise("")).alias("node_id"),
        F.when(at(5, 0), " ").when(at(5, 1), "太短的条文").otherwise("这一条条文有足够多的文字可以通过检查").alias("content"), F.when(at(4, 0), F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("pages"), F.array(box).alias("bboxes"),
        F.array().cast("array<struct<target_type:string,target_num:string>>").alias("refs"), F.when(at(3, 1), "或许").when(at(3, 0), "应").alias("modality"), F.when(at(6, 0), "odd").when(at(6, 1), "need_review").otherwise("ok").alias("status"), F.when(at(6, 2), "split_by_table").alias("status_reason"),
        F.when(at(11, 0), F.array(num)).otherwise(empty).alias("keywords"), F.lit(None).cast("string").alias("keywords_source"), *(empty.alias(c) for c in ("child_ids", "referenced_by", "explains", "explained_by")))
    return n.select("id", F.array_join(structure.problems(), ";").alias("problems")).filter("problems <> ''")


@query("""
WITH d AS (SELECT lang, count(*) AS n, count(*) FILTER (n_chars >= 25) AS long, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(DISTINCT text) AS different FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, round(40.0 * labelled / n + 25.0 * different / n + 15.0 * good / labelled + 20.0 * long / n, 1) AS score FROM d""")
def quality_score(spark, sf_dir):
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left").withColumn("h", F.md5(F.col("text").cast("binary")))
    g = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") >= 25).alias("long"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_distinct("h").alias("different"))
    return g.select("lang", quality.score(F.col("labelled") / F.col("n"), F.col("different") / F.col("n"), F.try_divide("good", "labelled"), F.col("long") / F.col("n")).alias("score"))


@query(None)
def context_budget(spark, sf_dir):
    """For each source, its documents as hits by length, cut to ten blocks of 9000 characters; the skip rule is a fold."""
    d = t(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "clause").when(F.col("lang") == "de", "item").when(F.col("lang") == "fr", "table").otherwise("figure")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    hits = d.select(F.col("source").alias("q_id"), F.col("doc_id").cast("string").alias("node_id"), kind.alias("type"), F.lit(None).cast("string").alias("parent_id"), F.col("doc_id").alias("seq"), "n_chars", F.row_number().over(w).alias("rank"), F.lit(None).cast("int").alias("via")).filter("rank <= 30")
    placed = context.core_and_rest(hits.withColumn("score", F.when(F.col("rank") <= 20, 1.0 / (60 + F.col("rank"))).otherwise(0.0)))
    texts = d.select(F.col("doc_id").cast("string").alias("node_id"), "text")
    return context.fill(placed.join(texts, "node_id")).select("q_id", "node_id", "type", F.char_length("text").alias("chars"))


@query("""
WITH k AS (SELECT count(*) * 3 // 2 + 1 AS k FROM benchmark), c AS (SELECT doc_id, doc_id % k AS item_id, text FROM documents, k), j AS (SELECT c.*, b.text AS item FROM c LEFT JOIN benchmark b USING (item_id))
SELECT doc_id, item_id, CASE WHEN item IS NULL THEN 'invalid' WHEN item_id % 2 = 0 THEN 'cited' WHEN contains(text, item) OR item_id % 3 = 0 THEN 'secondary' ELSE 'invalid' END AS verdict FROM j""")
def citation_verdict(spark, sf_dir):
    """Documents cite items, a third of which do not exist: cited if that is an even item, secondary if a third one or if all of its text stands in the document's."""
    d, b = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")
    k = b.agg((F.floor(F.count(F.lit(1)) * 3 / 2) + 1).alias("k"))  # one row
    key = lambda x: x.select(F.col("doc_id").alias("q_id"), F.lit("S").alias("standard_id"), F.lit("clause").alias("type"), F.col("item_id").cast("string").alias("num"))
    cites = d.join(F.broadcast(k)).withColumn("item_id", F.col("doc_id") % F.col("k")).drop("k")
    both = cites.join(b.select("item_id", F.col("text").alias("item")), "item_id")
    allowed, named = key(both.filter("item_id % 2 = 0")), key(both.filter(F.contains("text", "item") | (F.col("item_id") % 3 == 0)))
    out = context.verdicts(key(cites).withColumn("known", F.lit(True)), allowed, named)
    return out.select(F.col("q_id").alias("doc_id"), F.col("num").cast("long").alias("item_id"), "verdict")


@query("""
WITH n AS (SELECT lang AS type, CASE WHEN n_chars % 5 = 0 THEN 'cross_page_clause' WHEN n_chars % 7 = 0 THEN 'split_by_table' END AS reason, doc_id % 4 AS refs FROM documents)
SELECT 'type' AS what, type AS name, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'review', reason, count(*) FROM n WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'refs', 'all', CAST(sum(refs) AS BIGINT) FROM n UNION ALL SELECT 'refs', 'in_scope', CAST(sum((refs + 1) // 2) AS BIGINT) FROM n""")
def product_summary(spark, sf_dir):
    """K7 on documents as nodes with up to three references, every other one in scope."""
    d = t(spark, sf_dir, "documents")
    reason = F.when(F.col("n_chars") % 5 == 0, "cross_page_clause").when(F.col("n_chars") % 7 == 0, "split_by_table")
    three = F.array(*(F.struct(F.lit(x).alias("in_scope")) for x in (True, False, True)))
    return structure.summary(d.select(F.col("lang").alias("type"), reason.alias("status_reason"), F.when(reason.isNull(), "ok").otherwise("need_review").alias("status"), F.slice(three, F.lit(1), (F.col("doc_id") % 4).cast("int")).alias("refs")))


@query("""
WITH c AS (SELECT i, i % 50 AS k, i % 60 AS node, i % 7 = 0 AS enum FROM (SELECT p_partkey AS i FROM part)), e AS (SELECT c.*, n.n_nationkey IS NULL AS lost, CASE WHEN n.n_nationkey IS NULL THEN '' ELSE '间距' || n.n_nationkey || 'mm' END AS held FROM c LEFT JOIN nation n ON n.n_nationkey = node)
SELECT i AS id, CASE WHEN lost THEN 'n' || node ELSE '' END AS missing, CASE WHEN enum THEN '' ELSE array_to_string([x FOR x IN [k || 'mm', CAST(k AS VARCHAR)] IF NOT contains(held, x)], ',') END AS absent FROM e""")
def evidence_check(spark, sf_dir):
    """One case for each part, with one piece of evidence."""
    i = F.col("p_partkey")
    cases = t(spark, sf_dir, "part").select(i.alias("id"), F.when(i % 7 == 0, "enum").otherwise("fact").alias("type"), F.concat(F.lit("值为"), (i % 50).cast("string"), F.lit("mm")).alias("answer_gold"), F.array(F.concat(F.lit("n"), (i % 60).cast("string"))).alias("evidence"))
    n = F.col("n_nationkey").cast("string")
    nodes = t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), n).alias("node_id"), F.concat(F.lit("间距"), n, F.lit(" mm")).alias("content"))
    return quality.check_cases(cases, nodes).select("id", F.array_join("missing", ",").alias("missing"), F.array_join("absent", ",").alias("absent"))


