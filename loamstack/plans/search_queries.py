"""Driver queries on retrieval: postings, BM25, vectors, fusion, mentions, synonyms, row search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking as R

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = "unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'))"


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {WORDS} AS term FROM documents) GROUP BY ALL")
def token_postings(spark, sf_dir):
    return R.postings(t(spark, sf_dir, "documents"), "doc_id", R.latin_words("text"))


@query(f"""
WITH w AS (SELECT doc_id, {WORDS} AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
l AS (SELECT round(count(*) / (SELECT n FROM n), 6) AS avgdl FROM w), d AS (SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY term)
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, avgdl FROM d, n, l""")
def corpus_stats(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    tf = R.stored(R.postings(docs, "doc_id", R.latin_words("text")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("words")))
    total = tf.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words")).join(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))))  # one row each
    stats = total.select("n", F.round(F.col("words") / F.col("n"), 6).alias("avgdl"))
    df = tf.join(F.broadcast(stats))  # one row
    return df.select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"), "avgdl")


BM25 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS term FROM documents), dl AS (SELECT doc_id, count(*) AS dl FROM d GROUP BY doc_id),
s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM d) / (SELECT count(*) FROM documents) AS avgdl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {WORDS} AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), s GROUP BY ALL),
bm AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc WHERE score > 0)
"""


def _bm25(spark, sf_dir, k):
    words = R.latin_words("text")
    return R.bm25(t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark"), "doc_id", "item_id", words, words, k)


@query(BM25 + "SELECT item_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


def _hash_sql(table: str, key: str) -> str:
    return f"""SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS value FROM (
      SELECT {key}, CAST(('0x' || substr(md5(term), 1, 8))::UBIGINT % 512 AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {key}, {WORDS} AS term FROM {table}) GROUP BY ALL)"""


@query(f"SELECT doc_id, bucket, round(value, 6) AS value FROM ({_hash_sql('documents', 'doc_id')})")
def hash_embed_buckets(spark, sf_dir):
    return R.hashed(t(spark, sf_dir, "documents"), "doc_id", R.latin_words("text")).withColumn("value", F.round("value", 6))


def _vectors(spark, sf_dir, k):
    v = t(spark, sf_dir, "embeddings")
    return R.nearest(v, v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", "embedding", k, exclude_self=True)


VECTORS = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM c)
"""


@query(VECTORS + "SELECT query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    return _vectors(spark, sf_dir, 10).withColumn("score", F.round("score", 5)).withColumn("rank", F.col("rank").cast("long"))


@query(VECTORS + """, n AS (SELECT query_id, label, count(*) AS votes FROM r WHERE rank <= 10 GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS i FROM n)
SELECT query_id, label, votes FROM w WHERE i = 1""")
def vector_label_vote(spark, sf_dir):
    hits = _vectors(spark, sf_dir, 10).join(t(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    votes = hits.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("query_id").orderBy(F.desc("votes"), "label")
    return votes.withColumn("i", F.row_number().over(w)).filter("i = 1").drop("i")


HYBRID = BM25 + f""", hd AS ({_hash_sql('documents', 'doc_id')}), hq AS ({_hash_sql('benchmark', 'item_id')}),
hs AS (SELECT item_id, hd.doc_id, round(sum(hq.value * hd.value), 9) AS score FROM hq JOIN hd USING (bucket) GROUP BY ALL),
hv AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM hs),
f AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS bm25_rank, b.rank AS vector_rank,
        coalesce(0.5 / (60 + a.rank), 0) + coalesce(0.5 / (60 + b.rank), 0) AS score
      FROM (SELECT * FROM bm WHERE rank <= 30) a FULL JOIN (SELECT * FROM hv WHERE rank <= 30) b ON a.item_id = b.item_id AND a.doc_id = b.doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM f)
"""


@query(HYBRID + "SELECT item_id, doc_id, bm25_rank, vector_rank, round(score, 6) AS score, rank FROM fr WHERE rank <= 10")
def hybrid_rrf(spark, sf_dir):
    words = R.latin_words("text")
    docs = R.hashed_vectors(t(spark, sf_dir, "documents"), "doc_id", words)
    asked = R.hashed_vectors(t(spark, sf_dir, "benchmark"), "item_id", words)
    vectors = R.nearest(docs, asked, "doc_id", "item_id", "vector", 30, at="at", dims=512).filter("score > 0")
    out = R.fuse(_bm25(spark, sf_dir, 30), vectors, "item_id", "doc_id", 10)
    long = lambda c, n: F.col(c).cast("long").alias(n)
    return out.select("item_id", "doc_id", long("rank_a", "bm25_rank"), long("rank_b", "vector_rank"), F.round("score", 6).alias("score"), long("rank", "rank"))


@query(r"""
WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS base FROM documents),
s AS (SELECT source, doc_id, (CASE WHEN base <= 30 THEN 0.5 / (60 + base) ELSE 0 END) + (CASE WHEN regexp_matches(text, '[0-9]+\.[0-9]+\.[0-9]+') THEN 0.05 ELSE 0 END) AS score FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT source, doc_id, round(score, 6) AS score, rank FROM k WHERE rank <= 10""")
def mention_boost(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    first = R.top(docs.withColumn("_n", F.col("n_chars").cast("double")), "source", "_n", "doc_id", 30).select("source", "doc_id", "rank")
    named = docs.filter(F.size(T.mentions("text")) > 0).select("source", "doc_id", F.lit(0.05).alias("boost"))
    out = R.fuse(first, first.limit(0), "source", "doc_id", 10, boost=named)
    return out.select("source", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SYNONYMS = {"then": "that those", "und": "oder nicht", "con": "para por", "there": "that here"}


@query("""
WITH w AS (SELECT item_id, text, list_distinct([x FOR x IN list_concat(list_concat(CASE WHEN contains(text, 'then') THEN ['that', 'those'] ELSE [] END,
  CASE WHEN contains(text, 'und') THEN ['oder', 'nicht'] ELSE [] END), list_concat(CASE WHEN contains(text, 'con') THEN ['para', 'por'] ELSE [] END, CASE WHEN contains(text, 'there') THEN ['that', 'here'] ELSE [] END))]) AS s FROM benchmark)
SELECT item_id, text || CASE WHEN contains(text, 'then') THEN ' that those' ELSE '' END || CASE WHEN contains(text, 'und') THEN ' oder nicht' ELSE '' END || CASE WHEN contains(text, 'con') THEN ' para por' ELSE '' END
  || CASE WHEN contains(text, 'there') THEN CASE WHEN contains(text, 'then') THEN ' here' ELSE ' that here' END ELSE '' END AS expanded, CAST(len(s) AS INTEGER) AS added FROM w""")
def synonym_expand(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark")
    expanded = T.expand_query("text", SYNONYMS)
    extra = F.trim(F.substring(expanded, F.char_length("text") + 1, F.char_length(expanded)))
    return b.select("item_id", expanded.alias("expanded"), F.when(extra == "", 0).otherwise(F.size(F.split(extra, " "))).alias("added"))


PHRASE = ["small", "ring", "Brand#2", "ECONOMY", "blue", "mal"]


@query(f"""
WITH r AS (SELECT p_partkey, 'p_name=' || p_name || '；p_brand=' || p_brand || '；p_type=' || p_type AS row_text FROM part),
s AS (SELECT p_partkey, row_text, CAST({' + '.join(f"(length(row_text) - length(replace(row_text, '{w}', ''))) // {len(w)}" for w in PHRASE)} AS BIGINT) AS score FROM r),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, p_partkey) AS rank FROM s WHERE score > 0)
SELECT p_partkey, row_text, score, rank FROM k WHERE rank <= 50""")
def phrase_row_search(spark, sf_dir):
    from ..operators.tables import find_rows, row_text

    rows = t(spark, sf_dir, "part").select("p_partkey", row_text(["p_name", "p_brand", "p_type"]).alias("row_text"))
    return find_rows(rows, "p_partkey", "row_text", PHRASE, 50)


@query("""SELECT p_partkey, concat_ws('；', CASE WHEN p_name <> '' THEN 'p_name=' || p_name END, CASE WHEN p_brand <> '' THEN 'p_brand=' || p_brand END,
  CASE WHEN p_type NOT IN ('', 'SMALL') THEN 'p_type=' || p_type END, 'p_size=' || p_size) AS row_text FROM part""")
def row_flatten(spark, sf_dir):
    from ..operators.tables import row_text

    p = t(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_type") != "SMALL", F.col("p_type"))).withColumn("p_size", F.col("p_size").cast("string"))
    return p.select("p_partkey", row_text(["p_name", "p_brand", "p_type", "p_size"]).alias("row_text"))


@query("""
WITH d AS (SELECT d.doc_id, p.page_id, regexp_replace(lower(regexp_extract(p.html, '<title>([^<]*)</title>', 1)), '[^0-9a-z]', '', 'g') AS a, regexp_replace(lower(d.text), '[^0-9a-z]', '', 'g') AS b
  FROM pages p JOIN documents d ON d.doc_id = p.page_id),
g AS (SELECT page_id, CASE WHEN length(a) < 2 THEN [] ELSE list_distinct([substr(a, CAST(i AS INTEGER), 2) FOR i IN range(1, length(a))]) END AS x,
             CASE WHEN length(b) < 2 THEN [] ELSE list_distinct([substr(b, CAST(i AS INTEGER), 2) FOR i IN range(1, length(b))]) END AS y FROM d)
SELECT page_id, CAST(len(list_intersect(x, y)) AS INTEGER) AS overlap, CAST(len(x) AS INTEGER) AS title_grams FROM g""")
def title_overlap(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lower("text").alias("text"))
    d = d.join(R.bounded(p.select("page_id")), "page_id", "left_semi").repartition("page_id")  # texts with a page lie together in a few files
    x, y = T.bigrams("title", "[^0-9a-z]"), T.bigrams("text", "[^0-9a-z]")
    return p.join(d, "page_id").select("page_id", F.size(F.array_intersect(x, y)).alias("overlap"), F.size(x).alias("title_grams"))
