"""The engine (H4, C7, S15): indexes over nodes, search, context and checked answers, for whole sets of questions at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import context, graph, ranking, tables
from ..sources import embedders
from ..sources.io import missing_embeddings, stored
from ..streaming import answers

POOL, TOP, BOOST = 30, 10, 0.05


class Engine:
    """Nodes of one or several standards with links and a `seq` that is unique over all of them, as read_nodes gives it; questions
    are DataFrames (q_id long, question string). Everything is a plan over both.

    `embed` turns a list of texts into vectors; without it, or where `reachable` says that its service is down, vectors are hashed
    tokens. Of nodes with one node_id the last counts.
    """

    def __init__(self, nodes: DataFrame, synonyms: dict[str, str] | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None, reachable: Callable[[], bool] | None = None, cache: DataFrame | None = None):
        if nodes.groupBy("seq").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).count():
            raise ValueError("seq must be unique over all nodes")
        last = nodes.groupBy("node_id").agg(F.max("seq").alias("seq"))
        nodes = nodes.join(last, ["node_id", "seq"], "left_semi")
        self.nodes, self.synonyms = nodes.withColumn("nid", F.col("seq").cast("long")), synonyms
        self.embed = embed if embed and embedders.choose(reachable or (lambda: True)) == "service" else None  # S11
        self.cache = cache
        self.vector_nodes = self.nodes.filter(F.col("type").isin(V.VECTOR_TYPES))  # V1
        refs = nodes.select(F.col("node_id").alias("src"), "seq", F.explode("refs").alias("r")).select("src", F.col("r.target_node_id").alias("dst"), F.col("r.target_type").alias("type"), "seq")
        known = nodes.select(F.col("node_id").alias("dst"))
        contains = nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("contains").alias("type"), "seq")
        self.edges = stored(graph.edges(refs.join(known, "dst", "left_semi"), contains))

    def search(self, questions: DataFrame, k: int = TOP) -> DataFrame:
        """(q_id, node_id, type, num, score, rank, bm25_rank, vector_rank, via_graph): fused ranks, boosted mentions, closure."""
        q = questions.withColumn("asked", X.expand_query("question", self.synonyms))
        n = self.nodes.withColumn("tokens", F.concat(X.tokens("content"), F.flatten(F.array_repeat(X.tokens(F.array_join("keywords", " ")), 3))))
        words = X.tokens("asked")
        bm = ranking.bm25(n, q, "nid", "q_id", F.col("tokens"), words, POOL, unique=True)
        vec = self._vectors(q, words)
        named = q.select("q_id", F.explode(X.mentions("question")).alias("m")).select("q_id", F.col("m.type").alias("type"), F.col("m.num").alias("num"))
        first = self.nodes.agg(F.min_by("standard_id", "seq").alias("standard_id"))  # a bare number means the first standard
        boost = named.join(self.nodes.join(F.broadcast(first), "standard_id", "left_semi").select("nid", "type", "num"), ["type", "num"]).select("q_id", "nid").distinct().withColumn("boost", F.lit(BOOST))
        hits = ranking.fuse(bm, vec, "q_id", "nid", k, boost=boost).join(self.nodes.select("nid", "node_id", "type", "num"), "nid")
        hits = stored(hits.select("q_id", "node_id", "type", "num", "score", "rank", F.col("rank_a").alias("bm25_rank"), F.col("rank_b").alias("vector_rank"), F.lit(None).cast("string").alias("via_graph")))
        more = graph.closure(hits.select("q_id", F.col("node_id").alias("id"), "rank", "type"), self.edges, self.nodes.select(F.col("node_id").alias("id"), "type"), V.REFERENCE_KINDS)
        more = more.join(self.nodes.select(F.col("node_id").alias("id"), "type", "num"), "id")
        none = lambda t: F.lit(None).cast(t)
        every = hits.unionByName(more.select("q_id", F.col("id").alias("node_id"), "type", "num", F.lit(0.0).alias("score"), none("int").alias("rank"), none("int").alias("bm25_rank"), none("int").alias("vector_rank"), F.col("via").alias("via_graph")))
        return stored(every)  # contexts and comparisons read it several times

    def _vectors(self, q: DataFrame, words: Column) -> DataFrame:
        """Nearest nodes by vectors of the service, where there is one, else of hashed tokens; stored vectors are used again."""
        if not self.embed:
            docs = ranking.hashed_vectors(self.vector_nodes, "nid", X.tokens("content"), unique=True)
            return ranking.nearest(docs, ranking.hashed_vectors(q, "q_id", words), "nid", "q_id", "vector", POOL, at="at", dims=512)
        texts = self.vector_nodes.select("nid", embedders.key("content").alias("key"), "content")
        new = embedders.embed_with(missing_embeddings(texts, self.cache) if self.cache else texts.select("key", F.col("content").alias("text")).dropDuplicates(["key"]), "key", "text", self.embed)
        self.cache = stored(new.unionByName(self.cache.select("key", "vector")) if self.cache else new)
        docs = texts.select("nid", "key").join(self.cache, "key").select("nid", "vector")
        asked = embedders.embed_with(q, "q_id", "asked", self.embed)
        return ranking.nearest(docs, asked, "nid", "q_id", "vector", POOL)

    def rows(self, questions: DataFrame, k: int = 3) -> DataFrame:
        """(q_id, node_id, title, row_index, row_text, score, rank): the rows of stored tables that hold most words of a question."""
        held, _ = tables.store_rows(self.nodes.filter("type = 'table'"))
        return tables.rows_for(held, questions, k)

    def contexts(self, hits: DataFrame, max_blocks: int = 10, max_chars: int = 9000, several: bool = False) -> DataFrame:
        """(q_id, place, node_id, type, text): the blocks that go to the generator."""
        picked = stored(context.with_parents(hits.select("q_id", "node_id", "score", "rank"), self.nodes))
        placed = stored(context.core_and_rest(picked, max_blocks))
        texts = self.nodes.select("node_id", X.block_text(several).alias("text"))
        return context.fill(placed.join(texts, "node_id"), max_chars)

    def lookups(self, questions: DataFrame, chosen: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
        """Exact values for a question's keys, from tables that no block holds yet."""
        lookup = tables.tools(self.nodes) if lookup is None else lookup
        registered = tables.registry(self.nodes).select("node_id", "seq", F.col("body.title").alias("title"))
        return tables.probe(questions, registered, lookup, chosen)

    def verify(self, answers: DataFrame, blocks: DataFrame) -> DataFrame:
        """A verdict on each citation of (q_id, answer), by the blocks given for it."""
        own = blocks.select("q_id", "node_id", "text").join(self.nodes.select("node_id", "standard_id", "standard_code", "type", "num"), "node_id")
        codes = own.select("q_id", "standard_code", "standard_id").unionByName(own.select("q_id", F.col("standard_id").alias("standard_code"), "standard_id"))
        cites = context.attributed(context.citations(answers), answers, codes)
        return context.verdicts(cites, own.select("q_id", "standard_id", "type", "num"), context.named_in(own))

    def ask(self, question: str, generate: answers.Pieces = answers.extract, detail: str = "brief") -> Iterator[tuple[str, dict]]:
        """The events of one answer: hits and blocks, the generator's pieces, then the checked citations."""
        spark = self.nodes.sparkSession
        q = spark.createDataFrame([(0, question)], "q_id long, question string")
        names = [(r["standard_code"], r["standard_name"]) for r in context.standards(self.nodes).collect()]  # as many as there are books
        hits = self.search(q)
        blocks = self.contexts(hits, several=len(names) > 1)
        chosen = blocks.orderBy("place").collect()  # ten at most
        held = spark.createDataFrame([(0, r["node_id"]) for r in chosen], "q_id long, node_id string")
        keys = q.select(F.size(X.key_candidates("question"))).first()[0]
        found = self.lookups(q, held).collect() if keys else []  # three at most
        material = [r["text"] for r in chosen] + [f"【{r['node_id']}】\n【查表结果】{r['key']} → {r['value']}{'' if r['exact'] else '（表中无此精确值，取最接近的一档）'}" for r in found]
        messages = [{"role": "system", "content": X.system_prompt(names, detail)}, {"role": "user", "content": f"材料：\n\n{question}" if not material else "\n\n".join(material) + f"\n\n问题：{question}"}]

        def finish(answer: str) -> dict:
            a = spark.createDataFrame([(0, answer)], "q_id long, answer string")
            own = spark.createDataFrame([(0, r["node_id"], r["text"]) for r in chosen], "q_id long, node_id string, text string")
            return {"citations": [r.asDict() for r in self.verify(a, own).collect()], "refused": a.select(X.is_refusal("answer")).first()[0]}

        meta = {"blocks": [r["node_id"] for r in chosen], "tables": [r["node_id"] for r in found], "rows": [r.asDict() for r in self.rows(q).orderBy("rank").collect()]}  # three rows
        yield from answers.events(messages, generate, finish, meta)

    def health(self) -> dict:
        """Counts."""
        s = graph.stats(self.nodes, self.edges).first()
        return {"nodes": s["nodes"], "edges": s["edges"], "standards": [r["standard_code"] for r in context.standards(self.nodes).collect()]}

    def node(self, node_id: str) -> dict | None:
        """One node."""
        row = self.nodes.filter(F.col("node_id") == node_id).first()
        return row.asDict(recursive=True) if row else None

    def trace(self, question: str) -> list[dict]:
        """The hits of one question, without an answer."""
        q = self.nodes.sparkSession.createDataFrame([(0, question)], "q_id long, question string")
        return [r.asDict() for r in self.search(q).orderBy(F.col("rank").asc_nulls_last(), "node_id").collect()]  # TOP hits and nine neighbours


def boxes_by_page(nodes: DataFrame) -> DataFrame:
    """(node_id, page, boxes): a node's boxes on each of its pages."""
    x = nodes.select("node_id", F.explode(F.arrays_zip("pages", "bboxes")).alias("z")).select("node_id", F.col("z.pages").alias("page"), F.col("z.bboxes").alias("box"))
    return x.groupBy("node_id", "page").agg(F.sort_array(F.collect_list("box")).alias("boxes"))


def badges(verdicts: DataFrame, answers: DataFrame) -> DataFrame:
    """(q_id, cited, secondary, invalid, refused) of each answer."""
    v = verdicts.groupBy("q_id").agg(*(F.count_if(F.col("verdict") == k).alias(k) for k in ("cited", "secondary", "invalid")))
    return answers.select("q_id", X.is_refusal("answer").alias("refused")).join(v, "q_id", "left").na.fill(0, ["cited", "secondary", "invalid"])


def compare_rankings(engine: Engine, questions: DataFrame, k: int = 3) -> DataFrame:
    """(q_id, method, node_id, rank): the first k by words, by vectors and fused."""
    hits = engine.search(questions, POOL).filter("via_graph IS NULL")
    part = lambda c, name: hits.filter(F.col(c) <= k).select("q_id", F.lit(name).alias("method"), "node_id", F.col(c).alias("rank"))
    return part("bm25_rank", "bm25").unionByName(part("vector_rank", "vector")).unionByName(part("rank", "hybrid"))
