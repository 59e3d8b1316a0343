"""Context assembly (C1 to C8) and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V


def type_order(kind: Column | str) -> Column:
    order = V.CONTEXT_TYPES + ["section", "chapter"]
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(kind) if isinstance(kind, str) else kind), F.lit(0)).cast("int"), F.lit(len(order) + 1))


def with_parents(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits of context types, and parents of theirs that are no hits, with score 0. Needs q_id, node_id, score, rank."""
    own = nodes.select("node_id", "type", "parent_id", "seq")
    picked = hits.join(own, "node_id").filter(F.col("type").isin(V.CONTEXT_TYPES))
    up = picked.select("q_id", F.col("parent_id").alias("node_id"), F.col("rank").alias("via")).filter("node_id IS NOT NULL").groupBy("q_id", "node_id").agg(F.min("via").alias("via"))
    up = up.join(picked.select("q_id", "node_id"), ["q_id", "node_id"], "left_anti").join(own, "node_id").filter(F.col("type").isin(V.CONTEXT_TYPES))
    return picked.withColumn("via", F.lit(None).cast("int")).select("q_id", "node_id", "type", "parent_id", "seq", "score", "rank", "via").unionByName(up.select("q_id", "node_id", "type", "parent_id", "seq", F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("rank"), "via"))


def core_and_rest(picked: DataFrame, max_blocks: int = 10) -> DataFrame:
    """Direct hits by type then score, those of at least half the first one's score, `max_blocks` less two at most; then
    the others by type into what room is left, items whose clause is in already excepted first. Adds `place`."""
    direct = picked.filter("score > 0").withColumn("o", type_order("type"))
    w = Window.partitionBy("q_id").orderBy("o", F.desc("score"), "seq", "node_id")
    direct = direct.withColumn("i", F.row_number().over(w)).withColumn("lead", F.first("score").over(w))
    core = direct.filter(F.col("score") >= 0.5 * F.col("lead")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max(2, max_blocks - 2))
    core = core.drop("o", "i", "lead")
    rest = picked.filter("NOT coalesce(score > 0, false)").join(core.select("q_id", "node_id"), ["q_id", "node_id"], "left_anti")
    clauses = core.filter("type = 'clause'").select("q_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("in_core"))
    rest = rest.join(clauses, ["q_id", "parent_id"], "left").filter("NOT (type = 'item' AND coalesce(in_core, false))").drop("in_core")
    held = core.groupBy("q_id").agg(F.count(F.lit(1)).cast("int").alias("held"))
    rw = Window.partitionBy("q_id").orderBy(type_order("type"), F.coalesce("rank", "via"), "seq", "node_id")
    rest = rest.join(held, "q_id", "left").withColumn("held", F.coalesce("held", F.lit(0))).withColumn("i", F.row_number().over(rw)).filter(F.col("i") <= F.greatest(F.lit(1), max_blocks - F.col("held")))
    return core.unionByName(rest.withColumn("place", F.col("held") + F.col("i")).drop("held", "i")).filter(F.col("place") <= max_blocks)


def within_budget(sizes: Column, budget: int) -> Column:
    """For lengths in order, whether each fits what is left; one that does not is skipped, not the end."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("keep"))

    def step(a: Column, n: Column) -> Column:
        fits = a["used"] + n <= budget
        return F.struct((a["used"] + F.when(fits, n).otherwise(0)).cast("long").alias("used"), F.concat(a["keep"], F.array(fits)).alias("keep"))

    return F.aggregate(sizes, zero, step, lambda a: a["keep"])


def fill(blocks: DataFrame, budget: int = 9000) -> DataFrame:
    """Blocks (q_id, node_id, type, parent_id, place, text) that stay: items after their clause go, then the budget in characters."""
    w = Window.partitionBy("q_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_set(F.when(F.col("type") == "clause", F.col("node_id"))).over(w)  # at most max_blocks
    b = blocks.withColumn("_seen", before).filter(~((F.col("type") == "item") & F.coalesce(F.array_contains("_seen", F.col("parent_id")), F.lit(False)))).drop("_seen")
    s = F.sort_array(F.collect_list(F.struct("place", "node_id", "type", "text")))
    g = b.groupBy("q_id").agg(s.alias("s"))
    keep = within_budget(F.transform("s", lambda x: F.char_length(x["text"]).cast("long")), budget)
    return g.select("q_id", F.explode(F.filter(F.arrays_zip(F.col("s"), keep.alias("keep")), lambda z: z["keep"])).alias("z")).select("q_id", "z.s.*")


def standards(nodes: DataFrame) -> DataFrame:
    """The standards at hand by code."""
    return nodes.select("standard_id", "standard_code", "standard_name").distinct().orderBy("standard_code")


def as_of(events: DataFrame, marks: DataFrame, by: str, at: str, mark_at: str, value: str) -> DataFrame:
    """The last mark before each event, one sort of both together: adds `value` and `mark_at` of that mark (null without any)."""
    cols = events.columns
    both = events.select(*cols, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(marks.schema[value].dataType).alias("_v"), F.lit(None).cast(marks.schema[mark_at].dataType).alias("_m")).unionByName(
        marks.select(*(F.col(by) if c == by else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in cols), F.col(mark_at).alias("_t"), F.lit(0).alias("_k"), F.col(value).alias("_v"), F.col(mark_at).alias("_m")))
    # a mark at the same place as an event is not before it
    w = Window.partitionBy(by).orderBy("_t", F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("_k") == 0, F.struct("_m", "_v")), ignorenulls=True).over(w)
    return both.withColumn("_h", hit).filter("_k = 1").select(*cols, F.col("_h._v").alias(value), F.col("_h._m").alias(mark_at))


def positions(text: Column, pattern: str) -> Column:
    """(start, match) of every match: starts follow from the pieces between matches."""
    found = X.all_matches(text, pattern, 0)
    pieces = F.split(text, X.UNI + pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("out"))

    def step(a: Column, m: Column) -> Column:
        i = F.size(a["out"])
        start = (a["at"] + F.char_length(F.get(pieces, i))).cast("int")
        return F.struct((start + F.char_length(m)).cast("int").alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), m.alias("match")))).alias("out"))

    return F.aggregate(found, zero, step, lambda a: a["out"])


def citations(answers: DataFrame) -> DataFrame:
    """(q_id, type, num, at) cited in the source tags of an answer, or in all of it if it has none."""
    a = answers.select("q_id", F.col("answer"), positions(F.col("answer"), V.SOURCE_TAG).alias("tags"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("answer").alias("match")))
    parts = a.select("q_id", F.explode(F.when(F.size("tags") > 0, F.col("tags")).otherwise(whole)).alias("p"))
    out = None
    for kind, pattern in V.CITATIONS:
        x = parts.select("q_id", F.col("p.start").alias("base"), F.explode(positions(F.col("p.match"), pattern)).alias("m"))
        x = x.select("q_id", F.lit(kind).alias("type"), F.regexp_replace(F.regexp_extract("m.match", X.UNI + pattern, 1), r"(?U)\s+", "").alias("num"), (F.col("base") + F.col("m.start")).alias("at"))
        out = x if out is None else out.unionByName(x)
    return out


def attributed(cites: DataFrame, answers: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds standard_id and `known`: the nearest standard code before a citation; null and known without any code before,
    null and not known if that code is of none of `codes` (standard_code, standard_id, and q_id where each answer has its own)."""
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    marks = answers.select("q_id", F.explode(positions(F.col("answer"), V.STANDARD_CODE)).alias("m")).select("q_id", F.col("m.start").alias("code_at"), squeeze(F.col("m.match")).alias("code"))
    x = as_of(cites, marks, "q_id", "at", "code_at", "code")
    on = ["q_id", "code"] if "q_id" in codes.columns else ["code"]
    c = codes.withColumn("code", squeeze(F.col("standard_code"))).groupBy(*on).agg(F.max("standard_id").alias("standard_id"))
    return x.join(c, on, "left").withColumn("known", F.col("code").isNull() | F.col("standard_id").isNotNull())


def named_in(blocks: DataFrame) -> DataFrame:
    """(q_id, standard_id, type, num) that the texts of blocks cite."""
    out = None
    for kind, pattern in V.CITATIONS:
        x = blocks.select("q_id", "standard_id", F.lit(kind).alias("type"), F.explode(X.all_matches("text", pattern, 1)).alias("num"))
        out = x if out is None else out.unionByName(x)
    return out.withColumn("num", F.regexp_replace("num", r"(?U)\s+", "")).distinct()


def verdicts(cites: DataFrame, allowed: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Each citation once with cited (in the material), secondary (only named by it) or invalid. `cites` and both lists have
    q_id, standard_id, type, num; a citation without a standard takes any that the material has for it."""
    c = cites.select("q_id", "standard_id", "type", "num", "known").distinct()
    key = ["q_id", "type", "num"]

    def held(d: DataFrame, name: str) -> DataFrame:
        own = d.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("standard_id").alias("_own")).distinct()
        same = (F.col("standard_id") == F.col("_own")) | F.col("standard_id").isNull()
        x = c.join(own, [F.col(k) == F.col(f"_{k}") for k in key] + [same]).filter("known")
        return x.select(*key, F.coalesce("standard_id", F.lit("")).alias("_s")).distinct().withColumn(name, F.lit(True))

    out = c.withColumn("_s", F.coalesce("standard_id", F.lit("")))
    out = out.join(held(allowed, "_in"), [*key, "_s"], "left").join(held(mentioned, "_by"), [*key, "_s"], "left")
    return out.select("q_id", "standard_id", "type", "num", F.when(F.col("_in"), "cited").when(F.col("_by"), "secondary").otherwise("invalid").alias("verdict"))
