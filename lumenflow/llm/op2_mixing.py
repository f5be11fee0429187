"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree (domain, language, source): each node's children share its budget by weight, a child that
cannot use its share leaves the rest to its siblings, and only what a whole subtree cannot use reaches the siblings of its
ancestors. A leaf spends its budget on whole epochs of its documents, then on a prefix of one more, in an order drawn from a
seed. All arithmetic is on integers, so any engine finds the same mix.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import discard, stage

LEVELS = ("domain", "lang", "source")
#: The first hexadecimal digits of a document's key: a leaf's order is cut first by these, then inside the one that the cut falls in.
BUCKET_DIGITS, BROADCAST_LEAVES = 3, 100_000
SPACE, WORDS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def source_domain(source: Column) -> Column:
    """The registered query's domains: web (src0 to src9), books (src10 to src14), forum (all others)."""
    return F.when(source.rlike("^src[0-9]$"), "web").when(source.rlike("^src1[0-4]$"), "books").otherwise("forum")


# Parameters of the registered query and the pipeline; what isn't named weighs 1.
WEIGHTS = {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    w = F.lit(1)
    for name, value in weights.get(level, {}).items():
        w = F.when(F.col(level) == name, value).otherwise(w)
    return w.cast("long")


def budgets(leaves: DataFrame, budget: int, max_epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """leaves (LEVELS, tokens) with full (whole epochs) and rest (tokens of one more).

    At each level a child is full when its weight's share of what its smaller siblings leave is no less than its capacity;
    siblings are taken by capacity for weight. Integer division may leave a token for each child unspent.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    given: DataFrame | None = None
    for depth in range(1, len(LEVELS) + 1):
        names, above = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = caps.groupBy(*names).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(LEVELS[depth - 1], weights))
        nodes = nodes.withColumn("b", F.lit(budget).cast("long")) if given is None else nodes.join(given, above)
        order = Window.partitionBy(*above).orderBy((F.col("cap") / F.col("w")), LEVELS[depth - 1])
        group = Window.partitionBy(*above)
        nodes = nodes.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        nodes = nodes.withColumn("beside", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        nodes = nodes.withColumn("is_full", F.col("cap") * F.col("beside") <= (F.col("b") - F.col("before")) * F.col("w"))
        nodes = nodes.withColumn("spent", F.sum(F.when(F.col("is_full"), F.col("cap")).otherwise(0)).over(group)).withColumn("open", F.sum(F.when(F.col("is_full"), 0).otherwise(F.col("w"))).over(group))
        share = F.expr("if(is_full, cap, (b - spent) * w div open)")
        given = nodes.select(*names, share.alias("b"))
    out = leaves.join(given, list(LEVELS))
    return out.select(*LEVELS, "tokens", "b", F.expr("if(tokens = 0, 0L, b div tokens)").alias("full"), F.expr("if(tokens = 0, 0L, b % tokens)").alias("rest"))


def _prepared(docs: DataFrame, domain: Column) -> DataFrame:
    """doc_id, LEVELS (never null) and tokens of every row."""
    t = F.col("text").cast("string")
    cols = [F.col("doc_id"), domain.alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), token_count(t).alias("tokens")]
    return docs.select(*cols)


def _key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.col("doc_id").cast("string")))


def _small(leaves: DataFrame) -> DataFrame:
    """leaves for a broadcast join if they are few enough; otherwise Spark chooses the join."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def plan(rows: DataFrame, share: float, max_epochs: int, weights: Mapping[str, Mapping[str, int]], seed: int) -> DataFrame:
    """LEVELS, full, cut_key, cut_tokens for each leaf: the prefix of its last epoch takes documents with a smaller key whole
    and cut_tokens of those with the key itself. A staged table of a row per leaf.

    The cut is found by first adding tokens up by the key's first digits, so no leaf is sorted as a whole.
    """
    leaves = stage(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    parts = stage(budgets(leaves, int(total * share), max_epochs, weights), "budgets")
    discard(leaves)
    keyed = rows.join(_small(parts.select(*LEVELS, "full", "rest").where("rest > 0")), list(LEVELS)).withColumn("key", _key(seed)).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*LEVELS, "full", "rest", "bucket").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    edge = stage(sums.withColumn("upto", upto).where("upto >= rest and upto - t < rest").select(*LEVELS, "full", "bucket", (F.col("rest") - F.col("upto") + F.col("t")).alias("left")), "edges")
    inside = keyed.join(_small(edge.drop("full")), [*LEVELS, "bucket"]).groupBy(*LEVELS, "left", "key").agg(F.sum("tokens").alias("t"))
    reach = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    cut = inside.withColumn("reach", reach).where("reach >= left and reach - t < left").select(*LEVELS, F.col("key").alias("cut_key"), (F.col("left") - F.col("reach") + F.col("t")).alias("cut_tokens"))
    return stage(parts.join(cut, list(LEVELS), "left").select(*LEVELS, "full", "cut_key", "cut_tokens"), "mix")


def _decide(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    rows = rows.join(_small(leaves), list(LEVELS)).withColumn("key", _key(seed))
    prefix = F.expr("case when cut_key is null or key > cut_key then 0L when key < cut_key then tokens else least(tokens, cut_tokens) end")
    return rows.withColumn("prefix_tokens", prefix)


def mix(docs: DataFrame, domain: Column, share: float = 0.6, max_epochs: int = 3, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, seed: int = 7) -> DataFrame:
    """doc_id, domain, lang, source, tokens, full_epochs, prefix_tokens of the documents that the mix takes.

    share: the budget as a share of all tokens (words between ASCII white space). A null language or source is "", a null text
    has no tokens and is never taken. Rows that share a doc_id and a leaf are drawn together; at the cut each of them is cut alike. An
    empty table gives none.
    """
    rows = stage(_prepared(docs, domain), "counted")
    out = _decide(rows, plan(rows, share, max_epochs, weights, seed), seed)
    return out.where("tokens > 0 and (full > 0 or prefix_tokens > 0)").select("doc_id", *LEVELS, "tokens", F.col("full").alias("full_epochs"), "prefix_tokens")


def mixed_documents(docs: DataFrame, domain: Column, share: float, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The documents that a mix of at most one epoch takes, with all their columns; that at a leaf's cut keeps its first words.

    Each row is decided by its leaf's row alone, so texts are not shuffled. Cases are those of mix().
    """
    rows = stage(_prepared(docs, domain), "counted")
    leaves = plan(rows, share, 1, weights, seed)
    names = ["__domain", "__lang", "__source", "__full", "__cut_key", "__cut_tokens"]
    t = F.col("text").cast("string")
    left = docs.withColumns({"__domain": domain, "__lang": F.coalesce(F.col("lang"), F.lit("")), "__source": F.coalesce(F.col("source"), F.lit("")), "__tokens": token_count(t)})
    left = left.join(_small(leaves.toDF(*names)), names[:3])
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__full").cast("string"), F.col("doc_id").cast("string")))
    left = left.withColumn("__key", key)
    cut = F.col("__key") == F.col("__cut_key")
    taken = (F.col("__tokens") > 0) & ((F.col("__full") > 0) | F.coalesce((F.col("__key") < F.col("__cut_key")) | cut, F.lit(False)))
    short = (F.col("__full") == 0) & cut & (F.col("__cut_tokens") < F.col("__tokens"))
    words = F.expr("split(regexp_replace(text, '^[ \\\\t-\\\\r]+', ''), '[ \\\\t-\\\\r]+', cast(__cut_tokens + 1 as int))")
    rest = F.element_at(words, -1)
    prefix = F.rtrim(F.substr(t, F.lit(1), F.length(t) - F.length(rest)))
    text = F.when(F.coalesce(short, F.lit(False)), prefix).otherwise(F.col("text"))
    return left.where(taken).select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def _case(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"


def _level(depth: int) -> str:
    names, above, last = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth - 1]), LEVELS[depth - 1]
    part = f"PARTITION BY {above}" if above else ""
    source = f"n{depth} JOIN g{depth - 1} USING ({above})" if above else "n1 CROSS JOIN (SELECT CAST(floor(sum(tokens) * 0.6) AS BIGINT) AS b FROM leaves)"
    return f"""
n{depth} AS (SELECT {names}, CAST(sum(tokens * 3) AS BIGINT) AS cap, CAST({_case(last)} AS BIGINT) AS w FROM leaves GROUP BY {names}),
o{depth} AS (SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {last} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER ({part} ORDER BY cap / w, {last} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS beside FROM {source}),
f{depth} AS (SELECT *, cap * beside <= (b - before) * w AS is_full FROM o{depth}),
s{depth} AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS spent, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS open FROM f{depth}),
g{depth} AS (SELECT {names}, CAST(CASE WHEN is_full THEN cap ELSE (b - spent) * w // open END AS BIGINT) AS b FROM s{depth}),"""


ORACLE = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src1[0-4]$') THEN 'books' ELSE 'forum' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
{"".join(_level(depth) for depth in (1, 2, 3))}
l AS (SELECT domain, lang, source, b // tokens AS whole, b % tokens AS rest FROM leaves JOIN g3 USING (domain, lang, source) WHERE tokens > 0),
k AS (SELECT d.*, l.whole, l.rest, md5('7:' || l.whole || ':' || doc_id) AS key FROM d JOIN l USING (domain, lang, source)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) - tokens AS before FROM k)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(whole AS BIGINT) AS full_epochs, CAST(greatest(0, least(tokens, rest - before)) AS BIGINT) AS prefix_tokens
FROM c WHERE tokens > 0 AND (whole > 0 OR least(tokens, rest - before) > 0)
"""
