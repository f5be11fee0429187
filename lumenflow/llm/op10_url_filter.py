"""URL filter: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 256-bit blocks (four longs). A URL's hash names one block and eight bits in it; a URL
whose bits aren't all set is on no list. The few that pass meet the list itself in a hash join, which removes false positives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest filter that is broadcast: 2 ** 17 blocks of four longs, 5 MB. A larger one is joined by block.
BROADCAST_BLOCKS, URLS_PER_BLOCK, PROBES = 1 << 17, 16, 8


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query's contract.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule whose host is host's or above it and whose path starts path; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def canonical(host: Column, path: Column) -> Column:
    """host and path without a leading "www." or "m.", a trailing slash or ".html": addresses of one page."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def _block_and_masks(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    block, bits = F.pmod(F.xxhash64(url), F.lit(blocks)), F.xxhash64(url, F.lit(1))
    masks = [F.lit(0).cast("long")] * 4
    for k in range(PROBES):
        place = F.shiftrightunsigned(bits, 8 * k).bitwiseAND(F.lit(255))
        one = F.expr("1L")
        for w in range(4):
            masks[w] = masks[w].bitwiseOR(F.when(F.shiftright(place, 6) == w, F.call_function("shiftleft", one, place.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
    return block, masks


def bloom_blocks(urls: DataFrame, blocks: int) -> DataFrame:
    """The blocked Bloom filter of column canon: block, m0 to m3."""
    block, masks = _block_and_masks(F.col("canon"), blocks)
    rows = urls.select(block.alias("block"), *[m.alias(f"m{w}") for w, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"m{w}") for w in range(4)])


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed (boolean) for every row of pages.

    listed: a column url; its canonical URLs are blocked where no rule fits. Null URLs and those without "://" have an empty
    host and path, fit no rule and are on no list: they are allowed. Repeated rows stay; a null page_id is passed on; other
    columns aren't read. An empty list blocks nothing.
    """
    host, path = host_and_path(F.col("url"))
    urls = listed.select(F.col("url").cast("string").alias("url")).select(host.alias("host"), path.alias("path"))
    urls = urls.select(canonical(F.col("host"), F.col("path")).alias("canon")).where("canon <> ''").distinct()
    n = urls.count()
    blocks = 1 << max(0, (n // URLS_PER_BLOCK).bit_length())
    table = bloom_blocks(urls, blocks)
    if blocks <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("of_rule"), canonical(F.col("host"), F.col("path")).alias("canon"))
    block, masks = _block_and_masks(F.col("canon"), blocks)
    rows = rows.withColumn("block", block).join(table, "block", "left")
    may = F.lit(True)
    for w, m in enumerate(masks):
        may = may & (F.col(f"m{w}").bitwiseAND(m) == m)
    rows = rows.withColumn("may", F.coalesce(may, F.lit(False))).select("page_id", "host", "path", "rule", "of_rule", "canon", "may")
    hits = rows.where("may").join(urls.hint("shuffle_hash").withColumn("listed", F.lit(True)), "canon", "left")
    rest = rows.where("not may").withColumn("listed", F.lit(False))
    both = hits.unionByName(rest, allowMissingColumns=True).withColumn("listed", F.coalesce("listed", F.lit(False)))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("of_rule", method).alias("verdict"), "listed")


def tracked(pages: DataFrame) -> DataFrame:
    """The list of the registered query: the URLs that carry a campaign parameter."""
    return pages.where(F.col("url").contains("utm_source=")).select("url")


ORACLE = """
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url,
         CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM r),
c AS (
  SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/)$', '') AS canon FROM h),
rules(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, v FROM c JOIN rules
    ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)),
best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM m GROUP BY host, path),
listed AS (SELECT DISTINCT canon FROM c WHERE url LIKE '%utm_source=%' AND canon <> '')
SELECT c.page_id, c.host, c.path, best.rule, listed.canon IS NOT NULL AS listed,
       coalesce(best.v, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best ON c.host = best.host AND c.path = best.path LEFT JOIN listed ON c.canon = listed.canon
"""
