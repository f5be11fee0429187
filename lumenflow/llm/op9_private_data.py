"""Personal data: base patterns, and contextual patterns bootstrapped from what these find.

Every word that holds a digit or @ is an instance, so every base span has one; the words to its left and right are its lexical patterns. Instances that a
base pattern covers are seeds. In rounds, a pattern's score is the share of sure instances among its occurrences, and an
instance's the chance that one of its patterns is right. Instances that high-confidence patterns reach become spans of kind "id".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.common import discard, stage

KINDS = ("email", "ip", "card", "phone")
# The base patterns, each with a check that a text may hold a match. Written so that no match is tried again
# from inside a run that has failed, and no repetition is held on the stack: possessive, from a run's start or the last match's end.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11,}+", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
WORD = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
LAMBDA = 2.0


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes Luhn's check."""
    d = f"int(substr({digits}, length({digits}) - i, 1))"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + if(i % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d}))) % 10 = 0"


def _ok(kind: str) -> str:
    """SQL: whether a match f of kind counts."""
    digits = "regexp_replace(f, '[^0-9]', '')"
    if kind == "ip":
        return "forall(split(f, '[.]'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', substr(ltrim('0', p), 1, 3))) <= 255)"
    if kind == "card":
        return f"if(length({digits}) between 12 and 19, {_luhn(digits)}, false)"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    return "true"


def _matches(kind: str, pattern: str, guard: str) -> Column:
    """array<struct<g: length before it, f: its length, ok>> of all matches in text."""
    p, q = pattern.replace("\\", "\\\\"), guard.replace("\\", "\\\\")
    parts = f"zip_with(split(text, '{p}', -1), regexp_extract_all(text, '{p}', 0), (g, f) -> if(f is null, null, named_struct('g', length(g), 'f', length(f), 'ok', {_ok(kind)})))"
    return F.expr(f"if(text rlike '{q}', filter({parts}, m -> m is not null), cast(array() as array<struct<g:int,f:int,ok:boolean>>))")


#: Matches whose places are counted up together; so that a text of n matches copies about n * RUN / 2 of them, not n * n / 2.
RUN = 64


def _placed(column: str, fields: str, kind: str) -> str:
    """SQL: the structs (g: length before it, f: its length, others) of an array as structs of s and e, their places, and fields (of x) of type kind.

    Lengths add up run by run, then within each run.
    """
    empty = f"cast(array() as array<struct<{kind}s:int,e:int>>)"
    runs = f"transform(sequence(0, (size({column}) - 1) div {RUN}), b -> slice({column}, b * {RUN} + 1, {RUN}))"
    starts = f"aggregate(transform({runs}, r -> aggregate(r, 0, (a, x) -> a + x.g + x.f)), named_struct('pos', 0, 'out', cast(array() as array<int>)), (a, n) -> named_struct('pos', a.pos + n, 'out', concat(a.out, array(a.pos))), a -> a.out)"
    one = f"named_struct({fields}'s', a.pos + x.g, 'e', a.pos + x.g + x.f)"
    within = f"aggregate(r, named_struct('pos', p, 'out', {empty}), (a, x) -> named_struct('pos', a.pos + x.g + x.f, 'out', if(x.ok, concat(a.out, array({one})), a.out)), a -> a.out)"
    return f"if(coalesce(size({column}), 0) <= 0, {empty}, flatten(zip_with({runs}, {starts}, (r, p) -> {within})))"


def _places(matches: str) -> Column:
    """array<struct<s, e>> of the matches that count, as code points."""
    return F.expr(_placed(matches, "", ""))


def _words() -> Column:
    """array<struct<v: word, l: left word, r: right word, g, f, ok>> of words that hold a digit or @, so of every base span."""
    w = WORD.replace("\\", "\\\\")
    tidy = lambda s: f"translate({s}, '\\n\\t\\r', '   ')"
    short = lambda w: f"if(length({w}) > 40, sha2({w}, 256), {w})"
    last, first = f"lower(substring_index(rtrim({tidy('m.g')}), ' ', -1))", f"lower(substring_index(ltrim({tidy('m.n')}), ' ', 1))"
    left, right = f"if(trim({tidy('m.g')}) = '', if(i = 0, '^', '#'), {short(last)})", f"if(trim({tidy('m.n')}) = '', '$', {short(first)})"
    gaps, found = f"split(text, '{w}', -1)", f"regexp_extract_all(text, '{w}', 0)"
    joined = f"zip_with(zip_with({gaps}, {found}, (g, f) -> named_struct('g', g, 'f', f)), slice({gaps}, 2, size({gaps})), (m, n) -> named_struct('g', m.g, 'f', m.f, 'n', n))"
    return F.expr(f"""if(text rlike '[0-9@]', transform(filter({joined}, m -> m.f is not null),
        (m, i) -> named_struct('v', if(length(m.f) > 200, sha2(m.f, 256), regexp_replace(m.f, '[.,;:!?)]+$', '')), 'l', {left}, 'r', {right}, 'g', length(m.g), 'f', length(m.f), 'ok', true)), null)""")


def base_spans(docs: DataFrame) -> DataFrame:
    """rid, doc_id, an array of places for each base kind, and words: the candidates with their contexts and places."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select("doc_id", *[_matches(k, *PATTERNS[k]).alias(k) for k in KINDS], _words().alias("words"))
    found = stage(found.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *KINDS, "words"), "matches")  # or each use of them would match again
    return found.select("rid", "doc_id", *[_places(k).alias(k) for k in KINDS], "words")


def _candidates(base: DataFrame) -> DataFrame:
    """rid, v, l, r, s, e, seed for each word that holds a digit or @."""
    known = F.concat(*KINDS)
    places = _placed("words", "'v', x.v, 'l', x.l, 'r', x.r, ", "v:string,l:string,r:string,")
    with_places = base.where("size(words) > 0").select("rid", known.alias("known"), F.expr(places).alias("w"))
    one = with_places.select("rid", "known", F.inline("w"))
    return one.select("rid", "v", "l", "r", "s", "e", F.expr("exists(known, k -> k.s < e and k.e > s)").alias("seed"))


def discover(candidates: DataFrame, rounds: int = 3, sure: float = 0.6, support: int = 3) -> DataFrame:
    """v, l, r, score of instances that no base pattern covers and that high-confidence patterns find.

    l and r are null where all occurrences of v count. A string that a base pattern covers somewhere is a seed; its other occurrences count
    each by their own two patterns (l, r), scored after the last round without what the string itself gives them.

    Pattern: the word to the left or to the right. Its score is the sum of its instances' scores by (their number + LAMBDA),
    counted by distinct instances, and 0 below support of them. An instance's score is 1 less the product of (1 - its patterns' scores); seeds have 1.
    """
    pairs = candidates.select("v", "seed", F.explode(F.array(F.concat(F.lit("L:"), "l"), F.concat(F.lit("R:"), "r"))).alias("p"))
    graph = stage(pairs.groupBy("v", "p").agg(F.max("seed").alias("seed")), "graph")
    score = stage(graph.groupBy("v").agg(F.max("seed").alias("seed")).select("v", "seed", F.col("seed").cast("double").alias("s")), "scores")
    for _ in range(rounds):
        held = graph.select("v", "p").join(score, "v")
        patterns = held.groupBy("p").agg(F.sum("s").alias("t"), F.count("*").alias("c")).where(F.col("c") >= support).select("p", (F.col("t") / (F.col("c") + LAMBDA)).alias("ps")).where("ps > 0.05")
        reached = graph.select("v", "p").join(patterns, "p").groupBy("v").agg((1 - F.exp(F.sum(F.log(1 - F.least("ps", F.lit(0.999)))))).alias("new"))
        new = score.join(reached, "v", "left").select("v", "seed", F.when(F.col("seed"), 1.0).when(F.col("new") >= sure / 2, F.col("new")).otherwise(0.0).alias("s"))
        old, score = score, stage(new, "scores")
        discard(old)
    totals = graph.select("v", "p").join(score, "v").groupBy("p").agg(F.sum("s").alias("t"), F.count("*").alias("c"))
    left, right = F.concat(F.lit("L:"), "l"), F.concat(F.lit("R:"), "r")
    open_ = candidates.where("not seed").join(score.where("seed").select("v"), "v").select("v", "l", "r").distinct()
    others = open_.select("v", "l", "r", F.explode(F.array(left, right)).alias("p")).join(totals.where(F.col("c") > support), "p")
    others = others.select("v", "l", "r", ((F.col("t") - 1) / (F.col("c") - 1 + LAMBDA)).alias("ps")).where("ps > 0.05")
    known = others.groupBy("v", "l", "r").agg((1 - F.exp(F.sum(F.log(1 - F.least("ps", F.lit(0.999)))))).alias("score")).where(F.col("score") >= sure)
    none = F.lit(None).cast("string")
    new = score.where(~F.col("seed") & (F.col("s") >= sure)).select("v", none.alias("l"), none.alias("r"), F.col("s").alias("score"))
    added = stage(new.union(known), "added")
    discard(graph, score)
    return added


def find_private_data(docs: DataFrame, rounds: int = 3, sure: float = 0.6, support: int = 3) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id (those that contexts add) for every row.

    Places are code points of the text, end exclusive; spans are kind:start:end by start, then kind (email, ip, card, phone,
    id), joined by commas. A null or empty text has none. Repeated rows stay and agree; a null doc_id is passed on; other columns
    aren't read. An empty table gives none. Texts of any length are searched whole; ties of start go by kind, those of score don't matter.
    """
    base = stage(base_spans(docs), "base")
    candidates = stage(_candidates(base), "instances")
    added = discover(candidates, rounds, sure, support)
    here = added.select("v", F.col("l").alias("al"), F.col("r").alias("ar"))
    more = candidates.where("not seed").join(here, "v").where("al is null or al <=> l and ar <=> r").groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("id"))
    rows = base.select("rid", "doc_id", *KINDS).join(more, "rid", "left")
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def of_kind(n: int, kind: str) -> Column:
        tag = lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))
        return F.transform(F.coalesce(F.col(kind), none), lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), tag(x).alias("t")))

    def tagged(kinds: tuple[str, ...]) -> Column:
        every = F.array_sort(F.concat(*[of_kind(n, k) for n, k in enumerate(kinds)]))
        return F.array_join(F.transform(every, lambda x: x["t"]), ",")

    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(tagged(KINDS).cast("binary"), 256).alias("base_sha256"), tagged((*KINDS, "id")).alias("spans"), F.size(F.coalesce("id", none)).cast("long").alias("n_id"))
