"""Secret scans over a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: the regex is expanded
to alternatives of literal runs, and a text that matches an alternative must hold
all trigrams of its runs. The index has a posting (trigram, doc_id) for each trigram of
the rules' queries and each document that holds it in lower case. Postings are intersected per
document, the documents that fulfil a rule's query are that rule's candidates, and
only they are verified with the regex. A rule with an alternative that has no
trigram is verified on every document.

Only DataFrame functions run on the main path.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm.common import stored, table

#: alternatives that a part of a regex is expanded to at most; beyond, it counts as unknown, which only widens the query
ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: the group whose length counts, and its least length
    group: int
    least: int


#: fixed rules
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # a maximal run of 32 or more is what is left of [0-9a-f]+ after the length test
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

GAP = None
Alternative = tuple


def _joined(left: Alternative, right: Alternative) -> Alternative:
    if left and right and left[-1] is not GAP and right[0] is not GAP:
        return (*left[:-1], left[-1] + right[0], *right[1:])
    return (*left, *right)


def _alternatives(nodes) -> list[Alternative]:
    """Sequences of literal runs and gaps, one of which any matching text goes through."""
    found: list[Alternative] = [()]
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            here = [(chr(arg).lower(),)]
        elif name == "SUBPATTERN":
            here = _alternatives(arg[3])
        elif name == "BRANCH":
            here = [a for part in arg[1] for a in _alternatives(part)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, part = arg
            inner = _alternatives(part)
            if high == 1:
                here = [(), *inner]
            elif low:
                here = [(*a, GAP, *a) if low > 1 else (GAP, *a, GAP) for a in inner] if len(inner) == 1 else [(GAP, *a, GAP) for a in inner]
            else:
                here = [(GAP,)]
        elif name == "AT":
            here = [()]
        else:
            here = [(GAP,)]
        here = list(dict.fromkeys(here))
        if len(found) * len(here) > ALTERNATIVES:
            here = [(GAP,)]
        found = [_joined(a, b) for a, b in product(found, here)]
    return list(dict.fromkeys(found))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The regex as an OR of ANDs of lower-case trigrams; None if some text without any may match."""
    clauses = set()
    for alternative in _alternatives(sre.parse(pattern)):
        runs = [run for run in alternative if run is not GAP]
        grams = frozenset(run[k : k + 3] for run in runs for k in range(len(run) - 2) if run[k : k + 3].isascii())
        if not grams:
            return None
        clauses.add(grams)
    return [c for c in clauses if not any(d < c for d in clauses)]


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id), sorted; a trigram of many documents spans many partitions."""
    low = docs.select(F.col("doc_id").cast("long"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    postings = low.select("doc_id", F.explode(held).alias("trigram"))
    return stored(postings.repartitionByRange("trigram", "doc_id").sortWithinPartitions("trigram", "doc_id"), "postings")


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id and the kinds whose query it fulfils."""
    by_doc = postings.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))

    def fulfils(clause: frozenset[str]) -> Column:
        return F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(clause))))) == len(clause)

    kinds = [F.when(reduce(lambda a, b: a | b, map(fulfils, clauses)), F.lit(kind)) for kind, clauses in queries.items()]
    return by_doc.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


def _spans(rule: Rule, order: int, parts: Column) -> Column:
    """parts: pieces between matches, matches, and values, zipped; positions are running sums of lengths."""
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["piece"])
        end = begin + F.coalesce(F.length(part["match"]), F.lit(0))
        span = F.struct(begin.cast("long").alias("start"), F.lit(order).alias("rank"), end.cast("long").alias("end"), F.lit(rule.kind).alias("kind"))
        good = F.coalesce(F.length(part["value"]) >= rule.least, F.lit(False))
        return F.struct(end.cast("long").alias("at"), F.when(good, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda state: state["spans"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All spans of the rules in each row of docs (doc_id, text; other columns are ignored).

    Returns doc_id and spans, an array of (start, rank, end, kind) in order of start, then of
    the rules: code points, end exclusive, leftmost non-overlapping for each kind. A
    null text counts as empty, a very long one is scanned whole; rows that share a doc_id, or have none, are each scanned; spans of
    several rules that begin alike stand in the rules' order. An empty table gives no rows.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if queries:
        postings = build_index(base, sorted({t for clauses in queries.values() for c in clauses for t in c}))
        found = stored(candidates(postings, queries), "candidates").withColumnRenamed("doc_id", "__id")
        base = base.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    else:
        base = base.withColumn("kinds", F.array().cast("array<string>"))
    parts = []
    for rule in rules:
        asked = F.array_contains("kinds", rule.kind) if rule.kind in queries else F.col("text").rlike(rule.pattern)
        pieces = F.split("text", rule.pattern, -1)
        matches = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        values = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
        zipped = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), values.alias("value"))
        parts.append(F.when(F.coalesce(asked, F.lit(False)), zipped).alias(rule.kind))
    split = base.select("doc_id", *parts)
    spans = [F.coalesce(_spans(rule, k, F.col(rule.kind)), F.array()) for k, rule in enumerate(rules)]
    return split.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(rule.kind) for rule in RULES]
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.withColumn("told", told).select("doc_id", *counts, F.sha2("told", 256).alias("base_sha256"), F.col("told").alias("spans"))


def _rule_sql(rule: Rule, order: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {order} AS o, {rule.least} AS least, regexp_extract_all(x, '{p}', 0) AS ms,
        regexp_extract_all(x, '{p}', {rule.group}) AS vs, string_split_regex(x, '{p}') AS ps FROM t"""


OP3_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS ({" UNION ALL ".join(_rule_sql(r, k) for k, r in enumerate(RULES))}),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, o, list_sum(list_transform(ps[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda y: length(y))), 0) AS b,
             length(ms[i]) AS n FROM e WHERE length(vs[i]) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || b::BIGINT || ':' || (b + n)::BIGINT, ',' ORDER BY b, o) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""
