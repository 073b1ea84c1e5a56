"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w, u uniform from a hash of its id (of its text, if
it has none) and w its quality weight; within a source, documents in ascending key order, then by id and a digest of the text,
are a weighted random order without replacement. Rows that repeat id, source and text are one document with a number. A source whose target is t times its size is taken
whole floor(t) times, and then the sorted order is prefix-summed up to what is left of
the token budget.

The prefix sum needs no task that holds a source: a source of n rows is cut by key
into about sqrt(n) ranges, the ranges' sums are accumulated, and rows are sorted only
within their range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernweave.llm.common import fresh, lookup, stored, table

#: fixed weights by rank of the source, repeating
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"

_PLAIN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)) + b" \t\n\r\x0b\x0c"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, distinct, plain, n_bytes = [], [], [], []
        for value in batch.column(batch.num_columns - 1):  # the text comes last
            data = value.as_py() or b""
            words = data.split()
            size.append(len(words))
            distinct.append(len(set(words)))
            plain.append(len(data) - len(data.translate(None, _PLAIN)))
            n_bytes.append(len(data))
        made = [pa.array(x, pa.int64()) for x in (size, distinct, plain, n_bytes)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *made], [*batch.schema.names[:-1], "size", "n_distinct", "n_plain", "n_bytes"]
        )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest of the text, size in words, distinct words, bytes of letters and white space, bytes."""
    raw = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text_digest(F.col("text")).alias("digest"), F.col("text").cast("binary").alias("data"))
    return raw.mapInArrow(_measure, "doc_id long, source string, digest string, size long, n_distinct long, n_plain long, n_bytes long")


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def quality_weight() -> Column:
    """From 0.05 to 1: the share of plain bytes times the share of distinct words' square root."""
    share = (F.col("n_plain") / F.greatest("n_bytes", F.lit(1))) * F.sqrt(F.col("n_distinct") / F.greatest("size", F.lit(1)))
    return F.greatest(F.lit(0.05), share)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Water-filling over (source, source_size, n_docs), which has one row for each source.

    Adds weight and target. Targets share the sum of all sizes by weight, and stop at
    max_epochs times the source's size with the excess reshared: with sources in order
    of cap / weight, those capped are a prefix of it, so two running sums give the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    cap = F.col("source_size") * F.lit(max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("total", F.sum("source_size").over(whole))
    levels = ranked.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    # the level of the first source that is not capped holds for all after it
    open_level = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), "source", "level"))).over(whole)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("open.level") * F.col("weight"))
    return levels.withColumn("open", open_level).withColumn("target", target).select("source", "source_size", "n_docs", "weight", "target")


def _placed(docs: DataFrame, weight: Column | None, weights: tuple[int, ...], max_epochs: int, seed: str) -> DataFrame:
    """One row for each document: doc_id, source, digest, size, source_size, target, rows, epochs, and extra, how many of its rows are taken once more."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("digest"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    rows = measured(docs).withColumn("w", weight if weight is not None else quality_weight())
    rows = rows.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("skey"), "source", "digest", "size", (-F.log(u) / F.col("w")).alias("key"))
    rows = stored(rows.groupBy("doc_id", "skey", "source", "digest", "size", "key").agg(F.count("*").alias("rows")), "mix-rows")
    words = F.col("size") * F.col("rows")
    sizes = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum(words).alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(sizes, weights, max_epochs)
    targets = targets.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    targets = targets.withColumn("epochs", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    targets = targets.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("cuts", F.ceil(F.sqrt("n_docs")))
    joined = lookup(rows, "skey", stored(targets.drop("source"), "mix-targets"), F.col("n_docs"), rows.count())
    # any rising function of the key cuts a source into ranges; this one is even where weights are alike
    joined = joined.withColumn("cut", F.floor(F.col("cuts") * (1 - F.exp(-F.col("key") * 0.8))).cast("long"))
    cuts = joined.groupBy("skey", "cut").agg(F.sum(words).alias("cut_size"))
    cuts = cuts.withColumn("offset", F.sum("cut_size").over(Window.partitionBy("skey").orderBy("cut")) - F.col("cut_size")).drop("cut_size")
    inside = Window.partitionBy("skey", "cut").orderBy("key", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = joined.join(cuts, ["skey", "cut"]).withColumn("before", F.col("offset") + F.sum(words).over(inside) - words)
    # the n-th row goes if that brings the source nearer: before + n * size - size / 2 <= left
    room = F.col("left") - F.col("before") + F.col("size") / 2
    fit = F.when(F.col("size") == 0, F.when(room >= 0, F.col("rows")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("rows"), F.floor(room / F.greatest("size", F.lit(1))))))
    extra = F.when((F.col("left") > 0) & (F.col("epochs") < max_epochs), fit).otherwise(0).cast("long")
    return placed.select("doc_id", "source", "digest", "size", "source_size", "target", "rows", "epochs", extra.alias("extra"))


def mix(docs: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """How much the mix takes of each row of docs (doc_id, text, source; others are ignored).

    Returns doc_id, source, size, source_size, target, copies and taken. size is the number of
    words; a null text has none. Null sources are one source, last in order. taken is
    copies times size; documents are taken whole, very long ones too, the one at the budget's edge if
    that brings the source nearer to its target. Rows that share an id, or have none, are documents of their own by their texts; of
    rows that repeat id, source and text as many are taken once more as there is room for. An empty table gives no rows. The same
    rows give the same result, in whatever order and partitions they come: keys that tie go by id and the text's digest.
    """
    placed = _placed(docs, weight, weights, max_epochs, seed).withColumn("number", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    copies = (F.col("epochs") + (F.col("number") <= F.col("extra")).cast("long")).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _document(doc_id: Column, source: Column, digest: Column) -> Column:
    """One key for id, source and text."""
    return F.md5(F.concat_ws("\n", F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), digest, F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-"))).cast("binary"))


def mixed_documents(docs: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with docs' columns, whatever their names. As for odd rows, see mix().

    Of rows that repeat id, source and text, of which a part is taken once more, the first one stands for that part.
    """
    key, number, extra = (fresh(docs, n) for n in ("taken_key", "taken_copies", "taken_extra"))
    placed = _placed(docs, weight, weights, max_epochs, seed)
    every = F.col("extra") == F.col("rows")
    facts = placed.select(
        _document(F.col("doc_id"), F.col("source"), F.col("digest")).alias(key), (F.col("epochs") + every.cast("long")).cast("int").alias(number),
        F.when(every, 0).otherwise(F.col("extra")).cast("int").alias(extra), F.col("rows").alias("__rows"),
    )
    facts = stored(facts.filter((F.col(number) > 0) | (F.col(extra) > 0)), "mix-taken")
    keyed = docs.withColumn(key, _document(F.col("doc_id"), F.col("source"), text_digest(F.col("text"))))
    total = facts.agg(F.sum("__rows")).first()[0] or 0
    taken = lookup(keyed, key, facts.filter(F.col(number) > 0).drop(extra), F.col("__rows"), total)
    taken = taken.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(number)))).select(*docs.columns)
    # one document of each source at most
    parts = facts.filter(F.col(extra) > 0)
    if not parts.limit(1).count():
        return taken
    part = lookup(keyed, key, parts.drop(number), F.col("__rows"), total)
    part = part.groupBy(key, extra).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return taken.unionByName(part.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(extra)))).select("row.*"))


_WS = r"[^\x20\x09-\x0D]+"
OP7_SQL = rf"""
WITH d0 AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WS}') AS ws FROM documents),
d AS (SELECT doc_id, source, len(ws)::BIGINT AS size, len(list_distinct(ws)) AS nd, strlen(t) AS nb,
             strlen(t) - strlen(regexp_replace(t, '[A-Za-z\x20\x09-\x0D]|[^\x00-\x7F]', '', 'g')) AS np,
             md5(t) AS h, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(t))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d0),
k AS (SELECT doc_id, source, size, h, -ln(u) / greatest(0.05, (np / greatest(nb, 1)) * sqrt(nd / greatest(size, 1))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             source_size * 3 AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (SELECT *, CASE WHEN lv * w >= cap THEN cap::DOUBLE ELSE
             (SELECT first(lv ORDER BY cap / w, source NULLS LAST) FROM l WHERE lv * w < cap) * w END AS target FROM l),
e AS (SELECT source, source_size, target, floor(target / greatest(source_size, 1)) AS ep, target - floor(target / greatest(source_size, 1)) * source_size AS rest FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.ep, e.rest,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.h ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       ((ep + CASE WHEN upto - size / 2 <= rest AND rest > 0 AND ep < 3 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
"""
