"""Ranked runs: (run_no, run_name, weight, <key>, score, rank), one row for each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DECAY, BEST = 0.1, 3


def make_run(scored: DataFrame, number: int, name: str, weight: float, position: str) -> DataFrame:
    """Rank by score, falling; equal scores keep the order of position."""
    order = Window.orderBy(F.desc("score"), position)
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.select(F.lit(number).alias("run_no"), F.lit(name).alias("run_name"), F.lit(weight).alias("weight"), *ranked.columns)


def union_candidates(runs: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """One row for each key: first_run and first_rank of its first sight, and a score column for each named run."""
    scores = [F.max(F.when(F.col("run_name") == n, F.col("score"))).alias(n) for n in names]
    seen = runs.groupBy(key).agg(F.min(F.struct("run_no", "rank")).alias("first"), *scores)
    return seen.select(key, F.col("first.run_no").alias("first_run"), F.col("first.rank").alias("first_rank"), *names)


def page_run(run: DataFrame, best: int = BEST, decay: float = DECAY) -> DataFrame:
    """A chunk run (with page_id) as a page run: each page's best chunks, falling powers of decay, ranked anew.

    Only the chunks of the run count; ties go by the page's best chunk.
    """
    of_page = Window.partitionBy("run_no", "page_id").orderBy("rank")
    top = run.withColumn("nth", F.row_number().over(of_page)).filter(F.col("nth") <= best)
    pages = top.groupBy("run_no", "run_name", "weight", "page_id").agg(
        F.sum(F.col("score") * F.pow(F.lit(decay), F.col("nth") - 1)).alias("score"), F.min("rank").alias("first_rank")
    )
    return ranked_pages(pages)


def ranked_pages(pages: DataFrame, score: Column | None = None) -> DataFrame:
    order = Window.partitionBy("run_no").orderBy((score if score is not None else F.col("score")).desc(), "first_rank")
    ranked = pages.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.select("run_no", "run_name", "weight", "page_id", "score", "rank")


def page_union(runs: DataFrame) -> DataFrame:
    """Pages in order of first sight over runs by number, then rank: page_id, union_pos."""
    first = runs.groupBy("page_id").agg(F.min(F.struct("run_no", "rank")).alias("first"))
    return first.select("page_id", F.row_number().over(Window.orderBy("first")).cast("long").alias("union_pos"))


def length_run(union: DataFrame, pages: DataFrame, number: int = 2, weight: float = 1.0) -> DataFrame:
    """Longer pages first; ties by union order."""
    measured = union.join(pages.select("page_id", F.length("content").cast("double").alias("score")), "page_id")
    made = measured.select(F.lit(number).alias("run_no"), F.lit("length").alias("run_name"), F.lit(weight).alias("weight"), "page_id", "score", F.col("union_pos").alias("first_rank"))
    return ranked_pages(made)


def reciprocal_rank_fusion(runs: DataFrame, k: int = 60, names: tuple[str, ...] = ()) -> DataFrame:
    """page_id, rrf, first sight (first_run, first_rank) and a score column for each of names; a missing run adds nothing."""
    scores = [F.max(F.when(F.col("run_name") == n, F.col("score"))).alias(n) for n in names]
    fused = runs.groupBy("page_id").agg(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("rrf"), F.min(F.struct("run_no", "rank")).alias("first"), *scores)
    return fused.select("page_id", "rrf", F.col("first.run_no").alias("first_run"), F.col("first.rank").alias("first_rank"), *names)


def best_of_each(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.filter("nth = 1").drop("nth")
