"""Explicit schemas of the persistent relations and row validation at the boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_KINDS = {
    "LONG": LongType(), "INT": IntegerType(), "STRING": StringType(), "BOOLEAN": BooleanType(), "TIMESTAMP": TimestampType(), "DOUBLE": DoubleType(),
    "ARRAY<FLOAT>": ArrayType(FloatType()),
}


def _schema(ddl: str) -> StructType:
    """Built without a session, so that it can be imported anywhere."""
    fields = [part.split(" ", 2) for part in ddl.split(", ")]
    return StructType([StructField(name, _KINDS[kind], rest != ["NOT NULL"]) for name, kind, *rest in fields])


SITES = _schema(
    "id LONG NOT NULL, base_url STRING NOT NULL, sitemap_url STRING, feed_url STRING NOT NULL, last_polled_at TIMESTAMP, next_poll_at TIMESTAMP, "
    "feed_etag STRING, feed_last_modified STRING, poll_failures INT NOT NULL, poll_lease_until TIMESTAMP, poll_lease_token STRING, sync_error STRING, "
    "history_pending BOOLEAN NOT NULL, history_error STRING, added_at TIMESTAMP NOT NULL"
)
CRAWL_JOBS = _schema(
    "id LONG NOT NULL, site_id LONG NOT NULL, url STRING NOT NULL, source STRING NOT NULL, attempt_count INT NOT NULL, next_attempt_at TIMESTAMP, "
    "lease_until TIMESTAMP, lease_token STRING, last_error STRING, failed_at TIMESTAMP, discovered_at TIMESTAMP NOT NULL"
)
PAGES = _schema("id LONG NOT NULL, site_id LONG NOT NULL, url STRING NOT NULL, title STRING, content STRING NOT NULL, published_at TIMESTAMP, language STRING, fetched_at TIMESTAMP NOT NULL")
CHUNKS = _schema("id LONG NOT NULL, page_id LONG NOT NULL, start_offset INT NOT NULL, content_length INT NOT NULL, embedding ARRAY<FLOAT> NOT NULL")
POSTINGS = _schema("term STRING NOT NULL, chunk_id LONG NOT NULL, tf INT NOT NULL")
RUN = _schema("run_no INT, run_name STRING, weight DOUBLE, page_id LONG, score DOUBLE, rank LONG")

RELATIONS = {"sites": SITES, "crawl_jobs": CRAWL_JOBS, "pages": PAGES, "chunks": CHUNKS, "postings": POSTINGS}

#: rules beside NOT NULL, as SQL
CHECKS = {
    "sites": ("poll_failures >= 0",),
    "crawl_jobs": ("attempt_count >= 0",),
    "pages": ("language IS NULL OR language RLIKE '^[a-z]{2}$'",),
    "chunks": ("start_offset >= 0", "content_length > 0", "size(embedding) > 0"),
    "postings": ("tf > 0",),
}


def violations(df: DataFrame, relation: str) -> Column:
    """Number of rules of the relation that a row breaks."""
    schema = RELATIONS[relation]
    rules = [F.col(f.name).isNotNull() for f in schema if not f.nullable] + [F.coalesce(F.expr(c), F.lit(False)) for c in CHECKS[relation]]
    return sum((F.when(rule, 0).otherwise(1) for rule in rules), F.lit(0))


def validate(df: DataFrame, relation: str) -> DataFrame:
    """One row: rows and bad_rows. Raises at once if columns or their types differ from the schema."""
    expected = {f.name: f.dataType.simpleString() for f in RELATIONS[relation]}
    found = dict(df.dtypes)
    wrong = {c: found.get(c) for c, kind in expected.items() if found.get(c) != kind}
    if wrong:
        raise TypeError(f"{relation}: unexpected columns or types {wrong}")
    return df.agg(F.count("*").alias("rows"), F.count_if(violations(df, relation) > 0).alias("bad_rows"))
