from datetime import date

import pytest
from pyspark.sql import functions as F

from fernweave.functions import text as T
from fernweave.operators import chunk, rank
from fernweave.operators.filters import by_language, by_published_range, compiled
from fernweave.plans import search


def runs(spark, *rows):
    return spark.createDataFrame(rows, "run_no int, run_name string, weight double, page_id long, score double, rank long")


def test_run_keeps_order_of_equal_scores(spark):
    scored = spark.createDataFrame([(11, 7.25), (12, 3.0), (13, 7.25), (14, 9.5)], "chunk_id long, score double")
    assert [r.chunk_id for r in rank.make_run(scored, 0, "dense", 2.0, "chunk_id").orderBy("rank").collect()] == [14, 11, 13, 12]


def plain_fusion(weights, orders, k=60):
    """Page ids by their sum of weight / (k + rank)."""
    found = {}
    for weight, order in zip(weights, orders, strict=True):
        for at, page in enumerate(order, 1):
            found[page] = found.get(page, 0) + weight / (k + at)
    return dict(sorted(found.items(), key=lambda x: -x[1]))


@pytest.mark.parametrize("orders", [((31, 32, 33), (34, 33)), ((31,), (32, 31), (33, 32, 31)), ((31, 32), (), (32, 35, 36, 31))])
def test_fusion(spark, orders):
    weights = (1.5, 0.75, 4.0)[: len(orders)]
    df = runs(spark, *[(n, f"r{n}", weights[n], page, 1.0, at) for n, order in enumerate(orders) for at, page in enumerate(order, 1)])
    fused = rank.reciprocal_rank_fusion(df).orderBy(F.desc("rrf")).collect()
    expected = plain_fusion(weights, orders)
    assert [r.page_id for r in fused] == list(expected)
    assert [r.rrf for r in fused] == pytest.approx(list(expected.values()))


def test_best_three_chunks_decay(spark):
    scores = {5: [4.0, 3.0, 2.0, 1.0], 6: [5.0], 7: [-2.0, -4.0]}
    scored = spark.createDataFrame([(n, p, s) for n, (p, s) in enumerate((p, s) for p, ss in scores.items() for s in ss)], "chunk_id long, page_id long, score double")
    found = rank.page_run(rank.make_run(scored, 0, "dense", 2.0, "chunk_id")).orderBy("rank").collect()
    expected = {p: sum(s * 0.1**n for n, s in enumerate(ss[:3])) for p, ss in scores.items()}
    assert [r.page_id for r in found] == sorted(expected, key=lambda p: -expected[p])
    assert {r.page_id: r.score for r in found} == pytest.approx(expected)


def test_length_run(spark):
    union = spark.createDataFrame([(8, 1), (9, 2), (10, 3)], "page_id long, union_pos long")
    pages = spark.createDataFrame([(8, "Rosen"), (9, "Rosen und Nelken im Mai"), (10, "Tulpe")], "page_id long, content string")
    found = rank.length_run(union, pages).orderBy("rank").collect()
    assert [(r.page_id, r.score) for r in found] == [(9, 23.0), (8, 5.0), (10, 5.0)]


def test_scores_merge_by_run(spark):
    df = spark.createDataFrame([(1, "bm25", 77, 12.5, 3), (0, "dense", 77, 0.31, 9), (1, "bm25", 78, 2.5, 4)], "run_no int, run_name string, chunk_id long, score double, rank long")
    rows = {r.chunk_id: r for r in rank.union_candidates(df, "chunk_id", ("dense", "bm25")).collect()}
    assert (rows[77].dense, rows[77].bm25, rows[77].first_run) == (0.31, 12.5, 0)
    assert (rows[78].dense, rows[78].bm25, rows[78].first_run) == (None, 2.5, 1)


def test_runs_are_fused_by_page(spark):
    chunks = "chunk_id long, page_id long, score double"
    dense = rank.make_run(spark.createDataFrame([(61, 21, 0.5), (62, 21, 0.4), (63, 22, 0.45), (64, 23, 0.1)], chunks), 0, "dense", 2.0, "chunk_id")
    bm25 = rank.make_run(spark.createDataFrame([(64, 23, 8.0), (63, 22, 6.0)], chunks), 1, "bm25", 0.5, "chunk_id")
    pages = spark.createDataFrame([(21, "a"), (22, "b"), (23, "c")], "page_id long, content string")
    found = search.fuse([dense, bm25], pages).orderBy("position").collect()
    assert [r.page_id for r in found] == list(plain_fusion((2.0, 0.5), ((21, 22, 23), (23, 22))))
    assert {r.page_id: r.dense for r in found} == pytest.approx({21: 0.54, 22: 0.45, 23: 0.1})


def test_empty_runs_find_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, page_id long, score double")
    pages = spark.createDataFrame([(1, "a")], "page_id long, content string")
    assert search.fuse([rank.make_run(none, 0, "dense", 2.0, "chunk_id")], pages, (rank.length_run,)).count() == 0


def test_filters(spark):
    df = spark.sql("SELECT 1 id, 'en' language, timestamp '2025-03-04 23:59:59' published_at UNION ALL SELECT 2, NULL, NULL UNION ALL SELECT 3, 'en', timestamp '2025-03-05 00:00:00'")
    assert df.filter(compiled((), df)).count() == 3
    assert [r.id for r in df.filter(compiled((by_language("en"), by_published_range(date(2025, 1, 2), date(2025, 3, 4))), df)).collect()] == [1]
    assert df.filter(compiled((by_published_range(None, None),), df)).count() == 3


@pytest.mark.parametrize(("start", "end"), [("20250102", ""), ("2025-03-04", "2025-01-02"), ("x", "")])
def test_bad_ranges(start, end):
    with pytest.raises(ValueError):
        T.parse_range(start, end)


def test_ranges():
    assert T.parse_range("", "") == (None, None)
    assert T.parse_range("2025-01-02", "") == (date(2025, 1, 2), None)


@pytest.mark.parametrize(("n", "starts"), [(20, [0, 6, 12]), (17, [0, 6, 12]), (8, [0]), (0, [])])
def test_windows_of_characters(n, starts):
    assert [a for a, _ in chunk.spans_of([(k, k + 1) for k in range(n)], 8, 2)] == starts


def test_word_windows_rebuild_text(spark):
    text = "  one two\tthree\n\nfour five  six seven eight nine ten "
    pages = spark.createDataFrame([(1, text), (2, " \n"), (3, ""), (4, None)], "page_id long, content string")
    rows = chunk.word_windows(pages, 4, 1).orderBy("chunk_no").collect()
    assert {r.page_id for r in rows} == {1}
    assert [r.content.split() for r in rows] == [text.split()[k : k + 4] for k in (0, 3, 6)]
    assert all(text[r.start_offset : r.start_offset + r.content_length] == r.content for r in rows)


def test_window_needs_room(spark):
    with pytest.raises(ValueError):
        chunk.word_windows(spark.createDataFrame([(1, "a")], "page_id long, content string"), 4, 4)


@pytest.mark.parametrize(("score", "name"), [(1.0, "high"), (0.65, "high"), (0.6499, "mid"), (0.57, "mid"), (0.5, "mid"), (0.4999, "low"), (-1.0, "low")])
def test_confidence(spark, score, name):
    assert spark.range(1).select(T.confidence(F.lit(score)).alias("c")).first().c == name


@pytest.mark.parametrize(
    ("body", "good"),
    [
        ('{"model":"m","data":[{"index":1,"embedding":[-8,0.5]},{"index":0,"embedding":[6,7]}]}', True),
        ('{"data":[{"index":0,"embedding":[6,7]},{"index":1,"embedding":[-8,Infinity]}]}', False),
        ('{"data":[{"index":0,"embedding":[6,7]},{"index":false,"embedding":[-8,0.5]}]}', False),
        ('{"data":[{"index":0,"embedding":[6,7]},{"index":1,"embedding":[-8,0.5,1]}]}', False),
        ('{"data":[{"index":0,"embedding":[6,7]},{"index":1,"embedding":[-8,0.5]},{"index":2,"embedding":[1,1]}]}', False),
        ('{"data":[{"index":1,"embedding":[6,7]},{"index":1,"embedding":[-8,0.5]}]}', False),
        ('{"data":{"index":0}}', False),
        ("<html>", False),
    ],
)
def test_embedding_payloads(spark, body, good):
    vectors = spark.range(1).select(T.embeddings_payload(F.lit(body), F.lit(2), 2).alias("v")).first().v
    assert vectors == ([[6.0, 7.0], [-8.0, 0.5]] if good else None)


def test_poll_offsets():
    found = [T.poll_offset_of(f"https://beet{n}.garten.example", 600) for n in range(1500)]
    assert min(found) >= 0 and max(found) < 600
    quarters = [sum(150 * q <= x < 150 * (q + 1) for x in found) for q in range(4)]
    assert all(300 < n < 450 for n in quarters)


def test_query_text():
    assert T.query_text("rote Rosen", "Finde passende Texte") == "Instruct: Finde passende Texte\nQuery: rote Rosen"
    assert T.query_text("rote Rosen") == "rote Rosen"
