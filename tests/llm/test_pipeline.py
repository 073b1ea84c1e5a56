"""The corpus pipeline, each stage on its own input, against plain versions."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from fernweave.llm import decontam, mixing, quality, simhash, tokens
from fernweave.llm.common import stored


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(stored(stage(spark, made[-1], sf), "test"))
    return made


def test_stages(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_quality_stage(stages):
    kept = Counter(r.doc_id for r in stages[1].select("doc_id").collect())
    told = {r.doc_id: r.accepted for r in quality.classify(stages[0].select("doc_id", "text")).select("row.doc_id", "accepted").collect()}
    assert kept == Counter(i for i, ok in told.items() if ok)


def test_near_dedup_stage(stages):
    """All pairs on whole shingle sets: of each group that they connect, the least id stays."""
    rows = sorted((r.doc_id, set(np.unique(simhash.shingle_hashes((r.text or "").encode(), 5)).tolist())) for r in stages[1].collect())
    group = {i: i for i, _ in rows}
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if len(a & b) >= 0.8 * len(a | b) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {x: low if g == high else g for x, g in group.items()}
    assert {r.doc_id for r in stages[2].collect()} == set(group.values())
    assert len(set(group.values())) < len(group)


def test_decontamination_stage(spark, sf, stages):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()["text"]
    for r in stages[3].collect():
        assert not any(i in (r.text or "") for i in items)
    gone = {r.doc_id for r in stages[2].collect()} - {r.doc_id for r in stages[3].collect()}
    told = decontam.matches(stages[2].select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert gone == {r.doc_id for r in told.collect()}


def test_mixing_stage(stages):
    told = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter({i: n for i, n in told.items() if n})


def test_token_stage_and_run(spark, sf, stages):
    found = sorted(map(tuple, stages[5].collect()), key=lambda r: r[1])
    texts = sorted(((r.doc_id, r.text) for r in stages[4].collect()), key=lambda r: r[0])
    start = 0
    for (doc_id, at, n, crc), (expected, text) in zip(found, texts, strict=True):
        ids = [*tokens.load(tokens.vocabulary_path(tokens.TOKENIZER)).encode(text or "", add_special_tokens=False).ids, 1]
        assert (doc_id, at, n, crc) == (expected, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=lambda r: r[1]) == found


def test_rows_under_one_id_are_told_apart(spark):
    """Null and repeated ids: near-dedup, decontamination and mixing treat every text on its own."""
    words = [f"w{k}" for k in range(60)]
    item = "When Bob has 12 apples and gives 5 kg of them to Mary because she asked Bob politely."
    texts = [" ".join(words[k:] + words[:k]).replace("w", f"x{k}y") for k in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, of_id long")
    assert Counter((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()) == Counter(rows)
    copies = [*rows, (None, texts[0]), (7, texts[4]), (7, texts[2].upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in copies], docs.schema)
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()]
    assert len(kept) == 5 and {t.lower() for _, t in kept} == set(texts) and (9, texts[4]) not in kept and (7, texts[4]) in kept
    leaked = [*rows, (None, f"Some words. {item} More."), (7, f"Other words. {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in leaked], docs.schema)
    items = spark.createDataFrame([(None, item), (3, "something else entirely that no text has")], "item_id long, text string")
    assert Counter((r.doc_id, r.text) for r in decontam.clean_documents(docs, items).collect()) == Counter(rows)
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()} == {(None, None), (7, None)}
    assert [r.contaminated for r in decontam.contamination(docs, items).collect()].count(True) == 2


def test_mixing_reruns_alike_and_comes_near_the_target(spark):
    """Ties of keys, null ids and repeated rows, in several partitionings."""
    texts = ["a b c d", "a b c d", "e f g h", "e f g h"] * 10 + ["long " * 30] * 20
    rows = [(None if k % 4 == 0 else k % 3, t, "en", f"s{k % 2}") for k, t in enumerate(texts)]
    seen, taken = set(), set()
    for parts in (1, 7, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(parts)
        made = mixing.mix(docs).collect()
        seen.add(tuple(sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source, r.taken) for r in made)))
        whole = mixing.mixed_documents(docs).collect()
        taken.add(tuple(sorted((r.doc_id is None, r.doc_id or 0, r.text, r.source) for r in whole)))
        assert len(made) == len(rows)
        for source in ("s0", "s1"):
            target = next(r.target for r in made if r.source == source)
            assert abs(sum(r.taken for r in made if r.source == source) - target) <= 30
            assert sum(len(r.text.split()) for r in whole if r.source == source) == sum(r.taken for r in made if r.source == source)
    assert len(seen) == 1 and len(taken) == 1
