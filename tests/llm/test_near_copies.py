"""Groups of near copies against all pairs on whole shingle sets."""

import random

from fernweave.llm import simhash


def words(rng, n):
    return [f"w{rng.randrange(50_000)}" for _ in range(n)]


def plain_groups(texts):
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    group = list(range(len(texts)))
    pairs = 0
    for k, a in enumerate(sets):
        for j in range(k):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                pairs += 1
                low, high = sorted((group[k], group[j]))
                group = [low if g == high else g for g in group]
    return dict(enumerate(group)), pairs


def check(spark, texts):
    expected, pairs = plain_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.group for r in simhash.copy_groups(docs).collect()} == expected
    return pairs


def test_appended_and_truncated_copies_are_all_found(spark):
    rng = random.Random(1)
    texts = []
    for k in range(80):
        base = words(rng, rng.randrange(60, 400))
        share = 0.802 + 0.001 * (k % 40)
        texts += [" ".join(base), " ".join(base + words(rng, int(len(base) * (1 / share - 1)))) if k % 2 else " ".join(base[: int(len(base) * share) + 2])]
    assert check(spark, texts) >= 70


def test_copies_on_one_template_are_found(spark):
    """Pages of one template are no copies of each other, but some have a copy."""
    rng = random.Random(2)
    template = words(rng, 300)
    texts = []
    for _ in range(60):
        page = template[:150] + words(rng, 45) + template[150:]
        copy = page + words(rng, 60)
        texts += [" ".join(page), " ".join(copy)]
    assert check(spark, texts) >= 50


def test_long_texts_are_decided_on_whole_sets(spark):
    rng = random.Random(3)
    texts = []
    for k in range(60):
        base = words(rng, rng.randrange(600, 1500))
        share = (0.785, 0.795, 0.803, 0.812)[k % 4]
        texts += [" ".join(base), " ".join(base + words(rng, int((len(base) - 4) * (1 / share - 1))))]
    assert 25 <= check(spark, texts) <= 35


def test_candidates_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    """Copies that are similar to one text only, alone and with other pages: few candidates a text, whether its keys are cut into chunks or not."""
    rng = random.Random(4)
    base = words(rng, 130)
    texts = [" ".join(base)]
    while len(texts) < 400:
        copy = base.copy()
        for at in rng.sample(range(130), 2):
            copy[at] = f"w{rng.randrange(50_000)}"
        texts.append(" ".join(copy))
    texts += [" ".join(words(rng, 100)) for _ in range(40)]
    made, whole = [], simhash.stored

    def counted(df, label, keep=False):
        kept = whole(df, label, keep)
        if label in ("found", "met"):
            made.append(kept.count())
        return kept

    monkeypatch.setattr(simhash, "stored", counted)
    for chunk, sample in ((simhash.CHUNK, simhash.SAMPLE), (16, 1)):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        monkeypatch.setattr(simhash, "SAMPLE", sample)
        made.clear()
        assert check(spark, texts) >= 399
        assert sum(made) < 10 * len(texts), made
