"""Benchmark items that windows of one reading or scattered windows tell wrongly."""

import random
from collections import defaultdict

import regex

from fernweave.llm import decontam


def found(spark, docs, items):
    docs = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.matches(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}


def test_names_that_begin_sentences_are_exchanged(spark):
    items = {
        1: "Anna has 12 red apples. Anna gives Ben 5 apples. Ben eats 2 of them. How many apples remain?",
        2: "Tom sells 4 cups. Tom buys 3 plates. Tom breaks 2 bowls. Tom keeps 9 jars. What did Tom spend?",
    }
    docs = {
        1: "Question: Carla has 31 red apples. Carla gives Dan 7 apples. Dan eats 4 of them. How many apples remain?",
        2: "Sue sells 5 cups. Sue buys 6 plates. Sue breaks 7 bowls. Sue keeps 8 jars. What did Sue spend?",
        3: "Sue sells 5 cups. Max buys 6 plates. Eve breaks 7 bowls. Sue keeps 8 jars. What did Kim spend?",
        4: items[1].lower().replace("anna", "Anna").replace("ben", "Ben"),
    }
    assert found(spark, docs, items) == {(1, 1), (2, 2), (4, 1)}


def test_items_without_windows_are_found_word_for_word(spark):
    items = {1: "What is 17 * 23?", 2: "Solve 3x + 5 = 20.", 3: "Compute 12 + 35 * 7 - 4.", 4: "Evaluate 12 km / 4 h + 3 km/h", 5: "", 6: None}
    docs = {k: f"Here it comes. {t} And so on." for k, t in items.items() if t} | {11: "What is 17 * 24?", 12: "Solve 3x + 5", 13: "", 14: None}
    assert found(spark, docs, items) == {(k, k) for k in (1, 2, 3, 4)}


def test_scattered_windows_are_no_run(spark):
    rng = random.Random(4)
    item = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in range(600)]
    parts = [item[k : k + 5] for k in range(0, 600, 40)]
    rng.shuffle(parts)
    scattered = " and yet again ".join(" ".join(p) for p in parts)
    assert found(spark, {1: scattered, 2: "so " + " ".join(item[100:113]) + " too", 3: "so " + " ".join(item[100:112]) + " too"}, {7: " ".join(item)}) == {(2, 7)}


def test_values_are_consistent_across_alignments(spark):
    """Words put in between make two alignments; names of several words are one value."""
    item = "Once Bob went down to the market with 12 fresh eggs in one basket, and after a while dear Bob came home from there with 5 of them."
    docs = {
        1: "Once Zed went down to the market with 30 fresh eggs in one basket, and after a short long while dear Zed came home from there with 7 of them.",
        2: "Once Zed went down to the market with 30 fresh eggs in one basket, and after a short long while dear Max came home from there with 7 of them.",
        3: "Once Ann Lee went down to the market with 30 fresh eggs in one basket, and after a while dear Ann Lee came home from there with 7 of them.",
        4: "Once Ann Lee went down to the market with 30 fresh eggs in one basket, and after a while dear Ann Poe came home from there with 7 of them.",
    }
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    made = {r.doc_id: r.share for r in decontam.matches(rows, spark.createDataFrame([(1, item)], "item_id long, text string"), run=40).collect()}
    # without the second part hardly half of the windows are left
    assert set(made) >= {1, 3} and made[3] == 1.0 and made[1] > 0.7
    assert made.get(2, 0) < 0.6 and 4 not in made


def test_names_of_several_words_begin_sentences(spark):
    items = {1: "Bob has 7 cats. Eva has 8 dogs. How many animals do Bob and Eva keep at home?"}
    docs = {1: "Tom has 3 cats. Ann has 4 dogs. How many animals do Tom and Ann keep at home?", 2: "Ann Lee has 3 cats. Jo Poe has 4 dogs. How many animals do Ann Lee and Jo Poe keep at home?", 3: "Tom has 3 cats. Ann has 4 dogs. How many animals do Ann and Tom keep at home?"}
    assert {(1, 1), (2, 1)} <= found(spark, docs, items)


def plain_words(text):
    text = (text or "").translate({ord(c): " " for c in "§¤‿"})
    opener = rf"(?:{'|'.join(decontam.OPENERS)})(?![\p{{L}}\p{{N}}])"
    text = regex.sub(rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}_])(?:(?<=[\p{{Ll}}\p{{N}},;:] )|(?!{opener}))", "§", text)
    text = regex.sub(r"(§[\p{L}\p{N}]+) (?=§)", r"\1‿", text).lower()
    text = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "_", text)
    text = regex.sub(rf"(?<=[0-9])\s?(?=(?:{'|'.join(decontam.UNITS)})(?![\p{{L}}\p{{N}}]))", " ¤", text)
    return regex.findall(r"[\p{L}\p{N}§¤‿_]+", text)


def kind(word):
    return "#" if word[0] in "0123456789" else word[0] if word[0] in "§¤" else word


def value(word):
    return regex.sub(".*‿§?", "§", word)


def one_to_one(pairs):
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def plain_matches(docs, items):
    """Every window of every document against every window of every item."""
    found = {}
    for i, text in items.items():
        item = plain_words(text)
        windows = [k for k in range(len(item) - 4) if sum(kind(w) not in "#§¤" for w in item[k : k + 5]) >= 3]
        for d, other in docs.items():
            doc = plain_words(other)
            if not windows:
                bare = [w.translate({ord(c): "" for c in "§¤"}) for w in item]
                have = [w.translate({ord(c): "" for c in "§¤"}) for w in doc]
                if bare and any(have[k : k + len(bare)] == bare for k in range(len(have))):
                    found[d, i] = (1.0, 0)
                continue
            lines = defaultdict(lambda: (set(), set()))
            for at in range(len(doc) - 4):
                for k in windows:
                    if [*map(kind, doc[at : at + 5])] == [*map(kind, item[k : k + 5])]:
                        ats, pairs = lines[at - k]
                        ats.add(k)
                        pairs |= {(value(a), value(b)) for a, b in zip(item[k : k + 5], doc[at : at + 5], strict=True) if a[0] in "0123456789§¤"}
            good = sorted((-len(ats), sorted(ats), sorted(pairs)) for ats, pairs in lines.values() if one_to_one(pairs))
            run, held, told = 0, set(), set()
            for n, (_, ats, pairs) in enumerate(good):
                start = last = None
                for at in ats:
                    start = at if last is None or at - last > 5 else start
                    last = at
                    run = max(run, at - start + 5)
                if not n or one_to_one(told | set(pairs)):
                    held |= set(ats)
                    told |= set(pairs)
            share = len(held) / len(windows)
            if good and (share >= decontam.SHARE or run >= decontam.RUN):
                found[d, i] = (share, sum(a != b for a, b in told))
    return found


def test_as_plain_windows(spark):
    rng = random.Random(7)
    people, units, nouns = ["Bob", "Eva", "Tom", "Ann Lee", "Jo Poe", "Max"], ["kg", "km", "hours", "cents"], "apples pears cups bowls jars eggs".split()

    def story(names, numbers, unit, extra=0):
        a, b = names
        words = [f"{a} has {numbers[0]} red {{n0}} and {numbers[1]} {unit} of flour.", f"When {b} meets {a} on the way,", f"{b} gives back {numbers[2]} {{n1}} to {a}.", f"How many {{n0}} does {a} keep in the end?", f"Yesterday {b} had {numbers[0]} more."]
        for _ in range(extra):
            words.insert(rng.randrange(len(words)), rng.choice(["Well now.", "It rains today.", "That is so, they say."]))
        return " ".join(words)

    def values():
        return rng.sample(people, 2), rng.sample(range(2, 99), 3), rng.choice(units)

    items, docs = {}, {}
    for k in range(12):
        n0, n1 = rng.sample(nouns, 2)
        items[k] = story(*values()).replace("{n0}", n0).replace("{n1}", n1)
    items |= {20: "Compute 3 + 4 * 5.", 21: "What is 17 * 23?", 22: None, 23: "", 24: "one two three four five 6 7 8 9"}
    for k in range(60):
        n0, n1 = rng.sample(nouns, 2)
        text = story(*values(), extra=k % 3).replace("{n0}", n0).replace("{n1}", n1)
        cut = text.split()
        docs[k] = " ".join(cut[: rng.randrange(len(cut) // 2, len(cut) + 1)]) if k % 4 == 0 else f"Here it is. {text} And what is 17 * 23?" if k % 5 == 0 else text
    docs |= {100: "So compute 3 + 4 * 5. Now", 101: None, 102: "", 103: items[3] + " " + items[4], 104: "one two three four five 6 7 8 9", 105: "one two three four five 6 7 8 10"}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    made = decontam.matches(rows, spark.createDataFrame(list(items.items()), "item_id long, text string"))
    expected = plain_matches(docs, items)
    assert {(r.doc_id, r.item_id): (round(r.share, 9), r.changed) for r in made.collect()} == {k: (round(s, 9), c) for k, (s, c) in expected.items()}
    assert len(expected) > 40
