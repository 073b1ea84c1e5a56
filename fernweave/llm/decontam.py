"""Benchmark decontamination by template canonicalisation.

Texts of documents and benchmark items become templates: numbers, names within a sentence and units
after numbers turn into typed placeholders, everything else is lower-cased, and marks go. Windows of
five template words are hashed and joined; a document and an item that share enough of the
item's windows match if the values in the placeholders are consistent: along one alignment, equal
values of the item stand for equal values of the document and different ones for
different ones. Alignments are put together, longest first, as long as that holds across them. So an item is found verbatim and
with its numbers, names or units exchanged, also if words were put in between.

A capitalised word that begins a sentence counts as a name too, but for some that begin many (OPENERS); such a word as
"Yesterday" then is a value like others. Names of several words are one placeholder, and its value is the last of
them. Items without any window (short or dense in numbers) are found by their whole sequence of words, values included:
it is cut into pieces of five words, all of which must stand in one alignment.

Only DataFrame functions run. Words of the documents are spread to rows of five, which are hashed and probe the item
side; that is broadcast in blocks of BLOCK windows at most, with one pass over the documents for each block, whatever the
benchmark's size. Nothing but hits leaves the pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm.common import fresh, stored, table, text_key

WIDTH = 5
#: a match has this share of an item's windows, or a run of RUN words along one alignment
SHARE, RUN = 0.5, 13
#: windows with fewer plain words tell nothing
PLAIN_WORDS = 3
BLOCK = 1 << 18
#: fixed values: words that begin sentences and are no names
OPENERS = (
    "A", "An", "The", "This", "That", "These", "Those", "There", "Here", "He", "She", "It", "We", "You", "They", "His", "Her", "Its", "Our", "Your", "Their", "My", "How", "What", "When", "Where", "Which",
    "Who", "Whose", "Why", "If", "In", "On", "At", "By", "For", "From", "To", "Of", "With", "Without", "After", "Before", "During", "While", "As", "And", "But", "Or", "So", "Then", "Now", "Each", "Every", "All",
    "Some", "Many", "Most", "Is", "Are", "Was", "Were", "Do", "Does", "Did", "Can", "Could", "Will", "Would", "Should", "Has", "Have", "Had", "Not", "No", "Yes", "Let", "Find", "Compute", "Solve", "Evaluate",
)
#: fixed values
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "miles", "mile", "feet", "ft", "inches", "pounds", "lbs", "dollars", "euros", "cents", "percent", "mph", "degrees")

_NUMBER, _NAME, _UNIT, _JOIN = "#", "§", "¤", "‿"
_W = [f"w{k}" for k in range(WIDTH)]


def _marked(text: Column) -> Column:
    """Words of the text in lower case; names begin with § and units with ¤, numbers with their first digit; a name's words are joined."""
    text = F.translate(F.coalesce(text, F.lit("")), _NAME + _UNIT + _JOIN, "   ")
    opener = rf"(?:{'|'.join(OPENERS)})(?![\p{{L}}\p{{N}}])"
    text = F.regexp_replace(text, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}_])(?:(?<=[\p{{Ll}}\p{{N}},;:] )|(?!{opener}))", _NAME)
    text = F.regexp_replace(text, rf"({_NAME}[\p{{L}}\p{{N}}]+) (?={_NAME})", f"$1{_JOIN}")
    text = F.regexp_replace(F.lower(text), r"(?<=[0-9])[.,](?=[0-9])", "_")
    text = F.regexp_replace(text, rf"(?<=[0-9])\s?(?=(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))", f" {_UNIT}")
    return F.regexp_extract_all(text, F.lit(rf"[\p{{L}}\p{{N}}{_NAME}{_UNIT}{_JOIN}_]+"), F.lit(0))


def _template(word: Column) -> Column:
    return F.when((word >= "0") & (word < ":"), F.lit(_NUMBER)).when(word.startswith(_NAME), F.lit(_NAME)).when(word.startswith(_UNIT), F.lit(_UNIT)).otherwise(word)


def _spread(rows: DataFrame) -> DataFrame:
    """rows(…, text) with at (0 first) and the words from there on, w0 to w4, null beyond the end, for each word; the text goes."""
    others = [c for c in rows.columns if c != "text"]
    rows = rows.select(*others, _marked(F.col("text")).alias("words"))
    shifted = [F.slice("words", k + 1, F.size("words")).alias(_W[k]) if k else F.col("words").alias(_W[0]) for k in range(WIDTH)]
    return rows.select(*others, F.posexplode(F.arrays_zip(*shifted)).alias("at", "w")).select(*others, "at", *[F.col("w")[w].alias(w) for w in _W])


def _bare(word: Column) -> Column:
    return F.translate(word, _NAME + _UNIT, "")


def _window_key() -> Column:
    """Hash of the template of five words; null if there are fewer."""
    return F.when(F.col(_W[-1]).isNotNull(), F.xxhash64(*[_template(F.col(w)) for w in _W]))


def _piece_key(n: int) -> Column:
    """Hash of n words, values included; null if there are fewer."""
    return F.when(F.col(_W[n - 1]).isNotNull(), F.xxhash64(F.lit(n), *[_bare(F.col(w)) for w in _W[:n]]))


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the items are found by: item_id, item (tells items apart), item_at, key, whole and item_words; and of each item the number of its keys.

    Windows that have enough plain words, and for items without any the pieces of the whole (whole is true).
    """
    rows = stored(_spread(items.select("item_id", text_key(F.col("text")).alias("item"), "text").distinct()), "item-words")
    plain = sum((F.when(_template(F.col(w)).isin(_NUMBER, _NAME, _UNIT), 0).otherwise(1) for w in _W), F.lit(0))
    windows = rows.withColumn("key", _window_key()).filter(F.col("key").isNotNull() & (plain >= PLAIN_WORDS))
    sizes = rows.groupBy("item_id", "item").agg(F.count("*").cast("int").alias("size"))
    of = windows.select(F.col("item_id").alias("i"), F.col("item").alias("j")).distinct()
    rest = sizes.join(of, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item") == F.col("j")), "left_anti").select(F.col("item_id").alias("i"), F.col("item").alias("j"), "size")
    mine = rows.join(rest, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item") == F.col("j"))).withColumn("n", F.least(F.col("size"), F.lit(WIDTH)))
    # every fifth word begins a piece, and so does the last place where one fits
    mine = mine.filter((F.col("at") + F.col("n") <= F.col("size")) & ((F.col("at") % WIDTH == 0) | (F.col("at") + F.col("n") == F.col("size"))))
    pieces = mine.withColumn("key", F.coalesce(*[F.when(F.col("n") == n, _piece_key(n)) for n in range(1, WIDTH + 1)]))
    shown = [F.col("item_id"), F.col("item"), F.col("at").alias("item_at"), F.col("key")]
    both = windows.select(*shown, F.lit(0).alias("whole"), F.array(*_W).alias("item_words")).unionByName(pieces.select(*shown, F.col("n").alias("whole"), F.array(*_W).alias("item_words")))
    both = stored(both, "item-windows")
    return both, both.groupBy(F.col("item_id").alias("of_id"), F.col("item").alias("of_item")).agg(F.countDistinct("item_at").alias("windows"))


def _longest(ats: Column, width: int) -> Column:
    """Most words in a row that windows beginning at ats cover."""

    def step(a: Column, at: Column) -> Column:
        start = F.when(at - a["last"] <= width, a["start"]).otherwise(at)
        return F.struct(at.alias("last"), start.alias("start"), F.greatest(a["best"], at - start + width).alias("best"))

    zero = F.struct(F.lit(-(1 << 30)).alias("last"), F.lit(0).alias("start"), F.lit(0).alias("best"))
    return F.aggregate(F.array_sort(ats), zero, step, lambda a: a["best"])


def _fits(pairs: Column) -> Column:
    """Whether (item_words, doc_words) tell one value for each value, both ways."""

    def told(side: str) -> Column:
        return F.size(F.array_distinct(F.transform(pairs, lambda p: p[side])))

    return (F.size(pairs) == told("item_words")) & (F.size(pairs) == told("doc_words"))


def _together(lines: Column) -> Column:
    """The windows and values of the longest alignment and of each that is consistent with those before."""

    def step(state: Column, line: Column) -> Column:
        pairs = F.array_distinct(F.concat(state["pairs"], line["pairs"]))
        both = F.struct(F.array_union(state["ats"], line["ats"]).alias("ats"), pairs.alias("pairs"))
        return F.when(_fits(pairs), both).otherwise(state)

    first = lines[0]
    return F.aggregate(lines, F.struct(first["ats"].alias("ats"), first["pairs"].alias("pairs")), step)


def _matches(docs: DataFrame, items: DataFrame, share: float, run: int) -> DataFrame:
    """doc_id, row, item_id, item, share, changed for each match of docs (doc_id, row, text)."""
    wanted, per_item = item_windows(items)
    # whole is the number of words in a piece, five at most
    lengths = sorted(r.whole for r in wanted.select("whole").distinct().collect())
    blocks = max(1, -(-wanted.count() // BLOCK))
    keys = F.array(*[F.struct(F.lit(n).alias("whole"), (_piece_key(n) if n else _window_key()).alias("key")) for n in lengths]) if lengths else F.array().cast("array<struct<whole:int,key:bigint>>")
    rows = _spread(docs).select("doc_id", "row", "at", *_W, F.explode(keys).alias("k")).select("doc_id", "row", "at", *_W, "k.whole", "k.key")
    hits = None
    for block in range(blocks):
        part = wanted.filter(F.pmod("key", F.lit(blocks)) == block)
        found = rows.join(F.broadcast(part), ["whole", "key"]).select("doc_id", "row", "item_id", "item", "whole", "at", "item_at", F.array(*_W).alias("doc_words"), "item_words")
        hits = found if hits is None else hits.unionByName(found)
    key = ["doc_id", "row", "item_id", "item"]
    # one row for each alignment first; its values are few, an item's length at most
    pairs = F.filter(F.arrays_zip("item_words", "doc_words"), lambda p: p["item_words"].rlike(rf"^[0-9{_NAME}{_UNIT}]"))
    pairs = F.transform(pairs, lambda p: F.struct(*[F.regexp_replace(p[side], f".*{_JOIN}{_NAME}?", _NAME).alias(side) for side in ("item_words", "doc_words")]))
    values = F.when(F.col("whole") == 0, pairs).otherwise(F.array())
    lines = hits.groupBy(*key, (F.col("at") - F.col("item_at")).alias("line"), (F.col("whole") > 0).alias("whole")).agg(
        F.array_sort(F.collect_set("item_at")).alias("ats"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(values)))).alias("pairs")
    )
    of = F.col("item_id").eqNullSafe(F.col("of_id")) & (F.col("item") == F.col("of_item"))
    exact = lines.filter("whole").join(per_item, of).filter(F.size("ats") == F.col("windows")).select(*key, F.lit(1.0).alias("share"), F.lit(0).alias("changed")).distinct()
    lines = lines.filter(~F.col("whole") & _fits(F.col("pairs"))).withColumn("run", _longest(F.col("ats"), WIDTH))
    told = F.struct((-F.size("ats")).alias("size"), "ats", "pairs")
    both = lines.groupBy(*key).agg(_together(F.array_sort(F.collect_set(told))).alias("best"), F.max("run").alias("run"))
    changed = F.size(F.filter("best.pairs", lambda p: p["item_words"] != p["doc_words"]))
    joined = both.join(per_item, of).withColumn("share", F.size("best.ats") / F.col("windows"))
    return joined.filter((F.col("share") >= share) | (F.col("run") >= run)).select(*key, "share", changed.alias("changed")).unionByName(exact)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("row"), "text")


def matches(docs: DataFrame, items: DataFrame, share: float = SHARE, run: int = RUN) -> DataFrame:
    """doc_id, item_id, share of the item's windows, and changed: the number of its values that differ.

    docs has doc_id and text, items item_id and text; other columns are ignored. Null and empty texts match nothing, and very long ones
    are read whole. Items with fewer than five words or with hardly any plain word match word for word only, whatever their
    length. Null ids, of documents and items, are ids like any other. Documents that share an id are matched one by one
    by their texts, as are items; rows that repeat both count once. Of alignments equally long the one of earlier windows comes
    first. An empty table of either gives no rows.
    """
    return _matches(_rows(docs), items, share, run).drop("row", "item")


def contamination(docs: DataFrame, items: DataFrame, share: float = SHARE, run: int = RUN) -> DataFrame:
    """One row for each of docs: doc_id, contaminated, n_items, item_id and share of the best item (of ties, the least id), changed. As for odd rows, see matches()."""
    found = _matches(_rows(docs), items, share, run)
    best = found.groupBy(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")).agg(
        F.count("*").alias("n_items"), F.max(F.struct("share", (-F.col("item_id")).alias("neg"), "changed")).alias("best")
    )
    rows = _rows(docs).drop("text")
    joined = rows.join(stored(best, "contaminated"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")), "left")
    return joined.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        (-F.col("best.neg")).alias("item_id"),
        F.coalesce("best.share", F.lit(0.0)).alias("share"),
        F.coalesce("best.changed", F.lit(0)).alias("changed"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, share: float = SHARE, run: int = RUN) -> DataFrame:
    """The rows of docs that match no item, with docs' columns, whatever their names; other rows under the id of a match stay. As for odd rows, see matches()."""
    key, row = fresh(docs, "leaked_id"), fresh(docs, "leaked_row")
    found = _matches(_rows(docs), items, share, run).select(F.col("doc_id").alias(key), F.col("row").alias(row)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (text_key(docs["text"]) == F.col(row))
    return docs.join(stored(found, "leaks"), same, "left_anti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that match; documents without a row are clean."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("item"), "share", (F.col("changed") > 0).alias("other_values"))
