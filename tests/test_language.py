"""The language query against a plain detector, on every document."""

import re
from collections import Counter

from fernweave import queries
from fernweave.functions.text import LANGUAGE_SAMPLE, STOP_WORDS


def plain_language(text):
    if text is None:
        return None
    sample = text[:LANGUAGE_SAMPLE].lower()
    if re.search("[\u4e00-\u9fff\u3400-\u4dbf]{2}", sample):
        return "zh"
    words = re.findall(r"[^\W\d_]+", sample)
    n, code = max((sum(w in stop for w in words), code) for code, stop in STOP_WORDS.items())
    return code if n else None


def test_language_of_every_page(spark, tmp_path):
    texts = ["The cat is on the mat", "der Hund ist nicht im Haus", "le chat est dans la maison", "el perro no es de la casa", "中文文本", "xyzzy 12", "", None, "The " + "x" * 2000 + " der die das und"]
    rows = [(k, t, "en" if k % 2 else None, "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = Counter(map(tuple, queries.QUERIES["u8_language"](spark, str(tmp_path)).collect()))
    assert found == Counter((k, plain_language(t)) for k, t in enumerate(texts))
