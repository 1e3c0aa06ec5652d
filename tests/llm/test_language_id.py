import random

from data import documents, empty
from pyspark.sql import functions as F

from tributary.llm import language_id as L

SYLLABLES = {"aa": ["th", "er", "ing", "and", "ou", "wh", "ea"], "bb": ["ción", "qué", "os", "ñ", "ar", "ll", "ie"], "cc": ["sch", "ung", "ü", "ei", "pf", "ver", "ach"]}


def corpus(spark, n=240):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(15, 90)))
        rows.append((i, text, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = L.fit(docs)
    assert set(model) == set(SYLLABLES)
    got = L.classify(docs, model, keep=["lang"]).withColumn("held", L.held_out())
    assert got.where("held").count() > 30
    assert got.where("held and lang_pred = lang").count() >= 0.97 * got.where("held").count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_learns_from_the_rest_only(spark):
    docs = corpus(spark)
    lies = docs.withColumn("lang", F.when(L.held_out(), F.lit("lie")).otherwise(F.col("lang")))
    assert L.fit(lies) == L.fit(docs)
    other = docs.withColumn("doc_id", F.col("doc_id")).withColumn("text", F.when(L.held_out(), F.lit("zzz")).otherwise(F.col("text")))
    assert L.fit(other) == L.fit(docs)


def test_odd_rows(spark):
    docs, model = documents(spark), L.fit(corpus(spark))
    got = L.classify(docs, model)
    assert got.count() == docs.count()
    assert {r.lang_pred for r in L.classify(docs.where("text is null or text in ('', '12 34', '...')"), model).collect()} == {"und"}
    assert got.where("lang_pred = 'und' and not rejected").count() == 0
    assert L.classify(empty(spark), model).count() == 0
    assert L.fit(empty(spark)) == {}
    assert {r.lang_pred for r in L.classify(docs, {}).collect()} == {"und"}
    assert {r.lang_pred for r in L.classify(docs.where("doc_id = 0"), {"xx": b"abc"}).collect()} == {"xx"}


def slow_fit(rows, n):
    """The dictionaries, from a list of (id, text, lang, hash)."""
    import re
    import zlib
    from collections import Counter

    kept = {}
    for i, text, lang, h in rows:
        if i is not None and lang is not None and text and any(c.isalpha() for c in text) and zlib.crc32(str(i).encode()) % 4 != 2:
            kept.setdefault(lang, {})[h] = text.lower()
    parts = {lang: [re.split(r"(?<=[.\n])", texts[h]) for h in sorted(texts)[:n]] for lang, texts in kept.items()}
    seen = Counter(x for some in parts.values() for p in some for x in {y.strip() for y in p})
    return {lang: "\n".join("".join(x for x in p if seen[x.strip()] < 2) or "".join(p) for p in some).encode() for lang, some in parts.items()}


def test_brute_force(spark):
    """Fitting on whole texts, and predictions by plain zstandard, one piece at a time."""
    import zstandard

    docs = corpus(spark, 90).unionByName(corpus(spark, 30)).unionByName(spark.createDataFrame([(1000, "Shared line.\n" + "lang " * 4000 + "ende", "aa"), (1001, "Shared line.\nother", "bb")], "doc_id long, text string, lang string"))
    docs = docs.unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.explode(F.sequence(F.lit(5000), F.lit(5600)).cast("array<long>"))))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", F.xxhash64("text")).collect()]
    for n in (5, 1000):
        model = L.fit(docs, fit_texts=n)
        assert model == slow_fit(rows, n)
    for r in L.classify(docs, model, keep=["text"]).distinct().collect():
        raw, sizes = r.text.lower().encode(), []
        for lang, d in sorted(model.items()):
            c = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(c.compress(raw[i : i + L.PIECE_BYTES])) for i in range(0, len(raw), L.PIECE_BYTES)), lang))
        (a, lang), (b, _) = sorted(sizes)[:2]
        assert (r.lang_pred, r.margin) == (lang, (b - a) / b) and r.rejected == ((b - a) / b < L.MIN_MARGIN)
