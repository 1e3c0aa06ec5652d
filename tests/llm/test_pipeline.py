from data import LINE, SCHEMA, documents, empty, sentence
from pyspark.sql import functions as F

import corpus_pipeline as P
from tributary.llm import decontaminate, language_id
from tributary.scratch import cut, new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def folder(spark, docs):
    """A data folder with documents and a benchmark."""
    path = new_path(spark, "data")
    docs.select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    text = docs.where("doc_id = 3").first()
    item = " ".join(text.text.split(" ")[:30]) if text else "x"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors_slowly(rows):
    """The rows that stay when all pairs are compared: the smallest id of each group, null ids last; texts decide between equal ids."""
    sets = [grams(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]


def test_ids_do_not_tell_documents_apart(spark):
    """One id with two texts, null ids, repeated rows: only copies go."""
    import random

    rng = random.Random(4)
    a, b, c, d = (sentence(rng, 40) for _ in range(4))
    data = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, None, "en", "s", 1), (7, "", "en", "s", 1), (3, a, "de", "t", 2), (1, a, "en", "s", 1), (9, d, "en", "s", 1), (2, d + " more", "en", "s", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.drop_near_copies(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, a), (1, b), (None, c), (7, ""), (2, d + " more")], key=repr)


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash", "decontaminate", "sentencepiece"]


def test_each_stage_decides(spark):
    path = folder(spark, documents(spark))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    one = cut(P.identify_language(spark, docs, path))
    model = language_id.fit(docs)
    kept = language_id.classify(docs, model).where("not rejected").select("doc_id")
    assert sorted(map(repr, one.select("doc_id").collect())) == sorted(map(repr, kept.collect()))
    assert one.where("text is null or text = '12 34'").count() == 0
    two = cut(P.drop_repeated_lines(spark, one, path))
    holders = two.where(F.exists(F.split(F.lower("text"), "\n"), lambda x: F.btrim(x, F.lit(" \t")) == LINE.lower())).select("doc_id").distinct().collect()
    assert len(holders) == 1
    assert two.where("n_chars != length(text) and doc_id != 25").count() == 0
    three = cut(P.drop_near_copies(spark, two, path))
    assert sorted(map(repr, three.collect())) == sorted(map(repr, survivors_slowly(two.collect())))
    four = cut(P.drop_contaminated(spark, three, path))
    dirty = decontaminate.contamination(three, spark.read.parquet(f"{path}/benchmark.parquet")).where("contaminated").count()
    assert dirty >= 1 and four.count() == three.count() - dirty
    for df in (one, two, three, four):
        assert df.columns == COLUMNS
    five = P.tokenize(spark, four, path)
    assert five.count() == four.count() and five.where("not round_trip").count() == 0
    whole = P.run(spark, path)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, five.collect()))


def test_nothing_comes_of_nothing(spark):
    assert P.run(spark, folder(spark, empty(spark))).count() == 0


def test_clean_documents_stay(spark):
    import random

    rng = random.Random(9)
    rows = [(i, sentence(rng, 80), "en" if i % 2 else "de", "s", 1, *[None] * 6) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    path = folder(spark, docs)
    docs = docs.select(*COLUMNS)
    for name, stage in P.STAGES[1:3]:
        assert stage(spark, docs, path).count() == 40, name


def test_columns_of_any_name_come_along(spark):
    """Names of results and of internal columns do no harm, in the operators' results either."""
    from tributary.llm import html_extract, line_dedup, sentencepiece
    from tributary.llm.queries import vocabulary

    clash = ["score", "margin", "rejected", "lang_pred", "n_words", "n_hit", "contaminated", "n_lines", "n_dropped", "kept_text", "keep_runs", "n_tokens", "ids", "fp", "rid", "row", "other", "key", "id", "Lang_Pred2"]
    base = documents(spark).select(*COLUMNS)
    path, docs = folder(spark, documents(spark)), base.select(*COLUMNS, *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    for name, stage in P.STAGES[:4]:
        got, want = stage(spark, docs, path), stage(spark, base, path)
        assert got.columns == docs.columns, name
        assert sorted(map(repr, got.select(*COLUMNS).collect())) == sorted(map(repr, want.collect())), name
    assert len(set(line_dedup.deduplicate(docs).columns)) == len(line_dedup.deduplicate(docs).columns)
    got = language_id.classify(docs, {"en": b"abc"}, keep=["score", "source"])
    assert got.columns == ["doc_id", "source", "lang_pred", "score", "margin", "rejected"] and got.where("score > 1").count() == 0
    assert sentencepiece.encode(docs, vocabulary("piece_bpe_32k.model"), keep=["n_tokens", "ids", "source"]).columns.count("ids") == 1
    pages = spark.createDataFrame([(1, "u", "<p>x", 5, 6)], "page_id long, url string, html string, text int, n_chars int")
    assert html_extract.extract(pages, keep=["text", "n_chars"]).first().text == "x"
