import random

from data import SCHEMA, documents, empty, sentence

import corpus_pipeline as P
from tributary.llm import near_copies as N


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def changed(rng, text, k):
    """text with k of its words replaced, far apart from each other."""
    words = text.split(" ")
    for i in rng.sample(range(0, len(words), 5), k):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def test_near_copies_go(spark):
    """Copies of similarity 0.8 to 0.97 go, whatever their SimHash distance; others stay."""
    rng, texts, near = random.Random(3), [], 0
    for k in range(1, 31):
        base = sentence(rng, 200)
        copy = changed(rng, base, k % 9 + 1)
        texts += [base, copy]
        near += jaccard(base, copy) >= 0.8
    assert 5 <= near <= 25
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *[None] * 6) for i, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()}
    for i in range(0, len(texts), 2):
        assert i in kept and (i + 1 in kept) == (jaccard(texts[i], texts[i + 1]) < 0.8)


def test_chains_and_crowds(spark):
    """Components equal those of all pairs, in one large group whose members are partly apart."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    texts = [changed(rng, base, rng.randrange(6)) for _ in range(150)] + [sentence(rng, 50) for _ in range(20)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.components(docs).collect()} == {i: find(i) for i in range(len(texts))}


def test_rows_stay(spark):
    docs = documents(spark)
    assert N.components(docs).count() == docs.count()
    assert N.components(empty(spark)).count() == 0


def test_sets_whose_keys_meet(spark):
    """Sets that share their key, here of two bits, are still told apart, and equal ones still meet."""
    rng = random.Random(8)
    texts = [sentence(rng, 30) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string")
    rows, parts = N._grouped(docs, "doc_id", "text", key_bits=2)
    fps = {r.id: r.fp for r in rows.select("id", "fp").collect()}
    assert len(set(fps.values())) == 20 and all(fps[20 + i] == fps[i] for i in range(5)) and parts.count() == 0


def test_links_of_operator_1_are_the_first_candidates(spark):
    """What SimHash connects at two bits is found from its fingerprints, before any other candidate."""
    from tributary.llm import simhash

    rng = random.Random(6)
    texts = []
    for _ in range(6):
        base = sentence(rng, 1_500)
        texts += [base, f"{base} end", f"new {base}", sentence(rng, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, _ = N._grouped(docs, "doc_id", "text")
    ids = {r.fp: r.id for r in rows.select("fp", "id").collect()}
    root = {i: i for i in ids.values()}

    def find(i):
        return i if root[i] == i else find(root[i])

    for r in N._close(rows).collect():
        a, b = sorted((find(ids[r.u]), find(ids[r.v])))
        root[b] = a
    want = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {i: find(i) for i in root} == want and len(set(want.values())) < len(texts)
