import random

import public_tokenizers
import pytest
from data import documents, empty, rows
from tokenizers import Tokenizer

from tributary.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "don't we'll I'M  x", " \n\n \t y", "՘a \U000107bb x \x85 \xa0z", "zß" * 400, "x" * 5_000, "12345678901234567890½²", "🙂🙂 👩‍👩‍👧", "é" * 50 + "é" * 50, "\x00\x01 \x7f", "ಠ_ಠ", "a" * 1_200_000 + " end of it"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def slow(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_against_the_library(spark, library):
    docs = documents(spark)
    some = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for df in (docs, some):
        want = sorted(((r.doc_id, len((r.text or "").encode()), n := slow(library, r.text), n > 1024) for r in df.collect()), key=repr)
        assert rows(token_counts.count(df, PATH), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_random_texts(library):
    counter, rng = token_counts.Counter(PATH), random.Random(5)
    pool = list("abcdefgh eot'\n\t .,-12") + ["the ", " and", "'ll", "ä", "日", "🙂", "​", "՘", "ก็", "<|endoftext|>", "  ", "\r\n", "İ", "ᾳ"]
    for _ in range(3_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        assert counter.count(text) == slow(library, text), text
    assert counter.differing and "a" in counter.settled


def test_both_ways_of_merging():
    counter, rng = token_counts.Counter(PATH), random.Random(6)
    for _ in range(300):
        raw = bytes(rng.choice(b"aeiounst \xc3\xa4lr") for _ in range(rng.randrange(1, 200)))
        ids = [counter.first[b] for b in raw]
        assert counter._merge_short(list(ids)) == counter._merge_long(list(ids))


def test_proven_strings_are_single_tokens(library):
    counter = token_counts.Counter(PATH)
    assert len(counter.proven) > 40_000
    some = sorted(counter.proven)[::97]
    assert all(len(library.model.tokenize("".join(dict(zip(token_counts._alphabet().values(), token_counts._alphabet()))[b] for b in s.encode()))) == 1 for s in some)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_memory_of_counts_is_bounded(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 3)
    counter = token_counts.Counter(PATH)
    text = "qzx wvq zzkx pqj xxkq vvz qqj zkw"
    assert counter.count(text) == slow(library, text) and len(counter.counts) <= len(counter.proven) + 3


def test_clashing_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", 9, "x"), (1, "a b", 9, "x"), (None, None, 1, None)], "doc_id long, text string, n_tokens int, source string")
    got = token_counts.count(docs, PATH, keep=["source", "N_tokens"])
    assert got.columns == ["doc_id", "source", "n_bytes", "n_tokens", "over_limit"]
    assert rows(got, "doc_id", "source", "n_tokens") == [(1, "x", 2), (1, "x", 2), (None, None, 0)]
    assert token_counts.count(empty(spark), PATH).count() == 0
