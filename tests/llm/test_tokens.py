import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from data import documents, empty, rows
from pyspark.sql import functions as F

from tributary.llm import sentencepiece, token_store
from tributary.llm.queries import vocabulary
from tributary.scratch import new_path

ODD = ["a", "th", "e", "  ", " ", "\n", "é", "é", "İ", "Σ", "日", "🙂", "in", "<|endoftext|>", "\x85", "\x1c", "\xa0", "'s", "12", "--", "\0", "▁", "THE", "ing", "ße", ".", ",", "!?"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def spelled(encode, texts):
    ids, starts = encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]


def test_word_encoder_is_the_librarys():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = odd_texts(1500, 1)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert spelled(token_store.Encoder(vocabulary("word_bpe_49k.json")), [*texts, None]) == [*want, []]


def test_piece_encoder_is_the_librarys():
    import sentencepiece as lib

    sp = lib.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    model = sentencepiece.Model(vocabulary("piece_bpe_32k.model"))
    texts = odd_texts(4000, 2)
    assert spelled(model.encode, [*texts, None]) == [*[sp.encode(t) for t in texts], []]
    for t in texts:
        assert model.decode(sp.encode(t)) == t.replace("▁", " ")


def test_cuts():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 49_000, 20_000).astype("<u4")
    ends = token_store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes[:-1].min() >= token_store.MIN_IDS and sizes.max() <= token_store.MAX_IDS
    moved = token_store.cuts(np.concatenate([ids[:500], ids[7:]]))
    assert len({e + 493 for e in ends} & set(moved)) > 0.8 * len(ends)
    assert token_store.cuts(ids[:0]) == [] and token_store.cuts(ids[:1]) == [1]


def test_crc_and_merkle():
    rng = random.Random(3)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(50)), rng.randbytes(rng.randrange(5000))
        assert token_store.combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert len({token_store.merkle(x) for x in ([], [b"a"], [b"a", b"b"], [b"b", b"a"], [b"a", b"b", b"b"])}) == 5


def want_tokens(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out, at = [], 0
    some = sorted(((r.doc_id, lib.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    for i, ids in some:
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_store_round_trip(spark):
    docs = documents(spark)
    path = token_store.write(docs, new_path(spark, "tokens"), vocabulary("word_bpe_49k.json"))
    want, got = want_tokens(docs), token_store.read_digests(spark, path).collect()
    assert sorted((r.id, r.n_tokens, r.ids_crc32) for r in got if r.id is not None) == sorted((i, n, c) for i, _, n, c, _ in want if i is not None)
    # Rows of one id may stand in either order; the others' starts are fixed.
    once = [i for i, *_ in want if i is not None and [w[0] for w in want].count(i) == 1]
    assert {r.id: r.start for r in got if r.id in once} == {i: s for i, s, *_ in want if i in once}
    assert sorted(r.start for r in got)[0] == 0 and len({r.start for r in got}) == len(got)
    ids = sorted((tuple(r.ids) for r in token_store.read_ids(spark, path).collect()))
    assert ids == sorted(tuple(w[4]) for w in want)
    chunks = token_store._chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_store_of_nothing_and_broken_store(spark):
    path = token_store.write(empty(spark), new_path(spark, "tokens"), vocabulary("word_bpe_49k.json"))
    assert token_store.read_digests(spark, path).count() == 0
    path = token_store.write(documents(spark), new_path(spark, "tokens"), vocabulary("word_bpe_49k.json"))
    pack = spark.read.parquet(f"{path}/pack")
    bad = new_path(spark, "tokens")
    pack.withColumn("ids", F.when(F.length("ids") > 60, F.concat(F.substring("ids", 1, 10), F.col("ids"))).otherwise(F.col("ids"))).write.partitionBy("kind").parquet(f"{bad}/pack")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{bad}/{part}")
    with pytest.raises(Exception, match="other bytes"):
        token_store.read_digests(spark, bad).collect()


def test_sentencepiece_operator(spark):
    import sentencepiece as lib

    sp = lib.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    docs = documents(spark)
    got = sentencepiece.encode(docs, vocabulary("piece_bpe_32k.model"), keep=["key", "text"])
    assert {tuple(r.ids) == tuple(sp.encode(r.text or "")) and r.round_trip and r.n_tokens == len(r.ids) for r in got.collect()} == {True}
    back = sentencepiece.decode(got, vocabulary("piece_bpe_32k.model"))
    assert rows(back, "doc_id", "text") == rows(docs.fillna("", ["text"]), "doc_id", "text")
    assert sentencepiece.encode(empty(spark), vocabulary("piece_bpe_32k.model")).count() == 0


def test_nothing_is_lost_silently(spark):
    """A store that lacks a chunk, a recipe or a node of its manifest, or has another one, can't be read."""
    docs = spark.createDataFrame([(i, f"text number {i} " * (i + 1) * 40) for i in range(12)] + [(None, "x"), (3, "again"), (3, "again")], "doc_id long, text string")
    path = token_store.write(docs, new_path(spark, "t"), vocabulary("word_bpe_49k.json"))
    want = token_store.read_digests(spark, path).collect()
    assert len(want) == 15

    def changed(part, change):
        other = new_path(spark, "broken")
        for p in ("pack", "recipes", "manifest"):
            df = spark.read.parquet(f"{path}/{p}")
            df = change(df) if p == part else df
            (df.write.partitionBy("kind") if p == "pack" else df.write).parquet(f"{other}/{p}")
        return other

    assert sorted(token_store.read_digests(spark, changed("pack", lambda df: df)).collect(), key=repr) == sorted(want, key=repr)
    one = spark.read.parquet(f"{path}/pack").where("kind = 'chunk'").agg({"digest": "min"}).first()[0]
    for part, change in (
        ("pack", lambda df: df.where((F.col("kind") != "chunk") | (F.col("digest") != F.lit(one)))),
        ("recipes", lambda df: df.where("id is null or id != 5")),
        ("recipes", lambda df: df.where("id is null")),
        ("recipes", lambda df: df.withColumn("lengths", F.transform("lengths", lambda x: x + 1))),
        ("manifest", lambda df: df.withColumn("root", F.when(F.col("level") == token_store.STORE, F.lit(b"x" * 16)).otherwise(F.col("root")))),
        ("manifest", lambda df: df.withColumn("n_docs", F.col("n_docs") + 1)),
        ("manifest", lambda df: df.where("level != 0")),
        ("manifest", lambda df: df.withColumn("start", F.col("start") + 1_000)),
        ("recipes", lambda df: df.withColumn("id", F.when(F.col("id") == 1, 2).when(F.col("id") == 2, 1).otherwise(F.col("id")).cast("long"))),
    ):
        with pytest.raises(Exception, match="chunk|document|manifest"):
            token_store.read_digests(spark, changed(part, change)).collect()
    with pytest.raises(Exception, match="chunk"):
        token_store.read_ids(spark, changed("pack", lambda df: df.where((F.col("kind") != "chunk") | (F.col("digest") != F.lit(one))))).collect()


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    import json

    config = json.load(open(vocabulary("word_bpe_49k.json"), encoding="utf-8"))
    config["normalizer"]["normalizers"] = [n for n in config["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(config), encoding="utf-8")
    with pytest.raises(ValueError, match="vocabulary"):
        token_store.Encoder(str(path))


def test_plain_words_are_encoded_without_normalizing():
    encode = token_store.Encoder(vocabulary("word_bpe_49k.json"))
    lib, texts = encode.tokenizer, ["straße übel ciónado naïve ÿ ß", "ÜBEL İx ªb µm áb ǆ ſt ÷x", "the don't we're", " ".join(f"w{chr(97 + k % 26)}{'é' * (k % 3)}x{'y' * (k % 7)}" for k in range(1_000))]
    ids, starts = encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    asked = []

    class Counted:
        def encode_batch_fast(self, some, **options):
            asked.extend(some)
            return lib.encode_batch_fast(some, **options)

    encode.tokenizer = Counted()
    encode(pa.array(["brandnew wörter hereare"]))
    assert not [t for t in asked if t], asked
