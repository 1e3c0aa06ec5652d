"""Rows with all that operators must bear: nulls, empty, blank and very long texts, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, doc string, pos int, lines string, id string"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "ter", "sa") for b in ("", "r", "sti", "ndo", "ve", "plu")]
LINE = "This Line of text is found in many documents of the corpus"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, seed=0):
    rng = random.Random(seed)
    base = [sentence(rng, 60) for _ in range(6)]
    texts = [*base, base[0], base[0] + " ende", base[1].upper(), None, "", "   \n\t ", "wort", "wort zwei", "Ünï 日本 🙂 ́x", sentence(rng, 20_000), "\n\n", "a\nb\n", "12 34", "..."]
    for k in range(8):
        texts.append(f"{sentence(rng, 5)}\n  {LINE if k % 2 else LINE.upper()}\t\n{sentence(rng, 3)}\n{LINE}")
    texts.append(f"{LINE}\n{LINE}")
    rows = [(i, t, ("en", "de", None)[i % 3], None if i % 5 == 0 else "s", None if t is None else len(t), "k", 7, "d", 3, "l", "i") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, base[3], "en", "s", 1, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    rows.append((25, "another text under an id that is taken " + LINE, "de", "s", 3, "k", 1, "x", 1, "y", "z"))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
