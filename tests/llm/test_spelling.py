import random
from collections import Counter
from itertools import combinations

import pytest
from data import documents, empty

from tributary.llm import spelling


def edit(a, b):
    """Edit distance of code points, by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def vocabulary(n=260, seed=4, letters="aeißstr"):
    rng, words = random.Random(seed), set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
        words.add(w)
        for _ in range(3):
            k = rng.randrange(len(w))
            words |= {w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]}
    return sorted(words - {""})


@pytest.mark.parametrize("most", [spelling.MOST, 3])
def test_pairs_against_brute_force(spark, most):
    words = [*vocabulary(), "aaaaaaaa", "aaaaaaa", "aaaaaaab", "baaaaaaa", "aaaabaaa", "aaaaaaaaa"]
    want = sorted((min(p), max(p)) for p in combinations(sorted(set(words)), 2) if edit(*p) == 1)
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string").repartition(3)
    got = sorted((r.a, r.b) for r in spelling.near_pairs(df, most).collect())
    assert got == want and len(want) > 200


def slow(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if abs(len(v) - len(w)) < 2 and edit(v, w) == 1]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if near and counts[best] >= ratio * n else None, n, len(near), counts[best] if near and counts[best] >= ratio * n else None)
    rows = []
    for w, (form, n, near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, near, form_n))
    return sorted(rows)


def test_forms_against_brute_force(spark):
    rng = random.Random(8)
    counts = {w: rng.choice((1, 2, 3, 20, 35, 300, 4_000)) for w in vocabulary(60, 9, "aeßs") if len(w) >= 5}
    occurring = spark.createDataFrame([(w, 1) for w, n in counts.items() for _ in range(n)] + [(None, 2)] * 3, "word string, n int")
    want = slow({w: n for w, n in counts.items() if n > 1})
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(occurring, min_length=5).collect())
    assert got == want and any(r[1] and r[2] != r[1] for r in want)


def test_ties_go_to_the_smaller_code_point(spark):
    words = spark.createDataFrame([("abcdefg", 2), ("abcdefgz", 20), ("abcdefgé", 20), ("abcdefga", 20)], "word string, n long")
    got = {r.word: (r.form, r.n_near) for r in spelling.forms(words, spelling.near_pairs(words)).collect()}
    assert got["abcdefg"] == ("abcdefga", 3) and got["abcdefgé"] == (None, 3)


def test_words_of_documents(spark):
    import re

    docs = documents(spark)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = Counter(w for r in docs.collect() for w in re.findall("[A-Za-zÀ-ÿ]+", (r.text or "").translate(lower)) if len(w) >= 7)
    assert Counter(r.word for r in spelling.occurrences(docs).collect()) == want
    assert spelling.group_variants(spelling.occurrences(empty(spark))).count() == 0


def test_ratio_has_to_grow(spark):
    with pytest.raises(ValueError):
        spelling.forms(spark.createDataFrame([("abc", 1)], "word string, n long"), spark.createDataFrame([], "a string, b string"), 1)
