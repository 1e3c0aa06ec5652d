import random

import xxhash
from data import documents, empty, rows

from tributary.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(pairs, radius=2):
    """Smallest id of each row's group; pairs of (id, fingerprint)."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= radius:
                root[find(a)] = find(b)
    low = {}
    for i, f in pairs:
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    return sorted(((i, f"{f:016x}", low.get(find(f))) for i, f in pairs), key=repr)


def test_documents(spark):
    docs = documents(spark)
    want = slow_groups([(r.doc_id, slow_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()])
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_long_text_in_steps():
    text = " ".join(str(i) for i in range(70_000))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_masks_cover():
    for free in (list(range(64)), list(range(3, 31)), list(range(6))):
        masks = simhash.covering_masks(free, 2)
        assert len(masks) == 7
        for i, a in enumerate(free):
            for b in free[:i]:
                assert any(not m >> a & 1 and not m >> b & 1 for m in masks)
    assert all(64 - bin(m).count("1") <= 6 for m in simhash._levels(2)[-1])


def test_dense_cluster(spark):
    """A group that fills buckets beyond what is compared directly: all levels are used, and nothing is lost."""
    rng = random.Random(4)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 1500:
        f = centre
        for _ in range(rng.randrange(5)):
            f ^= 1 << rng.randrange(0, 64, 3)
        fps.add(f)
    while len(fps) < 1700:
        fps.add(rng.getrandbits(64))
    pairs = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(simhash._signed(f),) for _, f in pairs], "fp long")
    from tributary.operators.components import connected_components

    found = {r.id: r.component for r in connected_components(simhash.links(df)).collect()}
    groups = {}
    for _, f in pairs:
        s = simhash._signed(f)
        groups.setdefault(found.get(s, s), set()).add(f)
    slow = {}
    for (i, f), (_, _, low) in zip(pairs, sorted(slow_groups(pairs)), strict=True):
        slow.setdefault(low, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))
