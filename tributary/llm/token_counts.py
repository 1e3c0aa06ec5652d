"""Token counts of texts under a byte-level BPE vocabulary, without encoding most of them.

Before any text is read it is proven which strings of the vocabulary encode
alone as one token: each is merged from its bytes, and counts if one part is
left and that part is the string itself. A text is then cut into pre-tokens;
one that is such a string is one token, and only the rest is merged.

The cut is made by an expression of our own, for the library's is slower.
Whether both agree on a character is proven too, when the character first
appears: beside a letter, a digit and a dot the library says what kind it is.
Texts with a character on which they differ (one that only the newer of two
Unicode versions knows) are counted by the library.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm._text import ddl, kept, resident, row_batch, slices

LIMIT = 1024
#: Pre-tokens whose counts a worker remembers; parts up to which merging looks at all pairs each time; characters of a text that is cut at once.
MEMO, SHORT, WHOLE = 400_000, 24, 1 << 20
_NEVER = (1 << 60, 0)


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Counter:
    """Counts the tokens of texts under one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model, pre = stored["model"], stored["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or stored["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or odd:
            raise ValueError("token counts need a plain byte-level BPE vocabulary")
        special = stored["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError("special tokens that take up what is beside them aren't counted")
        self.library = tokenizers.Tokenizer.from_file(path)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(special, key=lambda t: -len(t["content"])))) if special else None
        byte = _alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.first = [0] * 256
        for c, b in byte.items():
            self.first[b] = vocab[c]
        #: (rank, merged id) of a pair of ids.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        strings = {bytes(map(byte.__getitem__, s)): i for s, i in vocab.items() if all(c in byte for c in s)}
        self.proven = frozenset(s.decode() for s, i in strings.items() if self.merge(s) == [i] and _is_utf8(s))
        self.counts = _Counts(self)
        self.settled: set[str] = set()
        self.differing: set[str] = set()
        # Letters come first: no other alternative can begin with one, or with a space before one.
        self.cut = regex.compile(r" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+")

    def merge(self, raw: bytes) -> list[int]:
        """The ids that merging leaves of a pre-token: the pair of lowest rank first, the leftmost of equals."""
        ids = [self.first[b] for b in raw]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        while len(ids) > 1:
            rank, at = _NEVER, 0
            for k, pair in enumerate(zip(ids, ids[1:])):
                if (r := get(pair, _NEVER)) < rank:
                    rank, at = r, k
            if rank is _NEVER:
                break
            ids[at : at + 2] = [rank[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n for runs of any length."""
        get, n = self.merges.get, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heap = [(r, k, new, a, b) for r, new, k, a, b in heap]
        heapify(heap)
        while heap:
            _, k, new, a, b = heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x in (before[k], k):
                if x >= 0 and (y := after[x]) >= 0 and (m := get((ids[x], ids[y]))):
                    heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def agree(self, text: str) -> bool:
        """Whether the library and our expression see all characters of a text alike."""
        seen = set(text)
        if not seen <= self.settled:
            for c in seen - self.settled - self.differing:
                probe = f"a{c}\n1{c}\n.{c}\n"
                same = [x for _, x in self.library.pre_tokenizer.pre_tokenize_str(probe)] == [m.span() for m in self.cut.finditer(probe)]
                (self.settled if same else self.differing).add(c)
        return seen.isdisjoint(self.differing)

    def count(self, text: str) -> int:
        if not self.agree(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        parts = self.special.split(text) if self.special else [text]
        get, n = self.counts.__getitem__, len(parts) - 1
        for part in parts:
            pieces = self.cut.findall(part) if len(part) < WHOLE else (m[0] for m in self.cut.finditer(part))
            n += sum(map(get, pieces))
        return n


class _Counts(dict):
    """Tokens of a pre-token: 1 for the proven strings, which stay; the others are merged when asked for, and so many remembered."""

    def __init__(self, counter: Counter):
        super().__init__(dict.fromkeys(counter.proven, 1))
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        n = len(self.counter.merge(piece.encode()))
        if len(self) - len(self.counter.proven) >= MEMO:
            self.clear()
            self.update(dict.fromkeys(self.counter.proven, 1))
        if len(piece) < 256:
            self[piece] = n
        return n


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def load(path: str) -> Counter:
    """The counter of a path, kept by the worker process."""
    return resident(("counts", path), lambda: Counter(path))


def count(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: id, the columns in keep, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Counts are those of the library's encode without begin or end tokens; a
    special token's string inside a text is that token, as is its default.
    Null texts are empty, and empty ones have no tokens. Null ids and repeated
    rows are rows like others. Columns to keep that are named like a result are
    left out; an empty table gives no rows. Nothing is shuffled: rows stay where they are.
    """
    out = kept(id_col, keep, ("n_bytes", "n_tokens", "over_limit"))
    docs = docs.select(*dict.fromkeys([*out, text_col]))

    def run(batches):
        counter = load(vocabulary)
        for whole in batches:
            for b in slices(whole, text_col):
                texts = b.column(text_col)
                n = [counter.count(t) if t else 0 for t in texts.to_pylist()]
                size = pa.compute.coalesce(pa.compute.binary_length(texts), 0).cast(pa.int64())
                yield row_batch(b, out, {"n_bytes": (size, pa.int64()), "n_tokens": (n, pa.int64())})

    counted = docs.mapInArrow(run, f"{ddl(docs, out)}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
