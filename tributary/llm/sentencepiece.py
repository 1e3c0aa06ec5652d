"""SentencePiece encoding and decoding by a Viterbi search with shared prefixes.

A text becomes marked words: each space is the mark (U+2581), one mark goes
before the text, and a word is its marks and all up to the next mark or line
end. No piece of the vocabulary spans such a boundary (checked on loading), so
a text's ids are those of its words, one after the other.

The distinct words of a batch are sorted, which puts them in the depth-first
order of their trie. The forward table of a prefix (for every length the piece
that the best path to there ends in) is kept on a stack; a word drops what is
below the prefix that it shares with the word before and adds the rest.

The vocabulary is of the BPE kind: its scores are merge ranks, and adding them
up doesn't rank paths. The lattice therefore has the hard scores of merging: a
step from piece a to piece b is allowed if merging leaves exactly a and b of
their concatenation, and forbidden otherwise. For each prefix one piece can
follow the best path of what is before it, so the search has one survivor a
position, and its path is the library's own encoding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm._text import TAIL, Lexicon, Memo, ddl, kept, of_bytes, resident, row_batch, slices, spread, without_tails

MARK = "▁"
_NEVER = float("inf")
#: Words whose ids (in each of two generations), and pairs of pieces whose steps, a worker remembers.
WORDS, STEPS = 150_000, 300_000


class Model:
    """A vocabulary of the BPE kind with byte fallback, as a lattice search."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.rank: dict[str, float] = {}
        self.piece: dict[int, str] = {}
        self.byte_id, self.out = [0] * 256, [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.out[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece[i], self.rank[piece] = piece, -sp.get_score(i)
                self.out[i] = piece.replace(MARK, " ").encode()
        if any(re.search(f"[^{MARK}]{MARK}|\\n|\\0", p) for p in self.rank):
            raise ValueError("the vocabulary has pieces that span words")
        #: Whether no piece goes from a letter or digit to punctuation, so that these can be encoded apart.
        self.tails = not any(re.search(f"[0-9A-Za-z][{re.escape(TAIL)}]", p) for p in self.rank)
        self.lengths = [len(self.piece.get(i, "")) for i in range(n)]
        self.histories: dict[str, list] = {}
        self.steps: dict[int, bool] = {}
        self.words, self.lexicon = Memo(WORDS), Lexicon(self.learn, WORDS)
        self._automaton()

    def _automaton(self) -> None:
        """next[s][c]: state after c; ending[s]: (length, id) of the pieces that end in a state, the longest first."""
        self.next: list[dict[str, int]] = [{}]
        own: list[int | None] = [None]
        for i, piece in self.piece.items():
            s = 0
            for c in piece:
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    own.append(None)
                s = self.next[s][c]
            own[s] = i
        self.fail, self.ending = [0] * len(own), [()] * len(own)
        queue = [(0, c, s) for c, s in self.next[0].items()]
        for parent, c, s in queue:
            f = self.fail[parent]
            while parent and f and c not in self.next[f]:
                f = self.fail[f]
            self.fail[s] = self.next[f].get(c, 0) if parent else 0
            self.ending[s] = (((self.lengths[own[s]], own[s]),) if own[s] is not None else ()) + self.ending[self.fail[s]]
            queue.extend((s, d, t) for d, t in self.next[s].items())
        self.moves: dict[tuple[int, str], int] = {}

    def move(self, s: int, c: str) -> int:
        """The state after c where the trie itself has no such edge."""
        at = s
        while at and c not in self.next[at]:
            at = self.fail[at]
        if len(self.moves) > STEPS:
            self.moves.clear()
        to = self.moves[s, c] = self.next[at].get(c, 0)
        return to

    def merges(self, text: str) -> list[tuple[float, str, str]]:
        """How merging goes on in a text: after each merge its rank, the first and the last part.

        Merged is the pair of lowest rank, the leftmost of equals. The first
        entry is the start, the last one has an infinite rank and says how it ends.
        """
        parts, rank, out = list(text), self.rank, []
        while True:
            r, at = min(((rank.get(parts[k] + parts[k + 1], _NEVER), k) for k in range(len(parts) - 1)), default=(_NEVER, 0))
            out.append((r, parts[0], parts[-1]))
            if r == _NEVER:
                return out
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def allowed(self, a: int, b: int) -> bool:
        """Whether a step from piece a to piece b is in the lattice; a is negative at a word's start.

        Until something merges across the border, each side merges as if it
        stood alone; so the two sides' merges are followed in turn.
        """
        if len(self.steps) > STEPS:
            self.steps.clear()
        first, second = self.piece.get(a, ""), self.piece[b]
        left, right = self.history(first), self.history(second)
        i = j = 0
        ok = left[-1][1] == first and right[-1][1] == second
        while ok:
            (r, _, x), (s, y, _) = left[i], right[j]
            across = self.rank.get(x + y, _NEVER) if x else _NEVER
            if across < r and across <= s:
                ok = False
            elif r == s == _NEVER:
                break
            elif r <= s:
                i += 1
            else:
                j += 1
        self.steps[a << 20 | b] = ok
        return ok

    def history(self, piece: str) -> list[tuple[float, str, str]]:
        if (known := self.histories.get(piece)) is None:
            known = self.histories[piece] = self.merges(piece) if piece else [(_NEVER, "", "")]
        return known

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words: of what is before the punctuation at their ends, and of that."""
        cut, tails = without_tails(words) if self.tails else (words, [""] * len(words))
        coded = cut.dictionary_encode()
        ids = self.words.resolve(coded.dictionary.to_pylist(), self.search)
        ends = dict(zip(kinds := list(set(tails)), self.words.resolve(kinds, self.search), strict=True))
        return of_bytes([ids[i] + ends[t] if t else ids[i] for i, t in zip(coded.indices.to_pylist(), tails, strict=True)])

    def search(self, words: list[str]) -> None:
        """Remembers the ids of distinct words."""
        following, ending, moves, steps, lengths, known = self.next, self.ending, self.moves, self.steps, self.lengths, self.words.young
        # For each length of the current prefix: the automaton's state, and the piece that the best path ends in
        # (-1 at the start; below that a character that isn't in the vocabulary, with which nothing merges).
        before, states, last = "", [0], [-1]
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            state = states[shared]
            for k in range(shared, len(word)):
                c = word[k]
                if (to := following[state].get(c)) is None and (to := moves.get((state, c))) is None:
                    to = self.move(state, c)
                state = to
                for length, b in ending[state]:
                    a = last[k + 1 - length]
                    if a < 0:
                        a = -1
                    if (step := steps.get(a << 20 | b)) or (step is None and self.allowed(a, b)):
                        last.append(b)
                        break
                else:
                    last.append(-2 - ord(c))
                states.append(state)
            out, k = [], len(word)
            while k:
                if (i := last[k]) >= 0:
                    out.append(i)
                    k -= lengths[i]
                else:
                    out.extend(self.byte_id[x] for x in reversed(chr(-2 - i).encode("utf-8", "replace")))
                    k -= 1
            out.reverse()
            known[word] = array("I", out).tobytes()
            before = word

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's start (and the last one's end); none for null and empty."""
        return spread(marked_words(texts), self.lexicon)

    def decode(self, ids) -> str:
        """The text of ids: without the mark that encoding put before it."""
        raw = b"".join(map(self.out.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_SPLIT = re.compile(f"\n|\0|{MARK}*[^{MARK}\n\0]+|{MARK}+")


def marked_words(texts: pa.Array) -> pa.Array:
    """The marked words of each text, line ends by themselves; some may be empty."""
    texts = texts.fill_null("")
    plain = pc.replace_substring(pc.replace_substring(texts, " ", "\0" + MARK), "\n", "\0\n\0")
    split = pc.split_pattern(pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", MARK), plain, ""), "\0")
    # Runs of spaces are one word's marks, and what looks like marks and borders isn't any: the slow way for these texts.
    odd = pc.match_substring_regex(texts, f"^ |  |{MARK}|\\x00")
    if pc.any(odd).as_py():
        rows = split.to_pylist()
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            rows[i] = _SPLIT.findall(MARK + texts[i].as_py().replace(" ", MARK))
        split = pa.array(rows, pa.list_(pa.string()))
    return split


def load(path: str) -> Model:
    """The model of a path, kept by the worker process."""
    return resident(("model", path), lambda: Model(path))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: id, the columns in keep, n_tokens, ids_crc32, decoded_sha256, round_trip and, if asked for, ids.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers. The
    ids are decoded again: decoded_sha256 is that text's digest, and round_trip
    whether it is the text that came in (where each U+2581 is a space). Null and
    empty texts have no ids. Other columns are ignored, and so are columns to keep
    that are named like a result; empty tables give no rows.
    """
    out = kept(id_col, keep, ("n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "ids"))
    docs = docs.select(*dict.fromkeys([*out, text_col]))

    def run(batches):
        model = load(vocabulary)
        for whole in batches:
            for b in slices(whole, text_col, 2 << 20):
                texts = b[text_col].to_pylist()
                every, starts = model.encode(b[text_col])
                ids = [every[i:j] for i, j in pairwise(starts.tolist())]
                decoded = [model.decode(x.tolist()) for x in ids]
                new = {
                    "n_tokens": (np.diff(starts), pa.int64()),
                    "ids_crc32": ([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    "decoded_sha256": ([sha256(d.encode("utf-8", "replace")).hexdigest() for d in decoded], pa.string()),
                    "round_trip": ([d == (t or "").replace(MARK, " ") for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
                }
                if with_ids:
                    new["ids"] = ([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield row_batch(b, out, new)

    return docs.mapInArrow(run, f"{ddl(docs, out)}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean{', ids array<int>' * with_ids}")


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of ids; null ids give a null text, no ids an empty one."""

    @F.pandas_udf("string")
    def run(ids):
        model = load(vocabulary)
        return ids.map(lambda x: None if x is None else model.decode(x))

    return tokens.select(id_col, run(ids_col).alias("text"))
