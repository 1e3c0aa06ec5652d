"""Small helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space as the contracts have it: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other code point left alone."""
    return F.translate(c, UPPER, UPPER.lower())


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(id_col: str, keep: list[str] | None, results) -> list[str]:
    """The id and the columns to keep, each once; those named like a result column (in any case) are left out, the result has the name."""
    names = {r.lower() for r in results}
    return [c for c in dict.fromkeys([id_col, *(keep or [])]) if c == id_col or c.lower() not in names]


def ddl(df, cols: list[str]) -> str:
    """The schema string of some columns of df."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def utf8(column) -> list[bytes | None]:
    """An Arrow string column as bytes, without making Python strings of it."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def row_batch(batch, keep: list[str], new: dict):
    """An Arrow batch of kept columns, untouched, and new ones {name: (values, type)}."""
    import pyarrow as pa

    arrays = [batch.column(c) for c in keep] + [pa.array(v, t) for v, t in new.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *new])


_RESIDENT: dict[tuple, object] = {}


def resident(key: tuple, make):
    """make()'s result, once a worker process: what tasks of one stage share.

    A process keeps that of one key. Workers outlive stages, so the models of a
    stage that is done would else stay in memory beside those of the next one.
    """
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def release() -> None:
    """Drops what resident() keeps; for tasks that need none of it."""
    if _RESIDENT:
        _RESIDENT.clear()
        _give_back()


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Memo:
    """What is known of words, in two generations: the frequent ones stay, and memory is bounded."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, words: set) -> list:
        """The words that aren't known; the others are in young from here on."""
        if len(self.young) + len(words) > self.size:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for w in words.difference(young):
            if (v := old.get(w)) is None:
                new.append(w)
            else:
                young[w] = v
        return new

    def resolve(self, words: list, learn) -> list:
        """The values of distinct words; learn(missing) adds those of new ones to young."""
        learn(self.missing(set(words)))
        return list(map(self.young.__getitem__, words))


class Lexicon:
    """Ids of words, looked up for a whole Arrow array at a time; starts anew beyond a number of words.

    learn gives the ids of an array of distinct new words, one after the other, and how many each has.
    """

    def __init__(self, learn, size: int):
        self.learn, self.size = learn, size
        self._clear()

    def _clear(self) -> None:
        import numpy as np
        import pyarrow as pa

        self.words, self.pool = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.starts = self.sizes = np.zeros(0, np.int64)

    def __call__(self, words):
        """The pool of ids, and where in it the ids of each of the distinct words start and how many there are."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.words) > self.size:
            self._clear()
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            ids, sizes = self.learn(new := words.filter(at.is_null()))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
            index = at.fill_null(-1).to_numpy().astype(np.int64)
            index[index < 0] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
        else:
            index = at.to_numpy()
        return self.pool, self.starts[index], self.sizes[index]


def slices(batch, column: str, most: int = 8 << 20):
    """The batch in stretches of rows of about so many bytes of text, one row at least."""
    import numpy as np

    sizes = batch.column(column).cast("binary").fill_null(b"")
    ends = np.cumsum(np.diff(np.frombuffer(sizes.buffers()[1], np.int32)[sizes.offset : sizes.offset + len(sizes) + 1]))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def spread(words, lexicon: Lexicon):
    """Ids of documents from the words of each (an Arrow list array): all ids, and where each document's start."""
    import numpy as np

    coded = words.flatten().dictionary_encode()
    index = coded.indices.to_numpy()
    pool, starts, sizes = lexicon(coded.dictionary)
    ids, ends = gather(pool, starts[index], sizes[index])
    offsets = words.offsets.to_numpy()
    return ids, ends[offsets - offsets[0]]


def gather(pool, starts, sizes):
    """Stretches of a pool, one after the other, and where each of them starts in the result (and the last one's end)."""
    import numpy as np

    ends = np.concatenate([[0], np.cumsum(sizes)])
    kind = np.int32 if max(ends[-1], len(pool)) < 1 << 31 else np.int64
    return pool[np.arange(ends[-1], dtype=kind) + np.repeat((starts - ends[:-1]).astype(kind), sizes)], ends


def of_bytes(raw: list[bytes]):
    """Ids as 4 bytes each, one after the other, and how many each item has."""
    import numpy as np

    return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) >> 2


#: Punctuation that is taken off the ends of words, so that fewer are distinct.
TAIL = ".,;:!?"


def without_tails(words):
    """Distinct words (an Arrow array) without punctuation after an ASCII letter or digit, and that punctuation (mostly empty)."""
    import numpy as np
    import pyarrow.compute as pc

    bare = pc.utf8_rtrim(words, characters=TAIL)
    cut = pc.if_else(pc.match_substring_regex(bare, "[0-9A-Za-z]$"), bare, words)
    off, tails = pc.subtract(pc.binary_length(words), pc.binary_length(cut)).to_numpy(), [""] * len(words)
    for i in np.flatnonzero(off).tolist():
        tails[i] = words[i].as_py()[-off[i] :]
    return cut, tails
