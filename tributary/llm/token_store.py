"""A content-addressed store of token ids.

Writing. Each text is encoded, the end id is appended, and a rolling hash over
the ids cuts the stream into chunks, so that equal passages give equal chunks
wherever they stand. A chunk's address is the BLAKE2b digest of its bytes.

The store is a folder of Parquet tables:

- ``pack/kind=chunk``: digest and ids of every chunk, once, as little-endian
  unsigned integers of ``width`` bytes (2 while all ids fit, else 4)
- ``pack/kind=recipe``: for each document its chunks' digests and lengths in order,
  and the Merkle root over these
- ``recipes``: the recipes in ascending id order, numbered, in range partitions
- ``manifest``: the Merkle tree above the documents' roots, in blocks of ``FAN`` nodes
  (blocks of documents, blocks of these, partitions, the store), each with its
  number of documents and of ids; partitions also with the ids before them

A task sends a chunk's bytes only the first time that it meets it, and the
copies that different tasks sent meet by digest, of which there are at most as
many as tasks: no key is hot, and the ids move once.

Reading. Every chunk is read and checked against its address; a recipe's
Merkle root is rebuilt from the digests of the bytes that were read and must
equal the one written, as must the lengths and numbers of ids. The tree of the
manifest is rebuilt from the documents read and compared node by node, so a
missing chunk, recipe or block fails the read and is never left out silently.
Digests over whole documents are combined from those of their chunks; read_ids()
puts the ids themselves together.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections import OrderedDict
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm._text import Lexicon, gather, release, resident, slices, spread, without_tails
from tributary.scratch import cut

END_ID = 1
#: A cut is where the rolling hash of the last ROLL ids has CUT_BITS zero bits, at least MIN_IDS and at most MAX_IDS after the last one.
ROLL, CUT_BITS, MIN_IDS, MAX_IDS = 4, 8, 64, 2048
#: Words whose ids a worker remembers, and chunks whose digests a task remembers.
WORDS, SEEN = 800_000, 300_000
#: Words of letters that are encoded at a time.
MANY = 200
#: Words that these normalizers leave alone and this split leaves whole.
ASCII, PLAIN, STEPS = "^[a-z]+$", "^[a-zß-öø-ÿ]+$", {"NFC", "Replace", "Lowercase"}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Whole texts to ids by the tokenizers library, which encodes each distinct word about once.

    The vocabulary's pre-tokenizer joins nothing across white space, lower-cases,
    and separates letters and digits from punctuation. So a text's ids are those
    of its stretches without ASCII white space, and a stretch's are those of its
    word and of the punctuation after it. Words of letters alone are encoded many
    at a time: each is one pre-token, whose last id is of the kind that ends words.
    Small letters of PLAIN are as normalising would leave them, so words of these go to
    the same model without it, if the vocabulary has STEPS and SPLIT, for which that holds.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        with open(vocabulary, encoding="utf-8") as f:
            config = json.load(f)
        steps = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
        if "Lowercase" not in steps or config["model"].get("end_of_word_suffix") != "</w>" or not config.get("pre_tokenizer"):
            raise ValueError("the vocabulary isn't one that lower-cases, splits words and marks their ends")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        split = (config["pre_tokenizer"].get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        kinds = [n["type"] for n in config["pre_tokenizer"].get("pretokenizers", [])]
        self.plain = []
        if set(steps) <= STEPS and split == SPLIT and kinds == ["Split", "ByteLevel"]:
            spaces = pre_tokenizers.WhitespaceSplit()
            for pattern, cut in ((ASCII, spaces), (PLAIN, pre_tokenizers.Sequence([spaces, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]))):
                self.plain.append((pattern, Tokenizer(self.tokenizer.model)))
                self.plain[-1][1].pre_tokenizer = cut
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.lexicon = Lexicon(self.learn, WORDS)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's start (and the last one's end); none for null and empty."""
        return spread(pc.ascii_split_whitespace(texts.fill_null("")), self.lexicon)

    def learn(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Special tokens have a case, and are left whole.
        special = pc.match_substring(stretches, "<|")
        words, tails = without_tails(pc.if_else(special, stretches, pc.ascii_lower(stretches)))
        coded, kinds = words.dictionary_encode(), {t: i for i, t in enumerate(sorted(set(tails)))}
        pool, starts, sizes = self.encode(pa.concat_arrays([coded.dictionary, pa.array(kinds, pa.string())]))
        each = np.empty(2 * len(stretches), np.int64)  # a stretch's word, then its tail
        each[::2] = coded.indices.to_numpy()
        each[1::2] = len(coded.dictionary) + np.fromiter(map(kinds.__getitem__, tails), np.int64, len(tails))
        return gather(pool, starts[each], sizes[each])[0], sizes[each].reshape(-1, 2).sum(axis=1)

    def encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it those of each part start and how many they are."""
        found, sizes, order, others, left = [], [], [], [], np.ones(len(parts), bool)
        for pattern, tokenizer in [*self.plain, (None, self.tokenizer)]:
            which = np.flatnonzero(left)
            rest = parts.take(pa.array(which))
            fits = pc.match_substring_regex(rest, pattern).to_numpy(zero_copy_only=False) if pattern else [w.isalpha() for w in rest.to_pylist()]
            which = which[np.array(fits, bool)]
            left[which] = False
            starts = pa.array(np.append(np.arange(0, len(which), MANY), len(which)), pa.int32())
            lines = pc.binary_join(pa.ListArray.from_arrays(starts, parts.take(pa.array(which))), " ").to_pylist()
            for k, line in enumerate(lines):
                some = which[k * MANY : (k + 1) * MANY]
                ids = np.array(tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(some):  # letters that normalising takes apart
                    others.append(some)
                    continue
                found.append(ids)
                sizes.append(np.diff(stops, prepend=0))
                order.append(some)
        others = np.concatenate([*others, np.flatnonzero(left)])
        texts = parts.take(pa.array(others, pa.int64())).to_pylist()
        for at in range(0, len(others), 1000):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
            found.append(np.array([x for ids in lists for x in ids], "<u4"))
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            order.append(others[at : at + 1000])
        all_sizes = np.zeros(len(parts), np.int64)
        starts = np.zeros(len(parts), np.int64)
        if order:
            flat, order = np.concatenate(sizes), np.concatenate(order)
            all_sizes[order], starts[order] = flat, np.cumsum(flat) - flat
        return np.concatenate([np.zeros(0, "<u4"), *found]), starts, all_sizes


def encoder(vocabulary: str) -> Encoder:
    """The encoder of a vocabulary file, kept by the worker process."""
    return resident(("encoder", vocabulary), lambda: Encoder(vocabulary))


def _mixed(n: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each id (splitmix64)."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_TABLE = (_mixed(1 << 16) >> np.uint64(32)).astype(np.uint32)


def cuts(ids: np.ndarray) -> list[int]:
    """Where chunks end, the last id included; none for no ids."""
    n = len(ids)
    if n == 0:
        return []
    g = _TABLE[ids & 0xFFFF]
    h = g.copy()
    for k in range(1, min(ROLL, n)):
        h[k:] ^= g[:-k] << np.uint32(k * 5) | g[:-k] >> np.uint32(32 - k * 5)
    ends, last = [], 0
    for at in [*(np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1).tolist(), n]:
        while at - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if at - last >= MIN_IDS and at < n:
            last = at
            ends.append(at)
    if last < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves, in pairs; an odd one goes up as it is. Of none: the digest of nothing."""
    level = [digest(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else digest(b"")


_PACK = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("digest", pa.binary()), ("ids", pa.binary()), ("width", pa.int32()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("root", pa.binary())])
_PACK_DDL = "kind string, id long, digest binary, ids binary, width int, digests array<binary>, lengths array<int>, n_tokens long, root binary"


def _pack(vocabulary: str, end_id: int):
    def run(batches):
        encode, seen = encoder(vocabulary), OrderedDict()
        for whole in batches:
            for b in slices(whole, "text"):
                rows: list[tuple] = []
                every, starts = encode(b["text"])
                for k, id_ in enumerate(b["id"].to_pylist()):
                    ids = np.append(every[starts[k] : starts[k + 1]], np.uint32(end_id))
                    small, digests, lengths, last = ids.max() < 1 << 16, [], [], 0
                    packed = ids.astype("<u2") if small else ids.astype("<u4")
                    for end in cuts(ids):
                        chunk = packed[last:end].tobytes()
                        d = digest(bytes([packed.itemsize]) + chunk)
                        digests.append(d)
                        lengths.append(end - last)
                        last = end
                        if d not in seen:
                            seen[d] = None
                            if len(seen) > SEEN:
                                seen.popitem(last=False)
                            rows.append(("chunk", None, d, chunk, packed.itemsize, None, None, None, None))
                    rows.append(("recipe", id_, None, None, None, digests, lengths, len(ids), merkle(digests)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACK, strict=True)], schema=_PACK)

    return run


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> str:
    """Writes a store of all rows of docs to path, a new folder that executors share; returns path.

    Null and empty texts have the end id alone. Repeated rows each have a
    recipe, next to each other, and share their chunks. Null ids come first.
    Other columns are ignored. An empty table makes a store of no documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_pack(vocabulary, end_id), _PACK_DDL)
    # Recipes are dealt evenly and all stay; of a chunk's copies one stays.
    key = F.when(F.col("kind") == "chunk", F.xxhash64("digest")).otherwise(F.xxhash64("id", "root"))
    once = Window.partitionBy("key", "kind", "digest").orderBy("width")
    kept = rows.withColumn("key", key).withColumn("rn", F.row_number().over(once)).where("kind = 'recipe' or rn = 1")
    kept.drop("key", "rn").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/pack")
    recipes = spark.read.schema(_PACK_DDL).parquet(f"{path}/pack").where("kind = 'recipe'").select("id", "digests", "lengths", "n_tokens", "root")
    placed = recipes.repartitionByRange("id").sortWithinPartitions("id", "root").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "*")
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    _tree(_recipes(spark, path).select("row", "id", "n_tokens", "root")).write.parquet(f"{path}/manifest")
    return path


#: Bits of a row number that tell documents of a block apart, and levels of the manifest.
FAN_BITS = 12
#: Tasks that make a level above blocks.
FEW = 8
PART, STORE = 2, 3
_MANIFEST = "level int, key long, n_docs long, n_tokens long, root binary, start long"


def _tree(docs: DataFrame) -> DataFrame:
    """(level, key, n_docs, n_tokens, root, start) of the nodes above documents (row, id, n_tokens, root).

    A document's leaf is the digest of its id, number of ids and root, so none of
    these can change unnoticed. start, of partitions alone, is the number of ids before them.

    A row number is its partition and, below 33 bits, its place there: blocks of
    2 ** FAN_BITS documents, blocks of as many blocks, partitions, the store. So no task holds
    more than that many roots, and one a partition for the store's.
    """
    join = F.arrow_udf(_roots, "binary")

    def up(nodes: DataFrame, key, level: int, tasks: int | None = None) -> DataFrame:
        found = nodes.groupBy(key.alias("key")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct(F.col("key").alias("at"), "root"))).alias("nodes"))
        found = found.coalesce(tasks) if tasks else found
        return found.select(F.lit(level).alias("level"), "key", "n_docs", "n_tokens", join(F.col("nodes.root")).alias("root"))

    at = F.col("key")
    told = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "n_tokens", F.hex("root"))
    docs = docs.select("row", "n_tokens", F.unhex(F.sha2(told, 256)).alias("root"))
    blocks = cut(up(docs.select(F.col("row").alias("key"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", "root"), F.shiftright(at, FAN_BITS), 0), "blocks")
    # Above blocks there is a row in 2 ** (2 * FAN_BITS) documents or less: few tasks, and cheaper made again than written.
    groups = up(blocks, F.shiftright(at, FAN_BITS), 1, FEW)
    parts = up(groups, F.shiftright(at, 33 - 2 * FAN_BITS), PART, FEW)
    before = Window.partitionBy("level").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(None).cast("long").alias("start")
    starts = parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))  # one row a partition
    return blocks.unionByName(groups).unionByName(up(parts, F.lit(0).cast("long"), STORE, 1)).select("*", none).unionByName(starts)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, row long, id long, digests array<binary>, lengths array<int>, n_tokens long, root binary").parquet(f"{path}/recipes")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_PACK_DDL).parquet(f"{path}/pack").where("kind = 'chunk'").select("digest", "ids", "width")


@lru_cache(maxsize=4096)
def _zeros(n: int) -> list[list[int]]:
    """Tables that carry a CRC-32 over n zero bytes, a byte of it at a time."""
    if n == 1:
        base = [zlib.crc32(b"\0", b << s) ^ zlib.crc32(b"\0", 0) for s in (0, 8, 16, 24) for b in range(256)]
        return [base[i : i + 256] for i in range(0, 1024, 256)]
    half = _zeros(n // 2)
    out = [[_carry(half, x) for x in table] for table in half]
    if n % 2:
        one = _zeros(1)
        out = [[_carry(one, x) for x in table] for table in out]
    return out


def _carry(tables: list[list[int]], crc: int) -> int:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def combine(first: int, second: int, n: int) -> int:
    """The CRC-32 of two stretches of bytes from those of each; n is the second one's length."""
    return _carry(_zeros(n), first) ^ second if n else first


def _checked(batches):
    """Address as it follows from the bytes, number of ids, and the CRC-32 of the ids in 4 bytes each."""
    release()
    for b in batches:
        rows = []
        for d, data, width in zip(b["digest"].to_pylist(), b["ids"].to_pylist(), b["width"].to_pylist(), strict=True):
            if (found := digest(bytes([width]) + data)) != d:
                raise ValueError(f"chunk {d.hex()} has other bytes: {found.hex()}")
            ids = np.frombuffer(data, "<u2" if width == 2 else "<u4")
            rows.append((found, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int64()))], names=["digest", "n", "crc"])


def _rebuilt(parts: pa.Array, roots: pa.Array, totals: pa.Array) -> pa.Array:
    """The CRC-32 of each document, from its chunks (pos, digest, n, length, crc) in order."""
    release()
    _, digests, sizes, lengths, crcs = parts.flatten().flatten()
    if digests.null_count:
        raise ValueError("a chunk of a document isn't in the store")
    if not sizes.equals(lengths):
        raise ValueError("a chunk has another length than its recipe says")
    out, ends = [], (parts.offsets.to_numpy() - parts.offsets[0].as_py()).tolist()
    for (first, last), root, total in zip(pairwise(ends), roots.to_pylist(), totals.to_pylist(), strict=True):
        crc, size = 0, last - first
        some = sizes.slice(first, size).to_pylist()
        for n, c in zip(some, crcs.slice(first, size).to_pylist(), strict=True):
            crc = combine(crc, c, 4 * n)
        if merkle(digests.slice(first, size).to_pylist()) != root or sum(some) != total:
            raise ValueError("a document can't be rebuilt: its chunks don't give its Merkle root or its number of ids")
        out.append(crc)
    return pa.array(out, pa.int64())


def _roots(nodes: pa.Array) -> pa.Array:
    """The Merkle root over each list of nodes."""
    release()
    flat, ends = nodes.flatten(), (nodes.offsets.to_numpy() - nodes.offsets[0].as_py()).tolist()
    return pa.array([merkle(flat.slice(a, b - a).to_pylist()) for a, b in pairwise(ends)], pa.binary())


def _wanted(spark: SparkSession, path: str) -> DataFrame:
    """One row a chunk of a document, in any order."""
    each = F.posexplode(F.arrays_zip("digests", "lengths")).alias("pos", "c")
    return _recipes(spark, path).select("part", "row", "id", "n_tokens", F.col("root"), each).select("*", F.col("c.digests").alias("address"), F.col("c.lengths").alias("length")).drop("c")


def _check_manifest(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """(key, first): the number of ids before each partition, as it follows from these documents; fails unless the tree above them is that of the manifest."""
    found, written = cut(_tree(docs), "tree"), spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    node = F.struct("n_docs", "n_tokens", "root", "start")
    pairs = found.select("level", "key", node.alias("a")).join(written.select("level", "key", node.alias("b")), ["level", "key"], "full")
    bad = pairs.where(~F.col("a").eqNullSafe(F.col("b"))).select("level", "key").head(1)
    if bad:
        raise ValueError(f"the documents aren't those of the manifest: node {bad[0].key} of level {bad[0].level} differs")
    return found.where(F.col("level") == PART).select("key", F.col("start").alias("first"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document of a store.

    All of the store is read and verified when this is called: a chunk, recipe
    or node of the manifest that is missing, or isn't what it was, raises an error. Null ids
    come first; repeated documents each have a row, one after the other; an empty store gives no rows.
    """
    chunks = _chunks(spark, path).mapInArrow(_checked, "digest binary, n int, crc long")
    found = _wanted(spark, path).join(chunks, F.col("address") == F.col("digest"), "left")
    docs = found.groupBy("part", "row", "id", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n", "length", "crc"))).alias("parts"))
    crc = F.arrow_udf(_rebuilt, "long")("parts", "root", "n_tokens").alias("ids_crc32")
    docs = cut(docs.select("part", "row", "id", "n_tokens", "root", crc), "read")
    starts = _check_manifest(spark, path, docs.select("row", "id", "n_tokens", "root"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0).cast("long")))
    placed = placed.join(F.broadcast(starts), F.col("part") == F.col("key"))  # one row a partition
    return placed.select("id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, row, ids): the ids of each document, put together from its chunks; sort by row for the stored order.

    A chunk that is missing or has other bytes than its address says fails the
    read. The manifest isn't looked at: read_digests() verifies a whole store.
    """

    def join_ids(parts: pd.Series) -> pd.Series:
        def one(chunks):
            for c in chunks:
                if c["ids"] is None or digest(bytes([int(c["width"])]) + bytes(c["ids"])) != bytes(c["address"]):
                    raise ValueError("a chunk of a document isn't in the store, or has other bytes")
            return np.concatenate([np.frombuffer(c["ids"], "<u2" if c["width"] == 2 else "<u4").astype(np.int64) for c in chunks])

        return parts.map(one)

    found = _wanted(spark, path).join(_chunks(spark, path), F.col("address") == F.col("digest"), "left")
    found = found.groupBy("row", "id").agg(F.sort_array(F.collect_list(F.struct("pos", "address", "ids", "width"))).alias("parts"))
    return found.select("id", "row", F.pandas_udf(join_ids, "array<long>")("parts").alias("ids"))
