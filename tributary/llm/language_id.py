"""Language identification by compression with per-language zstandard dictionaries.

Each language's dictionary is raw content: its training texts, whole and in
lower case, one after the other. A text is cut into pieces of
``piece_bytes``; every piece is compressed against every dictionary, and the
language whose dictionary gives the fewest bytes in total is the prediction.
The pieces are short against the dictionary, so a long text isn't judged by
how well it compresses itself. All pieces of all texts count.

score is the margin of the best language over the next one, in parts of the
bytes that the next one took, times ``MARGIN_SCALE`` and at most 1. A margin under
``min_margin`` is narrow: the text is rejected, as are texts without letters.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm._text import ddl, kept, resident, row_batch

#: The classifier is fitted on at most this many texts a language, all of each.
FIT_TEXTS = 128
PIECE_BYTES = 2048
MIN_MARGIN = 0.002
MARGIN_SCALE = 5.0
LEVEL = 6
UNKNOWN = "und"


def held_out(id_col: str = "doc_id"):
    """Documents that the classifier never learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_texts: int = FIT_TEXTS) -> dict[str, bytes]:
    """{language: dictionary} from a bounded sample of whole texts: of each language the fit_texts distinct ones of smallest hash.

    Copies of a text are one. Rows with a null or blank text, a null language or
    a null id, and held-out rows, aren't learned from. An empty table gives no language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("id is not null and lang is not null and text is not null").where(~held_out("id")).where(F.col("text").rlike(r"\p{L}"))
    hashed = rows.select("lang", F.xxhash64("text").alias("h"), "text")
    # The smallest hashes are found without the texts: first in 64 ranges of hashes, so that a frequent language is spread, then of what these left.
    keys = hashed.select("lang", "h").distinct()
    first = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    keys = keys.withColumn("r", F.row_number().over(first)).where(F.col("r") <= fit_texts)
    last = Window.partitionBy("lang").orderBy("h")
    keys = keys.withColumn("r", F.row_number().over(last)).where(F.col("r") <= fit_texts).drop("r")
    chosen = hashed.join(F.broadcast(keys), ["lang", "h"]).distinct()  # fit_texts rows a language
    found: dict[str, list] = {}
    for r in chosen.collect():
        found.setdefault(r.lang, []).append((r.h, r.text.lower()))
    # Sentences that several texts share are passages that travel between documents, not language.
    split = {lang: [re.split(r"(?<=[.\n])", s) for _, s in sorted(v)] for lang, v in sorted(found.items())}
    seen = Counter(x for v in split.values() for parts in v for x in {p.strip() for p in parts})
    own = {lang: ["".join(p for p in parts if seen[p.strip()] < 2) or "".join(parts) for parts in v] for lang, v in split.items()}
    return {lang: "\n".join(v).encode("utf-8", "replace") for lang, v in own.items()}


class Classifier:
    """Compressors for each dictionary; made once a worker process."""

    def __init__(self, dictionaries: dict[str, bytes], piece_bytes: int = PIECE_BYTES, level: int = LEVEL):
        self.piece = piece_bytes
        self.by_lang = []
        for lang, raw in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by_lang.append((lang, zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False).compress))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); und with score 0 for null or without letters."""
        if not text or not self.by_lang or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        raw = text.lower().encode("utf-8", "replace")
        pieces = [raw[i : i + self.piece] for i in range(0, len(raw), self.piece)]
        sizes = sorted((sum(len(compress(p)) for p in pieces), lang) for lang, compress in self.by_lang)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        (best, lang), (next_best, _) = sizes[:2]
        margin = (next_best - best) / next_best
        return lang, min(1.0, MARGIN_SCALE * margin), margin


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def classify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per row of docs: id, the columns in keep, lang_pred, score (0 to 1), margin, rejected.

    lang_pred is a learned language, or und if the text is null or has no
    letter (or nothing could be learned). Ties go to the language that sorts
    first. rejected: und, or the margin is under min_margin. Empty tables give
    no rows; other columns are ignored, and so are columns to keep that are named
    like a result. Null ids and repeated rows are rows like others.
    """
    out = kept(id_col, keep, ("lang_pred", "score", "margin", "rejected"))
    docs = docs.select(*dict.fromkeys([*out, text_col]))
    shared, token = docs.sparkSession.sparkContext.broadcast(dictionaries), uuid.uuid4().hex

    def run(batches):
        predict = resident(("classifier", token), lambda: Classifier(shared.value))
        for b in batches:
            rows = [predict(t) for t in b[text_col].to_pylist()]
            new = {
                "lang_pred": ([r[0] for r in rows], pa.string()),
                "score": ([r[1] for r in rows], pa.float64()),
                "margin": ([r[2] for r in rows], pa.float64()),
                "rejected": ([r[0] == UNKNOWN or r[2] < min_margin for r in rows], pa.bool_()),
            }
            yield row_batch(b, out, new)

    return docs.mapInArrow(run, f"{ddl(docs, out)}, lang_pred string, score double, margin double, rejected boolean")
