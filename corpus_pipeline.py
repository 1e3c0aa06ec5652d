"""The corpus pipeline: five filtering stages of tributary.llm, from documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. run() writes each stage's result to the
shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import decontaminate, language_id, line_dedup, near_copies, sentencepiece
from tributary.llm._text import table
from tributary.llm.queries import vocabulary
from tributary.scratch import cut


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """docs under names that no operator uses, these names by the old ones, and the columns that bring the old ones back."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, [F.col(n).alias(c) for c, n in names.items()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject. The classifier learns from docs themselves.

    Null, empty and blank texts, those without letters and those whose margin is
    narrow go. Null ids stay (nothing is learned from them), repeated rows all
    stay or go, and other columns, whatever their names, come along. An empty table stays one.
    """
    plain, names, back = _renamed(docs)
    found = language_id.classify(plain, language_id.fit(docs), names["doc_id"], names["text"], keep=list(plain.columns))
    return found.where(~F.col("rejected")).select(*back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the lines that it keeps, n_chars as it then is; documents without any line left go.

    Null and empty texts lose no line and stay as they were. Repeated rows share
    their lines and their fate; null ids are one document. Other columns come along.
    """
    plain, names, back = _renamed(docs)
    found = line_dedup.deduplicate(plain, names["doc_id"], names["text"]).where((F.col("n_dropped") == 0) | (F.col("kept_text") != ""))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[F.when(F.col("n_dropped") > 0, new[c]).otherwise(F.col(n)).alias(c) if c in new else F.col(n).alias(c) for c, n in names.items()])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of 5-word shingles of 0.8 and more): the one with the smallest id.

    Candidates are operator 1's links of SimHash fingerprints, then, for copies
    beyond its two bits, those of MinHash bands; an exact check follows either.

    Documents are rows, not ids: null ids come last, an id that several texts
    have loses none of them that has no near copy, of rows that repeat one
    stays. Null, empty and blank texts are copies of each other.
    """
    return near_copies.survivors(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth are in windows of the benchmark.

    Null and empty texts are clean; null ids, repeated rows and other columns
    are kept as they are; with an empty benchmark all documents stay.
    """
    plain, names, back = _renamed(docs)
    found = decontaminate.contamination(plain, table(spark, sf_dir, "benchmark"), names["doc_id"], names["text"], keep=list(plain.columns))
    return found.where(~F.col("contaminated")).select(*back)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_crc32, decoded_sha256, round_trip and ids of every document.

    Null and empty texts have no ids; every row, repeated or with a null id, has
    its own; other columns are left out.
    """
    return sentencepiece.encode(docs, vocabulary("piece_bpe_32k.model"), keep=["lang", "source"])


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: Language identification and SentencePiece can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder. Empty documents give no rows; each stage says what it does with odd ones."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
