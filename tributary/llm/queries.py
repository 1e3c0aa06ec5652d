"""The queries of this package: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import chat, decontaminate, embeddings, html_extract, language_id, line_dedup, periodic_runs, sentencepiece, simhash, spelling, token_counts, token_store, warc
from tributary.llm._text import table
from tributary.scratch import new_path


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's vocabulary file; it is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "part", "assistant", "n_turns", "start", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), spans.alias("mask"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), vocabulary("word_bpe_49k.json"))
    return token_store.read_digests(spark, path).withColumnRenamed("id", "doc_id")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.classify(docs, language_id.fit(docs))
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicate(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def _id_hash() -> Column:
    """The unsigned crc32 of the decimal doc_id; a null id is the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_runs.words(F.col("text")).alias("words")).withColumns({"h": _id_hash(), "n": F.size("words").cast("long")})
    docs = docs.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.expr("g % nullif(n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("transform(words, (w, i) -> IF(i < a, w, words[CAST(a + (i - a) % p AS INT)]))")
    docs = docs.withColumn("words", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), repeated).otherwise(F.col("words")))
    out = periodic_runs.collapse(docs, "words", ["doc_id"])
    longest = F.array_max(F.expr("transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period))"))
    lines = F.array_join(F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"), "")
    out = out.withColumn("top", longest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("(1000 * top.length) div -top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.occurrences(table(spark, sf_dir, "documents"), id_col="doc_id")
    found = found.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary")))
    found = found.withColumn("at", (F.col("h") % F.length("word")).cast("int"))
    shorter = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
    return spelling.group_variants(found.select(F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("word")).alias("word")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_chat_perspectives, op3_token_store, op4_embedding_dedup, op5_language_id, op6_line_dedup, op7_warc, op8_html_extract, op9_decontaminate, op10_sentencepiece, op11_token_counts, op12_periodic_runs, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_perspectives": chat.ORACLE,
        "op4_embedding_dedup": embeddings.ORACLE,
        "op6_line_dedup": line_dedup.ORACLE,
        "op7_warc": warc.ORACLE,
        "op9_decontaminate": decontaminate.ORACLE,
        "op12_periodic_runs": periodic_runs.ORACLE,
        "op13_spelling_variants": spelling.ORACLE,
    }
