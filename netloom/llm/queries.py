"""One registered query for each text operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bpe, decontam, langid, linededup, minmax, packing, phrases, pii, repeats, rules, spelling, toolcalls, toxicity
from netloom.llm.common import held_out, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    found = langid.identify(docs, langid.train(docs.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def _linked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.turns_as_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(toolcalls.REPLY, "name string, field string, type string, required boolean")
    return toolcalls.link_calls(calls, results, schemas)


def op2_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = _linked_calls(spark, sf_dir)
    return linked.select(
        F.col("conv").alias("conv_id"), F.col("pos").alias("turn"), "call_id", "n_results", "level",
        (F.size("errors") == 0).alias("valid"), F.sha2("canonical", 256).alias("json_sha256"),
    )


def op2_chain_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked_calls(spark, sf_dir).select(F.col("conv").alias("conv_id"), F.col("pos").alias("turn"), "chain_level")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~out))
    return found.select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return rules.quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")), remainder == 1
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    joined = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(number(k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op7_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def bpe_round_trip(docs: DataFrame) -> DataFrame:
    """Digests of ids and decoded bytes, a row for each row of ``docs``."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(docs, path), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_toolcalls": toolcalls.ORACLE, "op2_chain_levels": toolcalls.CHAIN_ORACLE, "op8_lines": linededup.DIGEST_SQL, "op9_decontaminate": decontam.DIGEST_SQL, "op11_phrases": phrases.ORACLE}
