"""A corpus through five operators: language, repeated lines, near copies, benchmark, tokens.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and gives
the documents that stay, with the columns it got, and the last one token counts and digests.
``run`` writes each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import decontam, langid, linededup, minmax
from netloom.llm.common import held_out, materialize, table
from netloom.llm.queries import bpe_round_trip

#: A text whose shortest code needs more bits a byte than this is no text of any learned language.
MAX_BITS_PER_BYTE = 8.0


def _parts(docs: DataFrame):
    """The text, and the other columns as a struct that no result can clash with."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    return docs.select(others, "doc_id", "text")


def _whole(found: DataFrame, columns: list[str], text: str = "body") -> DataFrame:
    return found.select(*(F.col(text).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no language's model compresses, go."""
    frozen = langid.train(docs.filter(~held_out(F.col("doc_id"))))
    found = langid.identify(_parts(docs), frozen, id_col="row", keep_text=True)
    good = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("bits_per_byte") <= MAX_BITS_PER_BYTE)
    return _whole(found.filter(good), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three or more documents stay in one of them; every document stays, and ``n_chars`` follows."""
    clean = linededup.drop_repeated_lines(_parts(docs), carry="row")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return clean.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of smallest id; a null id groups with nothing and stays.

    Each row is a document. Where rows repeat an id, they are grouped by a number of their own.
    """
    uses = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not materialize(uses, "repeated-ids").isEmpty():
        others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
        rows = materialize(docs.select(F.monotonically_increasing_id().alias("number"), others, "doc_id", "text"), "numbered")
        found = minmax.near_duplicates(rows.filter("doc_id IS NOT NULL"), id_col="number")
        first = found.join(rows.select("number", "doc_id"), "number").groupBy("component_id").agg(
            F.min(F.struct("doc_id", "number"))["number"].alias("stays")
        )
        kept = rows.join(first, F.col("number") == F.col("stays"), "left_semi").union(rows.filter("doc_id IS NULL"))
        return _whole(kept, docs.columns, "text")
    gone = minmax.near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontam.find_benchmark(_parts(docs), table(spark, sf_dir, "benchmark"), id_col="row", keep_text=True)
    return _whole(found.filter(F.size("items") == 0), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs)


STAGES = [
    ("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark),
    ("tokens", tokens),
]
#: Learned models and near-duplicate groups cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
