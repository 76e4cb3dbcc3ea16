"""Line dedup: drop lines that many documents share, keeping one holder of each.

Lines are exploded with their positions and keyed by a 128-bit hash of the normalised
line. Two map-side combined aggregates, by (key, id) and then by key, count the documents
of each key, so no task gets the rows of a hot line. The lines of keys at or over the
threshold are joined back (an inner join, which adaptive execution splits where one line
holds a third of all rows), and each text is put together again by position from the
stretches between its dropped lines. DataFrame functions only.

Defined cases: a null or empty text is one empty line. Documents are told apart by id, so
repeated rows count once, and a null id is one document. All rows of the largest id that
holds a line keep it; null is smaller than any id. Keys shorter than ``min_chars`` are
never dropped. An empty table gives an empty result. The lines of a very long text are rows of
their own until it is put together. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import SPACES, ascii_lower, materialize


def drop_repeated_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: str | None = None,
) -> DataFrame:
    """``id_col``, ``n_lines``, ``n_dropped`` and ``clean_text``, a row for each row of ``docs``.

    ``carry`` names a column, perhaps a struct, that each row keeps.
    """
    carried = [F.col(carry).alias("carried")] if carry else []
    rows = docs.select(
        F.col(id_col).alias("id"), *carried, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")
    ).withColumn("fp", F.xxhash64("body"))
    key = F.btrim(ascii_lower(F.col("line")), F.lit(SPACES))
    keyed = materialize(
        rows.select("id", "fp", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
        .select("id", "fp", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "fp", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2")),
        "line-keys",
    )
    shared = (
        keyed.groupBy("k1", "k2", "id").agg(F.lit(1).alias("one"))
        .groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
        .filter(F.col("n") >= min_docs).select("k1", "k2", "last")
    )
    drops = (
        keyed.join(shared, ["k1", "k2"])
        .filter(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy("id", "fp").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        .select(F.col("id").alias("gid"), F.col("fp").alias("gfp"), "gone")
    )
    # Lines between two dropped ones stay; -1 and n_lines bound the first and last stretch.
    joined = (
        rows.join(drops, F.col("id").eqNullSafe(F.col("gid")) & (F.col("fp") == F.col("gfp")), "left")
        .select("id", *(["carried"] if carry else []), "body", "gone", F.split("body", "\n", -1).alias("lines"))
        .select(
            "id", *(["carried"] if carry else []), "body", "gone", "lines",
            F.when(
                F.col("gone").isNotNull(),
                F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines"))),
            ).alias("cuts"),
        )
    )
    stretches = F.transform(
        F.sequence(F.lit(1), F.size("cuts") - 1),
        lambda i: F.slice(
            F.col("lines"),
            F.get("cuts", i - 1) + 2,
            F.greatest(F.get("cuts", i) - F.get("cuts", i - 1) - 1, F.lit(0)),
        ),
    )
    return joined.select(
        F.col("id").alias(id_col),
        *([F.col("carried").alias(carry)] if carry else []),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("cuts").isNull(), F.col("body"))
        .otherwise(F.array_join(F.flatten(stretches), "\n")).alias("clean_text"),
    )


#: The same result in SQL (DuckDB).
ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.last AS gone
  FROM keyed k LEFT JOIN shared s USING (key))
"""
DIGEST_SQL = ORACLE + """
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
