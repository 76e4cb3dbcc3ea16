"""The driver's ``events`` table seen as packets.

Time runs 10 000 times faster than in the table. Users 140 and up act as a scanner,
120 to 139 as a flood, the rest as four ordinary services.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.session import materialize

_VIEW = """
SELECT 'events' AS stream_id, seq, ts_us,
 CASE WHEN g=2 THEN '192.168.1.250' WHEN g=1 THEN concat('198.51.100.', CAST(u AS {STR}))
      WHEN fwd THEN concat('192.168.1.', CAST(10+h AS {STR})) ELSE concat('203.0.113.', CAST(20+d AS {STR})) END AS src_ip,
 CASE WHEN g=2 THEN '10.9.9.9' WHEN g=1 THEN '10.0.0.80'
      WHEN fwd THEN concat('203.0.113.', CAST(20+d AS {STR})) ELSE concat('192.168.1.', CAST(10+h AS {STR})) END AS dst_ip,
 CAST(CASE WHEN g=2 THEN 50000+seq%1000 WHEN g=1 THEN 40000+k WHEN fwd THEN 41000+h*16+d ELSE svc END AS INT) AS src_port,
 CAST(CASE WHEN g=2 THEN 1+k WHEN g=1 THEN 80 WHEN fwd THEN svc ELSE 41000+h*16+d END AS INT) AS dst_port,
 CASE WHEN g=0 AND d=1 THEN 'UDP' ELSE 'TCP' END AS protocol,
 60 + CAST(floor(value) AS BIGINT) AS length,
 CASE WHEN g=0 AND d=1 THEN concat(substr(md5(CAST(seq AS {STR})),1,24),'.example.com.') END AS dns_query_name,
 (g=0 AND d=0 AND event_type='signup') AS tls_is_client_hello,
 CASE WHEN g=0 AND d=0 AND event_type='signup' AND h<4 THEN concat('h',CAST(h AS {STR}),'.example.com') END AS tls_sni
FROM (SELECT *, CASE d WHEN 0 THEN 443 WHEN 1 THEN 53 WHEN 2 THEN 80 ELSE 8080 END AS svc FROM (
 SELECT event_id AS seq, 1700000000000000 + ({US} - 1704067200000000) {DIV} 10000 AS ts_us,
        user_id % 150 AS u, user_id % 8 AS h, k, k % 4 AS d, event_id % 3 <> 0 AS fwd, event_type, value,
        CASE WHEN user_id % 150 >= 140 THEN 2 WHEN user_id % 150 >= 120 THEN 1 ELSE 0 END AS g
 FROM (SELECT *, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM {EVENTS}) e1) e2) e3
"""


def packets_sql(dialect: str, events: str = "events") -> str:
    """The packet view for ``spark`` or ``duckdb``."""
    if dialect == "spark":
        us, div, text = "unix_micros(CAST(ts AS TIMESTAMP))", "div", "STRING"
    else:
        us, div, text = "epoch_us(ts)", "//", "VARCHAR"
    return _VIEW.format(US=us, DIV=div, STR=text, EVENTS=events)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def driver_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(packets_sql("spark", "{events}"), events=table(spark, sf_dir, "events"))


def ingested_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets as a written packet table, which is what captures are decoded to.

    Steps that read packets several times then prune columns instead of deriving them anew.
    """
    return materialize(driver_packets(spark, sf_dir), "packets")
