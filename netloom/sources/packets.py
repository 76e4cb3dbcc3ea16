"""Packet tables as batch and stream sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.prepare import split_valid
from netloom.schema import PACKET_SCHEMA


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Packets in the shared packet schema, from any Spark file format."""
    return spark.read.format(fmt).options(**options).schema(PACKET_SCHEMA).load(path)


def write_packets(packets: DataFrame, path: str) -> None:
    """Packets partitioned by stream and sorted by arrival, so range scans are pruned."""
    (
        packets.repartitionByRange("stream_id", "seq")
        .sortWithinPartitions("stream_id", "seq")
        .write.mode("overwrite").partitionBy("stream_id").parquet(path)
    )


def stream_packets(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(PACKET_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


_SUBMITTED = (
    "stream_id string, seq bigint, timestamp double, length string, src_ip string, dst_ip string, src_port string, "
    "dst_port string, protocol string, dns_query_name string, dns_query_type int, dns_response_code int, "
    "tls_version int, tls_is_client_hello boolean, tls_sni string, tls_cipher_suites_count int, tls_extensions_count int"
)


def submitted_packets(json_rows: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Packets submitted as JSON text (a queue or file stream): (accepted, rejected)."""
    fields = json_rows.select(F.from_json(F.col(value).cast("string"), _SUBMITTED).alias("p")).select("p.*")
    accepted, rejected = split_valid(fields)
    typed = accepted.withColumn("ts", F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("bigint")))
    return typed.select(*[F.col(f.name).cast(f.dataType) for f in PACKET_SCHEMA.fields]), rejected
