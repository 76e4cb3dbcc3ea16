from pyspark.sql import functions as F

from netloom.schema import PACKET_SCHEMA

FIELDS = [f.name for f in PACKET_SCHEMA.fields if f.name != "ts"]
SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PACKET_SCHEMA.fields if f.name != "ts") + ", ts_us bigint"


def packet(seq, t, length=100, src="10.0.0.1:1000", dst="10.0.0.2:80", protocol="TCP", stream="s", **more):
    def split(text):
        if text is None:
            return None, None
        ip, _, port = text.rpartition(":")
        return ip, int(port)

    (src_ip, src_port), (dst_ip, dst_port) = split(src), split(dst)
    row = dict.fromkeys(FIELDS)
    row.update(
        stream_id=stream, seq=seq, ts_us=round(t * 1_000_000), length=length, src_ip=src_ip, dst_ip=dst_ip,
        src_port=src_port, dst_port=dst_port, protocol=protocol, tls_is_client_hello=False,
    )
    row.update(more)
    return row


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    return df.withColumn("ts", F.timestamp_micros("ts_us"))
