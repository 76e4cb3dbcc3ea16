"""SQL for DuckDB that computes the registered queries independently of Spark."""

from __future__ import annotations

from netloom.sources.driver_tables import packets_sql

W, S = 10_000_000, 1_000_000

PACKETS = f"pk AS MATERIALIZED ({packets_sql('duckdb')})"


def grid(window: int = W, slide: int = S) -> str:
    """Packets copied to windows; the data has no late packets and no long gaps."""
    return f"""
g AS (SELECT arg_min(ts_us, seq) AS a, max(ts_us) AS m FROM pk),
wp AS MATERIALIZED (
  SELECT pk.*, a + k * {slide} AS window_end_us FROM (
    SELECT pk.*, g.a, unnest(range(greatest(1, (ts_us - a + {slide - 1}) // {slide}),
                                   least((ts_us - a + {window}) // {slide}, (m - a) // {slide}) + 1)) AS k
    FROM pk, g) pk)"""


def flows(window: int = W, slide: int = S) -> str:
    return grid(window, slide) + f""",
ks AS (
  SELECT *, least(src_ip || '|' || lpad(CAST(src_port AS VARCHAR), 5, '0'), dst_ip || '|' || lpad(CAST(dst_port AS VARCHAR), 5, '0'))
         || '~' || greatest(src_ip || '|' || lpad(CAST(src_port AS VARCHAR), 5, '0'), dst_ip || '|' || lpad(CAST(dst_port AS VARCHAR), 5, '0'))
         || protocol AS fk FROM wp),
od AS (
  SELECT *, row_number() OVER o AS rn, lag(ts_us) OVER o AS prev, first_value(src_ip) OVER o AS s_ip,
         first_value(dst_ip) OVER o AS d_ip, first_value(src_port) OVER o AS s_port, first_value(dst_port) OVER o AS d_port
  FROM ks WINDOW o AS (PARTITION BY window_end_us, fk ORDER BY seq)),
fl AS MATERIALIZED (
  SELECT window_end_us, window_end_us - {window} AS window_start_us, s_ip AS src_ip, d_ip AS dst_ip, s_port AS src_port,
         d_port AS dst_port, protocol,
         s_ip || ':' || s_port || '-' || d_ip || ':' || d_port || '-' || protocol AS flow_id,
         min(seq) AS first_seq, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us,
         count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
         count(*) FILTER (src_ip = s_ip AND src_port = s_port) AS fwd_packet_count,
         count(*) FILTER (NOT (src_ip = s_ip AND src_port = s_port)) AS rev_packet_count,
         CAST(coalesce(sum(length) FILTER (src_ip = s_ip AND src_port = s_port), 0) AS BIGINT) AS fwd_byte_count,
         CAST(coalesce(sum(length) FILTER (NOT (src_ip = s_ip AND src_port = s_port)), 0) AS BIGINT) AS rev_byte_count,
         count(*) FILTER (prev > 0 AND ts_us >= prev) AS iat_count,
         coalesce(avg((ts_us - prev) / 1e6) FILTER (prev > 0 AND ts_us >= prev), 0) AS iat_mean,
         stddev_samp((ts_us - prev) / 1e6) FILTER (prev > 0 AND ts_us >= prev) AS iat_std,
         count(*) FILTER (rn > 1 AND dns_query_name <> '') AS dns_query_count,
         coalesce(bool_or(rn > 1 AND tls_is_client_hello), false) AS tls_client_hello,
         coalesce(bool_or(rn > 1 AND tls_is_client_hello AND tls_sni <> ''), false) AS tls_has_sni,
         arg_max(tls_sni, seq) FILTER (rn > 1 AND tls_is_client_hello AND tls_sni <> '') AS tls_sni
  FROM od GROUP BY window_end_us, fk, s_ip, d_ip, s_port, d_port, protocol),
fr AS (
  SELECT *, (last_seen_us - first_seen_us) / 1e6 AS dur,
         CASE WHEN last_seen_us > first_seen_us THEN fwd_packet_count / ((last_seen_us - first_seen_us) / 1e6) ELSE 0 END AS fwd_pps,
         CASE WHEN last_seen_us > first_seen_us THEN rev_packet_count / ((last_seen_us - first_seen_us) / 1e6) ELSE 0 END AS rev_pps,
         CASE WHEN last_seen_us > first_seen_us THEN fwd_byte_count / ((last_seen_us - first_seen_us) / 1e6) ELSE 0 END AS fwd_bps,
         CASE WHEN last_seen_us > first_seen_us THEN rev_byte_count / ((last_seen_us - first_seen_us) / 1e6) ELSE 0 END AS rev_bps
  FROM fl),
fan AS (
  SELECT window_end_us, src_ip, count(*) AS flow_count, count(DISTINCT dst_ip) AS unique_dst_ips,
         count(DISTINCT dst_port) AS unique_dst_ports FROM fl GROUP BY ALL),
dst AS (
  SELECT window_end_us, dst_ip, count(*) AS flows_to_dst, CAST(sum(packet_count) AS BIGINT) AS packets_to_dst,
         count(DISTINCT src_ip) AS unique_src_count FROM fl GROUP BY ALL)"""


# Detector thresholds below are those of ``queries.DRIVER_DETECTION``.
DDOS = """
dd AS (
  SELECT *, (CASE WHEN pps > 0.5 THEN 1 ELSE 0 END) + (CASE WHEN conc THEN 2 ELSE 0 END) + (CASE WHEN burst THEN 2 ELSE 0 END) AS sig
  FROM (SELECT fr.*, flows_to_dst, packets_to_dst, unique_src_count, fwd_pps + rev_pps AS pps, fwd_bps + rev_bps AS bps,
          (flows_to_dst > 40 OR unique_src_count > 25) AND dst_port <= 10000 AS conc,
          packets_to_dst > 45 AND flows_to_dst > 5 AND dst_port <= 10000 AS burst
        FROM fr JOIN dst USING (window_end_us, dst_ip)) x),
ddos AS (
  SELECT window_end_us, flow_id, pps, bps, flows_to_dst, least(1.0, sig / 3.0) AS confidence,
    concat_ws(' and ',
      CASE WHEN pps > 0.5 THEN printf('High traffic volume (%.2f pkts/sec)', pps) END,
      CASE WHEN conc THEN printf('High flow concentration (%d flows, %d src IPs to %s)', flows_to_dst, unique_src_count, dst_ip) END,
      CASE WHEN burst THEN printf('Distributed burst traffic (%d total packets to %s)', packets_to_dst, dst_ip) END) AS reason
  FROM dd WHERE sig >= 3)"""

BEACON = """
bw AS (
  SELECT *, CASE WHEN iat_count >= 2 AND iat_mean > 0 THEN iat_std / iat_mean END AS cv,
    count(*) OVER t AS windows_seen, (window_end_us - min(window_end_us) OVER t) / 1e6 AS span
  FROM fl WINDOW t AS (PARTITION BY flow_id ORDER BY window_end_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)),
bs AS (
  SELECT *, 0.5 * (1.0 - cv / 0.9) + 0.35 * least(1.0, (windows_seen - 5) / 20.0) + 0.15 * least(1.0, (packet_count - 3) / 50.0) AS confidence
  FROM bw WHERE dst_port NOT IN (53,67,68,123,137,138,161,162,389,636,5353) AND src_port NOT IN (53,67,68,123,137,138,161,162,389,636,5353)
    AND dst_ip NOT IN ('8.8.8.8','8.8.4.4','1.1.1.1') AND src_ip NOT IN ('8.8.8.8','8.8.4.4','1.1.1.1')
    AND cv <= 0.9 AND windows_seen >= 5 AND span >= 4 AND byte_count / packet_count < 300 AND packet_count >= 3),
c2 AS (
  SELECT window_end_us, flow_id, cv, windows_seen, span, packet_count, confidence,
    concat_ws(' and ', printf('Highly regular timing (CV=%.3f)', cv), printf('Sustained over %d windows (%.1fs)', windows_seen, span),
      printf('Non-infrastructure port (%d)', dst_port)) AS reason
  FROM bs WHERE confidence >= 0.3)"""

# Character entropy as a scalar expression over column {c}.
ENTROPY = """(SELECT -sum(p * log2(p)) FROM (
   SELECT count(*) * 1.0 / sum(count(*)) OVER () AS p FROM (SELECT unnest(string_split({c}, '')) AS ch) u GROUP BY ch) v)"""

DNS = """
dq AS (
  SELECT od.window_end_us, s_ip AS src_ip, d_ip AS dst_ip, fs.first_seq, dns_query_name AS name
  FROM od JOIN (SELECT window_end_us, fk, min(seq) AS first_seq FROM od GROUP BY ALL) fs USING (window_end_us, fk)
  WHERE rn > 1 AND dns_query_name <> ''),
de AS (SELECT *, lag(window_end_us) OVER (PARTITION BY src_ip, dst_ip ORDER BY window_end_us) AS pe
       FROM (SELECT DISTINCT src_ip, dst_ip, window_end_us FROM fl WHERE protocol = 'UDP' AND (src_port = 53 OR dst_port = 53)) x),
ds AS (SELECT src_ip, dst_ip, window_end_us,
         sum(CASE WHEN pe IS NULL OR window_end_us - pe > 3000000 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip, dst_ip ORDER BY window_end_us) AS sid FROM de),
nm AS (SELECT name, ent FROM (
    SELECT name, -sum(p * log2(p)) AS ent FROM (
      SELECT name, ch, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY name) AS p
      FROM (SELECT name, unnest(string_split(name, '')) AS ch FROM (SELECT DISTINCT name FROM dq) a) b GROUP BY name, ch) c GROUP BY name) d),
df AS (SELECT dq.*, sid, ent, row_number() OVER (PARTITION BY src_ip, dst_ip, sid, name ORDER BY window_end_us, first_seq) AS nth
       FROM dq JOIN ds USING (src_ip, dst_ip, window_end_us) JOIN nm USING (name)),
di AS (SELECT src_ip, dst_ip, sid, window_end_us, first_seq, count(*) AS c, sum(ent) AS e, sum(length(name)) AS l,
         count(*) FILTER (ent > 3.8) AS h FROM df WHERE nth = 1 GROUP BY ALL),
dr AS (
  SELECT window_end_us, flow_id, sum(coalesce(c, 0)) OVER o AS names, sum(coalesce(e, 0)) OVER o AS ents,
         sum(coalesce(l, 0)) OVER o AS lens, sum(coalesce(h, 0)) OVER o AS highs
  FROM (SELECT fl.window_end_us, fl.flow_id, fl.src_ip, fl.dst_ip, fl.first_seq, ds.sid, c, e, l, h FROM fl
        JOIN ds USING (src_ip, dst_ip, window_end_us)
        LEFT JOIN di ON di.src_ip = fl.src_ip AND di.dst_ip = fl.dst_ip AND di.sid = ds.sid AND di.window_end_us = fl.window_end_us AND di.first_seq = fl.first_seq
        WHERE protocol = 'UDP' AND (src_port = 53 OR dst_port = 53)) x
  WINDOW o AS (PARTITION BY src_ip, dst_ip, sid ORDER BY window_end_us, first_seq)),
dv AS (SELECT *, ents / names AS me, lens / names AS ml, highs / names AS hs FROM dr),
dns AS (
  SELECT window_end_us, flow_id, status, CAST(names AS BIGINT) AS names, me, ml, CAST(highs AS BIGINT) AS highs,
    CASE WHEN status = 'DETECTED' THEN least(1.0, sig / 3.0) END AS score,
    CASE WHEN status = 'DETECTED' THEN concat_ws(' and ',
      CASE WHEN me >= 3.8 THEN printf('High average domain entropy (%.2f)', me) END,
      CASE WHEN hs >= 0.5 THEN printf('High ratio of high-entropy domains (%d/%d)', CAST(highs AS BIGINT), CAST(names AS BIGINT)) END,
      CASE WHEN ml >= 20 THEN printf('Abnormal average domain length (%.1f chars)', ml) END) END AS reason
  FROM (SELECT *, (CASE WHEN me >= 3.8 THEN 1 ELSE 0 END) + (CASE WHEN hs >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN ml >= 20 THEN 1 ELSE 0 END) AS sig,
          CASE WHEN names < 15 THEN 'INSUFFICIENT_DATA'
               WHEN (CASE WHEN me >= 3.8 THEN 1 ELSE 0 END) + (CASE WHEN hs >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN ml >= 20 THEN 1 ELSE 0 END) >= 2 THEN 'DETECTED' END AS status
        FROM dv) y WHERE status IS NOT NULL)"""

TLS = """
te AS (SELECT *, lag(window_end_us) OVER (PARTITION BY flow_id ORDER BY window_end_us) AS pe FROM fl WHERE protocol = 'TCP' AND dst_port = 443),
ts AS (SELECT *, sum(CASE WHEN pe IS NULL OR window_end_us - pe > 3000000 THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY window_end_us) AS sid FROM te),
th AS (SELECT window_end_us, flow_id, bool_or(tls_client_hello) OVER o AS hello, bool_or(tls_has_sni) OVER o AS sni, count(*) OVER o AS windows_seen,
         max(fwd_byte_count) OVER o + max(rev_byte_count) OVER o AS total_bytes
       FROM ts WINDOW o AS (PARTITION BY flow_id, sid ORDER BY window_end_us)),
tls AS (SELECT window_end_us, flow_id, windows_seen, total_bytes, 0.85 AS confidence,
         concat_ws(' and ', 'Missing SNI in TLS ClientHello', printf('Suspicious TLS behavior (%d windows)', windows_seen)) AS reason
       FROM th WHERE hello AND NOT sni AND windows_seen >= 2)"""

RECON = """
recon AS (
  SELECT window_end_us, flow_id, unique_dst_ports, unique_dst_ips, 1.0 AS score,
    concat_ws(' and ', CASE WHEN ps THEN 'high destination-port fan-out (port scan)' END,
                       CASE WHEN sw THEN 'high destination-ip fan-out (subnet scan)' END) AS reason
  FROM (SELECT fl.window_end_us, fl.flow_id, fan.*, unique_dst_ports >= 15 AND unique_dst_ips <= 10 AS ps,
               unique_dst_ips >= 4 AND unique_dst_ports <= 5 AS sw
        FROM fl JOIN fan ON fan.window_end_us = fl.window_end_us AND fan.src_ip = fl.src_ip) x WHERE ps OR sw)"""

EXFIL = """
xw AS (SELECT *, lag(window_end_us) OVER (PARTITION BY src_ip, dst_ip ORDER BY window_end_us) AS pe FROM (
         SELECT DISTINCT src_ip, dst_ip, window_end_us FROM fl) x),
xs AS (SELECT src_ip, dst_ip, window_end_us, sum(CASE WHEN pe IS NULL OR window_end_us - pe > 3000000 THEN 1 ELSE 0 END)
         OVER (PARTITION BY src_ip, dst_ip ORDER BY window_end_us) AS sid FROM xw),
xh AS (SELECT window_end_us, flow_id, src_ip, dst_ip, max(fwd_byte_count) OVER o AS fwd, max(rev_byte_count) OVER o AS rev, count(*) OVER o AS n
       FROM fl JOIN xs USING (src_ip, dst_ip, window_end_us)
       WINDOW o AS (PARTITION BY src_ip, dst_ip, sid ORDER BY window_end_us, first_seq)),
exfil AS (
  SELECT window_end_us, flow_id, fwd, rev, fwd / greatest(rev, 1) AS ratio, n, least(1.0, fwd / 400 * 0.5 + 0.5) AS confidence,
    concat_ws(' and ', printf('High outbound volume (%d bytes)', fwd), printf('Highly asymmetric transfer (Out/In ratio: %.1f)', fwd / greatest(rev, 1)),
      printf('Sustained transfer (%d windows)', n)) AS reason
  FROM xh WHERE regexp_matches(src_ip, '^(10\\.|192\\.168\\.|172\\.)') AND NOT regexp_matches(dst_ip, '^(10\\.|192\\.168\\.|172\\.)')
    AND fwd >= 400 AND fwd / greatest(rev, 1) >= 2 AND n >= 2)"""

# The fold over verdicts is unrolled: a step for each detector, comparing one more.
PRIORITIES = {"DDOS": 100, "C2": 70, "DNS": 60, "TLS": 50, "RECON": 80, "EXFIL": 90}


def _verdicts(priorities: dict[str, int], extra: str) -> str:
    p = priorities
    return f"""
vd AS (
  SELECT window_end_us, flow_id, 1 AS pos, 'DDoSDetector' AS det, 'DDoS' AS threat, {p["DDOS"]} AS prio, confidence AS conf, CAST(NULL AS DOUBLE) AS sc FROM ddos
  UNION ALL SELECT window_end_us, flow_id, 2, 'C2BeaconingDetector', 'C2_BEACONING', {p["C2"]}, confidence, NULL FROM c2
  UNION ALL SELECT window_end_us, flow_id, 3, 'DNSTunnelDetector', 'DNS_DGA_TUNNEL', {p["DNS"]}, NULL, score FROM dns WHERE status = 'DETECTED'
  UNION ALL SELECT window_end_us, flow_id, 4, 'EncryptedMalwareDetector', 'ENCRYPTED_MALWARE', {p["TLS"]}, confidence, NULL FROM tls
  UNION ALL SELECT window_end_us, flow_id, 5, 'ReconnaissanceDetector', 'RECONNAISSANCE', {p["RECON"]}, NULL, score FROM recon
  UNION ALL SELECT window_end_us, flow_id, 6, 'ExfiltrationDetector', 'DATA_EXFILTRATION', {p["EXFIL"]}, confidence, NULL FROM exfil{extra}),
vn AS (SELECT *, coalesce(nullif(conf, 0), nullif(sc, 0), 0) AS val, row_number() OVER (PARTITION BY window_end_us, flow_id ORDER BY pos) AS i,
         count(*) OVER (PARTITION BY window_end_us, flow_id) AS cnt FROM vd),
s1 AS (SELECT window_end_us, flow_id, det, threat, prio, conf, sc, val, cnt,
         CASE WHEN cnt = 1 THEN 'only detector to fire' ELSE 'highest severity' END AS reason FROM vn WHERE i = 1)"""


def _step(n: int) -> str:
    prev, cur = f"s{n - 1}", f"s{n}"
    cls = f"(v.val IS NOT NULL AND abs(v.val - {prev}.val) <= 0.02 AND v.prio > {prev}.prio)"
    num = f"(v.val IS NOT NULL AND abs(v.val - {prev}.val) > 0.02 AND v.val > {prev}.val)"
    cols = ", ".join(f"CASE WHEN {cls} OR {num} THEN v.{c} ELSE {prev}.{c} END AS {c}" for c in ("det", "threat", "prio", "conf", "sc", "val"))
    return f"""
{cur} AS (SELECT {prev}.window_end_us, {prev}.flow_id, {cols}, {prev}.cnt,
  CASE WHEN {cls} THEN 'threat class priority ' || v.threat || ' > ' || {prev}.threat || ' (confidence tied)'
       WHEN {num} THEN printf('higher confidence %.2f vs %.2f', v.val, {prev}.val) ELSE {prev}.reason END AS reason
  FROM {prev} LEFT JOIN vn v ON v.window_end_us = {prev}.window_end_us AND v.flow_id = {prev}.flow_id AND v.i = {n})"""


def fused(priorities: dict[str, int] = PRIORITIES, extra: str = "", detectors: int = 6) -> str:
    """Results of all flow windows; ``extra`` adds verdicts of detectors after the sixth."""
    end = f"s{detectors}"
    return ",".join([_verdicts(priorities, extra), *[_step(n) for n in range(2, detectors + 1)]]) + f""",
fu AS MATERIALIZED (
  SELECT fl.window_end_us, fl.flow_id, CASE WHEN {end}.det IS NULL THEN 'BENIGN' ELSE 'DETECTED' END AS status,
    coalesce(threat, 'BENIGN') AS threat_type, CASE WHEN {end}.det IS NULL THEN NULL ELSE 'HIGH' END AS severity,
    CASE WHEN {end}.det IS NULL THEN 1.0 ELSE conf END AS confidence, sc AS score, coalesce(det, 'FusionEngine') AS detector_name,
    coalesce(reason, 'No detector fired') AS fusion_reason, coalesce(cnt, 0) AS detectors_fired
  FROM fl LEFT JOIN {end} ON {end}.window_end_us = fl.window_end_us AND {end}.flow_id = fl.flow_id),
al AS (SELECT window_end_us AS "timestamp", flow_id, threat_type AS threat_class, coalesce(confidence, score, 0) AS confidence, severity
       FROM fu WHERE status = 'DETECTED')"""


ALL_DETECTORS = ",".join([DDOS, BEACON, DNS, TLS, RECON, EXFIL])


def over(select: str, *parts: str) -> str:
    """A query over the packet view and the given building blocks."""
    return "WITH " + ",".join([PACKETS, *parts]) + "\n" + select


def over_flows(select: str, *parts: str, window: int = W, slide: int = S) -> str:
    return over(select, flows(window, slide), *parts)


def over_fused(select: str, **settings) -> str:
    return over_flows(select, ALL_DETECTORS, fused(**settings))
