"""Plain-Python reference results for small packet streams, from the written rules."""

from __future__ import annotations

from statistics import mean, stdev


def accepted(packets, window):
    """Packets not older than the running maximum by more than the window, in arrival order."""
    newest, out = None, []
    for p in packets:
        if newest is not None and p["ts_us"] < newest - window:
            continue
        out.append(p)
        newest = p["ts_us"] if newest is None else max(newest, p["ts_us"])
    return out


def windows(packets, window, slide):
    """(end, packets known when it closed, all on-time packets in it), in order of closing."""
    kept, emitted, end = accepted(packets, window), [], None
    for i, p in enumerate(kept):
        t = p["ts_us"]
        if end is None:
            end = t
        elif t > end + 2 * window:
            end = t - window
        while t >= end + slide:
            end += slide
            emitted.append((end, i))
    out = []
    for e, i in emitted:
        whole = [p for p in kept if e - window <= p["ts_us"] <= e]
        out.append((e, [p for p in kept[: i + 1] if e - window <= p["ts_us"] <= e], whole))
    return out


def flows(packets):
    """Flow rows of one window, keyed by flow id."""
    found = {}
    for p in packets:
        if p["protocol"] not in ("TCP", "UDP") or None in (p["src_ip"], p["dst_ip"], p["src_port"], p["dst_port"]):
            continue
        ends = sorted([(p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])])
        found.setdefault((*ends, p["protocol"]), []).append(p)
    out = {}
    for ps in found.values():
        head, rest = ps[0], ps[1:]
        fwd = [p for p in ps if (p["src_ip"], p["src_port"]) == (head["src_ip"], head["src_port"])]
        gaps = [(b["ts_us"] - a["ts_us"]) / 1e6 for a, b in zip(ps, rest) if a["ts_us"] > 0 and b["ts_us"] >= a["ts_us"]]
        name = f"{head['src_ip']}:{head['src_port']}-{head['dst_ip']}:{head['dst_port']}-{head['protocol']}"
        out[name] = {
            "first_seq": head["seq"],
            "first_seen_us": min(p["ts_us"] for p in ps),
            "last_seen_us": max(p["ts_us"] for p in ps),
            "packet_count": len(ps),
            "byte_count": sum(p["length"] for p in ps),
            "fwd_packet_count": len(fwd),
            "fwd_byte_count": sum(p["length"] for p in fwd),
            "iat_count": len(gaps),
            "iat_mean": round(mean(gaps), 7) if gaps else 0.0,
            "iat_std": round(stdev(gaps), 7) if len(gaps) > 1 else None,
            "dns_query_count": sum(1 for p in rest if p["dns_query_name"]),
            "tls_client_hello": any(p["tls_is_client_hello"] for p in rest),
            "tls_has_sni": any(p["tls_is_client_hello"] and p["tls_sni"] for p in rest),
        }
    return out
