"""One-pass sequential models the Spark operators are compared with."""

from collections import defaultdict

SERVICES = {
    21: ("FTP", 10, 30, 60), 22: ("SSH", 6, 30, 60), 23: ("Telnet", 8, 30, 60), 25: ("SMTP", 10, 60, 120),
    110: ("POP3", 8, 30, 60), 143: ("IMAP", 8, 30, 60), 3389: ("RDP", 5, 30, 120), 5900: ("VNC", 5, 30, 120),
    445: ("SMB", 8, 30, 120),
}
S = 1_000_000


def greedy(times, cooldown):
    kept, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= cooldown:
            kept.append(t)
            last = t
    return kept


def counting_stages(packets, indicators=frozenset()):
    """(event_id, name, severity) of SYN and login hits; packets are dicts in any order."""
    syn, syn_last, login, login_last, hits = defaultdict(list), {}, defaultdict(list), {}, []
    for p in sorted(packets, key=lambda p: (p["t_us"], p["event_id"])):
        if p["src_ip"] in indicators or p["dst_ip"] in indicators:
            continue
        if p["proto"] != "TCP" or "S" not in p["flags"] or "A" in p["flags"]:
            continue
        t, src = p["t_us"], p["src_ip"]
        syn[src] = [x for x in syn[src] if x >= t - 3 * S] + [t]
        if len(syn[src]) >= 30 and t - syn_last.get(src, -10**18) >= 10 * S:
            syn_last[src] = t
            hits.append((p["event_id"], "SYNFloodIndicator", 0.96))
            continue
        if p["dst_port"] not in SERVICES:
            continue
        service, need, window, cooldown = SERVICES[p["dst_port"]]
        key = (src, p["dst_port"])
        login[key] = [x for x in login[key] if x >= t - window * S] + [t]
        if len(login[key]) >= need and t - login_last.get(key, -10**18) >= cooldown * S:
            login_last[key] = t
            hits.append((p["event_id"], f"L7BruteForce_{service}", round(min(0.95 + 0.01 * (len(login[key]) - need), 0.99), 6)))
    return hits


def running_flows(packets, gap=120 * S):
    """event_id → (session start, frames, bytes)."""
    state, out = {}, {}
    for p in sorted(packets, key=lambda p: (p["t_us"], p["event_id"])):
        key = tuple(p[k] for k in ("src_ip", "dst_ip", "src_port", "dst_port", "proto"))
        start, last, frames, size = state.get(key, (p["t_us"], p["t_us"], 0, 0))
        if p["t_us"] - last > gap:
            start, frames, size = p["t_us"], 0, 0
        state[key] = (start, p["t_us"], frames + 1, size + p["packet_size"])
        out[p["event_id"]] = (start, frames + 1, size + p["packet_size"])
    return out
