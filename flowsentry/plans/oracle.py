"""DuckDB fragments: the independent SQL statement of every view the catalogue queries are checked against."""

from __future__ import annotations

PACKETS = """packets as (
select event_id as event_id,
 (us // 43200000000) * 50000000 + (us % 43200000000) // 20000 as t_us,
 case when user_id % 10 < 6 then '10.0.0.1' else '10.0.0.' || cast(10 + user_id % 4 as varchar) end as src_ip,
 '192.168.1.' || cast(k % 5 as varchar) as dst_ip,
 cast(1024 + user_id % 4 as integer) as src_port,
 case k % 12 when 0 then 21 when 1 then 22 when 2 then 23 when 3 then 25 when 4 then 110 when 5 then 143
   when 6 then 445 when 7 then 3389 when 8 then 5900 when 9 then 80 when 10 then 443 else 53 end as dst_port,
 case event_type when 'view' then 'UDP' when 'purchase' then 'OTHER' else 'TCP' end as proto,
 case event_type when 'click' then 'S' when 'error' then 'S' when 'signup' then 'SA' else '' end as flags,
 40 + cast(floor(value * 10) as bigint) as packet_size
from (select *, epoch_us(ts) - 1704067200000000 as us, cast(json_extract_string(props, '$.k') as integer) as k from events))"""

FEATURES = """gaps as (select *, case when t_us - lag(t_us) over (partition by src_ip, dst_ip, src_port, dst_port, proto
     order by t_us, event_id) > 120000000 then 1 else 0 end as cut from packets),
sessions as (select *, sum(cut) over (partition by src_ip, dst_ip, src_port, dst_port, proto order by t_us, event_id
     rows unbounded preceding) as session_no from gaps),
totals as (select *, min(t_us) over w as session_start_us, cast(count(*) over w as double) as total_frames,
     cast(sum(packet_size) over w as double) as total_bytes
   from sessions window w as (partition by src_ip, dst_ip, src_port, dst_port, proto, session_no
     order by t_us, event_id rows unbounded preceding)),
durations as (select *, greatest((t_us - session_start_us) / 1000000.0::double, 0.001::double) as duration from totals),
features as (select *, total_bytes / total_frames as avg_pkt_size, total_frames / duration as pkts_per_sec,
     total_bytes / duration as bytes_per_sec,
     case proto when 'ICMP' then 1 when 'TCP' then 6 when 'UDP' then 17 else 0 end as protocol_num,
     case flags when 'S' then 2 when 'SA' then 18 else 0 end as flags_mask from durations),
scored as (select *, least(case when dst_port in (21, 22, 23, 445, 3389) then 0.35::double else 0::double end
     + case when total_bytes > 1200 then 0.2::double else 0::double end
     + case when flags_mask in (2, 18) then 0.2::double else 0::double end
     + case when protocol_num = 0 then 0.15::double else 0::double end, 0.99::double) as ml from features)"""

SERVICES = """services(dst_port, service, attempts, window_us, cooldown_us) as (values
 (21, 'FTP', 10, 30000000, 60000000), (22, 'SSH', 6, 30000000, 60000000), (23, 'Telnet', 8, 30000000, 60000000),
 (25, 'SMTP', 10, 60000000, 120000000), (110, 'POP3', 8, 30000000, 60000000), (143, 'IMAP', 8, 30000000, 60000000),
 (3389, 'RDP', 5, 30000000, 120000000), (5900, 'VNC', 5, 30000000, 120000000), (445, 'SMB', 8, 30000000, 120000000))"""

SYN = """flagged as (select *, src_ip = '10.0.0.13' or dst_ip = '10.0.0.13' as ioc from packets),
syn_rows as (select * from flagged where not ioc and proto = 'TCP' and flags = 'S'),
syn_cand as (select * from (select *, lag(t_us, 29) over (partition by src_ip order by t_us, event_id) as back
   from syn_rows) where t_us - back <= 3000000),
syn_times as (
 select src_ip, min(t_us) as t_us from syn_cand group by src_ip
 union all
 select k.src_ip, min(c.t_us) from syn_times k join syn_cand c on c.src_ip = k.src_ip and c.t_us >= k.t_us + 10000000
 group by k.src_ip),
syn_hits as (select c.src_ip, c.t_us, min(c.event_id) as event_id from syn_cand c join syn_times using (src_ip, t_us)
   group by all)"""

LOGIN = """login_rows as (select r.*, service, attempts, window_us, cooldown_us from syn_rows r join services using (dst_port)
   where event_id not in (select event_id from syn_hits)),
login_ranked as (select *, row_number() over (partition by src_ip, dst_port order by t_us, event_id) as rn from login_rows),
login_counted as (select a.src_ip, a.dst_port, a.t_us, a.event_id, a.service, a.attempts, a.cooldown_us,
     count(*) as seen from login_ranked a join login_ranked b
   on a.src_ip = b.src_ip and a.dst_port = b.dst_port and b.rn <= a.rn and a.t_us - b.t_us <= a.window_us
   group by all),
login_cand as (select *, least(0.95::double + 0.01::double * least(seen - attempts, 4), 0.99::double) as severity
   from login_counted where seen >= attempts),
login_times as (
 select src_ip, dst_port, cooldown_us, min(t_us) as t_us from login_cand group by all
 union all
 select k.src_ip, k.dst_port, k.cooldown_us, min(c.t_us) from login_times k join login_cand c
  on c.src_ip = k.src_ip and c.dst_port = k.dst_port and c.t_us >= k.t_us + k.cooldown_us group by all),
login_hits as (select c.src_ip, c.dst_port, c.t_us, min(c.event_id) as event_id,
    arg_min(c.severity, c.event_id) as severity, 'L7BruteForce_' || min(c.service) as name
   from login_cand c join login_times using (src_ip, dst_port, t_us) group by c.src_ip, c.dst_port, c.t_us)"""

REGION_RULES = """rules as (
 select 0 as tier, 0 as line, 'KnownMaliciousSSH' as name, '10.10.10.66' as r_src, 22 as r_port, null as r_proto,
   0.95::double as severity, null::varchar as sid, 'builtin' as engine
 union all select 0, 1, 'TelnetBruteforcePattern', null, 23, 'TCP', 0.95::double, null, 'builtin'
 union all select 0, 2, 'HighRiskRDP', null, 3389, 'TCP', 0.85::double, null, 'builtin'
 union all select 1, r_regionkey, r_name || ' lookup', '10.0.0.' || cast(10 + r_regionkey as varchar), 53, 'UDP',
   0.98::double, cast(70000 + r_regionkey as varchar), 'snort' from region)"""

RULE_HITS = """rule_hits as (select event_id, name, severity, sid, engine from (
  select p.event_id, r.*, row_number() over (partition by p.event_id order by r.tier, r.line) as place
  from packets p join rules r on (r.r_src is null or r.r_src = p.src_ip) and (r.r_port is null or r.r_port = p.dst_port)
    and (r.r_proto is null or r.r_proto = p.proto)) where place = 1)"""

ALERTS = """matched as (select s.*, case when s.src_ip = '10.0.0.13' or s.dst_ip = '10.0.0.13' then 'ThreatIntel_IPv4_IOC'
     when y.event_id is not null then 'SYNFloodIndicator' when l.event_id is not null then l.name else r.name end as sig_name,
   case when s.src_ip = '10.0.0.13' or s.dst_ip = '10.0.0.13' then 0.99::double when y.event_id is not null then 0.96::double
     when l.event_id is not null then l.severity else r.severity end as sig_severity,
   case when s.src_ip = '10.0.0.13' or s.dst_ip = '10.0.0.13' then 'otx'
     when y.event_id is not null or l.event_id is not null then 'builtin' else r.engine end as sig_engine,
   case when s.src_ip = '10.0.0.13' or s.dst_ip = '10.0.0.13' or y.event_id is not null or l.event_id is not null
     then null else r.sid end as sig_sid
  from scored s left join syn_hits y on y.event_id = s.event_id left join login_hits l on l.event_id = s.event_id
   left join rule_hits r on r.event_id = s.event_id),
labelled as (select *, case when sig_name is not null then 'signature:' || sig_name else 'xgboost_anomaly' end as type,
   sig_name like '%L7BruteForce%' and ml >= 0.75::double as confirmed
  from matched where sig_name is not null or ml >= 0.75::double),
hashed as (select *, md5(concat_ws('|', event_id, t_us, src_ip, dst_ip, type)) as h from labelled),
alerts as (select event_id, t_us, src_ip, dst_ip, src_port, dst_port, proto as protocol, type,
   h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] as id,
   round(case when confirmed then round(least((sig_severity + ml) / 2 + 0.05::double, 0.99::double), 4)
     when sig_name is not null then sig_severity else ml end, 4) as score,
   coalesce(sig_engine, 'ml') as source, sig_sid as sid,
   case when sig_name is not null then round(ml, 4) end as ml_score, case when confirmed then true end as hybrid_confirmed,
   total_frames, total_bytes, duration, avg_pkt_size, pkts_per_sec, bytes_per_sec, cast(protocol_num as double) as protocol_code
  from hashed)"""


def chain(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


WITH_PACKETS = chain(PACKETS)
WITH_FEATURES = chain(PACKETS, FEATURES)
WITH_SYN = chain(PACKETS, SERVICES, SYN)
WITH_LOGIN = chain(PACKETS, SERVICES, SYN, LOGIN)
WITH_ALERTS = chain(PACKETS, FEATURES, SERVICES, SYN, LOGIN, REGION_RULES, RULE_HITS, ALERTS)

SEVERITY = (
    "case when {x} >= 0.95::double then 'CRITICAL' when {x} >= 0.8::double then 'HIGH' "
    "when {x} >= 0.55::double then 'MEDIUM' else 'LOW' end"
)


def severity(x: str) -> str:
    return SEVERITY.format(x=x)
