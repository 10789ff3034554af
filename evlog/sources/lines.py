"""Raw log lines rendered from the ``events`` table.

The same SQL text runs in Spark and in other engines and yields the same lines;
the structured columns beside ``raw`` are what a correct extraction must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BATCH_SIZE = 4096

_COLUMNS = """
SELECT event_id, ts, user_id, event_type, props, event_id % 14 AS kind,
  '10.' || cast(user_id % 256 as string) || '.' || cast(cast(floor(event_id / 256) as bigint) % 256 as string)
    || '.' || cast(event_id % 256 as string) AS src_ip,
  cast(1024 + event_id % 60000 as string) AS src_port,
  '192.168.' || cast(user_id % 256 as string) || '.' || cast((event_id * 7) % 256 as string) AS dst_ip,
  CASE user_id % 4 WHEN 0 THEN '22' WHEN 1 THEN '53' WHEN 2 THEN '443' ELSE '8080' END AS dst_port,
  CASE user_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS proto,
  CASE event_type WHEN 'signup' THEN 'ALLOW' WHEN 'click' THEN 'PERMIT' WHEN 'view' THEN 'ALERT'
    WHEN 'error' THEN 'DENY' ELSE 'DROP' END AS act,
  cast(event_id % 97 as string) AS policy,
  lpad(cast(hour(ts) as string), 2, '0') || ':' || lpad(cast(minute(ts) as string), 2, '0') || ':'
    || lpad(cast(second(ts) as string), 2, '0') AS hms
FROM {events}"""

_LINE = """CASE kind
  WHEN 0 THEN 'LOCK-4|' || act || '|' || proto || '|' || src_ip || '|' || src_port || '|' || dst_ip || '|' || dst_port
    || '|P' || policy
  WHEN 1 THEN 'CEF:0|Norwind|Gatepost|4.2|' || policy || '|Sweep of many ports|7|src=' || src_ip || ' spt=' || src_port
    || ' dst=' || dst_ip || ' dpt=' || dst_port || ' proto=' || proto || ' act=' || act || ' cs1=P-' || policy
    || ' cs1Label=Rule name'
  WHEN 2 THEN 'LEEF:2.0|Halyard|Seawall|30.1|' || policy || '|src=' || src_ip || chr(9) || 'dst=' || dst_ip
    || chr(9) || 'proto=' || lower(proto) || chr(9) || 'usrName=u' || user_id || chr(9) || 'sev=5'
  WHEN 3 THEN '<' || cast(event_id % 192 as string) || '>Jan ' || lpad(cast(day(ts) as string), 2, ' ') || ' ' || hms
    || ' quay' || user_id || ' tidegate: action=' || act || ' src=' || src_ip || ' spt=' || src_port || ' dst='
    || dst_ip || ' dpt=' || dst_port || ' proto=' || proto || ' policy=P-' || policy
  WHEN 4 THEN '{"timestamp":"2024-01-01T' || hms || 'Z","vendor":"Osier","product":"Reedbed","src_ip":"' || src_ip
    || '","src_port":' || src_port || ',"dst_ip":"' || dst_ip || '","dst_port":' || dst_port || ',"proto":"'
    || lower(proto) || '","action":"' || act || '","policy_id":"P-' || policy || '","severity":"High","user":"u'
    || user_id || '","custom":' || props || '}'
  WHEN 5 THEN '<Alarm><timestamp>2024-01-01T' || hms || 'Z</timestamp><src>' || src_ip || '</src><dst>' || dst_ip
    || '</dst><proto>' || lower(proto) || '</proto><action>' || act || '</action><note>n' || policy
    || '</note></Alarm>'
  WHEN 6 THEN 'Jan ' || lpad(cast(day(ts) as string), 2, ' ') || ' ' || hms || ' quay' || user_id
    || ' CEF:0|Marram|Dune|2|' || policy || '|Probe|5|src=' || src_ip
  WHEN 7 THEN 'LOCK-9|' || act || '|' || proto || '|300.' || user_id || '.9.2|70000|' || dst_ip || '|99999|P' || policy
  WHEN 8 THEN '<134>1 2024-01-01T' || hms || 'Z pier mooring ' || policy || ' - - src=' || src_ip
  WHEN 10 THEN 'LEEF:3.0 Halyard ' || policy || ' src=' || src_ip
  WHEN 11 THEN 'relay' || user_id || ' LEEF:1.0|Halyard|Seawall|30.1|' || policy || '|src=' || src_ip
  WHEN 12 THEN 'CEF:draft|Norwind|Gatepost|4.2|' || policy || '|src=' || src_ip
  WHEN 13 THEN 'Jan ' || lpad(cast(day(ts) as string), 2, ' ') || ' ' || hms || ' quay' || user_id || ' ' || policy
  ELSE 'free text line ' || event_type || ' ' || src_ip END"""


def lines_sql(events: str = "events") -> str:
    """SELECT giving batch_id, pos, raw and the columns each line was rendered from."""
    columns = _COLUMNS.replace("{events}", events)
    return (
        f"SELECT event_id, user_id, event_type, props, kind, src_ip, src_port, dst_ip, dst_port, proto, act, policy, hms,\n"
        f" 'b' || cast(cast(floor(event_id / {BATCH_SIZE}) as bigint) as string) AS batch_id,\n"
        f" event_id % {BATCH_SIZE} AS pos, lpad(cast(day(ts) as string), 2, ' ') AS dom,\n"
        f" {_LINE} AS raw\nFROM ({columns}) rendered"
    )


def read_table(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, *columns)


def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    events.createOrReplaceTempView("evlog_events")
    return spark.sql(lines_sql("evlog_events"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table of raw events: batch_id, pos, raw."""
    return rendered_lines(spark, sf_dir).select("batch_id", "pos", "raw")
