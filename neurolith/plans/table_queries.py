"""Queries on metadata tables and event streams, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurolith.operators import epochs as ep
from neurolith.operators import tables as tb
from neurolith.plans.signal_queries import snap, snap_sql
from neurolith.session import table
from neurolith.streaming import windows as sw


def newest_datasets(spark, d):
    return tb.newest(table(spark, d, "kb_documents").select("document_id", "title", "updated_at"), 20, "updated_at", "document_id")


def dashboard(spark, d):
    counts = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in ("recordings", "experiments", "kb_documents", "candidates")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def settings_overlay(spark, d):
    """Devices' units as defaults, overlaid by models that are not blank."""
    v = table(spark, d, "devices")
    stored = v.select("device_id", F.when(F.col("device_id") > "dev-040", F.col("model")).otherwise(F.lit(" ")).alias("unit"))
    return tb.overlay(v.select("device_id", "unit"), stored, "device_id", "unit")


def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return tb.latest(e, ["user_id", "event_type"], F.desc("event_id")).select("user_id", "event_type", "event_id", snap(F.col("value")).alias("value"))


def event_state(spark, d):
    """Last known value of each kind of event by user: the fold of an event log."""
    e = table(spark, d, "events")
    log = e.select("user_id", "event_id", *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("click", "error", "purchase", "view")])
    s = tb.last_known(log, ["user_id"], "event_id", ["click", "error", "purchase", "view"])
    return s.select("user_id", *[snap(F.col(k)).alias(k) for k in ("click", "error", "purchase", "view")])


def since_last_error(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return tb.since_last(e, ["user_id"], "event_id", F.col("event_type") == "error")


def json_payload_filter(spark, d):
    return table(spark, d, "events").filter(tb.json_equals(F.col("props"), "$.k", "42")).select("event_id", "user_id")


def dataset_delete_nulls(spark, d):
    x = table(spark, d, "experiments").select("experiment_id", "dataset_id")
    gone = table(spark, d, "recordings").filter("site = 'north'").select("dataset_id").filter("dataset_id is not null")
    return tb.with_nulled(x, gone, "dataset_id")


def recent_values(spark, d):
    """The last five events of a user as text."""
    e = tb.last_values(table(spark, d, "events"), ["user_id"], "event_id", 5)
    return e.select("user_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("last_ids"))


def hopping_event_counts(spark, d):
    w = sw.hopping_counts(table(spark, d, "events"), "ts", ["event_type"])
    return w.select("window_start", "event_type", "n", snap(F.col("total"), 4).alias("total"))


def event_sessions(spark, d):
    return sw.sessions(table(spark, d, "events"), "ts", ["user_id"], "6 hours").select("user_id", "session_start", "n")


def csv_event_codes(spark, d):
    """Codes of the labels of an event table: their rank in alphabetical order from 0, blank ones as \"0\"."""
    e = table(spark, d, "events").select("event_id", F.coalesce(F.when(F.trim("event_type") != "", F.trim("event_type")), F.lit("0")).alias("label"))
    labels = e.select("label").distinct().agg(F.array_sort(F.collect_set("label")).alias("ls"))
    codes = labels.select(F.posexplode("ls").alias("code", "label"))
    return e.join(codes, "label").select("event_id", "label", "code")


def numeric_coercion(spark, d):
    """Cells as numbers, 0 where they are none; the share of numeric ones."""
    cell = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return table(spark, d, "events").select("event_id", F.coalesce(cell.try_cast("double"), F.lit(0.0)).alias("v"))


def recordings_by_site(spark, d):
    h = ep.headers(table(spark, d, "recordings"))
    return h.rollup("site", "source_format").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


SQL = {
    "newest_datasets": "SELECT document_id, title, updated_at FROM kb_documents ORDER BY updated_at DESC NULLS LAST, document_id DESC LIMIT 20",
    "dashboard": "SELECT 'recordings' AS name, count(*) AS n FROM recordings UNION ALL SELECT 'experiments', count(*) FROM experiments UNION ALL SELECT 'kb_documents', count(*) FROM kb_documents UNION ALL SELECT 'candidates', count(*) FROM candidates",
    "settings_overlay": "SELECT device_id, CASE WHEN device_id > 'dev-040' AND trim(model) <> '' THEN model ELSE unit END AS unit FROM devices",
    "upsert_latest": f"SELECT user_id, event_type, event_id, {snap_sql('value')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
    "event_state": "SELECT user_id, " + ", ".join(f"{snap_sql(f'arg_max(value, event_id) FILTER (event_type = {chr(39)}{k}{chr(39)} AND value IS NOT NULL)')} AS \"{k}\"" for k in ("click", "error", "purchase", "view")) + " FROM events GROUP BY user_id",
    "since_last_error": "WITH m AS (SELECT user_id, max(event_id) AS f FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, event_id, event_type FROM events LEFT JOIN m USING (user_id) WHERE f IS NULL OR event_id >= f",
    "json_payload_filter": "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '42'",
    "dataset_delete_nulls": "SELECT experiment_id, CASE WHEN dataset_id IN (SELECT dataset_id FROM recordings WHERE site = 'north' AND dataset_id IS NOT NULL) THEN NULL ELSE dataset_id END AS dataset_id FROM experiments",
    "recent_values": "SELECT user_id, array_to_string(list_reverse(list_reverse_sort(list(event_id))[1:5]), ',') AS last_ids FROM events GROUP BY user_id",
    "hopping_event_counts": f"""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events)
        SELECT window_start, event_type, count(*) AS n, {snap_sql('sum(value)', 4)} AS total FROM w GROUP BY ALL""",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s""",
    "csv_event_codes": "WITH e AS (SELECT event_id, coalesce(nullif(trim(event_type), ''), '0') AS label FROM events) SELECT event_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM e",
    "numeric_coercion": "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS v FROM events",
    "recordings_by_site": "WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY uploaded_at DESC, source_path DESC) AS rn FROM recordings) WHERE rn = 1) SELECT site, source_format, count(*) AS n, CAST(grouping(site, source_format) AS INTEGER) AS level FROM h GROUP BY ROLLUP (site, source_format)",
}

QUERIES = {
    f.__name__: f
    for f in (
        newest_datasets, dashboard, settings_overlay, upsert_latest, event_state, since_last_error, json_payload_filter, dataset_delete_nulls, recent_values,
        hopping_event_counts, event_sessions, csv_event_codes, numeric_coercion, recordings_by_site,
    )
}
