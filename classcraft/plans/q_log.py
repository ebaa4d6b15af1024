"""Registered queries: prediction log and feedback.

``events`` stands in for the log (event_id → id, ts → created_at,
event_type → predicted label, props → inputs JSON, value → probability).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from classcraft.catalog import register
from classcraft.operators import drift as D
from classcraft.operators import score as SC
from classcraft.plans.q_metrics import PSI, _edges_sql, _long_sql, _shares_sql
from classcraft.plans.q_profile import scratch
from classcraft.plans.q_scoring import SCORED_SQL, fitted_scorer
from classcraft.sources import log as L
from classcraft.sources.tables import records, table

LOG_SQL = ("log AS (SELECT event_id AS id, ts AS created_at, 'v' || CAST(user_id % 3 + 1 AS VARCHAR) AS model_version, "
           "'event_type' AS target_column, props AS inputs, event_type AS predicted_label, least(value / 100.0, 1.0) AS probability FROM events)")
OUTCOMES_SQL = ("outcomes AS (SELECT event_id AS id, event_type AS actual_label, ts + INTERVAL 1 HOUR AS recorded_at FROM events "
                "WHERE event_type IN ('purchase', 'signup') UNION ALL SELECT event_id, 'view', ts + INTERVAL 2 HOUR FROM events WHERE event_type = 'purchase')")
LATEST_SQL = "latest AS (SELECT id, arg_max(actual_label, recorded_at) AS actual_label FROM outcomes GROUP BY id)"
WITH = f"WITH {LOG_SQL}, {OUTCOMES_SQL}, {LATEST_SQL} "


def _log(spark, sf):
    return L.events_as_log(table(spark, sf, "events"))


def _outcomes(spark, sf):
    return L.outcomes_from_events(table(spark, sf, "events"))


@register("s5_append_log", SCORED_SQL + (
    "SELECT CAST(record_id AS VARCHAR) AS reference, 'v1' AS model_version, 'outcome' AS target_column, 'batch' AS source, "
    "'batch-0001' AS batch_id, prediction AS predicted_label, probability, score, projects, department FROM out"))
def s5_append_log(spark, sf):
    """A scored table appended to a fresh log (partitioned by version) and read back."""
    path = scratch(spark, "log")
    scored = SC.score_frame(records(spark, sf), fitted_scorer(spark, sf))
    entries = L.log_entries(scored, ["score", "projects", "department"], ["approved", "rejected"], "v1", "outcome",
                            "batch-0001", reference="record_id", created_at="2024-01-01 00:00:00")
    L.append_log(entries, path)
    back = L.read_log(spark, path)
    return back.select("reference", "model_version", "target_column", "source", "batch_id", "predicted_label", "probability",
                       F.get_json_object("inputs", "$.score").cast("double").alias("score"),
                       F.get_json_object("inputs", "$.projects").cast("int").alias("projects"),
                       F.get_json_object("inputs", "$.department").alias("department"))


TWO_BATCHES = SCORED_SQL + (
    ", two AS (SELECT 'b1' AS batch_id, TIMESTAMP '2024-01-01 00:00:00' AS created_at, * FROM out UNION ALL "
    "SELECT 'b2', TIMESTAMP '2024-01-02 00:00:00', * FROM out WHERE training = 'Yes') ")


def two_appends(spark, sf):
    """A log of two appended batches, and outcomes for every third record of the second batch."""
    path = scratch(spark, "log")
    scored = SC.score_frame(records(spark, sf), fitted_scorer(spark, sf))
    for batch, day, rows in (("b1", "2024-01-01", scored), ("b2", "2024-01-02", scored.where(F.col("training") == "Yes"))):
        L.append_log(L.log_entries(rows, ["score"], ["approved", "rejected"], "v1", "outcome", batch, reference="record_id",
                                   created_at=f"{day} 00:00:00"), path)
    log = L.read_log(spark, path)
    outcomes = log.where((F.col("batch_id") == "b2") & (F.col("reference").cast("long") % 3 == 0)).select(
        "id", F.lit("approved").alias("actual_label"), F.col("created_at").alias("recorded_at"))
    return log, outcomes


@register("s5_two_appends", TWO_BATCHES + (
    "SELECT batch_id, CAST(record_id AS VARCHAR) AS reference, CASE WHEN batch_id = 'b2' AND record_id % 3 = 0 THEN 'approved' END AS actual_label, "
    "(SELECT count(*) FROM two) AS n_ids FROM two"))
def s5_two_appends(spark, sf):
    """Ids are distinct across appends, so an outcome attaches to one prediction."""
    log, outcomes = two_appends(spark, sf)
    ids = log.agg(F.count_distinct("id").alias("n")).first()["n"]
    return L.with_outcomes(log, outcomes).select("batch_id", "reference", "actual_label", F.lit(ids).cast("bigint").alias("n_ids"))


@register("s5_idempotent_append", SCORED_SQL + (
    "SELECT batch_id, CAST(record_id AS VARCHAR) AS reference, probability FROM (SELECT '0001' AS batch_id, * FROM out UNION ALL SELECT '0002', * FROM out WHERE training = 'Yes')"))
def s5_idempotent_append(spark, sf):
    """A batch that is written again after a retry is there once; another batch stays."""
    path = scratch(spark, "log")
    scored = SC.score_frame(records(spark, sf), fitted_scorer(spark, sf))
    for batch, rows in (("0001", scored), ("0002", scored.where(F.col("training") == "Yes")), ("0001", scored)):
        L.append_log(L.log_entries(rows, ["score"], ["approved", "rejected"], "v1", "outcome", batch, reference="record_id", created_at="2024-01-01 00:00:00"), path)
    return L.read_log(spark, path).select("batch_id", "reference", "probability")


@register("s6_recent_batches", TWO_BATCHES + "SELECT batch_id, count(*) AS n FROM (SELECT batch_id FROM two ORDER BY created_at DESC LIMIT "
          "(SELECT CAST(count(*) AS BIGINT) FROM out WHERE training = 'Yes')) GROUP BY 1")
def s6_recent_batches(spark, sf):
    """The newest rows are those of the last batch."""
    log, _ = two_appends(spark, sf)
    n = log.where(F.col("batch_id") == "b2").count()
    return L.recent(log, n).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@register("s6_recent", WITH + "SELECT id, predicted_label, probability FROM log WHERE model_version = 'v2' ORDER BY created_at DESC, id DESC LIMIT 200")
def s6_recent(spark, sf):
    return L.recent(_log(spark, sf), 200, "v2").select("id", "predicted_label", "probability")


@register("f6_awaiting_outcome", WITH + "SELECT id, predicted_label FROM log WHERE id NOT IN (SELECT id FROM latest)")
def f6_awaiting_outcome(spark, sf):
    return L.awaiting_outcome(_log(spark, sf), _outcomes(spark, sf)).select("id", "predicted_label")


@register("h1_expand_inputs", WITH + "SELECT id, model_version, predicted_label, json_extract_string(inputs, '$.k') AS k FROM log")
def h1_expand_inputs(spark, sf):
    return L.expanded(_log(spark, sf), ["k"]).select("id", "model_version", "predicted_label", "k")


# Inputs as models of different age log them: numbers and texts under one name, objects in objects, a list, broken and absent JSON.
MIXED_INPUTS = ("CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('{\"k\":\"n', CAST(event_id AS STRING), '\",\"place\":{\"x\":', CAST(user_id AS STRING), '.25,\"on\":true}}') "
                "WHEN 2 THEN '{\"k\": 1' WHEN 3 THEN concat('{\"place\":{\"x\":', CAST(user_id AS STRING), ',\"city\":{\"name\":\"c', CAST(user_id % 7 AS STRING), '\"}},\"id\":', "
                "CAST(event_id AS STRING), ',\"list\":[1,', CAST(user_id AS STRING), ']}') ELSE NULL END")
MIXED_SQL = (f"WITH raw AS (SELECT *, {MIXED_INPUTS} AS raw_inputs FROM events), "
             "log AS (SELECT event_id AS id, event_type, ts, CASE WHEN json_valid(raw_inputs) THEN raw_inputs END AS inputs FROM raw) ")


def mixed_log(spark, sf):
    events = table(spark, sf, "events")
    return L.events_as_log(events).drop("inputs").join(events.select(F.col("event_id").alias("id"), F.expr(MIXED_INPUTS).alias("inputs")), "id")


@register("h1_discovered_inputs", MIXED_SQL + (
    "SELECT id, json_extract_string(inputs, '$.k') AS k, CAST(json_extract_string(inputs, '$.place.x') AS DOUBLE) AS x, "
    "CAST(json_extract_string(inputs, '$.place.on') AS BOOLEAN) AS is_on, json_extract_string(inputs, '$.place.city.name') AS city, "
    "CAST(json_extract_string(inputs, '$.id') AS BIGINT) AS input_id, json_extract_string(inputs, '$.list') AS list FROM log"))
def h1_discovered_inputs(spark, sf):
    """H1: fields and types come from the log itself, nested ones by path, those of mixed kinds as text."""
    out = L.expanded(mixed_log(spark, sf))
    return out.select("id", "k", F.col("`place.x`").alias("x"), F.col("`place.on`").alias("is_on"), F.col("`place.city.name`").alias("city"),
                      F.col("`inputs.id`").alias("input_id"), "list")


@register("h3_discovered_rows", MIXED_SQL + (
    ", outcomes AS (SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'view' ELSE event_type END AS event_type FROM events WHERE event_type IN ('purchase', 'signup')) "
    "SELECT json_extract_string(inputs, '$.k') AS k, CAST(json_extract_string(inputs, '$.place.x') AS DOUBLE) AS x, o.event_type FROM log JOIN outcomes o USING (id)"))
def h3_discovered_rows(spark, sf):
    """H3: confirmed outcomes as training rows whose input columns nobody named."""
    rows = L.labelled_for_target(mixed_log(spark, sf), _outcomes(spark, sf), None, "event_type")
    return rows.select("k", F.col("`place.x`").alias("x"), "event_type")


@register("h2_record_actual", WITH + "SELECT id, actual_label FROM latest")
def h2_record_actual(spark, sf):
    return L.latest_outcomes(_outcomes(spark, sf))


@register("h3_labelled_rows", WITH + "SELECT json_extract_string(inputs, '$.k') AS k, actual_label AS event_type FROM log JOIN latest USING (id) WHERE target_column = 'event_type'")
def h3_labelled_rows(spark, sf):
    return L.labelled_for_target(_log(spark, sf), _outcomes(spark, sf), ["k"], "event_type")


@register("h4_summary", WITH + "SELECT count(*) AS total, count(actual_label) AS labelled, max(created_at) AS last FROM log LEFT JOIN latest USING (id)")
def h4_summary(spark, sf):
    return L.summary(_log(spark, sf), _outcomes(spark, sf))


@register("h4_by_version", WITH + "SELECT model_version, count(*) AS n FROM log GROUP BY 1")
def h4_by_version(spark, sf):
    return L.counts_by(_log(spark, sf), "model_version")


@register("h4_by_label", WITH + "SELECT predicted_label, count(*) AS n FROM log GROUP BY 1")
def h4_by_label(spark, sf):
    return L.counts_by(_log(spark, sf), "predicted_label")


@register("h5_append_feedback", WITH + (
    "SELECT CAST(json_extract_string(inputs, '$.k') AS BIGINT) AS k, predicted_label AS event_type, 'log' AS origin FROM log "
    "UNION ALL SELECT CAST(json_extract_string(inputs, '$.k') AS BIGINT), actual_label, NULL FROM log JOIN latest USING (id)"))
def h5_append_feedback(spark, sf):
    log = _log(spark, sf)
    train = L.expanded(log, ["k"]).select(F.col("k").cast("bigint").alias("k"), F.col("predicted_label").alias("event_type"),
                                          F.lit("log").alias("origin"))
    lab = L.labelled_for_target(log, _outcomes(spark, sf), ["k"], "event_type")
    return L.append_feedback(train, lab)


H6_SRC = f"WITH {LOG_SQL}, base AS (SELECT CAST(json_extract_string(inputs, '$.k') AS DOUBLE) AS k FROM log), " \
         "rec AS (SELECT CAST(json_extract_string(inputs, '$.k') AS DOUBLE) AS k FROM log WHERE model_version = 'v1'), "


@register("h6_log_drift", H6_SRC + (
    f"ed AS ({_edges_sql('base', ['k'])}), lb AS ({_long_sql('base', ['k'])}), sh AS {_shares_sql('lb', 'ed')}, "
    "st AS (SELECT \"column\", list_transform(edges, lambda e: round(e, 6)) AS edges FROM ed), "
    f"lr AS ({_long_sql('rec', ['k'])}), sr AS {_shares_sql('lr', 'st')}, "
    "psi AS (SELECT sh.\"column\", sum(" + PSI.format(n="sr.share", b="round(sh.share, 6)") + ") AS psi FROM sh JOIN sr USING (\"column\", bin) GROUP BY 1) "
    "SELECT \"column\", round(psi, 4) AS psi, CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.10 THEN 'watch' ELSE 'ok' END AS status, "
    "CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.10 THEN 'watch' ELSE 'ok' END AS overall, (SELECT count(*) FROM rec) AS n_recent FROM psi"))
def h6_log_drift(spark, sf):
    """H6: the active version's logged inputs against the baseline of all logged inputs."""
    log = L.expanded(_log(spark, sf), ["k"]).withColumn("k", F.col("k").cast("double"))
    base = D.numeric_baseline(log, ["k"])
    recent = log.where(F.col("model_version") == "v1")
    return D.drift_report(recent, base, None)
