"""The prediction log and outcome feedback.

The log is a Parquet table partitioned by ``model_version`` and ``batch_id``
(partition pruning replaces the reference's index on that column). A batch is
one folder and is written as a whole, so writing it again changes nothing.
Inputs are stored as a JSON string so a model retrained on other columns needs
no schema change; their fields and types are found from the log itself. Confirmed outcomes go to a second append-only table; the
latest write per prediction wins on read (there is no UPDATE on Parquet).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_COLUMNS = ("id", "created_at", "model_version", "target_column", "source", "batch_id",
               "reference", "inputs", "predicted_label", "probability", "probabilities")


def log_entries(scored: DataFrame, inputs: list[str], labels: list[str], model_version: str,
                target: str, batch_id: str, source: str = "batch", reference: str | None = None,
                created_at: str | None = None, key: str | None = None) -> DataFrame:
    """S5 (rows): one log row per scored record, all tagged with one batch id.

    ``id`` is a 64-bit hash of the batch id and the record's ``key`` (unique within the batch; ``reference`` by default),
    so appends share no ids and a retried task writes the same ones. Without a key it is the hash of a random UUID.
    """
    key = key or reference
    unique = F.xxhash64(F.lit(batch_id), F.col(f"`{key}`")) if key else F.xxhash64(F.expr("uuid()"))
    ts = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    probs = F.to_json(F.create_map(*[x for lbl in labels for x in (F.lit(lbl), F.col(f"`p_{lbl}`"))]))
    return scored.select(
        unique.alias("id"),
        ts.alias("created_at"),
        F.lit(model_version).alias("model_version"),
        F.lit(target).alias("target_column"),
        F.lit(source).alias("source"),
        F.lit(batch_id).alias("batch_id"),
        (F.col(f"`{reference}`").cast("string") if reference else F.lit(None).cast("string")).alias("reference"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in inputs])).alias("inputs"),
        F.col("prediction").alias("predicted_label"),
        F.col("probability").cast("double").alias("probability"),
        probs.alias("probabilities"),
    )


LOG_SCHEMA = ("id long, created_at timestamp, target_column string, source string, reference string, inputs string, predicted_label string, "
              "probability double, probabilities string, model_version string, batch_id string")


def append_log(entries: DataFrame, path: str) -> None:
    """S5 (sink): each (model version, batch) of ``entries`` becomes one folder, replaced as a whole.

    A batch that a driver writes again after a failure is there once; other batches are not touched. New files are staged and moved in when
    the job commits, so a failed write leaves the log as it was. Rows without a batch id form a batch of their own on each call.
    """
    alone = F.lit(f"single-{uuid.uuid4().hex}")
    (entries.withColumn("batch_id", F.coalesce("batch_id", alone)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("model_version", "batch_id").parquet(path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    # the types are fixed: a folder named batch_id=0001 is no number
    return spark.read.schema(LOG_SCHEMA).parquet(path).select(*LOG_COLUMNS)


def events_as_log(events: DataFrame) -> DataFrame:
    """The provided ``events`` table viewed as a prediction log (fixture mapping)."""
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("v"), (F.col("user_id") % 3 + 1).cast("string")).alias("model_version"),
        F.lit("event_type").alias("target_column"),
        F.lit("batch").alias("source"),
        F.date_format("ts", "yyyy-MM-dd").alias("batch_id"),
        F.col("user_id").cast("string").alias("reference"),
        F.col("props").alias("inputs"),
        F.col("event_type").alias("predicted_label"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("probability"),
        F.lit(None).cast("string").alias("probabilities"),
    )


def outcomes_from_events(events: DataFrame) -> DataFrame:
    """Fixture outcomes (H2 input): purchases and signups get a confirmed
    outcome an hour later; purchases are corrected an hour after that."""
    first = events.where(F.col("event_type").isin("purchase", "signup")).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("actual_label"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("recorded_at"))
    second = events.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("id"), F.lit("view").alias("actual_label"),
        (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("recorded_at"))
    return first.unionByName(second)


def recent(log: DataFrame, n: int = 200, model_version: str | None = None) -> DataFrame:
    """The newest ``n`` rows, optionally of one version (TakeOrderedAndProject)."""
    if model_version is not None:
        log = log.where(F.col("model_version") == model_version)
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def latest_outcomes(outcomes: DataFrame) -> DataFrame:
    """H2 (read side): one outcome per prediction id — the latest write wins."""
    return outcomes.groupBy("id").agg(F.max_by("actual_label", F.struct("recorded_at", "actual_label")).alias("actual_label"))


def with_outcomes(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The log with ``actual_label`` attached (left join on id)."""
    return log.join(latest_outcomes(outcomes), "id", "left")


def awaiting_outcome(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """log rows still awaiting a confirmed outcome (anti-join on id)."""
    return log.join(latest_outcomes(outcomes).select("id"), "id", "left_anti")


# Numbers with a fraction are read as doubles, whatever digits they were written with.
NUMBER = (T.DecimalType, T.DoubleType, T.FloatType)


def _object():
    parsed = F.try_parse_json("inputs")
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT<"), parsed)


def input_schema_of(inputs: DataFrame) -> T.StructType:
    """The merged schema of the JSON objects in the column ``inputs``, from one aggregate; texts that are no JSON object count as absent."""
    found = inputs.select(F.schema_of_variant_agg(_object())).first()[0]
    kind = re.sub(r"\bOBJECT\b(?=<)", "STRUCT", found or "VOID")
    parsed = T._parse_datatype_string(kind)
    if isinstance(parsed, T.StructType) and kind.startswith("STRUCT"):
        return parsed
    return T.StructType([])


def leaves(schema: T.StructType, above: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """(path, SQL type) of every field that is no object. A field whose values differ in kind, and a list, are text."""
    out = []
    for field in schema.fields:
        path = (*above, field.name)
        if isinstance(field.dataType, T.StructType):
            out += leaves(field.dataType, path)
        elif isinstance(field.dataType, NUMBER):
            out.append((path, "double"))
        elif isinstance(field.dataType, (T.LongType, T.BooleanType)):
            out.append((path, field.dataType.simpleString()))
        else:
            out.append((path, "string"))
    return out


def fields_by_version(log: DataFrame) -> DataFrame:
    """H1: (model_version, schema) as each version logged its inputs."""
    return log.groupBy("model_version").agg(F.schema_of_variant_agg(_object()).alias("schema"))


def discovered(log: DataFrame) -> DataFrame:
    """H1: every input field that occurs in the log as a typed column; a field of an object is named with dots.

    Inputs that are no JSON object give nulls. A field named like a column of the log gets the prefix ``inputs.``. A name with both
    kinds of quotes cannot be addressed in a variant and gives no column.
    """
    kept = [c for c in log.columns if c not in ("inputs", "probabilities")]
    fields = leaves(input_schema_of(log))
    parsed = log.select(*kept, _object().alias("__inputs"))
    columns = []
    for path, kind in fields:
        name = ".".join(path)
        if any("'" in step and '"' in step for step in path):
            continue
        place = "$" + "".join(f"['{step}']" if "'" not in step else f'["{step}"]' for step in path)
        columns.append(F.try_variant_get("__inputs", place, kind).alias(name if name not in kept else f"inputs.{name}"))
    return parsed.select(*kept, *columns)


def expanded(log: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """H1: each input field as its own column; bad JSON gives NULLs. Fields that are named are text, else all that
    occur are found and typed (``discovered``)."""
    if fields is None:
        return discovered(log)
    parsed = F.from_json(F.col("inputs"), "map<string,string>")
    return log.select(*[c for c in log.columns if c not in ("inputs", "probabilities")],
                      *[F.element_at(parsed, F.lit(f)).alias(f) for f in fields])


def labelled(log: DataFrame, outcomes: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """H3: confirmed outcomes as training rows — inputs plus the actual label,
    kept per target column (``target_column`` names the label column)."""
    joined = expanded(log.join(latest_outcomes(outcomes), "id", "inner"), fields)
    meta = {*LOG_COLUMNS, "actual_label"}
    names = [c for c in joined.columns if c not in meta] if fields is None else fields
    return joined.select("id", "target_column", *[F.col(f"`{c}`") for c in names], "actual_label")


def labelled_for_target(log: DataFrame, outcomes: DataFrame, fields: list[str] | None, target: str) -> DataFrame:
    """H3 for one target: inputs plus a column named after the target."""
    lab = labelled(log.where(F.col("target_column") == target), outcomes, fields)
    return lab.select(*[F.col(f"`{c}`") for c in lab.columns if c not in ("id", "target_column", "actual_label")], F.col("actual_label").alias(target))


def summary(log: DataFrame, outcomes: DataFrame, model_version: str | None = None) -> DataFrame:
    """H4: one row — total, labelled, last timestamp (optionally for one version)."""
    if model_version is not None:
        log = log.where(F.col("model_version") == model_version)
    j = log.select("id", "created_at").join(latest_outcomes(outcomes), "id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("actual_label").alias("labelled"),
        F.max("created_at").alias("last"),
    )


def counts_by(log: DataFrame, column: str) -> DataFrame:
    """H4: rows per model version or per predicted label."""
    return log.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def append_feedback(train: DataFrame, labelled_rows: DataFrame) -> DataFrame:
    """H5: confirmed outcomes appended to the training table (missing columns NULL)."""
    common = {c: t for c, t in train.dtypes}
    cast = labelled_rows.select(*[F.col(f"`{c}`").cast(common[c]).alias(c) if c in common else F.col(f"`{c}`") for c in labelled_rows.columns])
    return train.unionByName(cast, allowMissingColumns=True)
