"""The provided parquet tables and the `records` fixture derived from them.

`records` is the classification table used across the library's queries:
orders joined to customer, with columns of every shape the operators tell
apart (identifier, nulls, numbers-as-text, rare and untrimmed levels, a
constant, free text, three same-scale percentages, two counts, a noisy
learnable target). The SQL text is shared verbatim with the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed fixture definition (must stay identical on Spark and DuckDB).
RECORDS_SQL = """
SELECT o_orderkey AS record_id,
  o_totalprice / 5000.0 AS score,
  CAST(40 + ((o_orderkey * 13) % 601) / 10.0 AS DOUBLE) AS attendance,
  CAST(((o_custkey * 37 + o_orderkey) % 1001) / 10.0 AS DOUBLE) AS aptitude,
  CASE WHEN (o_orderkey * 31) % 10 = 3 THEN NULL ELSE c_acctbal END AS balance,
  CAST(o_custkey % 6 AS INT) AS projects,
  CAST((o_orderkey * 3) % 10 AS INT) AS backlogs,
  CAST(((o_orderkey * 7919) % 41) / 10.0 + 1.0 AS DOUBLE) AS rating,
  concat(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ',',
         lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0')) AS stipend,
  CASE WHEN o_orderkey % 400 = 7 THEN 'RARE'
       WHEN o_orderkey % 50 = 1 THEN concat(' ', o_orderpriority)
       ELSE o_orderpriority END AS department,
  CASE WHEN (o_orderkey * 7) % 11 < 5 THEN 'Yes' ELSE 'No' END AS training,
  'Main' AS campus,
  concat('free text row ', CAST(o_orderkey AS STRING)) AS notes,
  CASE WHEN 0.06 * (o_totalprice / 5000.0 - 50) + 0.5 * (o_custkey % 6) - 1.25
            + (CAST(((o_orderkey * 104729) % 1000) AS DOUBLE) / 1000 * 4 - 2) > 0
       THEN 'approved' ELSE 'rejected' END AS outcome
FROM orders JOIN customer ON o_custkey = c_custkey
"""

# Fixed formula score standing in for a fitted model wherever an oracle is
# wanted (rounded so both engines tie identically).
FORMULA_SCORE_SQL = "round(1 / (1 + exp(-(0.06 * (score - 50) + 0.5 * projects - 1.25))), 6)"

RECORD_FEATURES = ("score", "attendance", "aptitude", "balance", "projects", "backlogs",
                   "rating", "stipend", "department", "training", "campus", "notes")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the provided tables as temp views (lazy; nothing is read)."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `records` fixture as a lazy DataFrame over orders ⋈ customer."""
    register_tables(spark, sf_dir, ("orders", "customer"))
    return spark.sql(RECORDS_SQL)


def with_formula_score(df: DataFrame, column: str = "probability") -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumn(column, F.expr(FORMULA_SCORE_SQL))


def records_with_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_formula_score(records(spark, sf_dir))
