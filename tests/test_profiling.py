"""S3, P1–P16, F3 on hand-made frames and on the `records` fixture (sf0.001)."""

from __future__ import annotations

from classcraft.operators import profile as P
from classcraft.operators import target as T
from classcraft.operators.roles import auto_roles
from classcraft.sources.io import canonical_names, safe_column_name


def test_canonical_headers():
    got = canonical_names(["Test Score", "Attendance %", "Workshops/Certs", "2024 score"])
    assert list(got.values()) == ["test_score", "attendance", "workshops_certs", "col_2024_score"]


def test_header_collisions_and_empty_names():
    assert list(canonical_names(["A b", "a_b", "a-b"]).values()) == ["a_b", "a_b_2", "a_b_3"]
    assert safe_column_name("%%%") == "column"
    assert safe_column_name("Ünïcödé") == "unicode"


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert P.duplicate_rows(df).first()[0] == 1


def test_positive_class(spark):
    levels = spark.createDataFrame([("Failed", 10), ("Distinction", 3)], "value string, n bigint")
    assert T.positive_class(levels).first()[0] == "Distinction"
    numeric = spark.createDataFrame([("0", 10), ("1", 3)], "value string, n bigint")
    assert T.positive_class(numeric).first()[0] == "1"


def test_kinds(spark):
    df = spark.createDataFrame(
        [(i, float(i % 2), "Main", None, f"note {i}", ["a", "b"][i % 2]) for i in range(60)],
        "id int, flag double, campus string, empty string, notes string, grade string",
    )
    kinds = {r["column"]: r["kind"] for r in P.profile(df).collect()}
    assert kinds == {"id": "numeric", "flag": "boolean", "campus": "constant", "empty": "empty",
                     "notes": "text", "grade": "categorical"}


def test_records_profile_and_roles(records):
    prof = P.profile(records).cache()
    rows = {r["column"]: r for r in prof.collect()}
    assert rows["record_id"]["n_rows"] == 1500 and rows["record_id"]["is_identifier"]
    assert rows["balance"]["n_missing"] == 150 and rows["balance"]["missing_pct"] == 10.0
    assert rows["projects"]["is_integral"] and not rows["score"]["is_integral"]
    assert rows["stipend"]["numeric_like"]
    roles = {r["column"]: r["role"] for r in auto_roles(prof, "outcome").collect()}
    assert roles["record_id"] == roles["notes"] == roles["stipend"] == "identifier"
    assert roles["campus"] == "drop"
    assert roles["department"] == roles["training"] == "categorical_feature"
    for c in ("score", "attendance", "aptitude", "balance", "projects", "backlogs", "rating"):
        assert roles[c] == "numeric_feature", c
    assert T.target_candidates(prof).first()["column"] == "outcome"


def test_role_overrides_and_leakage(records):
    prof = P.profile(records.select("record_id", "score", "rating", "outcome"))
    roles = {r["column"]: (r["role"], r["source"]) for r in
             auto_roles(prof, "outcome", {"rating": "categorical_feature"}, leakage=["score"]).collect()}
    assert roles["rating"] == ("categorical_feature", "user")
    assert roles["score"][0] == "drop" and roles["outcome"][0] == "target"


def test_target_description_and_guard(spark, records):
    d = T.describe_target(records, "outcome").collect()
    assert {r["task_type"] for r in d} == {"binary_classification"} and sum(r["n"] for r in d) == 1500
    thin = spark.createDataFrame([("a",)] * 10 + [("b",)] * 3, "y string")
    assert [r["rule"] for r in T.target_guard(thin, "y").collect()] == ["thin_class"]
    single = spark.createDataFrame([("a",)] * 10, "y string")
    assert T.target_guard(single, "y").first()["rule"] == "single_class"
    assert T.target_guard(records, "outcome").count() == 0


def test_class_balance(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 10, "y string")
    rows = {r["value"]: r for r in T.class_balance(df, "y").collect()}
    assert rows["a"]["share"] == 90.0 and rows["a"]["imbalance"] == 80.0
