"""S5, S7, H1 and S1 beyond the happy path: retries, failed writes, tampering, versions, discovered fields, malformed lines."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from classcraft.sources import io
from classcraft.sources import log as L
from classcraft.sources.store import ModelStore, StoreError


class Toy:
    champion, metrics = "toy", {"score": 0.5}

    def __init__(self, rows, fail=False):
        self.rows, self.fail = rows, fail

    def save(self, spark, path):
        spark.createDataFrame([(r,) for r in self.rows], "v int").repartition(2).write.parquet(f"{path}/data")
        if self.fail:
            raise OSError("disk full")
        spark.createDataFrame([("m",)], "text string").coalesce(1).write.text(f"{path}/manifest")


def load_toy(spark, path):
    return sorted(r.v for r in spark.read.parquet(f"{path}/data").collect())


@pytest.fixture
def store(spark, tmp_path):
    return ModelStore(spark, str(tmp_path / "models"), load_toy)


def files_of(store, version):
    return [p for p in Path(store.root, "versions", version).rglob("*.parquet")]


def test_versions_newest_first_and_reactivated(store):
    assert store.active() is None and store.versions().count() == 0
    a, b, c = (store.save(Toy([i]), notes) for i, notes in enumerate("abc"))
    assert store.names() == [c, b, a] and store.active() == c
    store.activate(a)
    assert store.load() == [0] and store.load(b) == [1]
    rows = store.versions().collect()
    assert [r.version for r in rows] == [c, b, a] and [r.active for r in rows] == [False, False, True]
    assert rows[0].champion == "toy" and rows[0].score == 0.5 and rows[0].notes == "c" and rows[0].files >= 2
    d = store.save(Toy([9]), make_active=False)
    assert store.active() == a and store.names()[0] == d
    with pytest.raises(StoreError, match="no saved model"):
        store.activate("20200101-000000000000-dead")


def test_deleted_versions(store):
    a, b = store.save(Toy([1])), store.save(Toy([2]))
    store.delete(b)
    assert store.active() == a and store.load() == [1]
    store.delete(a)
    assert store.active() is None
    with pytest.raises(StoreError, match="no saved model"):
        store.load()


def test_tampered_file_is_refused(store):
    version = store.save(Toy([1, 2, 3]))
    victim = files_of(store, version)[0]
    (victim.parent / f".{victim.name}.crc").unlink(missing_ok=True)
    victim.write_bytes(victim.read_bytes() + b"x")
    with pytest.raises(StoreError, match="checksum"):
        store.load(version)


def test_missing_foreign_and_all_files_gone(store):
    version = store.save(Toy([1, 2, 3]))
    victim = files_of(store, version)[0]
    kept = victim.read_bytes()
    victim.unlink()
    with pytest.raises(StoreError, match="missing"):
        store.load(version)
    victim.write_bytes(kept)
    assert store.load(version) == [1, 2, 3]
    (victim.parent / "extra.parquet").write_bytes(kept)
    with pytest.raises(StoreError, match="foreign"):
        store.load(version)
    for p in Path(store.root, "versions", version).rglob("*"):
        if p.is_file():
            p.unlink()
    with pytest.raises(StoreError):
        store.load(version)


def test_failed_and_half_written_saves_do_not_exist(store):
    good = store.save(Toy([1]))
    with pytest.raises(OSError):
        store.save(Toy([2], fail=True))
    assert store.names() == [good] and [p.name for p in Path(store.root, "versions").iterdir()] == [good]
    Toy([3]).save(store.spark, f"{store.root}/versions/29990101-000000000000-ffffff")      # a driver lost before the record
    assert store.names() == [good] and store.active() == good
    with pytest.raises(StoreError):
        store.load("29990101-000000000000-ffffff")


def test_a_record_is_never_overwritten(store):
    version = store.save(Toy([1]))
    with pytest.raises(StoreError, match="exists"):
        store._put({}, "records", f"{version}.json")
    assert store.load(version) == [1]


# ── S5 ──────────────────────────────────────────────────────────────────────
def entries(spark, batch, labels, version="v1"):
    rows = [(i, label, 0.5, 0.25, 0.75) for i, label in enumerate(labels)]
    scored = spark.createDataFrame(rows, "key long, prediction string, probability double, p_a double, p_b double")
    return L.log_entries(scored, ["key"], ["a", "b"], version, "y", batch, reference="key", created_at="2024-01-01 00:00:00")


def test_same_batch_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch, labels in (("0001", "ab"), ("0002", "abb"), ("0001", "ab")):
        L.append_log(entries(spark, batch, labels), path)
    L.append_log(entries(spark, "0001", "b", "v2"), path)
    log = L.read_log(spark, path)
    assert {(r.model_version, r.batch_id): r.n for r in log.groupBy("model_version", "batch_id").agg(F.count("*").alias("n")).collect()} == {
        ("v1", "0001"): 2, ("v1", "0002"): 3, ("v2", "0001"): 1}
    assert log.columns == list(L.LOG_COLUMNS) and log.select("id").distinct().count() == 5   # v2 logged the same batch and key as v1


def test_rows_without_a_batch_are_all_kept(spark, tmp_path):
    path = str(tmp_path / "log")
    for _ in range(2):
        L.append_log(entries(spark, "x", "ab").withColumn("batch_id", F.lit(None).cast("string")), path)
    assert L.read_log(spark, path).count() == 4


def test_failed_write_leaves_the_log_readable(spark, tmp_path):
    path = str(tmp_path / "log")
    L.append_log(entries(spark, "b1", "ab"), path)
    before = sorted(map(tuple, L.read_log(spark, path).collect()))
    broken = entries(spark, "b1", "abba").repartition(4, "id").withColumn(
        "reference", F.when(F.col("reference") == "3", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("reference")))
    with pytest.raises(Exception, match="lost"):
        L.append_log(broken, path)
    assert sorted(map(tuple, L.read_log(spark, path).collect())) == before


# ── H1 ──────────────────────────────────────────────────────────────────────
def logged(spark, inputs):
    rows = [(i, f"v{i % 2 + 1}", t) for i, t in enumerate(inputs)]
    return spark.createDataFrame(rows, "id long, model_version string, inputs string")


def test_fields_and_types_are_found(spark):
    log = logged(spark, ['{"score": 70, "department": "CS", "who": {"age": 1.5, "it\'s": true}}', '{"score": 71, "who": {"age": 2}, "list": [1, {"a": null}]}',
                         "{broken", None, '{"score": null, "department": 7, "id": 12}', '"text"', "{}"])
    out = L.expanded(log)
    assert dict(out.dtypes) == {"id": "bigint", "model_version": "string", "score": "bigint", "department": "string", "who.age": "double", "who.it's": "boolean",
                                "list": "string", "inputs.id": "bigint"}
    rows = {r["id"]: r.asDict() for r in out.collect()}
    assert rows[0]["score"] == 70 and rows[0]["department"] == "CS" and rows[0]["who.age"] == 1.5 and rows[0]["who.it's"] is True
    assert rows[1]["who.age"] == 2.0 and json.loads(rows[1]["list"]) == [1, {"a": None}] and rows[4]["department"] == "7" and rows[4]["inputs.id"] == 12
    assert all(v is None for i in (2, 3, 5, 6) for k, v in rows[i].items() if k not in ("id", "model_version"))
    assert {r.model_version for r in L.fields_by_version(log).collect()} == {"v1", "v2"}


def test_no_usable_inputs(spark):
    assert L.expanded(logged(spark, ["nope", None])).columns == ["id", "model_version"]
    assert L.expanded(logged(spark, ["{}"]).limit(0)).columns == ["id", "model_version"]


# ── S1 ──────────────────────────────────────────────────────────────────────
def test_malformed_lines_are_quarantined(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,name,amount\n1,"a, b",2.5\n2,short\n3,c,4.5,long\n4,d,many\n5,,\n"6","e ""x""",1\n')
    good, bad, counts = io.read_checked(spark, str(path), "id long, name string, amount double", str(tmp_path / "out"))
    assert counts == {"lines": 6, "good": 3, "quarantined": 3}
    assert sorted(map(tuple, good.collect())) == [(1, "a, b", 2.5), (5, None, None), (6, 'e "x"', 1.0)]
    assert sorted(r.line for r in bad.collect()) == ["2,short", "3,c,4.5,long", "4,d,many"]


def test_only_good_or_no_lines(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id\n1\n2\n")
    (tmp_path / "none.csv").write_text("id\n")
    for name, n in (("good", 2), ("none", 0)):
        good, bad, counts = io.read_checked(spark, str(tmp_path / f"{name}.csv"), "id long", str(tmp_path / name))
        assert (good.count(), bad.count()) == (n, 0) and counts == {"lines": n, "good": n, "quarantined": 0}
