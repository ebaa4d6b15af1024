"""Shared fixtures: one local Spark session and the small frames of the reference's tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from classcraft.session import local_session

    session = local_session(cpus=4, shuffle_partitions=4, app="classcraft-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def clean_frame(spark):
    """a, b, c numeric and a three-level `grade` (the reference's 4-row frame)."""
    return spark.createDataFrame(
        [(1, 10, 0, "Low"), (2, 20, 1, "High"), (3, 30, 0, "Low"), (4, 40, 2, "Medium")],
        "a long, b long, c long, grade string",
    )


@pytest.fixture(scope="session")
def records(spark):
    from classcraft.sources.tables import records

    return records(spark, SMOKE_DIR).cache()
