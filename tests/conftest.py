from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from panel import invented_panel, invented_records  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def water_rows():
    return invented_panel()


@pytest.fixture(scope="session")
def water(spark):
    return spark.createDataFrame(invented_panel(), "location_id string, year int, season string, "
                                 "water_area_ha double, water_body_count int, data_quality string").cache()


@pytest.fixture(scope="session")
def nrm(spark):
    return spark.createDataFrame(invented_records(), "location_id string, year int, pond_presence int, "
                                 "crop_yield_ton_per_ha double, drought_sensitivity string").cache()


@pytest.fixture(scope="session")
def merged(water, nrm):
    from rainledger.operators.merging import merge_interventions
    return merge_interventions(water, nrm).cache()
