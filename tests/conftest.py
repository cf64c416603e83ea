import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from facetframe.session import ship_package
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2")
               .config("spark.default.parallelism", "2").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def plots(spark):
    """Eight rows with every semantic type, two gaps and one repeated row."""
    rows = [("P/100", "mill", 17, 410.25, "Aarhus", "2019-07-02", False), ("P/101", "dock", 9, 88.0, "Turku", "2018-12-30", True),
            ("P/102", "yard", 31, None, "Gdynia", "2020-02-29", True), ("P/103", "kiln", 12, 955.5, "Narvik", "2017-05-05", False),
            ("P/104", "quay", None, 120.75, "Tartu", "2021-09-14", True), ("P/105", "barn", 44, 300.0, "Umea", "2016-01-31", False),
            ("P/101", "dock", 9, 88.0, "Turku", "2018-12-30", True), ("P/106", "pier", 26, 640.0, "Visby", "2022-03-08", True)]
    return spark.createDataFrame(rows, "plot_id string, kind string, age int, annual_rent double, "
                                       "place string, opened string, is_leased boolean")
