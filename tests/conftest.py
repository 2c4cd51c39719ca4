import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small_df(spark):
    """84 tickets, one a day, with two categories and two measures drawn from hashes of the day's number."""
    draw = lambda seed, n: f"cast(pmod(xxhash64(id, {seed}), {n}) as int)"
    return spark.range(84).selectExpr(
        "concat('T', lpad(id, 4, '0')) as ticket_id",
        "timestamp_ntz'2023-03-01 00:00:00' + make_dt_interval(cast(id as int)) as sold_at",
        f"array('harbour', 'hill', 'old town')[{draw(1, 3)}] as district",
        f"array('lamp', 'rug')[{draw(2, 2)}] as article",
        f"round(5 + {draw(3, 40000)} / 100, 2) as amount",
        f"1L + {draw(4, 9)} as pieces")


@pytest.fixture(scope="session")
def text_df(spark):
    from tablelens.catalog.fixtures import REVIEWS
    return spark.createDataFrame([(r,) for r in REVIEWS], "review string")
