import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from scenaria.session import local_session

    s = local_session(cores=os.environ.get("SCENARIA_TEST_CORES", "*"), shuffle_partitions=8, app="scenaria-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fact(spark):
    return spark.createDataFrame(fx.fact_pdf()).cache()


@pytest.fixture(scope="session")
def totals(spark):
    return spark.createDataFrame(fx.totals_pdf()).cache()


@pytest.fixture(scope="session")
def price_util(spark):
    return fx.to_grid(spark, fx.price_util_pdf()).cache()


@pytest.fixture(scope="session")
def growth(spark):
    return fx.to_grid(spark, fx.growth_pdf()).cache()
