import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import SCHEMA, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(odd):
    """The odd documents with further columns whose names operators use themselves."""
    names = ("m", "topic", "h", "node", "key", "of", "at", "runs", "digest", "rank", "kept", "place", "range", "own", "left", "probability", "component_id")
    return odd.select("*", *(F.lit(1).alias(n) for n in names))
