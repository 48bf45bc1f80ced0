import os
import sys
import tempfile
import warnings

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TESTS = os.path.dirname(os.path.abspath(__file__))
# Python workers must import functions defined in test modules
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, TESTS, os.environ.get("PYTHONPATH", "")])
warnings.filterwarnings("ignore", category=FutureWarning)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("rosterspark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from rosterspark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="rosterspark-test-")


def brute_force_pairs(left, right, threshold, col="s"):
    """Reference for the near-duplicate join on small test inputs: an explicit cross join."""
    from pyspark.sql import functions as F

    from rosterspark.operators.fuzzy import similarity

    L = left.select(F.col(col).alias("a")).distinct()
    R = right.select(F.col(col).alias("b")).distinct()
    return L.crossJoin(R).withColumn("similarity", similarity("a", "b")).filter(
        (F.col("similarity") >= threshold) & (F.col("similarity") < 1.0))
