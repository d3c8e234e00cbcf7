import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("SESSIONLOOM_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def empty(spark, data, tmp_path_factory):
    """The tables without rows, but for the short ones that hold parameters."""
    folder = tmp_path_factory.mktemp("empty")
    for f in Path(data).glob("*.parquet"):
        df = spark.read.parquet(str(f))
        (df if f.stem in ("size_limits", "mix_targets") else df.limit(0)).write.parquet(str(folder / f.name))
    return str(folder)
