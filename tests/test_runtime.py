import os

import pytest

from sessionloom import runtime


def test_intermediates_are_written_and_released(spark):
    df = runtime.materialise(spark.range(5), "t")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path) and path.startswith(runtime.shared_dir(spark).removeprefix("file://"))
    assert runtime.release(spark) >= 1 and not os.path.exists(path) and runtime.release(spark) == 0


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="nope"):
        runtime.require_columns(spark.range(1), "id", "nope")
