import pytest


@pytest.fixture
def texts(spark):
    def make(*values, **extra):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")

    return make
