import pytest


@pytest.fixture(autouse=True)
def small_shuffles(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
