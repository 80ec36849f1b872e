import pytest
from pyspark.sql import functions as F

from pagemill.sources import sinks, versions


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/state"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_no_state_yet(spark, path):
    assert versions.read_version(spark, path) is None and versions.versions(spark, path) == []


def test_a_failing_write_leaves_the_old_state(spark, path, tmp_path):
    sinks.write_state(spark.range(3), path)
    broken = spark.range(8).repartition(4).withColumn("id", F.when(F.col("id") == 5, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        sinks.write_state(broken, path)
    assert versions.versions(spark, path) == [1] and rows(versions.read_version(spark, path)) == [(0,), (1,), (2,)]
    assert len(list((tmp_path / "state").glob("rows-*"))) == 1  # nothing of the failed one is left


def test_of_two_writers_one_loses(spark, path):
    versions.write_version(spark.range(1), path)
    base = versions.versions(spark, path)[-1]
    assert versions.write_version(spark.range(2), path, based_on=base) == 2
    with pytest.raises(versions.StateConflict):
        versions.write_version(spark.range(3), path, based_on=base)
    assert rows(versions.read_version(spark, path)) == [(0,), (1,)]


def test_a_marker_is_never_replaced(spark, path):
    """Both writers have looked before either commits: the rename itself decides."""
    versions.write_version(spark.range(1), path)
    hadoop, _, files = versions._files(spark, path)
    other = hadoop.Path(f"{path}/versions/.other")
    files.create(other, False).close()
    with pytest.raises(versions.StateConflict):
        versions._rename(spark, other, hadoop.Path(f"{path}/versions/{1:012d}"), 0)
    assert rows(versions.read_version(spark, path)) == [(0,)]


def test_old_versions_stay_readable_until_taken(spark, path, tmp_path):
    for n in (1, 2, 3):
        versions.write_version(spark.range(n), path)
    assert versions.read_version(spark, path, 1).count() == 1
    versions.vacuum(spark, path, keep=2)
    assert versions.versions(spark, path) == [2, 3] and len(list((tmp_path / "state").glob("rows-*"))) == 2
    assert versions.read_version(spark, path).count() == 3


def test_an_empty_state_keeps_its_columns(spark, path):
    versions.write_version(spark.createDataFrame([], "a long, b array<string>"), path)
    assert versions.read_version(spark, path).dtypes == [("a", "bigint"), ("b", "array<string>")]
