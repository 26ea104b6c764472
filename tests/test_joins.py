import pytest
from pyspark.sql import functions as F

from songsift.operators.joins import lookup, lookup_by_parts
from tests.conftest import plan_of, rows


def facts(spark):
    """A third of the rows share key 7, a tenth have none."""
    return spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.lit(None))
        .when(F.col("id") % 3 == 0, F.lit(7))
        .otherwise(F.col("id") % 100)
        .alias("k"),
        F.col("id").alias("row"),
    )


def test_lookup_equals_a_plain_join(spark):
    big = facts(spark)
    dim = spark.range(0, 100, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    dim = dim.unionByName(spark.createDataFrame([(7, 70)], "k bigint, v bigint"))
    for how in ("left", "inner"):
        plain = rows(big.join(dim, "k", how), "k", "row", "v")
        assert rows(lookup(big, dim, "k", how), "k", "row", "v") == plain


def test_lookup_on_two_columns(spark):
    big = facts(spark).withColumn("j", (F.col("row") % 2).cast("int"))
    dim = spark.createDataFrame([(7, 0, "a"), (7, 1, "b"), (8, 0, "c")], "k bigint, j int, v string")
    plain = rows(big.join(dim, ["k", "j"], "left"), "row", "v")
    assert rows(lookup(big, dim, ["k", "j"]), "row", "v") == plain


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_are_split_even_if_their_rows_are_equal(spark, how):
    """Two thousand keys with a hundred rows each, and one with rows that are all the same."""
    before = {name: spark.conf.get(name) for name in SKEW}
    for name, value in SKEW.items():
        spark.conf.set(name, value)
    try:
        many = spark.range(0, 200_000, 1, 16).select((F.col("id") % 2000).alias("k"), "id")
        same = spark.range(0, 300_000, 1, 16).select(F.lit(7).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("id"))
        # The result of an aggregate on the key, which alone would keep Spark from splitting.
        dim = spark.range(4000).groupBy((F.col("id") % 2000).alias("k")).agg(F.max("id").alias("v"))
        joined = lookup(many.union(same), dim, "k", how)
        hot = joined.filter("k = 7").groupBy(F.spark_partition_id().alias("p")).count()
        sizes = [r["count"] for r in hot.collect()]
        # Equal rows take few bytes, by which Spark goes, so they make two parts here and not ten.
        assert len(sizes) > 1 and max(sizes) < 0.8 * sum(sizes)
        assert joined.count() == 500_000 and joined.filter("v is null").count() == 0
        # Only the columns asked for are read.
        assert "id#" not in plan_of(joined.select("v")).split("Exchange")[-1]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("at_once, runs", [(1, 4), (40, 3), (10_000, 1)])
def test_lookup_by_parts_equals_a_plain_join(spark, tmp_path, at_once, runs):
    """Missing keys, NaN and both zeros too; parts that have too many rows are joined all the same."""
    big = facts(spark).select(
        F.when(F.col("row") % 7 == 0, F.lit(float("nan")))
        .when(F.col("row") % 11 == 0, F.lit(-0.0))
        .otherwise(F.col("k").cast("double"))
        .alias("x"),
        (F.col("row") % 5).cast("string").alias("name"),
        "row",
    )
    big = big.withColumn("p", F.pmod(F.xxhash64("x", "name"), F.lit(4)).cast("int"))
    big.write.partitionBy("p").parquet(str(tmp_path / "facts"))
    stored = spark.read.parquet(str(tmp_path / "facts"))
    dim = stored.select("x", "name", "p").distinct().withColumn("v", F.concat_ws("/", "x", "name"))
    dim = dim.filter("name <> '3' OR name IS NULL")
    frames = list(lookup_by_parts(stored, dim, ["x", "name"], "p", at_once))
    assert len(frames) == runs
    got = [row for frame in frames for row in rows(frame)]
    assert all(frame.columns == ["x", "name", "row", "v"] for frame in frames)
    want = stored.select("x", "name", "row", F.when(F.col("name") != "3", F.concat_ws("/", F.col("x") + 0.0, "name")))
    assert sorted(got, key=repr) == rows(want)


def test_lookup_by_parts_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "k bigint, p int, row bigint")
    frames = list(lookup_by_parts(none, none.select("k", "p", F.lit("a").alias("v")), ["k"], "p"))
    assert [f.columns for f in frames] == [["k", "row", "v"]] and frames[0].count() == 0
