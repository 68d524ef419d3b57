"""The filter of keys: no key is missed, few others pass, and beyond the bound an exact join decides."""

from pyspark.sql import functions as F

from twinlake.operators import keyfilter


def shares(rows, wanted, keys, **how):
    told = keyfilter.flagged(rows, wanted, keys, "told", **how)
    return told.select(F.avg(F.when(F.col("inside"), F.col("told").cast("int"))), F.avg(F.when(~F.col("inside"), F.col("told").cast("int")))).first()


def test_all_keys_pass_and_few_others(spark):
    for n in (1000, 1_000_000):
        rows = spark.range(2 * n, numPartitions=8).select((F.col("id") * 7919).alias("k"), (F.col("id") < n).alias("inside"))
        found, false = shares(rows, rows.where("inside"), ["k"])
        assert found == 1.0 and false < 0.01, (n, false)


def test_beyond_the_bound_the_answer_is_exact(spark):
    rows = spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") % 2 == 0).alias("inside"))
    assert tuple(shares(rows, rows.where("inside"), ["k"], most_bytes=16_000)) == (1.0, 0.0)


def test_the_filter_grows_with_the_keys_under_its_bound():
    assert keyfilter.filter_words(10**7) * 8 <= 20_000_000 + 8 * keyfilter.PAGE
    assert keyfilter.filter_words(10**8) * 8 > keyfilter.MOST_BYTES  # told by the join


def test_null_keys_several_columns_and_no_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "a"), (None, None), (2, "b")], "x int, y string")
    wanted = rows.where("x is null")
    for most in (keyfilter.MOST_BYTES, 0):
        told = {(r.x, r.y): r.f for r in keyfilter.flagged(rows, wanted, ["x", "y"], "f", most).collect()}
        assert told == {(1, "a"): False, (None, "a"): True, (None, None): True, (2, "b"): False}
    assert not any(r.f for r in keyfilter.flagged(rows, wanted.limit(0), ["x", "y"], "f").collect())
    left = keyfilter.without(rows, wanted, {"x": F.col("x"), "y": F.col("y")})
    assert sorted((r.x, r.y) for r in left.collect()) == [(1, "a"), (2, "b")]


def test_nothing_of_the_rows_is_shuffled(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("content").alias("content"))
    plan = keyfilter.marked_rows(rows, rows.where("k < 10"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
