"""Plans: what must reach the scan does, and aggregations combine before their shuffle."""

from pyspark.sql import functions as F

from sweepframe.operators import detect, frames
from sweepframe.plans.fixtures import Views

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_two_columns(spark):
    text = plan(Views(spark, DIR)("documents").filter("doc_id > 5").select("doc_id", "n_chars"))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in text and "GreaterThan(doc_id,5)" in text


def test_latest_values_are_combined_first(spark):
    text = plan(frames.mosaic_latest(Views(spark, DIR)("frames")))
    assert "partial_max" in text and "CartesianProduct" not in text


def test_bucketed_detection_is_an_equi_join(spark):
    many = spark.range(360).select(F.col("id").cast("int").alias("angle"))
    text = plan(detect.target_detect(Views(spark, DIR)("frames"), many, bucketed=True))
    assert "NestedLoop" not in text and "HashJoin" in text or "SortMergeJoin" in text


def test_log_tail_limits_ranks_before_the_shuffle(spark):
    from sweepframe.operators.messages import log_tail

    assert "WindowGroupLimit" in plan(log_tail(Views(spark, DIR)("log_events"), 10))


def test_views_number_their_rows_in_slices(spark):
    for name in ("packets", "frame_index_stream", "frames"):
        text = plan(Views(spark, DIR)(name))
        assert "__slice" in text and "row_number" not in text, name


def test_numbers_in_slices_are_row_numbers(spark):
    from pyspark.sql import Window

    from sweepframe.operators.sliced import numbered

    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 97).alias("t"), F.col("id").alias("n"))
    want = rows.withColumn("number", F.row_number().over(Window.partitionBy("k").orderBy("t", "n")).cast("long"))
    for slices in (None, 1, 7):
        assert sorted(numbered(rows, ["k"], ["t", "n"], "number", slices).select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)
