"""Totals over the wide catalogue: a task's names are bounded by the text that they come from."""

from pyspark.sql import functions as F

from registry import features, frames, results


def test_tasks_that_total_names_grow_in_number_with_the_text(spark, tmp_path, monkeypatch):
    """Spark would join tasks by the few bytes that the names shuffle to; one task then holds names without bound."""
    turns = spark.range(60).select(
        F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"),
        F.when(F.col("id") > 0, F.concat_ws(" ", F.lit("both"), F.concat(F.lit("w"), F.col("id")), F.expr("repeat('é', 40)"))).alias("text"),
    )
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(frames, "NAMES_BYTES", 100)
    size = sum(len((r.text or "").encode()) for r in turns.collect())
    dealt = frames.dealt_names(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == -(-size // 100) > spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, frames.word_catalog(spark, str(tmp_path)).collect()))
    for query in (results.semantic_summary, features.aggregate_semantic):
        found = query(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        first = plan.index("Exchange hashpartitioning")  # the last to run
        assert "REPARTITION_BY_NUM" in plan[first : plan.index("\n", first)]
        # the rows that are totalled have as many tasks as the text has pieces
        assert found.select("feature").count() > 0
    empty = tmp_path / "empty"
    turns.limit(0).write.parquet(f"{empty}/conversations.parquet")
    assert results.semantic_summary(spark, str(empty)).count() == 0
