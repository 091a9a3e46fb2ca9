"""Parts of all seeds are found once and written; what reads them by seed draws no digest again."""

from pyspark.sql import functions as F

from colsieve.operators import split
from registry import frames
from tests.conftest import SF_SMALL

SEEDS = [1, 2, 5]


def test_uses_of_the_written_orders_draw_no_digest(spark):
    rows = frames.split_leaky_orders(spark, SF_SMALL, several_uses=True)
    assert "md5" not in str(rows._jdf.queryExecution().optimizedPlan())
    train = frames._shares(rows.where(F.col("part") == "train"))
    assert "md5" not in str(train._jdf.queryExecution().optimizedPlan()) and train.count() > 0


def test_parts_at_once_are_the_parts_by_seed(spark):
    """Also for null labels, null and repeated row ids, one-row classes and rows whose class has no cut."""
    labels = [("a", i) for i in range(40)] + [(None, i) for i in range(7)] + [("b", 3), ("c", None), ("c", None), ("c", 1), ("c", 1)]
    rows = spark.createDataFrame(labels, "label string, id long")
    cuts = split.split_cuts(rows, "label", "id", SEEDS)
    more = rows.unionByName(spark.createDataFrame([("new", 9)], rows.schema))
    by_cuts = split.apply_cuts(more, cuts, "label", "id", SEEDS)
    at_once = split.by_seed(split.with_parts(more, cuts, "label", "id", SEEDS))
    assert at_once.columns == by_cuts.columns and at_once.count() == len(SEEDS) * (len(labels) + 1)
    assert sorted(map(repr, at_once.collect())) == sorted(map(repr, by_cuts.collect()))


def test_a_method_sums_the_shares_of_its_features(spark):
    """A feature that a method has twice counts twice, an unknown one counts in the mean alone, masked leaks show the base."""
    rows = frames.split_leaky_orders(spark, SF_SMALL, several_uses=True)
    dataset, seed = rows.select("dataset", "seed").orderBy("dataset", "seed").first()
    leak = frames.LEAK_CATEGORICAL[0]
    picked = [("twice", "order_status"), ("twice", "order_status"), ("odd", "order_status"), ("odd", "no_such"), ("leak", leak)]
    ranked = spark.createDataFrame([(dataset, seed, m, f, i + 1, True, f == leak) for i, (m, f) in enumerate(picked)], "dataset string, seed int, method string, feature string, rank int, selected boolean, is_injected_leakage boolean")
    found = frames.predictions(rows, ranked).collect()
    scores = {(r.method, r.setting, r.row_id): r.score for r in found}
    base = frames._shares(rows.where(F.col("part") == "train")).where((F.col("dataset") == dataset) & (F.col("seed") == seed)).first()["base"]
    ids = {r.row_id for r in found}
    assert len(found) == 6 * len(ids) > 0
    for i in ids:
        assert scores["odd", "leaky", i] * 2 == scores["twice", "leaky", i] == scores["twice", "clean", i]
        assert scores["leak", "clean", i] == base / frames.MICRO
    assert any(scores["leak", "leaky", i] != base / frames.MICRO for i in ids)
