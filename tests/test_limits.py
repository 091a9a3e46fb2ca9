"""Results must not depend on sizes: both ways of each operator, with nulls, many classes and many categories."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from colsieve.operators import metrics, prep, profile, stats, target
from colsieve.plans import experiment, settle
from colsieve.plans.ranking import number_rows
from colsieve.functions.scores import or_default

CODES = ["12D", "3f", "0x1p3", "1e3", " 7 ", "-.5", "+4.", "1_000", "inf", "nan", "", ".", "e5", "12 3", "NaN", None]


@pytest.mark.parametrize("limit", [10, 500_000])
def test_ranks_with_null_keys(spark, limit):
    df = spark.createDataFrame([(None if i % 2 else i % 6, i) for i in range(100)], "g int, v int")
    got = number_rows(df, ["g"], [F.col("v")], limit=limit)
    assert got.count() == 100
    assert sorted(r["rank"] for r in got.where("g is null").collect()) == list(range(1, 51))


@pytest.mark.parametrize("limit", [5, 500_000])
def test_missing_scores_are_lowest_both_ways(spark, limit):
    rows = [("a", i % 2, None if i % 5 == 0 else float("nan") if i % 7 == 0 else i / 60) for i in range(60)] + [(None, 1, 0.5), (None, 0, None)]
    df = spark.createDataFrame(rows, "cell string, label int, score double")
    got = {r.cell: (round(r.auroc, 9), round(r.auprc, 9)) for r in metrics.ranking_metrics(df, ["cell"], limit).collect()}
    key = lambda s: -1.0 if s is None else 99.0 if s != s else s
    for cell, (auroc, _) in got.items():
        own = [(y, key(s)) for c, y, s in rows if c == cell]
        pairs = [(p, n) for y, p in own if y for z, n in own if not z]
        assert auroc == round(sum((p > n) + (p == n) / 2 for p, n in pairs) / len(pairs), 9)
    small = {r.cell: round(r.auprc, 9) for r in metrics.ranking_metrics(df, ["cell"]).collect()}
    assert {c: v for c, (_, v) in got.items()} == small


@pytest.mark.parametrize("limit", [0, 100_000])
def test_normalise_and_attach_keep_null_groups(spark, limit, monkeypatch):
    monkeypatch.setattr(settle, "BROADCAST_BYTES", settle.BROADCAST_BYTES if limit else -1)
    df = spark.createDataFrame([("x", 1.0), (None, 2.0), (None, 4.0)], "dataset string, importance double")
    got = sorted((r.dataset or "", r.stat_score) for r in stats.normalise(df, ["dataset"]).collect())
    assert got == [("", 0.0), ("", 1.0), ("x", 0.5)]


def test_only_decimal_text_is_a_number(spark):
    df = spark.createDataFrame([(c,) for c in CODES], "c string")
    got = [r[0] for r in df.select(profile.parsed_number("c")).collect()]
    assert got == [None, None, None, 1000.0, 7.0, -0.5, 4.0, None, float("inf"), None, None, None, None, None, None, None]
    assert df.select(or_default(F.col("c"), 9.0)).first()[0] == 9.0
    codes = spark.createDataFrame([(f"{i}D",) for i in range(50)], "code string")
    assert profile.coerce_numeric(codes, ["code"]).dtypes == [("code", "string")]
    with pytest.raises(ValueError, match="no numbers"):
        target.median_binary(codes, "code")


def test_many_classes(spark):
    rows = spark.range(10_000).select((F.col("id") % 5000).cast("string").alias("y"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    prepared = stats.prepare(rows, ["a", "b"], "y")
    got = stats.forest_importances(prepared, trees=1, max_depth=1).collect()
    assert {r.feature for r in got} == {"a", "b"}
    assert prepared.rows.select("label").distinct().count() == 5000


def test_many_categories_fit(spark):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("c"), (F.col("id") % 2).cast("string").alias("y"), F.rand(1).alias("n"))
    encoder = prep.fit_encoder(rows, ["c", "n"])
    assert encoder.sizes == {"c": 200_000} and encoder.categories == {}
    one = encoder.transform(rows.where("c = '77'")).first()["features"]
    assert one.size == 200_001 and one.numNonzeros() == 2


def test_listed_and_joined_categories_agree(spark):
    train = spark.createDataFrame([("b", "x"), ("a", None), ("c", "y"), ("b", "y")], "c string, d string")
    new = spark.createDataFrame([("zzz", "x"), (None, "y"), ("c", None)], "c string, d string")
    listed, joined = prep.fit_encoder(train, ["c", "d"]), prep.fit_encoder(train, ["c", "d"], listed=0)
    assert listed.slots() == joined.slots() and joined.dictionary is not None
    shown = [sorted(map(str, e.transform(new).select("features").collect())) for e in (listed, joined)]
    assert shown[0] == shown[1]


def test_null_targets_change_nothing(spark):
    from colsieve.sources.snapshots import LabelledTable, TableSpec

    rows = spark.range(240).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "no").otherwise("yes").alias("y"), (F.col("id") % 2).cast("double").alias("signal"),
        ((F.col("id") * 37) % 11).cast("double").alias("noise"),
    )
    more = rows.union(rows.limit(24).select(F.col("row_id") + 1000, F.lit(None).cast("string"), "signal", "noise"))
    catalog = spark.createDataFrame([("t", f, f, False) for f in ("signal", "noise")], "dataset string, feature string, description string, is_injected_leakage boolean")
    table = LabelledTable(TableSpec("t", "y"), rows, ["signal", "noise"], catalog, [])
    settings = experiment.RunSettings(seeds=[1], trees=5, max_depth=3, k_ratio=0.5)
    raw = experiment.offline_semantic(catalog)
    shown = [sorted((r.method, r.leaky_auroc, r.leaky_f1) for r in experiment.run_main(t, raw, settings).metrics.collect()) for t in (table, replace(table, rows=more))]
    assert shown[0] == shown[1]
    assert max(r[1] for r in shown[0]) == 1.0


def test_row_ids_do_not_follow_the_layout(spark):
    from colsieve.sources.snapshots import _with_row_id

    df = spark.createDataFrame([(i % 10, "same") for i in range(40)], "a int, b string")
    ids = [sorted((r.a, r.row_id) for r in _with_row_id(d, "row_id").collect()) for d in (df, df.repartition(5))]
    assert ids[0] == ids[1] and len({i for _, i in ids[0]}) == 40


def test_examples_of_sparse_columns_share_passes(spark):
    """The number of jobs must not follow the number of sparse columns."""
    df = spark.range(3000).select(F.col("id").alias("row_id"), *[F.when(F.col("id") % 700 == i % 600, F.concat(F.lit(f"v{i}-"), "id")).alias(f"c{i}") for i in range(60)])
    names = [f"c{i}" for i in range(60)]
    group = spark.sparkContext
    group.setJobGroup("examples", "examples")
    found = profile._examples(df, names, "row_id")
    jobs = len(group.statusTracker().getJobIdsForGroup("examples"))
    group.setLocalProperty("spark.jobGroup.id", None)
    for i, c in enumerate(names):
        assert found[c] == [f"v{i}-{x}" for x in range(i % 600, 3000, 700)][:4]
    assert jobs <= 12


def test_medians_in_batches(spark, monkeypatch):
    from colsieve.plans import order_stats

    df = spark.range(101).select(*[((F.col("id") * 7 + i) % 101).cast("double").alias(f"c{i}") for i in range(40)])
    together = order_stats.exact_medians(df, df.columns)
    monkeypatch.setattr(order_stats, "TOGETHER", 250)
    assert order_stats.exact_medians(df, df.columns) == together == {c: 50.0 for c in df.columns}
    assert order_stats.exact_medians(df, df.columns[:3], limit=10) == {c: 50.0 for c in df.columns[:3]}
