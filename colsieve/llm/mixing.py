"""Mixing sources to target weights with hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colsieve.llm.shared import SPACE, attach, settle, table, with_copies

SHARE = 1.5
WEIGHTS = (5, 2, 1)
MOST = 2
#: The order of documents has 60 bits: two levels of buckets, and the rest is compared value by value.
HASH_BITS, LEVEL_BITS = 60, 12


def n_words(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def digest() -> Column:
    return F.coalesce(F.md5(F.encode("text", "UTF-8")), F.lit(""))


def place() -> Column:
    """Where a row (doc_id, digest, copy) stands in its source's order: 60 bits of a hash, the same in every run."""
    parts = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("copy").cast("string"))
    return F.conv(F.substring(F.md5(F.encode(parts, "UTF-8")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources in code point order, null last, get the weights in turn. Of ``share`` times all sizes each gets its
    weight's part, but at most ``most`` times its size; the excess goes to the others by weight until none is
    above. Solved at once: the sources whose limit is least for their weight fill up first. These windows run over
    one row per source, sums made before.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    whole = Window.partitionBy()
    fill = Window.orderBy((F.lit(float(most)) * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.lit(float(share)) * F.sum("source_size").over(whole)
    spent = F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    full = weighed.withColumn("budget", budget).withColumn("is_full", F.lit(float(most)) * F.col("source_size") * rest < F.col("weight") * (budget - spent))
    limit = F.lit(float(most)) * F.coalesce(F.sum(F.when(F.col("is_full"), F.col("source_size"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(whole)
    target = F.when(F.col("is_full"), F.lit(float(most)) * F.col("source_size")).otherwise(F.col("weight") * ((F.col("budget") - limit) / open_weight))
    return full.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, cut) from (source, place, size): all documents are taken ``passes`` times,
    those with place <= cut once more.

    Sizes are summed by source and leading bits of the place. Running sums find each source's bucket in which the
    rest of the budget ends; only that bucket is summed again, by the next bits, and at last place by place. The
    document in which the budget ends is taken if more than half of it fits. Documents are never sorted.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("passes", passes).withColumn("extra", F.col("target") - F.col("passes") * F.col("source_size"))
    state = settle(goals.withColumns({"low": F.lit(0).cast("long"), "base": F.lit(0).cast("long")}))
    for level in (1, 2):
        shift = HASH_BITS - level * LEVEL_BITS
        inside = attach(sized, state.select("source", "low", "base", "extra"), "source", "inner")
        if level > 1:
            inside = inside.where(F.shiftright("place", shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS))
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.first("base").alias("base"), F.first("extra").alias("extra"))
        running = Window.partitionBy("source").orderBy("bucket")
        ends = sums.withColumn("upto", F.col("base") + F.sum("size").over(running)).where(F.col("upto") > F.col("extra"))
        first = ends.groupBy("source").agg(F.min(F.struct("bucket", "upto", "size")).alias("b"))
        first = first.select("source", F.shiftleft("b.bucket", shift).alias("at"), (F.col("b.upto") - F.col("b.size")).alias("before"))
        found = state.alias("s").join(first.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left")
        state = settle(found.select(*[f"s.{c}" for c in goals.columns], F.coalesce("f.at", "s.low").alias("low"), F.coalesce("f.before", "s.base").alias("base")))
    inside = attach(sized, state.select("source", "low", "base", "extra"), "source", "inner").where(F.shiftright("place", shift) == F.shiftright("low", shift))
    sums = inside.groupBy("source", "place").agg(F.sum("size").alias("size"), F.first("base").alias("base"), F.first("extra").alias("extra"))
    upto = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("place"))
    last = sums.withColumn("upto", upto).where(F.col("upto") + (F.col("upto") - F.col("size")) <= 2 * F.col("extra"))
    last = last.groupBy("source").agg(F.max("place").alias("cut"))
    found = state.alias("s").join(last.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left")
    return settle(found.select("s.source", "s.source_size", "s.target", "s.passes", F.coalesce("f.cut", F.col("s.low") - 1).alias("cut")))


def _plan(docs: DataFrame, share: float, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    known = settle(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest().alias("digest")))
    placed = with_copies(known, ["source", "doc_id", "digest"]).withColumn("place", place())
    sized = settle(placed.drop("digest", "copy"))
    sizes = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    return sized, thresholds(sized.select("source", "place", "size"), targets(sizes, share, weights, most))


def _times() -> Column:
    return F.col("passes") + (F.col("place") <= F.col("cut")).cast("long")


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    Null texts have no words; null sources are one source. The order goes by id, text and, where rows repeat, the number of
    the copy, so that null and repeated ids are taken or left one by one. A source without words has target 0.
    """
    sized, cuts = _plan(docs, share, weights, most)
    return attach(sized, cuts, "source").select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mixed(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents as the mix takes them: a row for each time."""
    _, cuts = _plan(docs, share, weights, most)
    cuts = cuts.select("source", F.struct("passes", "cut").alias("_mix"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = with_copies(docs.select("source", "doc_id", digest().alias("digest"), whole), ["source", "doc_id", "digest"])
    placed = rows.select("source", place().alias("_place"), "_doc")
    marked = attach(placed, cuts, "source").withColumn("_times", F.col("_mix.passes") + (F.col("_place") <= F.col("_mix.cut")).cast("long"))
    return marked.where("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_doc.*")


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"))


#: The same rule with sorted running sums: words of a document count if its middle lies within its source's budget.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || SUBSTR(MD5(CONCAT(COALESCE(doc_id::VARCHAR, ''), ':', digest, ':', copy)), 1, 15))::BIGINT AS place
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, doc_id, digest) - 1 AS copy
        FROM (SELECT doc_id, source, text, COALESCE(MD5(text), '') AS digest FROM {documents}))
), named AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, 1.5::DOUBLE * SUM(source_size) OVER () AS budget,
         2.0::DOUBLE * source_size * (SUM(weight) OVER () - COALESCE(SUM(weight) OVER before, 0))
           < weight * (1.5::DOUBLE * SUM(source_size) OVER () - 2.0::DOUBLE * COALESCE(SUM(source_size) OVER before, 0)) AS is_full
  FROM named
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN 2.0::DOUBLE * source_size ELSE
           weight * ((budget - 2.0::DOUBLE * COALESCE(SUM(source_size) FILTER (is_full) OVER (), 0)) / SUM(weight) FILTER (NOT is_full) OVER ()) END AS target
  FROM filled
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size) ELSE 0 END::BIGINT AS passes FROM goals
), ordered AS (
  SELECT *, SUM(size) OVER (PARTITION BY source ORDER BY place) AS upto, SUM(size) OVER (PARTITION BY source, place) AS own FROM sized
)
SELECT {columns}
FROM ordered o JOIN parts p ON o.source IS NOT DISTINCT FROM p.source
"""
_TAKEN = "o.size * (passes + CASE WHEN upto + (upto - own) <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END)"

QUERIES = {"op8_mixing": op8_mixing}
SQL = {"op8_mixing": MIX_SQL.format(documents="documents", columns=f"doc_id, o.size, source_size, target, ({_TAKEN})::BIGINT AS taken")}
