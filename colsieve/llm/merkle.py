"""Merkle manifest of a table: one digest over all rows, and proofs of single rows.

Rows are leaves. Within a group (``lang``) eight consecutive nodes have a parent, level by level; the groups' roots
are leaves of one more such tree. Null ids stand first in their group, equal ids are ordered by their leaf, null groups
come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colsieve.llm.shared import settle, table

FANOUT = 8
#: Levels that one block of FANOUT**LEVELS neighbouring nodes climbs without another shuffle.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a row's fields, each with its length in bytes; null is told from empty."""
    return digest(*map(_field, fields.values()))


def _key(group: Column) -> Column:
    """A key that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with idx, gapless from 0 within ``grp`` by ``order`` (nulls first), and n, the group's rows.

    A range partitioning deals groups and places out evenly, however large a group is or how often a row is repeated;
    each piece is counted and the counts before it are added.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["grp", *order, "_tie"]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    placed = settle(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_piece", F.shiftright("_at", 33)))
    counts = placed.groupBy("grp", "_piece").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("grp")  # a row a piece
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("grp", "_piece", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    return placed.join(counts, ["grp", "_piece"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_piece", "_shift")


def climbed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (grp, idx, n, h, ...) with block, steps and top.

    Within a block of FANOUT**LEVELS nodes each level's nodes stand in the rows of their first descendants, so that a
    node's siblings are a fixed number of rows before and after it: lag and lead columns, masked by the slot in the run
    and the run's length. The first child's row hashes the parent, which is its row's node on the next level. steps:
    the siblings (left, right) of the row's ancestors, from its own level up; levels above a group's root have none.
    top: the digest that the block's first row arrives at, null in others.
    """
    order = Window.partitionBy("grp", "block").orderBy("idx")
    rows = nodes.withColumn("block", F.expr(f"idx div {FANOUT**LEVELS}")).withColumn("_h", F.col("h"))
    for level in range(LEVELS):
        step = FANOUT**level
        count = F.expr(f"(n + {step - 1}) div {step}")
        slot = F.expr(f"idx div {step} % {FANOUT}")
        length = F.least(F.lit(FANOUT), count - F.expr(f"idx div {step * FANOUT} * {FANOUT}"))
        stands, is_open = F.col("idx") % step == 0, count > 1
        left = [F.when(slot >= k, F.lag("_h", step * k).over(order)).otherwise("") for k in range(FANOUT - 1, 0, -1)]
        right = [F.when(slot + k < length, F.lead("_h", step * k).over(order)).otherwise("") for k in range(1, FANOUT)]
        rows = rows.withColumn("_step", F.when(stands & is_open, F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right"))))
        parent = F.when(is_open, digest(F.col("_h"), F.col("_step.right"))).otherwise(F.col("_h"))
        rows = rows.withColumn("_h", F.when(F.col("idx") % (step * FANOUT) == 0, parent)).withColumnRenamed("_step", f"_step{level}")
    # The nearest row before that stands for a node of a level is the ancestor's.
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = F.array(*[F.last(f"_step{level}", ignorenulls=True).over(sofar) for level in range(LEVELS)])
    return rows.withColumn("steps", F.filter(steps, lambda s: s.isNotNull())).withColumnRenamed("_h", "top").drop(*[f"_step{level}" for level in range(LEVELS)])


def storeys(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Settled tables of nodes, each holding the tops of the blocks of the one before, and (grp, h) of the roots."""
    floors = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    size = FANOUT**LEVELS
    while True:
        tops = climbed(floors[-1]).where(f"idx % {size} = 0").select("grp", F.col("block").alias("idx"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("h"))
        tops = settle(tops)
        if largest <= size:
            return floors, tops.select("grp", "h")
        largest = -(-largest // size)
        floors.append(tops)


def paths(floors: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest nodes with the steps up to their group's root and on through ``above`` (grp, steps, ...).

    What belongs to a group reaches its rows block by block, so that no group's rows meet in one task.
    """
    values = [c for c in above.columns if c not in ("grp", "steps")]
    above = above.withColumn("idx", F.lit(0).cast("long"))
    for floor in reversed(floors):
        own = [c for c in floor.columns if floor is floors[0] or c in ("grp", "idx")]
        upper = above.select("grp", F.col("idx").alias("block"), F.col("steps").alias("_on"), *values)
        joined = climbed(floor).select(*own, "block", "steps").join(upper, ["grp", "block"])
        above = joined.select(*own, *values, F.concat("steps", "_on").alias("steps"))
    return above


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, start, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(docs: DataFrame, tampered: Column | None = None, group: str = "lang", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; more columns are not read.

    ``tampered``: another text to prove against the manifest in place of the row's (null: its own). Repeated rows are
    leaves of their own; an empty table has no rows and no root. Texts are read once and don't move: 64 digits a row
    are sorted and shuffled.
    """
    own = {c: F.col(c) for c in fields}
    other = leaf(own | {"text": tampered}) if tampered is not None else F.lit(None).cast("string")
    changed = F.when(tampered.isNotNull(), other) if tampered is not None else other
    leaves = settle(docs.select(_key(F.col(group)).alias("grp"), "doc_id", leaf(own).alias("h"), changed.alias("changed")))
    floors, subroots = storeys(settle(numbered(leaves, ["doc_id", "h"])))
    listed = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "h"), ["of"])
    upper, roots = storeys(settle(listed))
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    tops = paths(upper, roots.select("grp", nothing.alias("steps"), F.col("h").alias("root")))
    proved = paths(floors, tops.select(F.col("of").alias("grp"), "steps", F.col("h").alias("subroot"), "root"))
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    found = proved.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), fold(F.coalesce("changed", "h"), F.col("steps")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document by its id's checksum is proved with a lower-cased text; a row without id keeps its own."""
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", _UPPER, _LOWER))
    return manifest(table(spark, sf, "documents"), lowered)


def _crc32(value: str) -> str:
    """DuckDB has no checksum: the bits one by one, by the reversed polynomial."""
    state = f"xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr({value}, (k // 8 + 1)::BIGINT, 1)) ELSE 0 END)"
    return f"xor(list_reduce(range(8 * length({value})), lambda c, k: xor({state} >> 1, 3988292384 * ({state} & 1)), 4294967295::BIGINT), 4294967295)"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in (*FIELDS[:-1], text)) + ")"


_SIBLINGS = """SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY level, grp, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY level, grp, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY level, grp) AS n FROM {nodes}) WHERE n > 1"""
_PARENTS = """SELECT level + 1, grp, idx // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {nodes}) WHERE n > 1 GROUP BY level, grp, idx // 8"""

SQL = {
    "op12_merkle": f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_sql_leaf("text")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 AND text IS NOT NULL THEN {_sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS row FROM texts),
nodes(level, grp, idx, h) AS (SELECT 0, grp, idx, leaf FROM leaves UNION ALL {_PARENTS.format(nodes="nodes")}),
subroots AS (SELECT grp, arg_max(h, level) AS h FROM nodes GROUP BY grp),
listed AS (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS idx FROM subroots),
tops(level, grp, idx, h) AS (SELECT 0, '', idx, h FROM listed UNION ALL {_PARENTS.format(nodes="tops")}),
root AS (SELECT arg_max(h, level) AS root FROM tops),
low AS ({_SIBLINGS.format(nodes="nodes")}), high AS ({_SIBLINGS.format(nodes="tops")}),
steps AS (
  SELECT d.row, s.level, s.l, s.r FROM leaves d JOIN low s ON s.grp = d.grp AND s.idx = d.idx // (8 ** s.level)::BIGINT
  UNION ALL
  SELECT d.row, 100 + s.level, s.l, s.r FROM leaves d JOIN listed t USING (grp) JOIN high s ON s.idx = t.idx // (8 ** s.level)::BIGINT),
ordered AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY level) AS k FROM steps),
folds(row, k, h) AS (
  SELECT row, 0, coalesce(changed, leaf) FROM leaves
  UNION ALL SELECT f.row, f.k + 1, sha256(o.l || f.h || o.r) FROM folds f JOIN ordered o ON o.row = f.row AND o.k = f.k + 1),
proofs AS (SELECT row, string_agg(l || r, '' ORDER BY k) AS proof FROM ordered GROUP BY row),
folded AS (SELECT row, arg_max(h, k) AS folded_root FROM folds GROUP BY row)
SELECT d.doc_id, d.leaf, s.h AS subroot, root.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.folded_root, f.folded_root = root.root AS verified
FROM leaves d JOIN subroots s USING (grp) JOIN folded f USING (row) LEFT JOIN proofs p USING (row) CROSS JOIN root"""
}
QUERIES = {"op12_merkle": op12_merkle}
