"""Sharding by balanced label propagation: linked documents move together, sizes stay even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colsieve.llm.shared import attach, row_hash, same_text, settle, table, with_copies

SHARDS = 8
#: Documents stand in an order of 24 hashed bits; linked ones by 12 bits of their link, then 12 of their own.
BITS, HALF = 24, 12
#: Documents are dealt out by size, those over the first part of a shard first, so that smaller ones level the sizes.
TIERS = (1 / 16, 1 / 128, 1 / 1024)
#: Rows numbered by one task, about.
NUMBERED = 20_000
#: A link that more documents share is dealt out over several tasks of a join.
HOT_LINK = 10_000


def _hash(bits: int, *what: str | Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*what), 64 - bits)


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(lane, number, cut) for goals (lane, number, goal): the place in the order of ``rows`` (lane, spot, size) up to
    which the sizes of a lane come nearest to the goal.

    Sizes are summed by the first half of the bits; only the piece that holds the goal is summed by the other half.
    Running sums go over 2**12 sums at most, rows are never sorted.
    """
    unit = 1 << HALF
    top = rows.groupBy("lane", F.shiftright("spot", HALF).alias("top")).agg(F.sum("size").alias("size"))
    top = top.withColumn("upto", F.sum("size").over(Window.partitionBy("lane").orderBy("top")))
    over = top.join(F.broadcast(goals), "lane").where(F.col("upto") > F.col("goal"))
    piece = over.groupBy("lane", "number").agg(F.min(F.struct("top", (F.col("upto") - F.col("size")).alias("before"), "goal")).alias("p")).select("lane", "number", "p.*")
    inside = rows.withColumn("top", F.shiftright("spot", HALF)).join(F.broadcast(piece), ["lane", "top"])
    leaf = inside.groupBy("lane", "number", "goal", "before", "spot").agg(F.sum("size").alias("size"))
    leaf = leaf.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("lane", "number").orderBy("spot")))
    last = leaf.where(2 * F.col("upto") - F.col("size") <= 2 * F.col("goal")).groupBy("lane", "number").agg(F.max("spot").alias("last"))
    found = piece.join(last, ["lane", "number"], "left").select("lane", "number", F.coalesce("last", F.col("top") * unit - 1).alias("cut"))
    return goals.select("lane", "number").join(F.broadcast(found), ["lane", "number"], "left").select("lane", "number", F.coalesce("cut", F.lit((1 << BITS) - 1)).alias("cut"))


def _cut_values(rows: DataFrame, goals: list[tuple[int, int, float]]) -> dict[tuple[int, int], int]:
    """The cuts of a few goals, one number for each shard."""
    if not goals:
        return {}
    found = cuts(rows, rows.sparkSession.createDataFrame(goals, "lane int, number int, goal double"))
    return {(r.lane, r.number): r.cut for r in found.collect()}


def _sizes(rows: DataFrame, shards: int) -> list[int]:
    """Sum of sizes in each shard."""
    found = {r.shard: r.size for r in rows.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _by_shard(values: dict[int, int], shard: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), shard)


def propagate(linked: DataFrame, shards: int, target: float, rounds: int) -> DataFrame:
    """``linked`` (…, link, link_rows, size, spot, shard) with the shards that label propagation ends at.

    In each round every link's sizes by shard are summed and joined back to its documents. A document votes for
    the shard where most of its neighbours are, among those below their quota, if that beats its own; neighbours count
    up to the room that is left, so that a full shard's last sliver draws no large link; ties go to the shard with most room. Movers to a shard are admitted in hash order of their links, so that whole links come
    along, until linked documents fill it to ``target``. Stops when nothing moves.
    """
    salt = F.when(F.col("link_rows") > HOT_LINK, F.pmod(F.xxhash64("spot"), F.ceil(F.col("link_rows") / HOT_LINK))).otherwise(0)
    state = settle(linked.withColumn("salt", salt.cast("int")))
    for _ in range(rounds):
        room = [max(0.0, target - x) for x in _sizes(state, shards)]
        ranks = {s: i for i, s in enumerate(sorted(range(shards), key=lambda s: (room[s], -s)))}
        opened = [s for s in range(shards) if room[s] > 0]
        if not opened:
            break
        tally = state.groupBy("link", "shard").agg(F.sum("size").alias("votes"), F.max("link_rows").alias("link_rows"))
        fits = F.least(F.col("votes").cast("double"), _by_shard(dict(enumerate(room)), F.col("shard")))
        voted = F.struct(fits.alias("fits"), "votes", _by_shard(ranks, F.col("shard")).alias("rank"), "shard")
        wish = tally.groupBy("link").agg(
            F.max(F.when(F.col("shard").isin(opened), voted)).alias("best"), F.map_from_entries(F.collect_list(F.struct("shard", "votes"))).alias("votes"), F.max("link_rows").alias("n")
        )
        copies = wish.where("best is not null").select("link", "best", "votes", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HOT_LINK, F.ceil(F.col("n") / HOT_LINK) - 1).otherwise(0).cast("int"))).alias("salt"))
        own = F.struct(F.element_at("votes", F.col("shard")).alias("votes"), _by_shard(ranks, F.col("shard")).alias("rank"))
        better = F.coalesce(F.struct("best.votes", "best.rank") > own, F.lit(False))
        asked = settle(state.join(copies, ["link", "salt"], "left").withColumn("lane", F.when(better, F.col("best.shard"))).drop("best", "votes"))
        movers = asked.where("lane is not null")
        at = _cut_values(movers, [(s, 0, room[s]) for s in opened])
        allowed = _by_shard({s: at[s, 0] for s in opened}, F.col("lane"))
        moves = F.col("lane").isNotNull() & (F.col("spot") <= allowed)
        if asked.where(moves).isEmpty():
            break
        state = settle(asked.withColumn("shard", F.when(moves, F.col("lane")).otherwise(F.col("shard"))).drop("lane"))
    return state.drop("salt")


def level(linked: DataFrame, free: DataFrame, shards: int, target: float) -> DataFrame:
    """All rows with a shard: linked ones stay up to the target, the others fill what is left.

    What linked documents have beyond a shard's target becomes free. Free documents are dealt out in proportion to the
    room, the large ones first, by cuts in their hash order. Each tier corrects the last one's error, which is at most
    about one of its documents.
    """
    size = _sizes(linked, shards)
    over = {s: x for s, x in enumerate(size) if x > target}
    if over:
        at = _cut_values(linked.withColumn("lane", F.col("shard")), [(s, 0, target) for s in over])
        stays = F.coalesce(F.col("spot") <= _by_shard({s: at[s, 0] for s in over}, F.col("shard")), F.lit(True))
        free = free.unionByName(linked.where(~stays))
        linked = linked.where(stays)
        size = _sizes(linked, shards)
    free = free.withColumn("spot", _hash(BITS, "mark", F.lit("free")).cast("int"))
    done = linked
    free = free.select(linked.columns)
    tier = F.lit(len(TIERS))
    for i in reversed(range(len(TIERS))):
        tier = F.when(F.col("size") > TIERS[i] * target, i).otherwise(tier)
    tiers = settle(free.withColumns({"tier": tier, "lane": F.lit(0)}))
    totals = {r.tier: r.total for r in tiers.groupBy("tier").agg(F.sum("size").alias("total")).collect()}
    for i in sorted(totals):
        some, total = tiers.where(F.col("tier") == i).drop("tier"), totals[i]
        if not total:  # documents without size
            done = done.unionByName(some.drop("lane").withColumn("shard", F.pmod("spot", F.lit(shards)).cast("int")))
            continue
        room = [max(0.0, target - x) for x in size]
        if not sum(room):
            room = [1.0] * shards
        goals = [(0, s, total * sum(room[: s + 1]) / sum(room)) for s in range(shards - 1)]
        at = _cut_values(some, goals)
        passed = F.array(*[F.lit(at[0, s]) for s in range(shards - 1)])
        placed = some.withColumn("shard", F.size(F.filter(passed, lambda c: c < F.col("spot")))) if shards > 1 else some.withColumn("shard", F.lit(0))
        placed = placed.drop("lane").withColumn("shard", F.col("shard").cast("int"))
        size = [a + b for a, b in zip(size, _sizes(placed, shards))]
        done = done.unionByName(placed)
    return done


def numbered(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Add ``slot``: numbers from 0 without gaps in each shard, in hash order. Pieces of a shard are counted, then numbered alone."""
    bits = min(BITS, max(0, total // (shards * NUMBERED)).bit_length())
    rows = rows.withColumn("leaf", _hash(BITS, "mark").cast("int")).withColumn("leaf", F.shiftright("leaf", BITS - bits))
    counts = rows.groupBy("shard", "leaf").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "leaf", before.alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "leaf").orderBy("mark"))
    return rows.withColumn("row", within).join(starts, ["shard", "leaf"]).withColumn("slot", F.col("start") + F.col("row") - 1).drop("leaf", "row", "start")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """``docs`` (doc_id, link, size, …) with ``shard`` and ``slot``; documents with the same ``link`` belong together.

    Shards are near equal by size; a link is cut only where a quota demands it. Documents start where a hash puts
    them, move by label propagation, and the ones without partners level the sizes. A null link, or one that a single
    document has, links nothing. Rows that are equal throughout are told apart by their number. Propagation ends when nothing moves, or
    after ``rounds``, by default one for each shard: a round fills at least one shard for a link that is too large
    for one. The result depends on the rows alone, not on their partitions.
    """
    rounds = shards if rounds is None else rounds
    copies = with_copies(settle(docs), docs.columns)
    rows = settle(copies.withColumn("mark", F.xxhash64(row_hash(*docs.columns), "copy")).drop("copy"))
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    target = (total or 0) / shards
    spot = (_hash(HALF, "link") * (1 << HALF) + _hash(HALF, "mark")).cast("int")
    start = F.pmod(F.xxhash64("mark", F.lit("start")), F.lit(shards)).cast("int")
    shared = settle(rows.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("link_rows")).where("link_rows > 1"))
    known = settle(attach(rows, shared, "link").withColumns({"spot": spot, "shard": start}))
    linked = propagate(known.where("link_rows is not null"), shards, target, rounds)
    free = known.where("link_rows is null")
    placed = settle(level(linked.select(known.columns), free, shards, target).select(*rows.columns, "shard"))
    return numbered(placed, count, shards).drop("mark")


def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), same_text(F.col("text")).alias("link"))
    found = shard_documents(rows, SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_sharding": op1_sharding}
SQL: dict[str, str] = {}
