"""MinHash near-duplicates: banded candidates, pruned by sequential Bayesian comparison, confirmed on whole sets.

A document's set holds its different shingles. Documents are linked if their sets' similarity (shared by all) reaches a
threshold. Equal sets are one node, whatever their number. Nodes that agree in a band of their signatures meet in a
bucket; there only nodes of different components are compared, signature batch by signature batch, and those that the
posterior does not rule out are compared on their sets. A bucket gives as many links as hold its members together, not
all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colsieve.llm.shared import LOOKUP_BYTES, SPACE, components, find_words, hash_words, mix, settle, table, text_bytes, written

SHINGLE, PERCENT = 3, 85
#: A pair at the threshold shares no band with probability (1 - 0.85**5)**24 < 1e-6.
BANDS, ROWS = 24, 5
#: Bands that are gone through together: what the first ones link is not compared again in later ones.
ROUNDS = ((0, 6), (6, 24))
#: Signature rows that are compared at a time, and the probability of ruling out a pair that is similar enough.
BATCH, MISS = 12, 1e-6
#: Members of a bucket that are compared in one task; a larger bucket is cut into cells of such parts, none is skipped.
CELL = 512
#: Links that a task reads when components are made.
EDGES = 100_000
#: Bytes of text that are hashed at once.
_BLOCK = 1 << 21
_N = BANDS * ROWS
_SEEDS = mix(np.arange(1, _N + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(_SEEDS) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its different shingles; a text with fewer words has one, of all its words."""
    firsts, ends = find_words(data, offsets)
    words = hash_words(data, firsts, ends)
    cuts = np.searchsorted(firsts, offsets)
    for a, b in zip(cuts, cuts[1:]):
        n = min(shingle, b - a)
        if not n:
            yield np.zeros(0, np.uint64)
            continue
        joined = np.full(b - a - n + 1, n, np.uint64)
        for k in range(n):
            joined = mix(joined ^ words[a + k : b - n + 1 + k])
        yield np.unique(joined)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each hash function over each set (none empty), a row a set."""
    out = np.empty((len(sets), _N), np.uint64)
    at = 0
    while at < len(sets):
        to, size = at + 1, len(sets[at])
        while to < len(sets) and size + len(sets[to]) <= 1 << 15:
            size += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]])]).astype(np.int64) if to - at > 1 else np.zeros(1, np.int64)
        for k in range(_N):
            out[at:to, k] = np.minimum.reduceat((flat ^ _SEEDS[k]) * _FACTORS[k], starts)
        at = to
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A key for each band of each signature, other in other bands."""
    rows = mins.reshape(len(mins), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        keys = mix(keys ^ rows[:, :, k])
    return keys.view(np.int64)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each number of batches compared, the fewest matching rows with which a pair may still be similar enough.

    Rows match with probability s for pairs of similarity s, and one time in 256 by their last byte alone. After m
    matches in n rows and a uniform prior the posterior of that probability is Beta(m + 1, n - m + 1); its mass above
    the threshold t is the chance of at most m successes in n + 1 draws with t.
    """
    t = percent / 100 + (1 - percent / 100) / 256

    def above(m: int, n: int) -> float:
        return sum(math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))

    return [next(m for m in range(n + 1) if above(m, n) >= miss) for n in range(BATCH, _N + 1, BATCH)]


def possible(one: np.ndarray, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the signatures ``others`` may belong to sets similar to that of ``one``: batch by batch, those ruled out are left."""
    alive, count = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        count = count + np.count_nonzero(others[alive, part] == one[part], axis=1)
        keep = count >= need
        if not keep.all():
            alive, count = alive[keep], count[keep]
        if not len(alive):
            break
    return alive


def similar(one: np.ndarray, others: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which of the sets are similar enough, exactly."""
    sizes = np.array([len(s) for s in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    shared = np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * shared >= percent * (len(one) + sizes - shared)


# Per row: sets, signatures.


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices of about _BLOCK bytes of text, so that a worker holds little beside the batch."""
    sizes = np.diff(text_bytes(batch.column("text"))[1])
    part = (np.cumsum(sizes) - sizes) // _BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _row(text: Column) -> Column:
    """Tells rows with one doc_id and unlike texts apart."""
    return F.xxhash64(text)


def _sets_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def marked(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, n_shingles, key, bands, sig) of every row; key, bands and sig are null if the set is empty.

    key names the set, sig holds the last byte of each row of the signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole) if len(whole) else ():
                sets = list(shingle_sets(*text_bytes(batch.column("text")), shingle))
                full = [s for s in sets if len(s)]
                mins = signatures(full)
                bands = band_keys(mins)
                low = (mins & np.uint64(255)).astype(np.uint8)
                order = iter(range(len(full)))
                at = [next(order) if len(s) else None for s in sets]
                columns = [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_sets_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if k is None else bands[k] for k in at], pa.list_(pa.int64())),
                    pa.array([None if k is None else low[k].tobytes() for k in at], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_shingles", "key", "bands", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _row(F.col("text")).alias("row"), "text").mapInArrow(run, f"doc_id {kind}, row long, n_shingles long, key binary, bands array<long>, sig binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(key, hashes) of the sets of some rows, ``wanted`` (doc_id, row, key), made from their texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole) if len(whole) else ():
                sets = shingle_sets(*text_bytes(batch.column("text")), shingle)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "hashes"])

    rows = wanted.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "key")
    n = rows.count()
    lookup = F.broadcast(rows) if n * 48 <= LOOKUP_BYTES else rows
    texts = docs.select("doc_id", _row(F.col("text")).alias("row"), "text").join(lookup, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    return texts.select("key", "text").dropDuplicates(["key"]).mapInArrow(run, "key binary, hashes binary")


# Per bucket: cells of members, compared across components.


def cells(members: DataFrame, alone: bool, parted: bool) -> DataFrame:
    """(bucket, band, part, other, own, key, comp, asks) from members (bucket, band, key, comp): who is compared with whom.

    In a cell, the members that ask are held against all others of another component. Only buckets with two components
    are looked at. With ``alone`` the buckets over CELL members are cut into parts, each compared in itself. Without it
    every bucket is compared as a whole: the members outside its largest component ask, and where they or the bucket
    are too many for a cell, each part of those that ask meets each part of the bucket. own: the part in which a member
    was compared alone (``parted``: large buckets were), or -1.
    """
    by_comp = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    buckets = by_comp.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("main")).where("size > main.n")
    buckets = buckets.select("bucket", F.ceil(F.col("size") / CELL).alias("parts"), F.ceil((F.col("size") - F.col("main.n")) / CELL).alias("askers"), F.col("main.comp").alias("main"))
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    kept = ("bucket", "band", "key", "comp")
    if alone:
        placed = members.join(buckets.where("parts > 1"), "bucket")
        return placed.select(*kept, part.alias("part"), F.lit(0).alias("other"), F.lit(-1).alias("own"), F.lit(True).alias("asks"))
    own = (F.when(F.col("parts") > 1, part).otherwise(-1) if parted else F.lit(-1)).alias("own")
    placed = members.join(buckets, "bucket")
    asks = ~F.col("comp").eqNullSafe(F.col("main"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    single = (F.col("parts") == 1) & (F.col("askers") == 1)
    whole = placed.select(*kept, part.alias("part"), every("askers").alias("other"), own, (asks & single).alias("asks"))
    asking = placed.where(asks & ~single).select(*kept, F.pmod(F.xxhash64("key", F.lit(1)), F.col("askers")).cast("int").alias("other"), every("parts").alias("part"), own, F.lit(True).alias("asks"))
    return whole.unionByName(asking)


def _gathered(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy("bucket", "part", "other").agg(F.collect_list(F.struct(*columns)).alias("members"))


_CELL_SCHEMA = "bucket long, part int, other int, key binary, comp binary, asks boolean, sig binary"


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, _N)


def _columns(members: pa.StructScalar, names: tuple[str, ...]) -> list[list]:
    values = members.values
    return [values.field(n).to_pylist() for n in names]


def screened(rows: DataFrame, least: list[int]) -> DataFrame:
    """The members of cells for whom some signature of another component is possible, and those it belongs to.

    A pair that agrees in an earlier band, or that was compared in a part of its bucket, is not looked at again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("part", pa.int32()), ("other", pa.int32()), ("key", pa.binary()), ("comp", pa.binary()), ("asks", pa.bool_()), ("sig", pa.binary())])
        for batch in batches:
            out = []
            for bucket, part, other, members in zip(*(batch.column(c) for c in ("bucket", "part", "other")), batch.column("members")):
                keys, comps, asks, sigs, own = _columns(members, ("key", "comp", "asks", "sig", "own"))
                earlier = members.values.field("earlier").flatten().to_numpy(zero_copy_only=False)
                earlier, own = earlier.reshape(len(keys), len(earlier) // len(keys)), np.array(own)
                table_, found = _matrix(sigs), np.zeros(len(keys), bool)
                number = {c: k for k, c in enumerate(comps)}
                of = np.array([number[c] for c in comps])
                for k in np.flatnonzero(asks):
                    rest = np.flatnonzero((of != of[k]) & ((own != own[k]) | (own < 0)))
                    near = rest[possible(table_[k], table_[rest], least)]
                    near = near[~(earlier[near] == earlier[k]).any(axis=1)]
                    if len(near):
                        found[near] = found[k] = True
                out += [(bucket.as_py(), part.as_py(), other.as_py(), keys[k], comps[k], asks[k], sigs[k]) for k in np.flatnonzero(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)

    return _gathered(rows, ["key", "comp", "asks", "sig", "own", "earlier"]).mapInArrow(run, _CELL_SCHEMA)


def confirmed(rows: DataFrame, least: list[int], percent: int) -> DataFrame:
    """(a, b): similar sets of different components in a cell, enough of them to hold together what is similar there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("members"):
                keys, comps, asks, sigs, hashes = _columns(members, ("key", "comp", "asks", "sig", "hashes"))
                sets, table_ = [np.frombuffer(h, np.uint64) for h in hashes], _matrix(sigs)
                number = {c: k for k, c in enumerate(comps)}
                of = np.array([number[c] for c in comps])
                for k in np.flatnonzero(asks):
                    rest = np.flatnonzero(of != of[k])
                    rest = rest[possible(table_[k], table_[rest], least)]
                    for block in np.array_split(rest, len(rest) // 64 + 1):
                        block = block[of[block] != of[k]]
                        if len(block):
                            for hit in block[similar(sets[k], [sets[j] for j in block], percent)]:
                                if of[hit] != of[k]:
                                    a.append(keys[k])
                                    b.append(keys[hit])
                                    of[of == of[hit]] = of[k]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return _gathered(rows, ["key", "comp", "asks", "sig", "hashes"]).mapInArrow(run, "a binary, b binary")


def linked(docs: DataFrame, sets: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame | None:
    """(node, component) of the nodes of ``sets`` (key, doc_id, row, bands, sig) that are similar to others, or None if none is.

    Signatures travel to the buckets with two components, sets only for members that some signature leaves possible.
    """
    least, found, comps = least_matches(percent), [], None
    for low, high in ROUNDS:
        nodes = sets.select("key", F.posexplode(F.slice("bands", low + 1, high - low)).alias("band", "bucket")).withColumn("band", F.col("band") + low)
        crowded = settle(nodes.groupBy("bucket").count().where("count > 1"))
        n_buckets, largest = crowded.agg(F.count(F.lit(1)), F.max("count")).first()
        if not n_buckets:
            continue
        buckets = crowded.select("bucket")
        nodes = settle(nodes.join(F.broadcast(buckets) if n_buckets * 16 <= LOOKUP_BYTES else buckets, "bucket"))
        # Parts of large buckets are linked first, while every node is a component of its own.
        parted = comps is None and largest > CELL
        for alone in (True, False) if parted else (False,):
            if comps is None:
                members = nodes.withColumn("comp", F.col("key"))
            else:
                members = nodes.join(comps.select(F.col("node").alias("key"), F.col("component").alias("comp")), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
            placed = cells(members, alone, parted).join(sets.select("key", "sig", "bands"), "key")
            rows = placed.withColumn("earlier", F.slice("bands", F.lit(1), F.col("band"))).drop("bands")
            some = settle(screened(rows, least))
            if some.isEmpty():
                continue
            wanted = settle(sets.select("key", "doc_id", "row").join(some.select("key").distinct(), "key"))
            full = written(whole_sets(docs, wanted, shingle), "minhash-sets")
            new = settle(confirmed(some.join(full, "key"), least, percent).distinct())
            if not new.isEmpty():
                found.append(new)
                comps = settle(components(reduce(DataFrame.union, found), EDGES))
    return comps


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Rows whose sets share at least ``percent`` of all their shingles are linked; component_id is the least doc_id that
    links lead to. Null, empty and blank texts have an empty set and are linked with nothing. Repeated rows are rows of
    their own. A row without doc_id belongs to a component but names none; kept says whether doc_id and component_id
    are equal, both missing included. Other columns are not read.
    """
    rows = written(marked(docs, shingle), "minhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    sets = rows.where("key is not null").groupBy("key").agg(first, F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    sets = written(sets.select("key", "least.doc_id", "least.row", "bands", "sig"), "minhash-sets")
    comps = linked(docs, sets, percent, shingle)
    ids = sets.select("key", "doc_id")
    if comps is not None:
        joined = settle(ids.join(comps.withColumnRenamed("node", "key"), "key"))
        named = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        placed = joined.join(named, "component").select("key", "component_id")
        ids = ids.join(placed.withColumnRenamed("component_id", "_linked").withColumn("_is", F.lit(True)), "key", "left")
        ids = ids.select("key", F.when(F.col("_is"), F.col("_linked")).otherwise(F.col("doc_id")).alias("doc_id"))
    ids = settle(ids.withColumnRenamed("doc_id", "component_id"))
    empty = rows.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = rows.where("key is not null").select("doc_id", "n_shingles", "key").join(ids, "key").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


SQL = {
    "op11_minhash": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACE}]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
cells AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM cells a JOIN cells b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least_of AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(least(m, doc_id), doc_id) AS component_id, coalesce(least(m, doc_id), doc_id) = doc_id AS kept
FROM sets LEFT JOIN least_of USING (doc_id)"""
}
QUERIES = {"op11_minhash": op11_minhash}
