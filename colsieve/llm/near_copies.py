"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colsieve.llm.shared import components, settle, table

BITS = 64
SHINGLE, RADIUS = 3, 3
SEED = 42
#: Buckets of more fingerprints than this are split again by finer masks.
BUCKET = 1024
#: Masks are refined until this many bits are free: a bucket then has 2**14 different fingerprints at most.
FREE_BITS = 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text: the bits set in over half of its shingles' hashes; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        pieces, n = [b" ".join(words)], 1
    else:
        pieces, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter((hashed(x, SEED) for x in pieces), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        rows = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _digest() -> Column:
    """Key of equal texts; a null one is a text of its own."""
    return F.md5(F.encode("text", "UTF-8"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: str) -> DataFrame:
    """(doc_id, fp, …): the fingerprint of every whole text as a signed long, and the columns ``more``."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64))

    return docs.select("doc_id", fp("text").alias("fp"), *more)


def cover(bits: list[int], radius: int) -> list[int]:
    """Masks over ``bits`` such that any two words that differ in at most ``radius`` of them agree under some mask.

    Every bit gets a non-zero vector of radius + 1 binary digits; the mask of a vector a keeps the bits whose
    vectors have an odd product with a. Up to ``radius`` vectors always leave some a orthogonal to all of them,
    and its mask drops just such bits.
    """
    many = 2 ** (radius + 1) - 1
    return [sum(1 << bit for k, bit in enumerate(bits) if ((k % many + 1) & a).bit_count() % 2) for a in range(1, many + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _keys(rows: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(cover, key, fp) for each row and each (cover, mask)."""
    under = F.array(*[F.struct(F.lit(c).cast("long").alias("cover"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for c, m in masks])
    return rows.select("fp", F.explode(under).alias("k")).select("k.cover", "k.key", "fp")


def _within(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that hold together what lies within ``radius`` bits, directly or by steps: one fewer than members, not all pairs."""
    left, found = fps, []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                reached.extend(left[near])
                found += [(int(x), int(y)) for y in left[near]]
                left = left[~near]
    return found


def links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): enough links between the different fingerprints of ``rows`` (fp) to connect all within ``radius`` bits.

    Buckets of two are compared at once; larger ones are gathered and spanned. Buckets over BUCKET go to finer
    masks over the bits that their mask dropped: such a cover of the free bits loses no pair, and with FREE_BITS
    free bits a bucket is bounded by their values. No pair is ever skipped.
    """

    def span(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [p for fps in batch["fps"] for p in spanning(np.asarray(fps, np.int64), radius)]
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    every = (1 << BITS) - 1
    masks = list(enumerate(cover(list(range(BITS)), radius)))
    keyed, found = _keys(rows, masks), None
    while True:
        free = max((~m & every).bit_count() for _, m in masks)
        buckets = settle(keyed.groupBy("cover", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
        few = F.lit(True) if free <= FREE_BITS else F.col("n") <= BUCKET
        pairs = buckets.where((F.col("n") == 2) & _within("a", "b", radius)).select("a", "b")
        some = keyed.join(buckets.where((F.col("n") > 2) & few).select("cover", "key"), ["cover", "key"], "left_semi")
        spanned = some.groupBy("cover", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).select("fps").mapInPandas(span, "a long, b long")
        found = pairs.union(spanned) if found is None else found.union(pairs).union(spanned)
        hot = buckets.where(~few)
        if free <= FREE_BITS or hot.isEmpty():
            return found.distinct()
        crowd = keyed.join(hot.select("cover", "key"), ["cover", "key"], "left_semi")
        finer = {c: [m | x for x in cover([b for b in range(BITS) if not m >> b & 1], radius)] for c, m in masks}
        parts = F.create_map(*[x for c, ms in finer.items() for x in (F.lit(c).cast("long"), F.array(*[F.struct(F.lit(c * len(ms) + i).cast("long").alias("cover"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(ms)]))])
        keyed = settle(crowd.select("fp", F.explode(parts[F.col("cover")]).alias("k")).select("k.cover", F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"), "fp").distinct())
        masks = [(c * len(ms) + i, m) for c, ms in finer.items() for i, m in enumerate(ms)]


def _reached(each: DataFrame, radius: int) -> DataFrame:
    """(fp, component) of all different fingerprints ``each`` (fp, …); a component is named by its least one."""
    found = components(links(each.select("fp"), radius))
    return each.select("fp").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    Documents are linked if their fingerprints differ in at most ``radius`` bits; component_id is the least doc_id
    that links lead to, its own included. Null and empty texts have fingerprint 0 and link like others. Copies are
    one fingerprint, whatever their number. A row without doc_id belongs to a component but names none.
    """
    marked = settle(fingerprints(docs, shingle))
    each = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = each.join(_reached(each, radius), "fp")
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = settle(joined.join(named, "component").select("fp", "component_id"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents without near-copies: of each component one row stays, the one with the least doc_id, nulls last; among
    its texts the one with the least digest. Rows equal in both are one, whichever extra columns they have.
    """
    marked = settle(fingerprints(docs.withColumn("_digest", _digest()), shingle, "_digest"))
    rows = marked.groupBy("fp", "doc_id", "_digest").agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_digest", "_n")
    each = settle(rows.groupBy("fp").agg(F.min(order).alias("least")))
    kept = each.join(_reached(each, radius), "fp").groupBy("component").agg(F.min("least").alias("k"))
    kept = settle(kept.select(F.col("k.doc_id").alias("_doc"), F.col("k._digest").alias("_kept"), F.col("k._n").alias("_n")))
    found = docs.withColumn("_digest", _digest()).join(kept, F.col("_digest").eqNullSafe(F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    once = found.where("_n = 1").union(found.where("_n > 1").dropDuplicates(["doc_id", "_digest"]))
    return once.select(docs.columns)


def op10_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    found = near_copies(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_near_copies": op10_near_copies}
SQL: dict[str, str] = {}
