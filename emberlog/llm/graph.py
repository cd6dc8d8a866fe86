"""Links, components and groups of any size, without a task or driver that holds a group.

``components`` alternates large and small stars on distributed edges. ``deal`` splits a
group of n members into blocks and gives every pair of blocks a unit of its own, so that
all pairs of a group are met while no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(id, component) of every id in edges (a, b) but the least of each component.

    ``component`` is the least id that the edges reach. Also gives the scratch paths that
    the result reads. Each round is written to the shared folder, so nothing is lost with
    an executor; rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    tidy = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, path = store.save(tidy)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = now.select(F.col("v").alias("u")).distinct()
        state = now.agg(F.count("*").alias("n"), F.countDistinct("u").alias("k")).first()
        if state["n"] == state["k"] and now.join(roots, "u", "left_semi").limit(1).count() == 0:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")), [path]
        # written, so that Spark can split the join where an id has very many neighbours
        least, least_path = store.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = store.save(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = store.save(small)
        store.drop(spark, path, large_path, least_path)
        now, path = new, new_path


def deal(members: DataFrame, key: str, by: str, block: int, weight: str | None = None, heaviest: int = 0) -> DataFrame:
    """``members`` of groups of two and more, with unit, blk, lo and hi.

    A group of up to ``block`` members (and, of a column ``weight``, up to ``heaviest`` in sum)
    is one unit (lo = hi = 0). No group has more blocks than members. A larger one is cut by a hash of column ``by`` into blocks, and
    each pair lo <= hi of them is a unit.
    """
    parts = F.ceil(F.count("*") / block)
    if weight:
        # more blocks than members would only copy members that are heavy alone
        parts = F.greatest(parts, F.least(F.ceil(F.sum(weight) / heaviest), F.count("*")))
    counts = members.groupBy(key).agg(F.count("*").alias("n_members"), parts.cast("int").alias("n_blocks")).where("n_members > 1")
    cut = members.join(counts, key)
    cut = cut.withColumn("blk", F.pmod(F.xxhash64(by, F.lit(17)), F.col("n_blocks").cast("long")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    cut = cut.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
    return cut.withColumn("unit", F.xxhash64(key, "lo", "hi")).drop("n_members", "n_blocks", "other")


def whole_groups(it: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end with a group's end, and the offsets of their groups.

    The rows come sorted by ``key``, an integer that is never null.
    """
    held: list[pa.RecordBatch] = []

    def out():
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()  # the rows are held once, while a group is worked on
        k = t.column(key).to_numpy()
        return t, np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])

    last = None
    for b in it:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        if held and k[0] != last:
            yield out()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            held.append(b.slice(0, cut))
            yield out()
        held.append(b.slice(cut))
        last = k[-1]
    if held:
        yield out()


def stars(adjacent: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(id, least id) of the components of a small adjacency matrix; those alone are left out."""
    n = len(ids)
    label = np.arange(n)
    seen = np.zeros(n, bool)
    for i in np.flatnonzero(adjacent.any(1)):
        if seen[i]:
            continue
        group = np.zeros(n, bool)
        front = np.zeros(n, bool)
        front[i] = True
        while front.any():
            group |= front
            front = adjacent[front].any(0) & ~group
        seen |= group
        label[group] = i
    out = []
    for i in np.unique(label[seen]):
        members = ids[label == i]
        least = members.min()
        out += [(int(x), int(least)) for x in members if x != least]
    return out
