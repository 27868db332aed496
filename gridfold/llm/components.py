"""Connected components of links, in one task and over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridfold.session import stage


def local_roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of the component of each of 0..n-1 under links a-b,
    going on from ``roots`` of earlier links."""
    root = np.arange(n) if roots is None else roots
    while True:
        ra, rb = root[a], root[b]
        off = ra != rb
        if not off.any():
            return root
        a, b, ra, rb = a[off], b[off], ra[off], rb[off]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that
    its links reach. By alternating stars: each node hands its larger, then its
    smaller neighbours to its smallest one, until every edge points at a root,
    after about log(longest path) rounds. Each round is written to the shared
    folder. All steps are aggregates and joins on one node, which skewed hubs
    leave to partial aggregation and to the skew-join split."""
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    e, before = stage(spark, e, "components"), None
    mark = [F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))]
    while (now := e.agg(*mark).first()) != before and now[0]:
        before = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        star = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(star, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        e = stage(spark, small.union(star).distinct(), "components")
    nodes = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.union(e.select("lo", "lo").distinct())
