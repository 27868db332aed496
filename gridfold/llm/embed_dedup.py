"""Embedding near-duplicates with a robust-pruned flat graph.

Vectors go to their nearest cluster centres, to more than one, so that shards
overlap. Each shard builds a navigable graph (robust pruning keeps a neighbour
only if no kept one is much nearer to it). The adjacency lists of a vector from
all its shards are united; every vector then searches the shards of its
nearest centres, greedily from their medoids, and expands from what is in range
until nothing new is. Where an edge leads out of the shards searched, the search
goes on in the shard it leads to, from the rows in range that are in both. Hits are verified in double precision, and recall by row is
audited against a scan of all rows; where it falls short, more shards are
searched, and after all of them the rows that may be short are scanned exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridfold.llm.common import map_columns
from gridfold.llm.components import components, local_roots
from gridfold.session import ship_package, stage

#: Rows that centres are fitted on, vectors of one shard (a larger one is dealt into
#: blocks), queries of one task, and rows whose neighbours the audit finds by a scan
#: (of those with links found, and of those without).
FIT_ROWS, SHARD, QUERIES, AUDIT = 20_000, 2_000, 2_000, 1_000
#: Audited rows that a group size needs to be judged by itself.
JUDGED = 30
#: Pairs of a query and a row looked at at once.
PAIRS = 1 << 20
#: Shards a vector is put in; out-degree; search list; pruning slack; nearest
#: neighbours that link back whatever pruning says.
OVERLAP, DEGREE, LIST, ALPHA, BACK = 2, 24, 32, 1.2, 4


def unit_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and v (unit length, doubles), v null where the vector can't link:
    null, empty, zero, or with a null or non-finite component."""

    def make():
        def unit(x):
            if x is None or len(x) == 0 or any(c is None for c in x):
                return None
            a = np.asarray(x, dtype=np.float64)
            big = np.abs(a).max()
            if not np.isfinite(big) or big == 0:
                return None
            a = a / big
            return (a / math.sqrt(a @ a)).tolist()

        return lambda ids, xs: {"vec_id": ids, "v": [unit(x) for x in xs]}

    return map_columns(vectors.select("vec_id", "embedding"), "vec_id long, v array<double>", make)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres by a few rounds of spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, width: int, least: float = np.inf) -> tuple[np.ndarray, np.ndarray, list]:
    """Greedy search for all rows of ``q`` at once: the ``width`` nearest rows of
    ``x`` found (-1: none), nearest first, which rows were seen, and as places
    (query, row) all of cosine >= ``least`` that were seen. Each step expands every query's nearest rows not yet expanded."""
    n, rows = len(q), np.arange(len(q))[:, None]
    ids = np.full((n, width), -1, dtype=np.int64)
    sims = np.full((n, width), -np.inf)
    done = np.ones((n, width), dtype=bool)
    ids[:, 0], sims[:, 0], done[:, 0] = start, q @ x[start], False
    seen = np.zeros((n, len(x)), dtype=bool)
    seen[:, start] = True
    step, active, hits = 4, np.arange(n), [(np.flatnonzero(sims[:, 0] >= least), np.full((sims[:, 0] >= least).sum(), start))]
    while len(active):
        open_ = ~done[active]
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :step]  # the nearest open places
        real = np.take_along_axis(open_, pick, axis=1)
        at = np.where(real, np.take_along_axis(ids[active], pick, axis=1), -1)
        done[active[:, None], pick] = True
        near = np.where(at[:, :, None] >= 0, graph[at], -1).reshape(len(active), -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[active[:, None], near]
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        found = np.full(near.shape, -np.inf)
        found[r, c] = np.einsum("ij,ij->i", x[near[r, c]], q[active[r]])
        hit = found[r, c] >= least
        hits.append((active[r[hit]], near[r[hit], c[hit]]))
        all_sims = np.concatenate([sims[active], found], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        sims[active] = np.take_along_axis(all_sims, order, axis=1)
        ids[active] = np.where(np.isfinite(sims[active]), np.take_along_axis(np.concatenate([ids[active], near], axis=1), order, axis=1), -1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), order, axis=1)
        active = active[~done[active].all(axis=1)]
    return ids, seen, hits


def robust_prune(x: np.ndarray, node: np.ndarray, pool: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """For each node, up to ``degree`` of its pool (-1: none): again and again the
    nearest one left, without those that are alpha times nearer to it than to the
    node (in squared distance on the unit sphere)."""
    pool = pool.copy()
    pool.sort(axis=1)
    dup = np.zeros(pool.shape, dtype=bool)
    dup[:, 1:] = pool[:, 1:] == pool[:, :-1]
    pool[dup | (pool == node[:, None])] = -1
    y = x[pool]
    far = np.where(pool >= 0, 2 - 2 * np.einsum("ijk,ik->ij", y, x[node]), np.inf)
    out = np.full((len(node), degree), -1, dtype=np.int64)
    left, rows = far.copy(), np.arange(len(node))
    for k in range(degree):
        best = left.argmin(axis=1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        out[some, k] = pool[some, best[some]]
        between = 2 - 2 * np.einsum("ijk,ik->ij", y, y[rows, best])
        left[(alpha * between <= far) & some[:, None]] = np.inf
        left[rows, best] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = LIST, seed: int = 3) -> tuple[np.ndarray, int]:
    """Adjacency (-1: none) and medoid. Rows are put in by batches in random order:
    each searches the graph so far, prunes what it met, and its neighbours prune
    it in."""
    n = len(x)
    mean = x.mean(axis=0)
    medoid = int((x @ mean).argmax())
    graph = np.full((n, degree), -1, dtype=np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])
    at, size = 1, 16
    while at < n:
        new = order[at:at + size]
        met, _, _ = search(x, graph, medoid, x[new], width)
        # those put in together may be each other's neighbours too
        own = x[new] @ x[new].T
        np.fill_diagonal(own, -np.inf)
        mates = new[np.argsort(-own, axis=1)[:, :min(8, len(new) - 1)]] if len(new) > 1 else np.full((1, 0), -1)
        graph[new] = robust_prune(x, new, np.concatenate([met, mates], axis=1), degree)
        src, dst = np.repeat(new, degree), graph[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        sort = np.argsort(dst, kind="stable")
        src, dst = src[sort], dst[sort]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        back = np.full((len(nodes), count.max(initial=0)), -1, dtype=np.int64)
        back[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        graph[nodes] = robust_prune(x, nodes, np.concatenate([graph[nodes], back], axis=1), degree)
        at, size = at + len(new), min(256, 2 * size)
    return graph, medoid


def in_range(x: np.ndarray, graph: np.ndarray, medoid: int, q: np.ndarray, least: float, width: int = LIST, known: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) places of cosine >= least: what a greedy search finds, and from
    there and from the places ``known`` to be in range (queries in order), as long
    as something new is in range, the neighbours of all of it."""
    n = len(x)
    chunk = max(1, min(512, (1 << 23) // n))
    for k in range(0, len(q), chunk):
        part = q[k:k + chunk]
        _, seen, todo = search(x, graph, medoid, part, min(width, n), least)
        if known:
            some = slice(*np.searchsorted(known[0], (k, k + len(part))))
            r, row = known[0][some] - k, known[1][some]
            new = ~seen[r, row]
            seen[r[new], row[new]] = True
            todo.append((r[new], row[new]))
        while todo:
            r, row = todo.pop()
            yield r + k, row
            for i in range(0, len(r), PAIRS // graph.shape[1] + 1):
                some = slice(i, i + PAIRS // graph.shape[1] + 1)
                near = graph[row[some]]
                pair = (r[some, None] * n + near)[near >= 0]
                pair = np.unique(pair[~seen.ravel()[pair]])
                seen.ravel()[pair] = True
                a, b = np.divmod(pair, n)
                hit = np.einsum("ij,ij->i", x[b], part[a]) >= least
                if hit.any():
                    todo.append((a[hit], b[hit]))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def _shards(one: DataFrame, centres: np.ndarray, probes: int, blocks: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows put into their nearest shards: each into one block of ``OVERLAP`` shards
    for the index, and into all blocks of ``probes`` shards as a query."""

    def make():
        def work(ids, copies, vs):
            out = {k: [] for k in ("shard", "vec_id", "copies", "v", "near", "rank")}
            near = np.argsort(-(np.array(vs) @ centres.T), axis=1, kind="stable")[:, :max(probes, OVERLAP)]
            for i, c, v, shards in zip(ids, copies, vs, near.tolist()):
                for rank, s in enumerate(shards):
                    for key, value in zip(out, (s, i, c, v, shards, rank)):
                        out[key].append(value)
            return out

        return work

    rows = map_columns(one.select("vec_id", "copies", "v"), "shard long, vec_id long, copies long, v array<double>, near array<long>, rank int", make)
    rows = rows.withColumn("blocks", F.element_at(F.array(*map(F.lit, blocks)), F.col("shard").cast("int") + 1))
    index = rows.where(F.col("rank") < OVERLAP).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    query = rows.where(F.col("rank") < probes).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    return index, query


def _build(index: DataFrame) -> DataFrame:
    """(vec_id, out): each vector's neighbours in all its shards, united."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["vec_id"].to_numpy()
        graph, _ = build_graph(_matrix(pdf["v"]).astype(np.float32))
        out = [ids[g[g >= 0]].tolist() for g in graph]
        # pruning may leave a row that no list holds: its nearest ones get it back
        for row, g in enumerate(graph[:, :BACK]):
            for near in g[g >= 0]:
                out[near].append(ids[row])
        return pd.DataFrame({"vec_id": ids, "out": out})

    lists = index.groupBy("shard", "block").applyInPandas(build, "vec_id long, out array<long>")
    return lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out"))


def _places(ids: np.ndarray, out: pd.Series) -> np.ndarray:
    """Adjacency of a shard from lists of ids: those of other shards fall out here,
    and are met where the search goes on in those shards."""
    size = out.str.len().to_numpy()
    order, flat = np.argsort(ids), np.concatenate(out.to_numpy()).astype(np.int64)
    at = np.searchsorted(ids, flat, sorter=order).clip(max=len(ids) - 1)
    at, row = order[at], np.repeat(np.arange(len(ids)), size)
    here = ids[at] == flat
    at, row = at[here], row[here]
    count = np.bincount(row, minlength=len(ids))
    graph = np.full((len(ids), max(1, count.max())), -1, dtype=np.int64)
    graph[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = at
    return graph


def _search(index: DataFrame, query: DataFrame, lists: DataFrame, least: float, probes: int) -> DataFrame:
    """Rows (a, root, shard, found) of each task: a link of a spanning tree of what
    it found; or (root and shard null) all rows verified for a; or (root null)
    those of them that are in another shard too, which is not among the
    ``probes`` nearest ones of a. ``known`` of a query are rows in range of it."""
    deals = query.groupBy("shard", "block").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("deals"))
    query = query.join(deals, ["shard", "block"]).withColumn("deal", F.pmod(F.xxhash64("vec_id", F.lit(1)), "deals"))
    index = index.join(lists, "vec_id").select("shard", "block", "vec_id", "v", "near", "out")
    index = index.join(deals, ["shard", "block"]).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).drop("deals")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "root": [], "shard": [], "found": []})
        ids, x, qids, q = left["vec_id"].to_numpy(), _matrix(left["v"]), right["vec_id"].to_numpy(), _matrix(right["v"])
        graph = _places(ids, left["out"])
        light = x.astype(np.float32)
        medoid = int((light @ light.mean(axis=0)).argmax())
        node = np.unique(np.concatenate([ids, qids]))
        root, of_row, of_query = np.arange(len(node)), np.searchsorted(node, ids), np.searchsorted(node, qids)
        found = [(np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32))]
        of_known = np.repeat(np.arange(len(qids)), right["known"].str.len().to_numpy())
        known = np.concatenate(right["known"].to_numpy()).astype(np.int64)
        order = np.argsort(ids)
        at = order[np.searchsorted(ids, known, sorter=order).clip(max=len(ids) - 1)]
        here = ids[at] == known  # the others are in other blocks
        for a, b in in_range(light, graph, medoid, q.astype(np.float32), least - 1e-4, known=(of_known[here], at[here])):
            sure = (qids[a] != ids[b]) & (np.einsum("ij,ij->i", q[a], x[b]) >= least)
            a, b = a[sure], b[sure]
            found.append((a.astype(np.int32), b.astype(np.int32)))
            root = local_roots(len(node), of_query[a], of_row[b], root)
        a, b = (np.concatenate(f) for f in zip(*found))
        off = np.flatnonzero(root != np.arange(len(node)))
        out = [_hits(node[off], node[root[off]], None, None)]
        some, rows = _lists(a, ids[b])
        out.append(_hits(qids[some], None, None, rows))
        homes, probed = np.stack(left["near"].to_numpy())[:, :OVERLAP], np.stack(right["near"].to_numpy())[:, :probes]
        for home in homes.T:
            new = (probed[a] != home[b][:, None]).all(axis=1) & (home[b] != key[0])
            some, rows = _lists(a[new] * (homes.max() + 1) + home[b[new]], ids[b[new]])
            some, shard = np.divmod(some, homes.max() + 1)
            out.append(_hits(qids[some], None, shard, rows))
        return pd.concat(out)

    keys = ["shard", "block", "deal"]
    query = query.select(*keys, "vec_id", "v", "near", "known")
    return index.groupBy(*keys).cogroup(query.groupBy(*keys)).applyInPandas(run, HITS)


HITS = "a long, root long, shard long, found array<long>"


def _hits(a: np.ndarray, root: np.ndarray | None, shard: np.ndarray | None, found: list | None) -> pd.DataFrame:
    whole = lambda x: pd.array([None] * len(a) if x is None else x, dtype="Int64")
    return pd.DataFrame({"a": a, "root": whole(root), "shard": whole(shard), "found": pd.Series([None] * len(a) if found is None else found, dtype=object)})


def _search_on(index: DataFrame, query: DataFrame, lists: DataFrame, blocks: list[int], least: float, probes: int) -> DataFrame:
    """Hits of all rounds: a round searches, for each query, the shards that rows in
    range of it are in and that it has not searched yet, until there is none."""
    spark = index.sparkSession
    rows = query.where("rank = 0 AND block = 0").select("vec_id", "v", "near")
    asked = query.select("vec_id", "shard").distinct()
    query = query.withColumn("known", F.array().cast("array<long>"))
    hits = None
    while True:
        new = stage(spark, _search(index, query, lists, least, probes), "vector-hits")
        hits = new.where("shard IS NULL") if hits is None else hits.union(new.where("shard IS NULL"))
        on = new.where("shard IS NOT NULL").groupBy(F.col("a").alias("vec_id"), "shard").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("known"))
        on = stage(spark, on.join(asked, ["vec_id", "shard"], "left_anti"), "vector-on")
        if on.isEmpty():
            return hits
        asked = asked.union(on.select("vec_id", "shard"))
        query = on.join(rows, "vec_id").withColumn("blocks", F.element_at(F.array(*map(F.lit, blocks)), F.col("shard").cast("int") + 1))
        query = query.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))


def _lists(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys, and the values of each."""
    order = np.argsort(key, kind="stable")
    some, first = np.unique(key[order], return_index=True)
    return some, np.split(value[order], first[1:]) if len(some) else []


def pairs_of(hits: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair verified for either of its ends, once."""
    each = hits.where("root IS NULL AND shard IS NULL").select("a", F.explode("found").alias("b"))
    return each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def count_links(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """(a, n, copies): the rows linked to a, and how many copies these stand for.
    A pair counts for both of its ends."""
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    many = one.where("copies > 1").select(F.col("vec_id").alias("b"), (F.col("copies") - 1).alias("more"))
    more = both.join(many, "b").groupBy("a").agg(F.sum("more").alias("more"))
    counts = both.groupBy("a").agg(F.count("*").alias("n")).join(more, "a", "left")
    return counts.select("a", "n", (F.col("n") + F.coalesce("more", F.lit(0))).alias("copies"))


def audit(units: DataFrame, counts: DataFrame, least: float, rows: int = AUDIT) -> list[tuple[int, int, float]]:
    """(true, found, weight) of audited rows that have true links, by a scan of all
    rows: the ``rows`` vectors with the smallest id hashes of those the index found
    links for, and as many of those it found none for. A row weighs as many
    rows as it was chosen from for each one chosen."""
    found = units.join(counts.select(F.col("a").alias("vec_id"), "n"), "vec_id", "left").select("vec_id", "v", F.coalesce("n", F.lit(0)).alias("n"))
    parts = [found.where("n > 0"), found.where("n = 0")]
    picked = [p.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toPandas() for p in parts]
    weights = [p.count() / max(1, len(x)) for p, x in zip(parts, picked)]
    some = pd.concat(picked)
    if not len(some):
        return []
    q, ids = _matrix(some["v"]), some["vec_id"].tolist()

    def make():
        def work(_, vs):
            n = np.zeros(len(ids), dtype=np.int64)
            for k in range(0, len(vs), 1000):
                n += (np.array(vs[k:k + 1000]) @ q.T >= least).sum(axis=0)
            return {"a": ids, "n": n.tolist()}

        return work

    scanned = map_columns(units.select("vec_id", "v"), "a long, n long", make).groupBy("a").agg((F.sum("n") - 1).alias("true"))
    true = {r["a"]: r["true"] for r in scanned.collect()}  # at most 2 * rows
    return [(true[i], min(n, true[i]), w) for p, w in zip(picked, weights) for i, n in zip(p["vec_id"], p["n"]) if true[i]]


def judge(audited: list[tuple[int, int, float]], recall: float) -> tuple[float, int | None]:
    """The lowest mean of found / true over the audited rows of a group size (1, 2-3,
    4-7, ... links), and the largest number of links of a size that falls short of
    ``recall`` (none: null). A size with few rows is judged with its neighbour."""
    if not audited:
        return 1.0, None
    true, found, weight = np.array(audited).T
    share, size, groups = found / true, np.frexp(true)[1], []
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        if groups and len(groups[-1]) < JUDGED:
            groups[-1] = np.concatenate([groups[-1], at])
        else:
            groups.append(at)
    if len(groups) > 1 and len(groups[-1]) < JUDGED:
        groups[-2:] = [np.concatenate(groups[-2:])]
    means = [float(np.average(share[g], weights=weight[g])) for g in groups]
    short = [2 ** int(size[g].max()) - 1 for g, m in zip(groups, means) if m < recall]
    return min(means), max(short, default=None)


def scan(rows: DataFrame, one: DataFrame, least: float) -> DataFrame:
    """Hits of ``rows`` (vec_id, v) among all of ``one``, by comparing each with each:
    blocks of both meet in one task."""
    n, m = one.count(), rows.count()
    deals, blocks = max(1, math.ceil(m / (5 * QUERIES))), math.ceil(n / SHARD)
    left = one.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("deal"))
    right = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(deals)).alias("deal"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def run(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "root": [], "shard": [], "found": []})
        ids, x, qids, q = left["vec_id"].to_numpy(), _matrix(left["v"]), right["vec_id"].to_numpy(), _matrix(right["v"])
        node = np.unique(np.concatenate([ids, qids]))
        root, of_row, of_query = np.arange(len(node)), np.searchsorted(node, ids), np.searchsorted(node, qids)
        out, step = [], max(1, PAIRS // len(ids))
        for k in range(0, len(q), step):
            a, b = np.nonzero((q[k:k + step] @ x.T >= least) & (qids[k:k + step, None] != ids))
            root = local_roots(len(node), of_query[a + k], of_row[b], root)
            some, found = _lists(a, ids[b])
            out.append(_hits(qids[some + k], None, None, found))
        off = np.flatnonzero(root != np.arange(len(node)))
        return pd.concat([*out, _hits(node[off], node[root[off]], None, None)])

    keys = ["block", "deal"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, HITS)


def dedup_vectors(vectors: DataFrame, least: float = 0.9, probes: int = 4, recall: float = 0.98, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall: one row per row of ``vectors``.

    Two vectors link at a cosine of ``least`` or more. ``n_links`` counts the other
    vectors linked directly, ``component_id`` is the smallest vec_id that links
    reach, ``kept`` whether that is the row's own. ``recall`` is the audited share
    of a row's links that are found, as a mean over the rows of the group size
    where it is lowest (null: no audited row has a link, or the row can't
    link). Below the asked one, twice as many shards are
    searched, up to all of them; if it is still short, all rows that have no
    more links than the short sizes are held against all others.

    Equal vectors are one class: one of them is indexed, and counts for all.
    Vectors that are null, empty, zero, or hold a null or non-finite component
    link with nothing. Rows without a vec_id link with nothing and have no
    component. Each row is a vector of its own, also where a vec_id is repeated;
    such rows link by their vectors alone.
    Vectors of different lengths are compared among their own length only. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stage(spark, unit_rows(vectors), "vectors")
    can = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    units = rows.where(can)
    found = rows.where(~can).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    lengths = [r[0] for r in units.select(F.size("v").alias("n")).distinct().orderBy("n").toLocalIterator()]
    for n in lengths:
        found = found.unionByName(_dedup(spark, units.where(F.size("v") == n), least, probes, recall, shard))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "recall")


def _counts(spark, hits: DataFrame, one: DataFrame) -> DataFrame:
    return stage(spark, count_links(stage(spark, pairs_of(hits), "vector-pairs"), one), "vector-counts")


def _dedup(spark, units: DataFrame, least: float, probes: int, recall: float, shard: int) -> DataFrame:
    """The same for vectors of one length, without those that link with nothing.

    Classes of equal vectors are numbered in the order of their smallest vec_id,
    so the smallest number of a component is that of its smallest vec_id."""
    ship_package(spark)
    classes = units.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = stage(spark, classes.sort("first").withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    one = classes.select(F.col("class").alias("vec_id"), "copies", "v")
    n = one.count()
    sample = _matrix(one.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toPandas()["v"])
    centres = kmeans(sample, max(1, min(math.ceil(OVERLAP * n / shard), len(sample) // 8)))
    index, _ = _shards(one, centres, OVERLAP, [1] * len(centres))
    blocks = [1] * len(centres)
    for r in index.groupBy("shard").count().toLocalIterator():  # a row for each centre
        blocks[r["shard"]] = math.ceil(r["count"] / (2 * shard))
    index = stage(spark, _shards(one, centres, OVERLAP, blocks)[0], "vector-index")
    lists = stage(spark, _build(index), "vector-graph")
    probes = min(probes, len(centres))
    while True:
        query = stage(spark, _shards(one, centres, probes, blocks)[1], "vector-queries")
        hits = _search_on(index, query, lists, blocks, least, probes)
        counts = _counts(spark, hits, one)
        audited = audit(one, counts, least)
        share, short = judge(audited, recall)
        if share >= recall or probes == len(centres):
            break
        probes = min(2 * probes, len(centres))
    if share < recall:
        few = one.join(counts, F.col("vec_id") == F.col("a"), "left").where(F.coalesce("n", F.lit(0)) <= short)
        rows = stage(spark, few.select("vec_id", "v"), "vector-short")
        hits = hits.union(stage(spark, scan(rows, one, least), "vector-scan"))
        counts = _counts(spark, hits, one)
        audited = audit(one, counts, least)
        share, _ = judge(audited, recall)
    roots = components(hits.where("root IS NOT NULL"), "a", "root")
    least_id = classes.select(F.col("class").alias("root"), F.col("first").alias("least_id"))
    whole = (
        classes.join(counts.withColumnRenamed("copies", "others"), F.col("class") == F.col("a"), "left")
        .join(roots, F.col("class") == F.col("node"), "left").join(least_id, "root", "left")
        .select("v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least_id", "first").alias("component_id"))
    )
    return units.join(whole, "v").select("vec_id", "n_links", "component_id", F.lit(share if audited else None).cast("double").alias("recall"))


def link_sql(least: float = 0.9) -> str:
    """DuckDB SQL for the rows of :func:`dedup_vectors` over ``embeddings``, comparing each
    vector with each. It misses no link, so its recall is 1 wherever vectors of a length have one."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
can AS MATERIALIZED (
  SELECT row, vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
  SELECT a.row, b.row AS other FROM can a JOIN can b ON a.row <> b.row AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {least}),
reach AS (SELECT row, row AS other FROM v UNION SELECT r.row, l.other FROM reach r JOIN link l ON l.row = r.other),
root AS (SELECT r.row, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.row = r.other GROUP BY r.row),
n AS (SELECT row, count(*) AS n_links FROM link GROUP BY row),
linked AS (SELECT DISTINCT len(e) AS length FROM can JOIN n USING (row))
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept,
       CASE WHEN can.row IS NOT NULL AND len(can.e) IN (SELECT length FROM linked) THEN 1.0::DOUBLE END AS recall
FROM v JOIN root ON root.row = v.row LEFT JOIN n ON n.row = v.row LEFT JOIN can ON can.row = v.row"""
