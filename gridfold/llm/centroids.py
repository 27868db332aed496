"""Centroid clustering of integer vectors with Spark's own expressions.

Distances are integer sums over ``zip_with`` and ``aggregate`` against centroids
written into the plan, the least (distance, number) struct names the cluster,
and one sum per component makes the next centroids.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from gridfold.session import stage

#: Largest component, in size, for which every squared distance fits a long at 64 components.
LARGEST = 1 << 27


def quantize(vectors: DataFrame, components: int, scale: int) -> DataFrame:
    """vec_id, q: vectors of ``components`` finite numbers, each as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    sound = (F.size("embedding") == components) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    q = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    return vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", q.alias("q"))


def assigned(centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid to ``q``; ties go to the smaller number."""
    each = (f"struct(aggregate(zip_with(q, array({', '.join(f'{v}L' for v in c)}), (x, y) -> (x - y) * (x - y)), 0L, (t, s) -> t + s) AS distance, {k} AS cluster)"
            for k, c in enumerate(centroids))
    return F.expr(f"array_min(array({', '.join(each)}))")  # as one text: a call for each literal is slow


def moved(q: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: floor of each component's mean, an empty one as it was."""
    near = q.select("q", assigned(centroids)["cluster"].alias("cluster"))
    sums = [F.expr(f"sum(q[{i}]) AS s{i}") for i in range(len(centroids[0]))]
    out = list(centroids)
    for row in near.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row per centroid
        out[row["cluster"]] = [s // row["n"] for s in row[2:]]
    return out


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 per kept vector.

    Vectors that are null, of another length, or hold null or non-finite
    components are left out. The first centroids are the ``k`` vectors with the
    smallest sha256 of ``seed:vec_id``, in that order (equal ids: the smaller vector
    first; a null id hashes as nothing). With fewer vectors there are fewer
    centroids. Repeated rows are kept and count each; an empty table gives an empty
    result; other columns are ignored. A component over 2^27 in size after
    scaling is refused, for its squared distances would not fit a long.
    """
    spark = vectors.sparkSession
    q = stage(spark, quantize(vectors, components, scale), "centroid-vectors")
    largest = q.agg(F.max(F.array_max(F.transform("q", lambda v: F.abs(v))))).first()[0]
    if largest is not None and largest > LARGEST:
        raise ValueError(f"a component is {largest} after scaling; at most {LARGEST} can be clustered")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [r["q"] for r in q.select("q", name.alias("name")).orderBy("name", "q").limit(k).collect()]
    if not centroids:
        return q.select("vec_id", *(F.lit(0).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    for _ in range(rounds):
        centroids = moved(q, centroids)
    near = stage(spark, q.select("vec_id", F.inline(F.array(assigned(centroids)))), "centroid-assigned")
    sums = {r["cluster"]: r["s"] for r in near.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = [(c, s, sum(sums.values()), shas[c]) for c, s in sums.items()]
    facts = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: The same in DuckDB's SQL, every round spelled out.
def centroid_sql(k: int = 16, rounds: int = 3, components: int = 64, scale: int = 64) -> str:
    steps = [f"""q AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS INTEGER) AS cluster, q AS c FROM q ORDER BY sha256('1:' || vec_id), q LIMIT {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""n{r} AS MATERIALIZED (SELECT row, vec_id, any_value(q) AS q, min(d) AS distance, arg_min(cluster, d * {k} + cluster) AS cluster FROM
  (SELECT row, vec_id, q, cluster, list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM q, c{r}) GROUP BY row, vec_id)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT cluster, i, sum(v) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS v, generate_subscripts(q, 1) AS i FROM n{r}) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(f.c, c{r}.c) AS c FROM c{r} LEFT JOIN
  (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{r} GROUP BY cluster) f ON f.cluster = c{r}.cluster)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, n{rounds}.cluster, distance, CAST(sum(distance) OVER (PARTITION BY n{rounds}.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM n{rounds} JOIN c{rounds} ON c{rounds}.cluster = n{rounds}.cluster"""
