"""Ball k-means over integer vectors, exact to the last unit and tie.

A cluster is a ball: its centroid and a radius that holds its members. Only a centroid nearer than twice the radius can
take a member away; those are the cluster's neighbours. A member at squared distance d from its centroid is out of a
neighbour's reach while 4 d is below the squared distance of the two centroids (the triangle inequality), so members below
that for the nearest neighbour form the stable core, which is compared with nothing, and the rest lie in annuli: one more
neighbour is compared exactly with each annulus outward. Radii need no pass of their own: after an update a ball is at
most its old radius and its centroid's shift wide.

Each round is one pass that assigns (a table in the shared folder, which replaces the one before) and one aggregation of
sums with partial sums in every task. The driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import discard, staged

#: Components of a vector, steps of one unit, clusters and rounds of the query.
WIDTH, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Integers beyond this size have distances beyond 64 bits.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as integers floor(scale * x), of the vectors with ``width`` finite components.

    Left out: null vectors, other widths, null, NaN or infinite components, and integers of more than LARGEST in size, whose
    distances no 64-bit number holds. Null ids and repeated rows stay, each row as a vector of its own.
    """

    def fits(x: Column) -> Column:
        y = x.cast("double") * scale
        return x.isNotNull() & ~F.isnan(y) & (F.abs(y) <= LARGEST)

    rows = vectors.filter((F.size(vector_col) == width) & F.forall(vector_col, fits))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``, ties by their components. Null ids start no cluster."""
    found = rows.filter(F.col("vec_id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    return np.array([r["v"] for r in found.orderBy("h", "v").limit(k).select("v").collect()], np.int64)


@dataclass(frozen=True)
class Balls:
    """Centroids with, for each, its neighbours from the nearest on and their squared distances."""

    centroids: np.ndarray
    neighbours: tuple[tuple[tuple[int, int], ...], ...]

    @staticmethod
    def of(centroids: np.ndarray, radii: list[int | None]) -> Balls:
        """radii: at least those of the balls, None for an empty one."""
        near = []
        for i, radius in enumerate(radii):
            apart = [(sum((int(a) - int(b)) ** 2 for a, b in zip(centroids[i], c, strict=True)), j) for j, c in enumerate(centroids) if j != i]
            near.append(() if radius is None else tuple((j, d) for d, j in sorted(apart) if d <= 4 * radius * radius))
        return Balls(centroids, tuple(near))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of vectors that have no cluster yet; ties go to the smaller number."""
    cluster, best = np.zeros(len(x), np.int64), squared(x, balls.centroids[0])
    for j in range(1, len(balls.centroids)):
        d = squared(x, balls.centroids[j])
        less = d < best
        cluster[less], best[less] = j, d[less]
    return cluster, best


def move(x: np.ndarray, before: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance under new centroids of vectors whose cluster was ``before``."""
    own = squared(x, balls.centroids[before])
    cluster, best = before.astype(np.int64), own.copy()
    for i in np.unique(before):
        outer = np.flatnonzero(before == i)
        for j, apart in balls.neighbours[i]:
            outer = outer[4 * own[outer] >= apart]  # the annuli from here outward
            if not len(outer):
                break
            d = squared(x[outer], balls.centroids[j])
            less = (d < best[outer]) | (d == best[outer]) & (j < cluster[outer])
            cluster[outer[less]], best[outer[less]] = j, d[less]
    return cluster, best


def assigned(rows: DataFrame, balls: Balls, width: int) -> DataFrame:
    """vec_id, v, cluster and distance of every row; rows has the column cluster from the second time on."""
    has = "cluster" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1)
                x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
                found = move(x, batch.column(2).to_numpy(zero_copy_only=False), balls) if has else nearest(x, balls)
                yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(found[0].astype(np.int32)), pa.array(found[1])], names=["vec_id", "v", "cluster", "distance"])

    return rows.select("vec_id", "v", *["cluster"] * has).mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def updated(rows: DataFrame, balls: Balls) -> Balls:
    """The floored means of the clusters, and balls round them; an empty cluster's centroid stays."""
    width = balls.centroids.shape[1]
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.array(*[F.sum(F.col("v")[i]) for i in range(width)]).alias("total"))
    centroids, radii = balls.centroids.copy(), [None] * len(balls.centroids)
    for r in sums.collect():  # a row for each cluster
        k = r["cluster"]
        centroids[k] = [t // r["n"] for t in r["total"]]
        shift = sum((int(a) - int(b)) ** 2 for a, b in zip(centroids[k], balls.centroids[k], strict=True))
        radii[k] = isqrt(r["far"]) + isqrt(shift) + 2
    return Balls.of(centroids, radii)


def ball_kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of ``whole_vectors``.

    Ties go to the smaller cluster number. With fewer than k vectors there are as many clusters as vectors with an id; with
    none the result is empty. Repeated rows count as often as they stand; null ids are assigned like others.
    """
    rows = whole_vectors(vectors, id_col, vector_col, width)
    spark = rows.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    start = first_centroids(rows, k, seed)
    if not len(start):
        return spark.createDataFrame([], schema)
    balls = Balls.of(start, [None] * len(start))
    at = staged(assigned(rows, balls, width), "balls")
    for _ in range(rounds):
        balls, before = updated(at, balls), at
        at = staged(assigned(before, balls, width), "balls")
        discard(before)
    sums = {r["cluster"]: r["s"] for r in at.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    about = [(i, sums.get(i, 0), sum(sums.values()), digest(c)) for i, c in enumerate(balls.centroids)]  # k rows
    known = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return at.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select(*[c.split()[0] for c in schema.split(", ")])


def kmeans_sql(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, width: int = WIDTH, scale: int = SCALE) -> str:
    """The same clusters by plain comparison of every vector with every centroid."""
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""kept as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
            where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is not null and isfinite(x) and abs({scale} * x::double) <= {LARGEST})) = {width})""",
        f"""c0 as (select (row_number() over (order by sha256('{seed}:' || vec_id), v) - 1)::integer as j, v as c from kept where vec_id is not null
            order by sha256('{seed}:' || vec_id), kept.v limit {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} as (select rid, j, {far}::bigint as d from kept, c{r})")
        parts.append(f"a{r} as (select rid, arg_min(j, (d, j)) as j, min(d) as d from d{r} group by rid)")
        if r < rounds:
            parts.append(f"s{r} as (select j, i, floor_div(sum(x), count(*)) as m from (select a.j, unnest(k.v) as x, unnest(range({width})) as i from a{r} a join kept k using (rid)) group by j, i)")
            parts.append(f"c{r + 1} as (select c.j, coalesce(m.c, c.c) as c from c{r} c left join (select j, list(m order by i) as c from s{r} group by j) m using (j))")
    floor_div = "case when sum(x) >= 0 then sum(x) // count(*) else -((-sum(x) + count(*) - 1) // count(*)) end::bigint"
    body = ",\n".join(parts).replace("floor_div(sum(x), count(*))", floor_div)
    return f"""with {body}
        select k.vec_id, a.j::integer as cluster, a.d as distance, (sum(a.d) over (partition by a.j))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,
            sha256(array_to_string(c.c, ',')) as centroid_sha256
        from a{rounds} a join kept k using (rid) join c{rounds} c on c.j = a.j"""
