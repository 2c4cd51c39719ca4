import hashlib

import numpy as np
from pyspark.sql import functions as F

from tablelens.llm.bisector import Bisectors, cluster, inertia


def plain(vectors, k, rounds, levels=256):
    """The same clustering with Python integers: ids to (cluster, distance), and the centroids."""
    x = {i: [int(np.floor(levels * c)) for c in v] for i, v in vectors.items()}
    first = sorted(x, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:k]
    centres = [x[i] for i in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = {i: near(v)[1] for i, v in x.items()}
        for j in range(len(centres)):
            mine = [x[i] for i in x if own[i] == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return {i: near(v)[::-1] for i, v in x.items()}, centres


def test_against_plain_integers(spark):
    rng = np.random.default_rng(5)
    vectors = {i: (rng.normal(0, 1, 6) + 3 * (i % 5)).tolist() for i in range(300)} | {i: [0.0] * 6 for i in range(300, 310)}
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "vec_id long, embedding array<double>, cluster string")
    got, centres = cluster(df.repartition(5), k=12, rounds=5, dim=6)
    want, own = plain(vectors, 12, 5)
    assert centres == own
    assert {r.vec_id: (r.cluster, r.distance) for r in got.collect()} == want
    rows = inertia(got, centres).collect()
    assert {r.inertia for r in rows} == {sum(d for _, d in want.values())}
    assert all(r.cluster_inertia == sum(d for c, d in want.values() if c == r.cluster) for r in rows)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, own[r.cluster])).encode()).hexdigest() for r in rows)


def test_ties_go_to_the_smaller_number_and_large_components_stay_exact():
    centres = np.array([[4, 0], [0, 0], [4, 0], [2, 9]])
    assert Bisectors(centres).winners(np.array([[2, 0], [4, 0], [0, 0], [2, 8]], np.int64)).tolist() == [0, 0, 1, 3]
    big = (1 << 27) - 1
    planes = Bisectors(np.array([[big] * 64, [-big] * 64, [big] * 63 + [big - 1]], np.int64))
    x = np.array([[big] * 63 + [big - 1], [-big] * 64, [big] * 64, [0] * 64], np.int64)
    won = planes.winners(x)
    assert won.tolist() == [2, 1, 0, 2]  # the third centroid's norm is the smallest
    far = planes.distances(x[1:2], np.array([0]))
    assert int(far[0]) == 64 * (2 * big) ** 2


def test_odd_rows(spark):
    v = [0.5] * 4
    rows = [(1, v), (2, None), (3, []), (4, v[:3]), (5, [None] + v[1:]), (6, [float("nan")] + v[1:]), (7, [float("inf")] + v[1:]), (8, [1e17] + v[1:]),
            (9, [-0.25] * 4), (9, [3.0] * 4), (None, [2.0] * 4), (1, v)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, distance int")
    got, centres = cluster(df, k=40, rounds=5, dim=4)
    assert sorted((r.vec_id or 0, r.distance) for r in got.collect()) == [(0, 0), (1, 0), (1, 0), (9, 0), (9, 0)]
    assert len(centres) == 5 and centres[-1] == [512] * 4  # the null id last
    few, one = cluster(df, k=1, rounds=5, dim=4)
    assert {r.cluster for r in few.collect()} == {0} and one == [[(128 + 128 - 64 + 768 + 512) // 5] * 4]
    empty, none = cluster(df.limit(0), dim=4)
    assert none == [] and inertia(empty, none).count() == 0
    assert cluster(df.select(F.col("vec_id").alias("i"), F.col("embedding").alias("e")), k=2, dim=4, id_col="i", vector_col="e")[0].count() == 5
