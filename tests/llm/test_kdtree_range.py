import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablelens.llm.kdtree import quantise, top_k


def test_components_beyond_exact_products(spark):
    """Vectors whose products could leave the whole numbers that doubles hold take no part, and none ends the query."""
    edge = (2.0 ** 53 / 2) ** 0.5
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.25]), (1, [1e17, 0.0]), (2, [1e308, 1.0]), (3, [-1e19, 0.0]), (4, [edge / 256 * 0.999, 1.0]), (5, [0.0, -1.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.expr("vec_id % 50 = 0"))
    ids = {r["vec_id"] for r in got.collect()}
    assert ids == {0, 50, 4, 5}


def test_quantise_range():
    ok, big, inf, empty, null = quantise(pa.array([[0.5, -0.001], [1e17, 0.0], [float("inf"), 0.0], [], None], pa.list_(pa.float64())), 256)
    assert np.frombuffer(ok, np.int64).tolist() == [128, -1] and big is inf is empty is null is None
