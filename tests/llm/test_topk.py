import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.llm.topk import top_k_products


def brute(rows, k, asked):
    whole = [
        (i, [math.floor(1024 * x) for x in v]) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in {(i, tuple(v)) for i, v in whole if asked(i)}:
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(b) == len(a))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_agrees_with_brute_force(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 12))
    rows = [(i, [float(np.float32(x)) for x in (base[i % 8] + 0.1 * rng.normal(size=12)) * rng.choice([0.01, 1, 30])]) for i in range(600)]
    rows += [(600, None), (601, []), (602, [1.0] * 11 + [None]), (603, [1.0] * 11 + [float("nan")]), (604, [float("inf")] * 12), (None, [1.0] * 12)]
    rows += [(700, rows[0][1]), (700, rows[0][1]), (701, rows[0][1]), (800, [1.0, 2.0]), (801, [2.0, 1.0]), (803, [0.0] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = top_k_products(frame, F.col("vec_id") % 20 == 0, k=10, block=block).collect()
    float32 = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(float32, 10, lambda i: i % 20 == 0)


def test_empty_table(spark):
    assert top_k_products(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0
