import math

import numpy as np
import pytest

from tonegauge.llm import branch_bound, rpforest, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, block long"


def rows(n=600, dim=24, seed=0):
    r = np.random.default_rng(seed)
    out = [(i, [float(x) for x in np.float32(r.normal(size=dim) / math.sqrt(dim))]) for i in range(n)]
    out[7] = (7, out[3][1])
    out[9] = (9, out[20][1])
    bad = [(1000, None), (1020, [None] + [0.1] * (dim - 1)), (1040, [float("nan")] * dim), (1060, [float("inf")] + [0.0] * (dim - 1)),
           (1080, []), (None, out[0][1]), (1100, [0.0] * dim), (40, out[40][1]), (41, out[41][1]), (2000, [0.5, 0.25]), (2001, [0.5, -1.0])]
    return out + bad


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1, 5, 6) for i, v in data], SCHEMA).repartition(4)


def usable(data, zero):
    out = {}
    for i, v in data:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = np.array(v, np.float64)
    return out


def brute(data, step, k, inner):
    good, out = usable(data, inner), []
    for q, v in good.items():
        if q % step == 0:
            found = []
            for i, w in good.items():
                if i != q and len(w) == len(v):
                    s = int((np.floor(64 * v).astype(int) * np.floor(64 * w).astype(int)).sum()) if inner else float(np.sqrt(((v - w) ** 2).sum()))
                    found.append((-s if inner else s, i))
            out += [(q, rank, i, -s if inner else s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [50, 2048])
def test_inner_products_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    data = rows()
    got = branch_bound.top_inner_products(frame(spark, data), "vec_id % 20 = 0", 20).collect()
    assert sorted(tuple(r) for r in got) == brute(data, 20, 20, True)


def test_large_components(spark):
    data = [(i, [1e5 * (i % 7 - 3), 3e6 / (i + 1), float(i)]) for i in range(60)]
    got = branch_bound.top_inner_products(frame(spark, data), "vec_id % 20 = 0", 5).collect()
    assert sorted(tuple(r) for r in got) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in data], 20, 5, True)


def test_whole_forest_equals_brute_force(spark):
    data = rows()
    got = sorted(tuple(r) for r in rpforest.nearest(frame(spark, data), "vec_id % 100 = 0", 10, search=1.0).collect())
    want = brute(data, 100, 10, False)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-14, atol=0)


def test_recall_on_documents_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in df.collect()]
    got = rpforest.nearest(df, "vec_id % 100 = 0", 10).collect()
    want = {(q, i) for q, _, i, _ in brute(data, 100, 10, False)}
    assert len(got) == len(want)
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


def test_copies_only_and_empty_table(spark):
    data = [(i, [1.0, 2.0, 3.0]) for i in range(200)]
    got = rpforest.nearest(frame(spark, data), "vec_id % 100 = 0", 10).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(0, i) for i in range(1, 11)] + [(100, i) for i in range(10)]
    assert rpforest.nearest(frame(spark, []), "vec_id % 100 = 0", 10).count() == 0
    assert branch_bound.top_inner_products(frame(spark, []), "vec_id % 20 = 0", 20).count() == 0
