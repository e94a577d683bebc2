"""What must not grow faster than the input."""

import numpy as np

from quillon.operators import vector


def test_hashing_search_sends_no_pairs(spark):
    """The rows of a query's buckets and the buckets next to them, ranked; pairs stay in their tasks (a join made them
    rows before)."""
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(size=(300, 12)), np.zeros((1, 12))))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(400, None)], "key long, vector array<double>")
    q = v.where("key % 20 = 0").withColumnRenamed("key", "qid")
    for radius in (0, 1):
        index = vector.LshIndex.build(v, tables=3, bits=5)
        found = index.search(q, 5, radius)
        side = np.einsum("nd,tbd->ntb", x, index.planes) > 0
        unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
        for i in range(0, 301, 20):
            met = ((side != side[i]).sum(axis=2) <= radius).any(axis=1)
            want = sorted((-round(float(unit[i] @ unit[j]), 6), int(j)) for j in np.flatnonzero(met))[:5]
            got = sorted((r["rank"], r["key"], r["score"]) for r in found.where(f"qid = {i}").collect()) if i in (0, 100, 300) else None
            assert got is None or [(k, s + 0.0) for _, k, s in got] == [(j, -s + 0.0) for s, j in want]
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
