import numpy as np

from lectern.operators import running


def test_running_totals(spark):
    r = np.random.default_rng(0)
    rows = [(g, int(k), int(r.integers(100))) for g in "ab" for k in r.choice(10_000, 300, replace=False)] + [("c", -5, 7), ("c", -4, 1)]
    got = {(x["g"], x["k"]): x["t"] for x in running.total_before(spark.createDataFrame(rows, "g string, k int, v int"), "g", "k", "v", "t", 512).collect()}
    assert got == {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}
