import numpy as np

from threadloom.plans.conversations import exact_quantiles


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=3001), "b": np.repeat([1.0, 2.0, 2.0, 7.0], 500), "c": np.array([5.0]), "d": np.array([1.0, 4.0]), "e": np.concatenate([np.zeros(1999), [1e9]])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("f", None), ("a", None)]
    for cuts in (2, 7, 200):
        got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}, cuts).collect()}
        for g, vs in groups.items():
            assert [got[g].p50, got[g].p95, got[g].p0, got[g].p100] == [float(x) for x in np.quantile(vs, [0.5, 0.95, 0, 1])] or np.allclose([got[g].p50, got[g].p95, got[g].p0, got[g].p100], np.quantile(vs, [0.5, 0.95, 0, 1]), rtol=1e-12)
        assert got["a"].n == 3002 and got["f"].n == 1 and got["f"].p50 is None
