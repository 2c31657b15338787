"""The sweep of smoothing sizes: by blocks, and without a row for each value and size."""

import numpy as np
import pytest

from tidewright.operators import series
from tidewright.plans import series as plans


def brute(rows, sizes):
    out = {}
    for n in sizes:
        d = []
        for user in {r[0] for r in rows}:
            v = {t: x for u, t, x in rows if u == user}
            d += [(sum(v.get(k) or 0 for k in range(t - n // 2, t + n // 2 + 1)) / n - x) ** 2 for t, x in v.items() if x is not None]
        out[n] = np.mean(d)
    return out


@pytest.mark.parametrize("block", [1, 8, 1000])
def test_blocks_give_the_whole(spark, block):
    rng = np.random.default_rng(3)
    rows = [(u, t, None if rng.random() < 0.1 else float(rng.normal(5, 2))) for u, n in ((1, 90), (2, 1), (3, 17)) for t in range(n)]
    got = {r["size"]: r.mse for r in series.box_sweep(spark.createDataFrame(rows, "u long, t long, v double"), ["u"], [3, 5, 11], block).collect()}
    assert got == pytest.approx(brute(rows, [3, 5, 11]))


def test_no_row_for_each_value_and_size(spark):
    plan = plans.smoothing_sweep(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" not in plan and "lag(" not in plan
