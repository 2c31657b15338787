"""Temperature and limits of language identification come from all rows of the held-back fold."""

import numpy as np
import pytest

from tidewright.llm import langid


def test_all_held_rows_count(spark):
    rng = np.random.default_rng(5)
    n, langs = 9000, ["a", "b", "c"]
    truth = rng.integers(0, 3, n)
    entropy = rng.normal(3, 0.2, (n, 3))
    entropy[np.arange(n), truth] -= rng.exponential(0.4, n)
    rows = [(langs[t], e.tolist()) for t, e in zip(truth, entropy, strict=True)] + [("other", [1.0, 2.0, 3.0])] * 50
    got = langid.fitted(spark.createDataFrame(rows, "lang string, entropy array<double>"), langs)

    over = entropy - entropy.min(axis=1, keepdims=True)
    losses = [np.minimum(over[np.arange(n), truth] / t + np.log(np.exp(-over / t).sum(axis=1)), -np.log(1e-12)).mean() for t in langid.TEMPERATURES]
    assert got["temperature"] == langid.TEMPERATURES[int(np.argmin(losses))]
    for k, lang in enumerate(langs):
        mine = entropy[(truth == k) & (entropy.argmin(axis=1) == k), k]
        assert got["limits"][lang] == pytest.approx(np.sort(mine)[int(np.ceil(langid.REJECT * len(mine))) - 1] + 0.05, abs=2 * langid.STEP)


def test_few_rows_set_no_limit(spark):
    got = langid.fitted(spark.createDataFrame([("a", [1.0, 2.0])] * 19 + [("b", [2.0, 1.0])] * 20, "lang string, entropy array<double>"), ["a", "b"])
    assert list(got["limits"]) == ["b"]
    assert langid.fitted(spark.createDataFrame([], "lang string, entropy array<double>"), ["a"]) == {"limits": {}}
