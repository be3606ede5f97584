"""Blocked Gram moments against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import gram


def frame(spark, x, names):
    rows = [tuple(None if v is None or np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` DOUBLE" for n in names))


@pytest.mark.parametrize("block,state_bytes", [(256, 1 << 28), (3, 1 << 28), (4, 1)])
def test_pairs_equal_pandas(spark, block, state_bytes):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 11)) @ rng.normal(size=(11, 11)) + 1e6 * np.arange(11)      # far from 0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 3.3                                                                          # constant
    x[:, 7] = np.nan                                                                       # never present
    x[:350, 9] = np.nan
    x[350:, 10] = np.nan                                                                   # 9 and 10 never meet
    names = [f"c.{k}" for k in range(11)]
    got = gram.corr_wide(frame(spark, x, names).repartition(5), names, None, block, state_bytes).collect()
    want = pd.DataFrame(x, columns=names).corr()
    seen = ~np.isnan(x)
    assert len(got) == 55
    for r in got:
        a, b = names.index(r.column_a), names.index(r.column_b)
        assert a < b and r.n_complete == int((seen[:, a] & seen[:, b]).sum())
        w = want.iloc[a, b]
        if 4 in (a, b) or np.isnan(w):
            assert r["corr"] is None, r
        else:
            assert r["corr"] == pytest.approx(w, abs=1e-9)


def test_wave_bounds():
    assert len(gram.waves(64)) == 1 and len(gram.waves(2000)) == 1
    many = gram.waves(2000, 100, 6 * 8 * 100 * 100 * 7)
    assert max(map(len, many)) == 7 and len({p for w in many for p in w}) == sum(map(len, many)) == 210


def test_cases(spark):
    empty = frame(spark, [], ["a", "b", "c"])
    assert sorted(tuple(r) for r in gram.corr_wide(empty, ["a", "b", "c"]).collect()) == [("a", "b", 0, None), ("a", "c", 0, None), ("b", "c", 0, None)]
    df = spark.createDataFrame([(1.0, 2.0, 1), (2.0, float("inf"), 0), (3.0, 6.0, 0), (4.0, float("nan"), 1), (None, 1.0, 1), (5.0, 10.0, 0)], "a DOUBLE, b DOUBLE, y INT")
    assert [tuple(r) for r in gram.corr_wide(df, ["a", "b"]).collect()] == [("a", "b", 3, 1.0)]
    by = {r.column_name: (r.n_complete, r["corr"]) for r in gram.corr_wide_with_label(df, ["a", "b"], "y").collect()}
    assert by["a"] == (5, pytest.approx(np.corrcoef([1, 2, 3, 4, 5], [1, 0, 0, 1, 0])[0, 1], abs=1e-6)) and by["b"][0] == 4
    # a column that is constant only where its partner is present
    part = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 5.0), (7.0, None)], "a DOUBLE, b DOUBLE")
    assert [tuple(r) for r in gram.corr_wide(part, ["a", "b"]).collect()] == [("a", "b", 3, None)]
    with pytest.raises(ValueError):
        gram.pair_moments(df, ["a", "a"])
