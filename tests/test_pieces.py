import datetime as dt

import numpy as np
import pytest

from tidemark.functions import statistics as st
from tidemark.sources import store
from tidemark.streaming import incremental


def test_conditions():
    assert st.condition(">= 1.5") == (">=", 1.5) and st.condition(1) == ("==", 1.0)
    assert st.complement("> 2") == "<= 2"
    with pytest.raises(ValueError):
        st.condition("between 1 and 2")


def test_statistics():
    assert st.benjamini_hochberg([0.01, 0.5, 0.02], 0.1) == [True, False, True]
    assert st.declustered([1, 2, 5, 6, 9], 3) == [True, False, True, False, True]
    assert len(st.vocabulary(range(21), range(8), (3, 5))) == 1554
    sets = [("a", frozenset()), ("a", frozenset("x")), ("b", frozenset("x")), ("b", frozenset("xy")), ("b", frozenset("z")), ("b", frozenset("y"))]
    f = frozenset
    assert st.families(sets) == [[("a", f()), ("a", f("x"))], [("b", f("x")), ("b", f("y")), ("b", f("xy"))], [("b", f("z"))]]


def test_bootstrap(spark):
    """One pass over many hypotheses equals a plain loop over draws; no edge gives p near 1, a strong one the least p."""
    rng = np.random.default_rng(1)
    base = np.stack([rng.integers(20, 60, 12), np.full(12, 100)])
    counts = np.stack([np.stack([rng.integers(0, 6, 12), np.full(12, 6), *base]) for _ in range(5)] + [np.stack([np.full(12, 6), np.full(12, 6), *base])])
    w = st.draws(12, 300)
    want = []
    for hw, hn, bw, bn in counts:
        edges = [(d @ hw) / (d @ hn) - (d @ bw) / (d @ bn) for d in w]
        want.append(min(1.0, 2 * (min(sum(e <= 0 for e in edges), sum(e >= 0 for e in edges)) + 1) / (len(edges) + 1)))
    assert np.allclose(st.tails(counts, w), want) and want[-1] == 2 / 301
    rows = [(f"h{h}", b, *map(int, c[:, b])) for h, c in enumerate(counts) for b in range(12)]
    got = st.bootstrap(spark.createDataFrame(rows, "hypothesis string, block int, hit_wins long, hit_n long, base_wins long, base_n long"), 12, times=300).collect()
    assert np.allclose([r["p"] for r in sorted(got)], want)
    same = np.array([[[1] * 4, [2] * 4, [1] * 4, [2] * 4]])
    assert st.tails(same, st.draws(4, 50))[0] == 1.0


def test_store(spark, tmp_path):
    df = spark.sql("SELECT 'AAA' AS symbol, DATE '2020-01-02' AS trade_date, 1.0 AS x, false AS flag__x UNION ALL SELECT 'BBB', DATE '2021-01-04', 2.0, true")
    store.write(df, str(tmp_path), {"build": 1})
    got = store.load(spark, str(tmp_path), {"build": 1}, ["x"], {"x": "flag__x"}, start=dt.date(2021, 1, 1))
    assert got.columns == ["symbol", "trade_date", "x", "flag__x"] and got.count() == 1
    with pytest.raises(store.StaleStore):
        store.load(spark, str(tmp_path), {"build": 2})


def test_increment(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.sql("SELECT 'AAA' AS symbol, DATE '2020-01-02' AS trade_date, 1.0D AS close")
    rows.write.parquet(src)
    incremental.nightly(spark, src, rows.schema, out, mark).awaitTermination(120)
    spark.sql("SELECT 'AAA' AS symbol, DATE '2020-01-02' AS trade_date, 9.0D AS close UNION ALL SELECT 'AAA', DATE '2020-01-03', 2.0D").write.mode("append").parquet(src)
    incremental.nightly(spark, src, rows.schema, out, mark).awaitTermination(120)
    assert sorted(r["close"] for r in spark.read.parquet(out).collect()) == [1.0, 2.0]
