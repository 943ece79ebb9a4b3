import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barloom.library.analysis import classical_mds, lineage, pairwise_similarity, prune, redundancy
from barloom.library.sharing import PrecomputeStore, panel_fingerprint
from barloom.library.store import FactorLibrary
from barloom.sources import files as S
from barloom.sources.store import forward_adjust, membership_changes, membership_stays, prices_as_of, read_panel, resample, universe, universe_panels

D = dt.date
PX = "date date, symbol string, close double, volume double"
EV = "symbol string, ex_date date, split_ratio double, dividend_cash double"


def bars(spark, closes, start=D(2024, 1, 1), symbol="A"):
    return spark.createDataFrame([(start + dt.timedelta(days=i), symbol, float(c), 100.0) for i, c in enumerate(closes)], PX)


def closes(df):
    return [r.close for r in df.orderBy("date").collect()]


def test_splits_compose(spark):
    ev = spark.createDataFrame([("A", D(2024, 1, 3), 7.0, None), ("A", D(2024, 1, 4), 4.0, None), ("A", D(2024, 1, 4), float("nan"), None), ("A", D(2024, 1, 4), -2.0, 0.0), ("B", D(2024, 1, 2), 9.0, None)], EV)
    out = forward_adjust(bars(spark, [280, 280, 40, 10]), ev, "split")
    assert closes(out) == pytest.approx([10, 10, 10, 10])
    assert [r.volume for r in out.orderBy("date").collect()] == pytest.approx([2800, 2800, 400, 100])


def test_dividends(spark):
    ev = lambda ex, cash: spark.createDataFrame([("A", ex, None, cash)], EV)
    b = bars(spark, [100, 100, 99])
    assert closes(forward_adjust(b, ev(D(2024, 1, 3), 1.0), "total")) == pytest.approx([99, 99, 99])
    assert closes(forward_adjust(b, ev(D(2024, 1, 3), 1.0), "split")) == [100, 100, 99]
    assert closes(forward_adjust(b, ev(D(2024, 1, 1), 1.0), "forward")) == [100, 100, 99]  # no close before
    assert closes(forward_adjust(b, ev(D(2024, 3, 1), 1.0), "total")) == [100, 100, 99]  # too far back
    assert closes(forward_adjust(b, ev(D(2024, 1, 3), 100.0), "total")) == [100, 100, 99]  # factor not positive
    with pytest.raises(ValueError):
        forward_adjust(b, ev(D(2024, 1, 3), 1.0), "other")
    assert forward_adjust(b.limit(0), ev(D(2024, 1, 3), 1.0)).count() == 0


def test_knowledge_is_as_of(spark):
    p = spark.createDataFrame([(D(2024, 1, 1), " a", 1.0, 1.0, D(2024, 1, 1)), (D(2024, 1, 1), "A", 2.0, 1.0, D(2024, 1, 9)), (D(2024, 1, 2), "A", 3.0, 1.0, None)], PX + ", as_of_date date")
    early = prices_as_of(p, "2024-01-01", "2024-01-31", "2024-01-05").collect()
    late = prices_as_of(p, "2024-01-01", "2024-01-31", "2024-01-31").collect()
    assert [r.close for r in early] == [1.0] and [r.close for r in late] == [2.0]
    with pytest.raises(ValueError):
        read_panel(p, p, ["vwap"], "2024-01-01", "2024-01-31", "2024-01-31")


def test_universe(spark):
    s = spark.createDataFrame([("ix", D(2024, 1, 1), ["a", None, "b "], D(2024, 1, 1)), ("IX", D(2024, 2, 1), ["b", "c"], D(2024, 2, 1)), ("ix", D(2024, 3, 1), ["C", "B"], D(2024, 3, 1))], S.SNAPSHOTS)
    members = lambda d: {r.symbol for r in universe(s, d, "2024-12-31").collect()}
    assert members("2024-01-15") == {"A", "B"} and members("2024-02-15") == {"B", "C"} and members("2023-01-01") == set()
    assert [(r.effective_date, r.joined, r.left) for r in membership_changes(s, "2024-12-31").orderBy("effective_date").collect()][1] == (D(2024, 2, 1), ["C"], ["A"])


def test_panels_of_all_indices(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(4)]
    p = spark.createDataFrame([(d, s, 1.0, 1.0, D(2024, 1, 1)) for d in days for s in "ABCZ"], PX + ", as_of_date date")
    e = spark.createDataFrame([], EV + ", event_id string, as_of_date date")
    s = spark.createDataFrame([
        ("i1", days[0], ["A", "B"], days[0]), ("I1", days[1], ["A"], days[1]), ("i1", days[2], ["a", "B"], days[2]), ("i2", days[1], ["B", "C"], days[1]),
    ], S.SNAPSHOTS)
    got = lambda m: sorted((r.index_id, r.symbol, r.date.day) for r in universe_panels(p, e, s, ["close"], days[0], days[3], "2024-12-31", membership=m).collect())
    assert got("end") == sorted((i, x, d) for i, xs in (("I1", "AB"), ("I2", "BC")) for x in xs for d in (1, 2, 3, 4))
    assert got("daily") == sorted([("I1", "A", d) for d in (1, 2, 3, 4)] + [("I1", "B", d) for d in (1, 3, 4)] + [("I2", x, d) for x in "BC" for d in (2, 3, 4)])
    stays = {(r.index_id, r.symbol, r.valid_from.day, r.valid_to and r.valid_to.day) for r in membership_stays(s, "2024-12-31").collect()}
    assert stays == {("I1", "A", 1, None), ("I1", "B", 1, 2), ("I1", "B", 3, None), ("I2", "B", 2, None), ("I2", "C", 2, None)}


@pytest.mark.parametrize("name", ["universe_panels_end", "universe_panels_daily", "universe_panel_end", "universe_panel_daily"])
def test_panels_equal_sql(spark, data, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("price_raw", "adj_events", "universe_snapshots"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(tuple(map(str, r)) for r in entry.queries()[name](spark, data).select(*names).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["resample_weekly_whole", "resample_monthly_whole"])
def test_resampling_whole_table(spark, data, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"create view price_raw as select * from read_parquet('{data}/price_raw.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = entry.queries()[name](spark, data).select(*names).collect()
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in want.fetchall())
    # Days before the window of resample_weekly and resample_monthly are there too.
    assert min(r.date for r in got) < D(2021, 5, 3)


def test_too_many_factors_to_combine(spark):
    from barloom.evaluation.combine import combine

    f = spark.range(2_001).selectExpr("cast(id as string) as factor_id", "'A' as symbol", "date '2024-01-01' as date", "1d as value")
    with pytest.raises(ValueError, match="more than"):
        combine(f, f.selectExpr("symbol", "date", "value as fwd"), None)


def test_upsert(spark, tmp_path):
    path = f"{tmp_path}/prices"
    one = spark.createDataFrame([(D(2024, 1, 1), "A", 1.0), (D(2024, 2, 1), "A", 2.0), (D(2024, 1, 1), "A", 9.0)], "date date, symbol string, close double").withColumn("month", F.month("date"))
    S.upsert(spark, path, one, ["date", "symbol", "month"], ["month"], ["close"])
    two = spark.createDataFrame([(D(2024, 2, 1), "A", 5.0), (D(2024, 2, 2), "A", 6.0)], "date date, symbol string, close double").withColumn("month", F.month("date"))
    for _ in range(2):  # again after a failure
        S.upsert(spark, path, two, ["date", "symbol", "month"], ["month"], ["close"])
    assert sorted((r.date, r.close) for r in spark.read.parquet(path).collect()) == [(D(2024, 1, 1), 9.0), (D(2024, 2, 1), 5.0), (D(2024, 2, 2), 6.0)]
    with pytest.raises(ValueError):
        S.upsert(spark, path, two.withColumn("more", F.lit(1)), ["date"], ["month"])


def test_reading_files(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text(json.dumps({"id": "1", "execution_date": "2024-01-02", "split_from": 1, "split_to": 4, "ticker": "a"}) + "\n\n{bad\n" + json.dumps({"ticker": "b", "execution_date": "x", "split_from": 0, "split_to": 4}) + "\n")
    got = {r.symbol: r for r in S.split_events(S.read_jsonl(spark, f"{tmp_path}/d.jsonl", S.SPLITS)).where("symbol is not null").collect()}
    assert got["A"].split_ratio == 4.0 and got["A"].ex_date == D(2024, 1, 2) and got["B"].split_ratio is None and got["B"].ex_date is None
    (tmp_path / "day.csv").write_text("ticker,window_start,open,high,low,close,volume,transactions\nab,1704171600000000000,1,2,0.5,1.5,10,3\n")
    row = S.read_day_aggregates(spark, f"{tmp_path}/day.csv", "csv").first()
    assert (row.date, row.symbol, row.close, row.transactions) == (D(2024, 1, 2), "AB", 1.5, 3)


def test_trade_status_and_resample(spark):
    b = bars(spark, [10, 11, 9])
    lim = spark.createDataFrame([(D(2024, 1, 2), "A", 11.0, 9.0), (D(2024, 1, 3), "A", 12.0, 9.0), (D(2024, 1, 9), "A", 12.0, 9.0)], "date date, symbol string, up_limit double, down_limit double")
    got = [(r.limit_up_locked, r.limit_down_locked) for r in S.trade_status(b, lim).orderBy("date").collect()]
    assert got == [(True, False), (False, True), (False, False)]
    full = b.withColumns({"open": F.col("close"), "high": F.col("close"), "low": F.col("close")})
    w = resample(full, "1w").collect()
    assert len(w) == 1 and (w[0].open, w[0].high, w[0].low, w[0].close, w[0].date) == (10, 11, 9, 9, D(2024, 1, 3))


def test_library(spark, tmp_path):
    lib = FactorLibrary(spark, f"{tmp_path}/lib")
    assert lib.list().count() == 0 and lib.get("x") is None and not lib.delete("x")
    rows = spark.createDataFrame([("x", "one", 0.5), ("y", "two", None), ("z", "three", 0.9)], "factor_id string, name string, rank_icir double")
    lib.save(rows)
    lib.save(rows.where("factor_id = 'x'").withColumn("rank_icir", F.lit(1.5)))
    assert [r.factor_id for r in lib.list().collect()] == ["x", "z", "y"]
    assert [r.factor_id for r in lib.list(min_rank_icir=0.6, limit=1, offset=1).collect()] == ["z"]
    assert lib.delete("x") and lib.get("x") is None and lib.list().count() == 2


def test_similarity(spark):
    days = [D(2024, 1, 1), D(2024, 1, 2)]
    rows = [(f, d, f"S{j}", float({"a": j, "b": j * j, "c": -j}[f])) for f in "abc" for d in days for j in range(5)] + [("d", days[0], "S0", None)]
    long = spark.createDataFrame(rows, "factor_id string, date date, symbol string, value double")
    pairs = pairwise_similarity(long)
    got = {(r.a, r.b): round(r.similarity, 9) for r in pairs.collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): -1.0, ("b", "c"): -1.0, ("a", "d"): 0.0, ("b", "d"): 0.0, ("c", "d"): 0.0}
    assert {r.factor_id: r.nearest for r in redundancy(pairs).collect()}["a"] == "b"
    scores = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), ("d", 0.0)], "factor_id string, score double")
    assert {r.factor_id for r in prune(pairs, scores).collect()} == {"b", "c"}


def test_maps_and_lineage():
    import numpy as np

    pts = np.array([[0, 0], [3, 0], [0, 4.0]])
    d = np.linalg.norm(pts[:, None] - pts[None], axis=-1)
    m = classical_mds(d)
    np.testing.assert_allclose(np.linalg.norm(m[:, None] - m[None], axis=-1), d, atol=1e-9)
    assert lineage({"a": "delta(close, 1)", "b": "rank(delta(close, 1))", "c": "rank(delta(close, 1)) + 1"}) == [("a", "b"), ("b", "c")]


def test_precompute(spark, tmp_path):
    panel = bars(spark, range(1, 9)).unionByName(bars(spark, range(2, 10), symbol="B"))
    key = panel_fingerprint(panel, ["close"], adj="split")
    assert key != panel_fingerprint(panel, ["close"], adj="total")
    store = PrecomputeStore(spark, f"{tmp_path}/pre")
    factors = {"x": "rank(close)", "y": "ts_mean(close, 2)"}
    first = sorted(map(tuple, store.evaluate(panel, factors, key).collect()), key=str)
    assert sorted(map(tuple, store.evaluate(panel, factors, key).collect()), key=str) == first and store.get("ts_mean(close, 2)", key).count() == 16
