"""Stores that survive a job that dies, delivered files, deltas, execution rules and logs."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.curation.compaction import consolidate_day_files
from barloom.curation.snapshots import table_changes
from barloom.curation.units import documented_units, with_documented
from barloom.library.sharing import FactorCache, PrecomputeStore
from barloom.library.store import CombinationStore, FactorLibrary, resolve, run_id
from barloom.portfolio import accounting as A
from barloom.portfolio import execution as X
from barloom.portfolio.optimize import mean_variance, sample_covariance
from barloom.sources import files as L
from barloom.sources import store as S


def day(k):
    return dt.date(2022, 1, 3) + dt.timedelta(days=k)


def rows_of(spark, path):
    return sorted((r.k, r.v) for r in spark.read.parquet(path).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v long, p long")


@pytest.mark.parametrize("parts", [(), ("p",)])
def test_upsert_survives_a_death_between_any_two_renames(spark, tmp_path, monkeypatch, parts):
    path, fs_steps = f"file://{tmp_path}/store", []
    L.upsert(spark, path, frame(spark, [(1, 1, 0), (2, 2, 1)]), ["k", "p"], parts)
    want = sorted([(1, 10), (2, 2), (3, 30)])
    real = L.swap
    for die_at in range(1, 5):
        def dying(spark, path, staging, depth=0, die_at=die_at):
            make, fs = L._fs(spark, path)
            n = [0]

            class Dying:
                def __getattr__(self, name):
                    return getattr(fs, name)

                def rename(self, a, b):
                    n[0] += 1
                    if n[0] == die_at:
                        raise KeyboardInterrupt
                    return fs.rename(a, b)

            with monkeypatch.context() as m:
                m.setattr(L, "_fs", lambda *_: (make, Dying()))
                real(spark, path, staging, depth)

        with monkeypatch.context() as m:
            m.setattr(L, "swap", dying)
            try:
                L.upsert(spark, path, frame(spark, [(1, 10, 0), (3, 30, 1)]), ["k", "p"], parts)
                fs_steps.append(die_at)
            except KeyboardInterrupt:
                pass
        # Whole after recovery: every key is there once, old or new.
        L.recover(spark, path, len(parts))
        assert {k for k, _ in rows_of(spark, path)} >= {1, 2} and len(rows_of(spark, path)) == len({k for k, _ in rows_of(spark, path)})
        L.upsert(spark, path, frame(spark, [(1, 10, 0), (3, 30, 1)]), ["k", "p"], parts)
        assert rows_of(spark, path) == want
    with pytest.raises(ValueError):
        L.upsert(spark, path, frame(spark, []).drop("v"), ["k", "p"], parts)


def test_exponential_mean_in_blocks_is_the_fold(spark):
    from barloom.plans.compiler import evaluate

    rng = np.random.default_rng(3)
    x = [None if rng.random() < 0.2 else float(v) for v in rng.normal(5, 3, 300)]
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), s, v) for s in "AB" for i, v in enumerate(x)]
    panel = spark.createDataFrame(rows, "date date, symbol string, close double")
    for d in (1, 2, 5, 40):
        a, s, want = 2 / (d + 1), None, []
        for v in x:
            s = s if v is None else v if s is None else s * (1 - a) + v * a
            want.append(s)
        got = [r.factor for r in evaluate(panel, f"EMA($close, {d})").where("symbol = 'B'").orderBy("date").collect()]
        assert all((g is None and w is None) or math.isclose(g, w, rel_tol=1e-12) for g, w in zip(got, want)), d


def test_deltas_in_the_order_of_their_source(spark):
    d = [("i", day(0), 0, "union", ["A", " b", None, ""]), ("I ", day(1), 0, "difference", ["A"]), ("i", day(1), 1, "union", ["A", "c"]), ("i", day(2), 0, "union", ["D"]), ("i", day(2), 1, "difference", ["D", "B"]), ("i", day(3), 0, "drop", ["A"]), ("i", None, 0, "union", ["X"])]
    df = spark.createDataFrame(d, "index_id string, effective_date date, seq int, op string, symbols array<string>")
    got = {r.effective_date: r.symbols for r in S.apply_deltas(df).collect()}
    assert got == {day(0): ["A", "B"], day(1): ["A", "B", "C"], day(2): ["A", "C"]}
    assert S.apply_deltas(df.limit(0)).count() == 0


def test_table_changes(spark):
    old = [(1, "a", None), (2, "b", 1.0), (2, "b", 2.0), (3, "c", 1.0), (None, "n", 1.0), (5, "e", 0.5)]
    new = [(1, "a", None), (2, "b", 2.0), (2, "b", 1.0), (4, "d", 1.0), (None, "n", 2.0), (5, "e", 0.5), (5, "e", 0.5)]
    a, b = (spark.createDataFrame(x, "k int, s string, v double") for x in (old, new))
    got = {(r.k, r.change_kind) for r in table_changes(a, b, ["k"]).collect()}
    assert got == {(3, "removed"), (4, "added"), (None, "changed"), (5, "changed")}
    assert table_changes(a.limit(0), b.limit(0), ["k"]).count() == 0


def test_documented_units_are_intervals(spark):
    notes = [(1, " V ", "volume", None, "single shares"), (2, "v", "volume", day(5), "lots of one hundred"), (3, "v", "volume", day(5), "no unit here"), (4, "w", "close", None, "cents"), (5, None, None, None, None)]
    docs = documented_units(spark.createDataFrame(notes, "note_id int, vendor string, field_name string, valid_from date, note string"), "volume")
    rows = spark.createDataFrame([("v", day(0)), ("v", day(5)), ("w", day(0)), ("v", None)], "vendor string, day date")
    got = [(r.vendor, r.day, r.doc) for r in with_documented(rows, docs).collect()]
    assert sorted(got, key=str) == sorted([("v", day(0), 0), ("v", day(5), 2), ("w", day(0), None), ("v", None, None)], key=str)


def test_day_files_of_a_range(spark, tmp_path):
    folder = f"file://{tmp_path}/csv"
    rows = [(day(k), "a", 10, 1.0, 1.0, 1.0, 1.0, 0, 1) for k in range(4)]
    raw = spark.createDataFrame(rows, "day date, ticker string, volume long, open double, close double, high double, low double, window_start long, transactions long")
    raw.write.partitionBy("day").option("header", True).option("compression", "gzip").csv(folder)
    assert [p[-10:] for p in L.dated_files(spark, folder, day(1), day(2))] == [str(day(1)), str(day(2))]
    out = f"file://{tmp_path}/store"
    assert L.day_files_to_parquet(spark, folder, out, day(1), day(2)) == 2 and L.day_files_to_parquet(spark, folder, out, day(2), day(3)) == 2
    assert spark.read.parquet(out).count() == 3 and L.dated_files(spark, folder + "-none", day(0), day(9)) == []


def test_records_delivered_again_and_again(spark):
    head = "ticker,volume,open,close,high,low,window_start,transactions"
    line = "A,1,0.0,1,1,1,1000,5"
    files = [(k, f"p{k}", f"{head}\n{line}\n{'A,1.0,-0.0,1,1,1,1000,5' if k else line}\n") for k in range(60)] + [(99, "q", head + "\nB,2,1,1,1,1,1000,5\nB,2,1,1,1,1")]
    df = spark.createDataFrame(files, "file_id long, path string, payload string")
    assert sorted((r.file_id, r.line_no) for r in consolidate_day_files(df).collect()) == [(0, 2), (99, 2)]


def test_what_blocks_a_trade(spark):
    moves = [("r", day(0), s, m) for s, m in (("A", 0.1), ("B", -0.1), ("C", 0.1), ("D", 0.2), ("E", 0.1), ("F", 1e-13), ("G", 0.1))]
    market = [(day(0), "A", 11.0, 11.0, 9.0, 1.0), (day(0), "B", 9.0, 11.0, 9.0, 1.0), (day(0), "C", None, 1.0, 1.0, 1.0), (day(0), "D", 10.0, None, None, 0.5), (day(0), "E", 10.0, 11.0, 9.0, None), (day(0), "F", 10.0, 11.0, 9.0, None)]
    m = spark.createDataFrame(moves, "run_id string, date date, symbol string, move double")
    k = spark.createDataFrame(market, "date date, symbol string, price double, up_limit double, down_limit double, volume_room double")
    got = {r.symbol: (r.reason, round(r.filled, 6), round(r.deferred, 6)) for r in X.execute(m, k, max_share=0.2).collect()}
    assert got == {"A": ("limit_up", 0, 0.1), "B": ("limit_down", 0, -0.1), "C": ("suspended", 0, 0.1), "D": ("volume", 0.1, 0.1), "E": (None, 0.1, 0), "G": ("suspended", 0, 0.1)}
    assert {r.filled for r in X.execute(m, k, when_blocked="force").collect()} == {0.1, -0.1, 0.2}
    assert all(r.deferred == 0 for r in X.execute(m, k, when_blocked="cancel").collect())


def test_walk_defers_and_triggers():
    r = np.zeros((4, 2))
    no_buy = np.array([[True, False], [True, False], [False, False], [False, False]])
    got = A.walk(r, {0: np.array([0.5, 0.5])}, commission=0.0, no_buy=no_buy, defer=True)
    assert got.n_trades.tolist() == [1, 0, 1, 0] and got.turnover.tolist() == [0.25, 0, 0.25, 0]
    assert A.walk(r, {0: np.array([0.5, 0.5])}, commission=0.0, no_buy=no_buy).n_trades.tolist() == [1, 0, 0, 0]
    ranks = np.array([[0.0, 9.0], [0.0, 9.0], [0.0, 4.0], [0.0, 4.0]])
    got = A.walk(r, {0: np.array([0.5, 0.5]), 1: np.array([0.4, 0.6]), 2: np.array([0.2, 0.8])}, commission=0.0, ranks=ranks, rank_shift=3)
    assert got.n_trades.tolist() == [2, 0, 1, 0]


def test_covariance_and_turnover_bound():
    x = np.random.default_rng(1).normal(size=(30, 3))
    np.testing.assert_allclose(sample_covariance(x), np.cov(x.T))
    x[3, 1] = np.nan
    assert np.isnan(sample_covariance(x)[1]).all() and sample_covariance(x[:1]).shape == (3, 3)
    before = np.array([1.0, 0, 0])
    w = mean_variance(np.array([0.0, 0, 1.0]), np.eye(3) * 0.01, high=1.0, before=before, max_turnover=0.1)
    assert abs(np.abs(w - before).sum() / 2 - 0.1) < 1e-9


def test_precomputed_results_and_runs(spark, tmp_path):
    store = PrecomputeStore(spark, f"file://{tmp_path}/pre")
    values = spark.createDataFrame([("A", day(0), 1.0)], "symbol string, date date, value double")
    store.put("rank(close)", "f1", values, "2022-01-03")
    assert store.fresh("f1", "2022-01-03") and not store.fresh("f1", "2022-01-04") and not store.fresh("f2", "x")
    assert store.get("rank( close )", "f1").count() == 1 and store.stats().first().n_entries == 1
    cache = FactorCache(store)
    cache.put("close + open", values, "u", "a", "b")
    assert cache.get("close+open", "U ", "a", "b").count() == 1 and cache.get("close+open", "u", "a", "c") is None
    runs = CombinationStore(spark, f"file://{tmp_path}/runs")
    key = runs.save("ols", {"b": 1.0, "a": 0.5}, {"icir": 0.1})
    assert key == run_id("ols", ["a", "b"], market=None, universe=None, start=None, end=None) == runs.save("ols", {"a": 0.5, "b": 1.0}) and runs.table().count() == 1
    assert runs.list(uses="a").count() == 1 and runs.list(method="x").count() == 0 and runs.delete(key) and not runs.delete(key) and runs.get(key) is None
    lib = FactorLibrary(spark, f"file://{tmp_path}/lib")
    lib.save(spark.createDataFrame([("id1", "n", "rank(close)")], "factor_id string, name string, expression string"))
    assert resolve(lib, {"a": "lib:id1", "b": "close / open", "c": "lib:nope"}) == ({"a": "rank(close)", "b": "close / open"}, {"c": "no report nope"})


def test_command_line(spark, tmp_path, capsys):
    from barloom.cli import main

    assert main(["validate", "rank(close)"]) == 0 and main(["validate", "rank("]) == 1
    assert main(["catalog", "alpha101"]) == 0 and capsys.readouterr().out.count("\n") >= 101
    panel = pd.DataFrame([(day(k), s, float(k + j), 1.0 + k) for k in range(5) for j, s in enumerate("AB")], columns=["date", "symbol", "close", "open"])
    spark.createDataFrame(panel).write.parquet(f"file://{tmp_path}/panel")
    assert main(["evaluate", "rank(close)", "--panel", f"file://{tmp_path}/panel"], spark) == 0
    assert capsys.readouterr().out.count("\n") == 10


def test_series_of_some_symbols(spark):
    from barloom.sdk import Session, Sessions

    panel = spark.createDataFrame([(day(k), s, float(k * j + 1)) for k in range(6) for j, s in enumerate("ABC")], "date date, symbol string, close double")
    made = Sessions(1)
    s = made.open("x", lambda: Session(panel, horizons=(1,)))
    for e in ("ts_mean(close, 2)", "rank(close)"):
        whole = {(r.symbol, r.date): r.factor for r in s.evaluate(e).collect()}
        assert {(r.symbol, r.date): r.factor for r in s.factor_series(e, [" b"]).collect()} == {k: v for k, v in whole.items() if k[0] == "B"}
    assert made.evaluate("x", "rank(close)").count() == 18 and made.open("y", lambda: s) is s and made.names() == ["y"]
