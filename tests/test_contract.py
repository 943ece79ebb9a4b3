"""The driver's contract: queries against their SQL twins on the smallest data."""

import math
import os

import pytest

import __spark_entry__ as entry

QUICK = ["p2_found", "p3_found", "p3_grid", "p4_found", "p5_found", "p6_found", "op_cs_rank", "op_ts_corr", "op_ts_ema", "nested_decay_of_corr", "eval_ic_summary", "pit_panel_total", "universe_changes", "portfolio_nav", "combine_ic_weight", "factor_similarity", "batch_hourly_bars"]


def cells(rows, names):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.8g}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(plain(r[n]) for n in names) for r in rows)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{data}/{f}')")
    got = entry.queries()[name](spark, data)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    want_rows = [dict(zip(names, r)) for r in want.fetchall()]
    assert cells([r.asDict() for r in got.collect()], names) == cells(want_rows, names)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in range(1, 8)} <= set(entry.queries())


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data here")
    assert entry.entry(spark).count() > 0


def test_nothing_outside_llm_imports_it():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(f"{root}/barloom"):
        if folder.endswith("/llm"):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(f"{folder}/{n}") as f:
                    assert "barloom.llm" not in f.read(), n
