"""Edge cases of the curation operators: nulls, ties, repeats, empty tables, clashing names, hot groups; and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.curation.asof import asof_attributes
from barloom.curation.compaction import consolidate_day_files, consolidate_files, packing, parse_day_files
from barloom.curation.regular_grid import regular_grid
from barloom.curation.snapshots import attribute_history, composition_dates, compositions, snapshot_changes
from barloom.curation.spikes import flag_implausible
from barloom.curation.units import cash_power_from_words, dividend_units, stated_amount, stated_cash_power, volume_power_from_words, volume_units

D = dt.date
day = lambda n: D(2021, 1, 4) + dt.timedelta(days=n)

# --- as-of attributes


def asof_brute(events, versions):
    out = set()
    for i, e, d in events:
        seen = [v for v in versions if None not in v and e is not None and d is not None and v[0] == e and v[1] <= d and v[2] <= d]
        if seen:
            top = max((v[1], v[2]) for v in seen)
            ref = min(v[3] for v in seen if (v[1], v[2]) == top)
            out.add((i, e, ref, top[1]))
    return out


@pytest.mark.parametrize("target", [1_000_000, 7])
def test_asof_against_brute_force(spark, target):
    rng = random.Random(1)
    # One entity holds two thirds of the events, many on one day.
    events = [(i, rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([None, *[day(rng.randrange(300)) for _ in range(3)], day(100)])) for i in range(400)]
    versions = [(rng.choice(["hot", "b", "d", None]), rng.choice([None, day(rng.randrange(300)), day(5)]), rng.choice([None, day(rng.randrange(320)), day(5)]), rng.choice([None, f"r{rng.randrange(60):02d}"])) for _ in range(150)]
    versions += versions[:20]
    ev = spark.createDataFrame(events, "event_id long, entity string, date date").withColumn("ref_id", F.lit("clash")).withColumn("_day", F.lit(3))
    ve = spark.createDataFrame(versions, "entity string, valid_from date, known_from date, ref_id string").withColumn("date", F.lit("clash")).withColumn("_shard", F.lit(0))
    got = {tuple(r) for r in asof_attributes(ev, ve, shard_days=30, target_rows=target).collect()}
    assert got == asof_brute(events, versions)


def test_asof_empty(spark):
    ev = spark.createDataFrame([], "event_id long, entity string, date date")
    ve = spark.createDataFrame([("a", day(0), day(0), "r")], "entity string, valid_from date, known_from date, ref_id string")
    assert asof_attributes(ev, ve).count() == 0
    one = spark.createDataFrame([(1, "a", day(0)), (1, "a", day(0))], ev.schema)
    assert asof_attributes(one, ve.limit(0)).count() == 0
    assert asof_attributes(one, ve).count() == 2  # the version of the same day counts; repeated events each get a row


# --- regular grid

SPECS = "session_id string, start_date date, end_date date, step_minutes int, open_minute int, close_minute int"
READ = "panel_id long, session_id string, symbol string, read_at timestamp_ntz, close double, volume double"


def test_grid_fills_and_marks(spark):
    at = lambda d, h, m=0: dt.datetime(2021, 1, d, h, m)
    specs = spark.createDataFrame([("s", D(2021, 1, 7), D(2021, 1, 11), 60, 600, 800), ("none", D(2021, 1, 7), D(2021, 1, 8), 60, 600, 720), ("bad", None, D(2021, 1, 8), 60, 600, 720), ("zero", D(2021, 1, 8), D(2021, 1, 8), 0, 600, 720)], SPECS)
    rows = [
        (1, "s", " aa ", at(7, 10, 5), 1.0, 5.0), (2, "s", "AA", at(7, 10, 50), 2.0, None), (3, "s", "AA", at(7, 10, 50), 3.0, 1.0), (4, "s", "AA", at(7, 13, 19), 4.0, 1.0), (5, "s", "AA", at(7, 13, 20), 9.0, 1.0),
        (6, "s", "AA", at(9, 11), 9.0, 1.0), (7, "s", "AA", at(8, 10), None, 1.0), (8, "s", "BB", at(8, 3), 1.0, 1.0), (9, "s", None, at(8, 10), 1.0, 1.0), (10, "s", "CC", None, 1.0, 1.0), (11, "bad", "AA", at(8, 10), 1.0, 1.0), (12, "zero", "AA", at(8, 10), 1.0, 1.0), (13, None, "AA", at(8, 10), 1.0, 1.0),
    ]
    read = spark.createDataFrame(rows, READ).withColumn("step_minutes", F.lit(1)).withColumn("slot", F.lit(1))
    out = regular_grid(read, specs, max_gap=3).where("symbol = 'AA'").orderBy("slot").collect()
    # Thursday, Friday, Monday; four periods a day, the last one shorter.
    assert [str(r.slot_start) for r in out][:4] == ["2021-01-07 10:00:00", "2021-01-07 11:00:00", "2021-01-07 12:00:00", "2021-01-07 13:00:00"]
    assert [r.slot_start.day for r in out] == [7] * 4 + [8] * 4 + [11] * 4
    assert [r.n_obs for r in out] == [3, 0, 0, 1] + [0] * 8
    assert [r.status for r in out] == ["observed", "filled", "filled", "observed", "filled", "filled", "filled"] + ["missing"] * 5
    assert out[0].close == 3.0 and out[1].filled == 3.0 and out[0].volume == 6.0
    others = {r.symbol: r.n for r in regular_grid(read, specs).groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    assert others == {"AA": 12, "BB": 12, "CC": 12}
    assert regular_grid(read.limit(0), specs).count() == 0 and regular_grid(read, specs.limit(0)).count() == 0


# --- snapshots

SNAP = "snapshot_id string, index_id string, effective_date date, symbols array<string>, weights array<double>, as_of_date date"


def snaps(spark, rows):
    return spark.createDataFrame(rows, SNAP).withColumn("ord", F.lit("clash")).withColumn("weight", F.lit(1))


def test_snapshot_changes_and_history(spark):
    rows = [
        ("s1", "ix", day(0), ["A", " b", None, "b"], [0.5, 0.2, 0.1, 0.2], day(0)),
        ("s2", "IX ", day(10), ["b", "A", "C"], [0.2 + 5e-7, 0.5, None], day(9)),
        ("s3", "ix", day(10), ["b", "C"], [0.2 + 5e-7, None], day(12)),  # a correction of the same date
        ("s4", "ix", day(20), None, None, day(20)), ("s5", "ix", day(20), ["Z"], [1.0], None),
        ("s6", "ix", day(30), ["b", "C", "A"], [0.2 + 1.2e-6, 0.3, 0.5], day(30)), ("s6", "ix", day(30), ["b", "C", "A"], [0.2 + 1.2e-6, 0.3, 0.5], day(30)),
        ("s7", "ix", day(40), [], [], day(40)),
        ("s8", None, day(40), ["Q"], [1.0], day(40)), ("s9", "lone", day(1), ["Q"], [1.0], day(1)),
    ]
    s = snaps(spark, rows)
    got = {(r.index_id, r.effective_date, r.symbol, r.change_kind) for r in snapshot_changes(compositions(s), composition_dates(s)).collect()}
    assert got == {("IX", day(10), "A", "removed"), ("IX", day(10), "C", "added"), ("IX", day(30), "A", "added"), ("IX", day(30), "C", "changed"), ("IX", day(40), "A", "removed"), ("IX", day(40), "B", "removed"), ("IX", day(40), "C", "removed")}
    runs = {(r.index_id, r.symbol, r.valid_from, r.valid_to) for r in attribute_history(compositions(s), composition_dates(s)).collect()}
    assert runs == {("IX", "A", day(0), day(10)), ("IX", "A", day(30), day(40)), ("IX", "B", day(0), day(40)), ("IX", "C", day(10), day(30)), ("IX", "C", day(30), day(40)), ("LONE", "Q", day(1), None)}
    assert compositions(s.limit(0)).count() == 0 and attribute_history(compositions(s.limit(0)), composition_dates(s.limit(0))).count() == 0


def test_history_against_brute_force_over_many_words(spark):
    rng = random.Random(7)
    levels = [0.1, 0.1 + 6e-7, 0.1 + 1.3e-6, 0.4, 0.7]
    state, rows, comps = {}, [], []
    for k in range(200):  # more than three words of 64
        for m in "ABCDE":
            if rng.random() < 0.15:
                state[m] = rng.choice([None, *levels])
        now = {m: w for m, w in state.items() if w is not None}
        comps.append(now)
        rows.append((f"s{k:04d}", "ix", day(k), list(now), list(now.values()), day(k)))
    want, changes = set(), set()
    for m in "ABCDE":
        start = None
        for k in range(201):
            w = comps[k].get(m) if k < 200 else None
            before = comps[k - 1].get(m) if k else None
            goes_on = w is not None and before is not None and abs(w - before) <= 1e-6
            if before is not None and not goes_on:
                want.add((m, day(start), day(k) if k < 200 else None))
            if w is not None and not goes_on:
                start = k
            if 0 < k < 200 and not goes_on and (w is not None or before is not None):
                changes.add((m, day(k)))
    s = snaps(spark, rows)
    c, d = compositions(s), composition_dates(s)
    assert {(r.symbol, r.valid_from, r.valid_to) for r in attribute_history(c, d).collect()} == want
    assert {(r.symbol, r.effective_date) for r in snapshot_changes(c, d).collect()} == changes


# --- small files

HEAD = "ticker,volume,open,close,high,low,window_start,transactions"


def test_day_files(spark):
    rows = [
        (1, HEAD + "\nAB,10,1.0,1.1,1.2,0.9,1614574800000000001,5\nAB,10,1.0,1.1,1.2,0.9,1614574800000000002,5\n"),
        (2, "\r\nTicker;window_start;open;high;low;close;volume;transactions\r\nab ;1614574800000000001;1,00;1,20;0,9;1.10;1e1;5.0\r\nCD;1;1;1;1;1;1"),
        (3, HEAD + "\n\n CD, 7 ,1,1,1,1,9,1\nCD,8,1,1,1,1,9,1\nCD,8,1,1,1,,9,1\nCD,x,1,1,1,1,9,1"), (4, HEAD), (5, ""), (6, None), (7, "a,b\n1,2\n"), (8, HEAD + "\rCD,7,1,1,1,1,9,1\r"),
    ]
    files = spark.createDataFrame(rows, "file_id long, payload string").withColumn("line_no", F.lit(-1)).withColumn("ticker", F.lit("clash"))
    got = {(r.file_id, r.line_no) for r in consolidate_day_files(files).collect()}
    assert got == {(1, 2), (1, 3), (3, 3), (3, 4)}
    assert parse_day_files(files).count() == 6
    assert consolidate_day_files(files.limit(0)).count() == 0


def test_consolidating_files_keeps_every_record(spark, tmp_path):
    src, out = f"{tmp_path}/many", f"{tmp_path}/few"
    df = spark.range(500).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 == 0, None).otherwise(F.lit("x")).alias("s"))
    df.unionByName(df.limit(10)).repartition(40).write.parquet(src)
    done = consolidate_files(spark, src, out)
    assert done["records"] == 510 and done["files_out"] == 1
    again = spark.read.parquet(out)
    assert again.exceptAll(df.unionByName(df.limit(10))).count() == 0 and again.count() == 510
    assert int(packing(1000, 1_000_000)["spark__sql__files__openCostInBytes"]) <= 4 << 20


# --- units

PRICE = "row_id long, date date, symbol string, open float, high float, low float, close float, volume float, transactions long, as_of_date date, source_id string"
NOTE = "vendor string, field_name string, valid_from date, note string"


def price_rows(units, switch=None, n_days=40, seed=0):
    rng, rows = random.Random(seed), []
    for s in range(12):
        size, px = 10 ** rng.uniform(1.5, 2.5), 50.0
        for t in range(n_days):
            px *= 1 + rng.gauss(0, 0.01)
            tx = rng.randrange(500, 5000)
            for vendor, power in units.items():
                if rng.random() < 0.6:
                    p = 0 if switch and vendor == switch[0] and t >= switch[1] else power
                    rows.append((len(rows), day(t), f"S{s}", px, px, px, px, float(round(tx * size)) / 10**p, tx, day(t), f"{vendor}/x/{t}"))
    return rows


def test_units_are_found_without_notes(spark):
    rows = price_rows({"known": 0, "lots": 2, "mio": 6, "turns": 3}, ("turns", 20))
    rows += [(10**6, day(1), None, 1.0, 1.0, 1.0, 1.0, 5.0, 1, day(1), "lots/x"), (10**6 + 1, day(1), "S1", 1.0, 1.0, 1.0, 1.0, None, None, day(1), None), (10**6 + 2, day(1), "S1", 1.0, 1.0, 1.0, 1.0, -5.0, 0, day(1), "lots/x"), (10**6 + 3, None, "S1", 1.0, 1.0, 1.0, 1.0, 5.0, 1, day(1), "lots/x")]
    prices = spark.createDataFrame(rows, PRICE).withColumn("power", F.lit(9)).withColumn("vendor", F.lit("clash"))
    notes = spark.createDataFrame([("known", "volume", None, "plain share counts"), ("known", "close", None, "whatever"), (None, "volume", None, None)], NOTE)
    got = {(r.vendor, r.day): (r.power, r.unique_fit) for r in volume_units(prices, notes).collect()}
    for (vendor, d), (power, sure) in got.items():
        if vendor != "unknown":
            assert power == {"known": 0, "lots": 2, "mio": 6, "turns": 3 if d < day(20) else 0}[vendor] and sure
    assert got[("unknown", day(1))] == (0, False)
    free = volume_units(prices, notes.limit(0)).collect()
    assert not any(r.unique_fit for r in free)
    assert volume_units(prices.limit(0), notes).count() == 0


def test_units_in_words():
    assert [volume_power_from_words(x) for x in ("a board lot holds one hundred shares, in lots", "VOL = '000 sh", "thousands of shares", "switched to single shares", "Umsatz in Mio. Stück", "posted late", None)] == [2, 3, 3, 0, 6, None, None]
    assert [cash_power_from_words(x) for x in ("US dollars for one share", "US cents, one share", "(USD) are stated for a holding of ten shares", "see text", None)] == [0, -2, -1, None, None]


def test_dividends_in_words(spark):
    cases = [("$1.5/sh", 0, 1.5), ("per ten shares: $1.79", -1, 1.79), ("227.10 USD per 100 shs", -2, 227.1), ("257,90 Cent je Aktie", -2, 257.9), ("12 mills", -3, 12.0), ("45 cents on every ten shares", -3, 45.0), ("23.6c", -2, 23.6), ("US¢ 21.60", -2, 21.6), ("0.9 dollars for each 10 shares", -1, 0.9), ("per 100 shares, USD", -2, None), ("USc per 10", -3, None), ("soon", None, None), ("", None, None), (None, None, None)]
    df = spark.createDataFrame([(t,) for t, _, _ in cases], "t string")
    assert [tuple(r) for r in df.select(stated_cash_power(F.col("t")), stated_amount(F.col("t"))).collect()] == [(p, a) for _, p, a in cases]


EVENT = "symbol string, ex_date date, as_of_date date, event_type string, split_ratio double, dividend_cash double, provider_adj_factor double, event_id string, source string, dividend_text string"


def test_dividend_units(spark):
    prices = spark.createDataFrame([(i, day(i), "A", 1.0, 1.0, 1.0, 100.0, 1.0, 1, day(i), "v/x") for i in range(20)], PRICE)
    rows = [
        ("a", day(5), day(1), "d", 1.0, 150.0, 0.985, "e1", "cents:dividends", None), (" A", day(9), day(1), "d", 1.0, 200.0, 0.98, "e2", "cents:dividends", None), ("A", day(9), None, "d", 1.0, 200.0, 0.98, "e2", "cents:dividends", None),
        ("A", day(9), day(1), "d", 1.0, None, None, "e3", "words:dividends", "12 mills"), ("A", day(9), day(1), "d", 1.0, 3.0, 0.0, "e4", "lone:dividends", None), ("A", day(9), day(1), "d", 1.0, None, None, "e5", "words:dividends", None),
        ("A", day(9), day(1), "d", 1.0, 3.0, None, None, "words:dividends", None), ("A", day(9), day(1), "s", 2.0, 0.0, None, "e6", "x:splits", None), (None, None, day(1), "d", 1.0, 3.0, 0.5, "e7", "lone:dividends", None),
    ]
    notes = spark.createDataFrame([("lone", "dividend_cash", None, "amounts in cents")], NOTE)
    got = {r.event_id: (r.power, r.unique_fit) for r in dividend_units(spark.createDataFrame(rows, EVENT), prices, notes).collect()}
    assert got["e1"] == (-2, True) and got["e2"] == (-2, True) and got["e3"] == (-3, True) and got["e4"][0] == -2 and got["e7"][0] == -2 and set(got) == {"e1", "e2", "e3", "e4", "e7"}


# --- implausible readings


def test_implausible_readings(spark):
    rng, rows, want = random.Random(3), [], set()
    px, vol = 100.0, 1e6

    def bar(t, close, volume, vendor="v", symbol="A"):
        rows.append((len(rows), day(t), symbol, None, None, None, close, volume, None, day(t), f"{vendor}/x" if vendor else None))
        return len(rows) - 1

    for t in range(200):
        px *= 1 + rng.gauss(0, 0.01)
        if t == 120:
            px /= 4  # a split stays
        close, volume = round(px, 2), float(round(vol * 2.718 ** rng.gauss(0, 0.2)))
        if 60 <= t < 66:
            volume *= 6  # a busy stretch
        if t in (40, 150):
            i = bar(t, close * 1.5, volume)
            want |= {(i, "close")}
            want |= {(bar(t, close * 1.5, volume), "close")}  # delivered again
            bar(t, close, volume)  # corrected
        elif t == 90:
            want.add((bar(t, -1.0, 0.0), "close"))
            want.add((len(rows) - 1, "volume"))
        elif t == 100:
            want.add((bar(t, close, volume * 60), "volume"))
        elif 170 <= t < 178:
            i = bar(t, None if t == 173 else 77.25, volume)
            if t not in (170, 173):
                want.add((i, "close"))
        else:
            bar(t, close, volume)
    bar(0, float("nan"), None), bar(3, 50.0, 1e6, symbol="LONE")
    want.add((bar(3, 50.0, 1e6, None), "close"))  # without a vendor it still has neighbours
    rows.append((len(rows), day(0), None, None, None, None, -5.0, 1.0, None, day(0), "v/x"))
    want.add((len(rows) - 1, "close"))
    prices = spark.createDataFrame(rows, PRICE).withColumn("value", F.lit(1)).withColumn("day", F.lit(1))
    units = spark.createDataFrame([("v", day(0), 0)], "vendor string, day date, power int")
    got = [(r.row_id, r.field_name) for r in flag_implausible(prices, units).collect()]
    # The stuck value is far from the bars around it where the level has moved on; its first date may be flagged as a spike.
    first_stuck = {(i, "close") for i, r in enumerate(rows) if r[1] == day(170)}
    assert len(got) == len(set(got)) and set(got) - first_stuck == want
    assert flag_implausible(prices.limit(0), units).count() == 0
