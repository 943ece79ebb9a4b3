"""Quantities recorded in different units: units from words, and from identities among columns.

Two identities tie the recorded numbers together:

* shares traded = transactions x average trade size of the symbol, whatever vendor reports it;
* cash dividend per share = (1 - adjustment factor) x close before the ex-date.

In logarithms each is a sum, so a wrong unit moves the residual by whole powers of ten. Per vendor and
date the summed (capped) absolute residual of every candidate unit is one aggregate; a shortest path
over each vendor's dates then picks the sequence of units with the least residual, paying for every undocumented change.
What is documented enters as a mild preference, so data decide where there are enough of them; what a single
amount's own words say enters its own choice of unit as a stronger one.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.runtime import broadcast_if_small, norm_key, stage, staged_small

VOLUME_POWERS = tuple(range(0, 8))
CASH_POWERS = (0, -1, -2, -3, -4)
NUMBER_WORDS = {"one": 1, "ten": 10, "hundred": 100, "one hundred": 100, "thousand": 1000, "one thousand": 1000, "million": 10**6}
#: Cost of a change of unit, in summed powers of ten, of leaving the documented unit on one date, and of leaving the unit an amount's own words state.
SWITCH_COST, DOC_COST, WORD_COST, CAP, MARGIN = 4.0, 0.6, 1.2, 1.5, 1.0


def volume_power_from_words(note: str | None) -> int | None:
    """The power of ten of shares that a note on a volume field states; None if it states none."""
    s = (note or "").lower()
    if re.search(r"\blots?\b", s):
        m = re.search(r"(?:holds|of|is|=)\s+(\d[\d,]*|one hundred|one thousand|ten|hundred|thousand)\b", s)
        n = NUMBER_WORDS.get(m[1]) or int(m[1].replace(",", "")) if m else 100
        return round(np.log10(n)) if n > 0 else None
    for power, pattern in ((6, r"\bmio\b|million|\bmm\b|\bmn\b"), (3, r"'000|thousand|\btsd\b|\b000s\b|\bk sh"), (2, r"hundreds? of shares"), (0, r"single shares|share counts?|plain share|in shares|number of shares|st[üu]ck")):
        if re.search(pattern, s):
            return power
    return None


def cash_power_from_words(note: str | None) -> int | None:
    """The power of ten of US dollars per share that a note on a cash field states; None if it states none."""
    s = (note or "").lower()
    if re.search(r"\bmills?\b", s):
        power = -3
    elif re.search(r"\bcents?\b|\bct\b|¢|\busc\b", s):
        power = -2
    elif re.search(r"dollar|usd|us\$|\$", s):
        power = 0
    else:
        return None
    m = re.search(r"(?:holding of|for each|every|per|for|/)\s*(\d+|ten|one hundred|hundred|thousand)\b", s)
    n = (NUMBER_WORDS.get(m[1]) or int(m[1])) if m else 1
    return power - round(np.log10(n))


def documented_units(notes: DataFrame, field: str) -> DataFrame:
    """(vendor, from_day, to_day, power): the unit in force by the notes on ``field``, as intervals that exclude their end.

    Null from_day means from the beginning, null to_day until further notice. Notes that state no unit are left out; of several
    on one vendor and day the greatest power counts. The table is staged, as it is joined more than once.
    """
    read = volume_power_from_words if field == "volume" else cash_power_from_words

    def parse(batches):
        for b in batches:
            yield pd.DataFrame({"vendor": [(v or "").strip().lower() for v in b["vendor"]], "from_day": b["valid_from"], "power": pd.array([read(n) for n in b["note"]], "Int32")})

    said = notes.where(F.lower(F.trim("field_name")) == field).select("vendor", "valid_from", "note").mapInPandas(parse, "vendor string, from_day date, power int")
    said = said.where("power is not null").groupBy("vendor", "from_day").agg(F.max("power").alias("power"))
    in_time = Window.partitionBy("vendor").orderBy(F.col("from_day").asc_nulls_first())
    return stage(said.select("vendor", "from_day", F.lead("from_day").over(in_time).alias("to_day"), "power"), "documented-units")


def with_documented(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (vendor, day, ...) with ``doc``, the documented power of their vendor and day or null; one row each, as intervals do not overlap."""
    d = broadcast_if_small(docs.select(F.col("vendor").alias("_dv"), "from_day", "to_day", F.col("power").alias("doc")))
    inside = (F.col("from_day").isNull() | (F.col("day") >= F.col("from_day"))) & (F.col("to_day").isNull() | (F.col("day") < F.col("to_day")))
    return rows.join(d, (F.col("vendor") == F.col("_dv")) & inside, "left").drop("_dv", "from_day", "to_day")


def choose_units(powers: tuple[int, ...]):
    """A function for ``applyInPandas`` by vendor: cells (vendor, day, n, doc, c0, c1, ...) to (vendor, day, n, power, residual, unique_fit)."""

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("day", kind="stable")
        k, t_n = len(powers), len(cells)
        plain = cells[[f"c{i}" for i in range(k)]].to_numpy(float)
        cost = plain.copy()
        place = {p: i for i, p in enumerate(powers)}
        stated = np.array([place.get(int(d), -1) if d is not None and d == d else -1 for d in cells["doc"]])
        told = stated >= 0
        cost[told] += DOC_COST * (np.arange(k)[None, :] != stated[told][:, None])
        best, back = cost[0].copy(), np.zeros((t_n, k), int)
        for t in range(1, t_n):
            move = SWITCH_COST * (1 - np.eye(k))
            if stated[t] != stated[t - 1] and told[t]:
                move[:, stated[t]] = 0.0  # a documented change costs nothing
            come = best[:, None] + move
            back[t] = come.argmin(0)
            best = come.min(0) + cost[t]
        path = [int(best.argmin())]
        for t in range(t_n - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        path = np.array(path[::-1])
        # A stretch of one unit is unique if any other unit is clearly worse over the whole of it.
        unique = np.zeros(t_n, bool)
        for part in np.split(np.arange(t_n), np.flatnonzero(np.diff(path)) + 1):
            total = cost[part].sum(0)
            unique[part] = np.delete(total, path[part[0]]).min() - total[path[part[0]]] > MARGIN
        n = cells["n"].to_numpy()
        return pd.DataFrame({"vendor": cells["vendor"].to_numpy(), "day": cells["day"].to_numpy(), "n": n, "power": np.asarray(powers)[path], "residual": plain[np.arange(t_n), path] / n, "unique_fit": unique})

    return fit


def _fit(cells: DataFrame, residual: F.Column, powers: tuple[int, ...]) -> DataFrame:
    costs = [F.sum(F.coalesce(F.least(F.abs(residual + p), F.lit(CAP)), F.lit(0.0))).alias(f"c{i}") for i, p in enumerate(powers)]
    by_day = cells.groupBy("vendor", "day").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("doc"), *costs)
    return by_day.groupBy("vendor").applyInPandas(choose_units(powers), "vendor string, day date, n long, power int, residual double, unique_fit boolean")


def vendor_of(source: F.Column) -> F.Column:
    """The vendor is what stands before the first slash or colon; 'unknown' if there is none."""
    return F.coalesce(F.lower(F.trim(F.regexp_extract(source, "^([^/:]*)", 1))), F.lit("unknown"))


def volume_units(prices: DataFrame, notes: DataFrame) -> DataFrame:
    """(vendor, day, n, power, residual, unique_fit): one volume recorded by ``vendor`` for ``day`` is 10**power shares.

    ``prices``: date, symbol, volume, transactions, source_id. A symbol's average trade size is the median
    over rows of documented units (over all rows if nothing is documented; the common scale is then not
    unique and all fits are marked so). Rows with null, zero or negative volume or transactions give no
    evidence but have a unit. Where there is no evidence the documented unit stands, else 1, marked
    not unique. Rows with a null date are left out. The result has one row per vendor and day; ``n`` rows lie behind it and ``residual`` is their
    mean (capped) distance from the identity, in powers of ten.
    """
    docs = documented_units(notes, "volume")
    p = prices.select(vendor_of(F.col("source_id")).alias("vendor"), F.col("date").alias("day"), norm_key(F.col("symbol")).alias("symbol"), F.col("volume").cast("double").alias("v"), F.col("transactions").cast("double").alias("t")).where("day is not null")
    x = F.when((F.col("v") > 0) & (F.col("t") > 0) & ~F.isnan("v"), F.log10(F.col("v") / F.col("t")))
    p = with_documented(p.withColumn("x", x), docs)
    anchored = docs.limit(1).count() > 0
    level = F.col("x") + (F.col("doc") if anchored else F.lit(0))
    scale = p.groupBy("symbol").agg(F.percentile_approx(level, 0.5, 1000).alias("s"))
    cells = p.join(staged_small(scale.where("s is not null and symbol is not null"), "trade-size", 1_000_000), "symbol", "left")
    fit = stage(_fit(cells, F.col("x") - F.col("s"), VOLUME_POWERS), "volume-units")  # a row per vendor and day, read more than once
    return fit if anchored else fit.withColumn("unique_fit", F.lit(False))


AMOUNT = r"(\d+(?:[.,]\d+)?)"
PER = r"(?:\bper|/|\beach|\bevery|\bholding of)\s*(\d+|ten|hundred|one hundred|thousand)\b(?!\.)"


def stated_cash_power(text: F.Column) -> F.Column:
    """The power of ten of US dollars per share that a dividend's own words state, else null."""
    s = F.lower(text)
    money = (
        F.when(s.rlike(r"\bmills?\b"), -3)
        .when(s.rlike(r"\bcents?\b|\bct\b|¢|\busc\b|\d\s*c\b"), -2)
        .when(s.rlike(r"dollar|usd|us\$|\$"), 0)
    )
    n = F.regexp_extract(s, PER, 1)
    per = F.when(n == "", 0).when(n == "ten", 1).when(n.isin("hundred", "one hundred"), 2).when(n == "thousand", 3).otherwise(F.round(F.log10(n.try_cast("double"))).cast("int"))
    return money - per


def stated_amount(text: F.Column) -> F.Column:
    """The number in a dividend's words that is not the number of shares it is for, else null."""
    s = F.regexp_replace(F.lower(text), PER, " ")
    return F.regexp_replace(F.regexp_extract(s, AMOUNT, 1), ",", ".").try_cast("double")


def dividend_residuals(events: DataFrame, prices: DataFrame) -> DataFrame:
    """(event_id, vendor, symbol, day, amount, stated, residual), one row per dividend with an amount.

    ``amount`` is ``dividend_cash``, or if that is null the amount in ``dividend_text``; ``stated`` the power of ten its own words state;
    ``residual`` its decimal logarithm over what the identity says, (1 - factor) x the median close of the ten days before, which a spike does not move; null without a
    factor between 0 and 1, a close or a positive amount. Repeats of an event_id count once: the row of
    the latest as_of_date, nulls last, then the greatest amount. Splits, rows with a null event_id and rows
    without an amount (null, NaN, or zero with no words) give no row. The table is staged.
    """
    cash = F.when(~F.isnan("dividend_cash"), F.col("dividend_cash"))
    e = (
        events.where(F.lower("source").contains("dividend") & F.col("event_id").isNotNull())
        .select("event_id", vendor_of(F.col("source")).alias("vendor"), norm_key(F.col("symbol")).alias("symbol"), F.col("ex_date").alias("day"), "as_of_date", F.coalesce(cash, stated_amount(F.col("dividend_text"))).alias("amount"), stated_cash_power(F.col("dividend_text")).alias("stated"), F.col("provider_adj_factor").alias("f"))
        .where("amount is not null")
        .groupBy("event_id")
        .agg(F.max_by(F.struct("vendor", "symbol", "day", "amount", "stated", "f"), F.struct(F.coalesce("as_of_date", F.lit("0001-01-01").cast("date")), "amount")).alias("r"))
        .select("event_id", "r.*")
    )
    e = stage(e, "dividends")
    # Each event asks for the ten days before its ex-date: an equi-join on (symbol, date), also for a hot symbol.
    asked = e.where("f > 0 and f < 1 and amount > 0").select("event_id", "symbol", F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.date_sub("day", k))).alias("date"))
    closes = prices.where("close > 0").select(norm_key(F.col("symbol")).alias("symbol"), "date", F.col("close").cast("double").alias("close"))
    before = broadcast_if_small(asked).join(closes, ["symbol", "date"]).groupBy("event_id").agg(F.percentile("close", 0.5).alias("prev_close"))
    residual = F.log10(F.col("amount") / ((1 - F.col("f")) * F.col("prev_close")))
    return stage(e.join(before, "event_id", "left").select("event_id", "vendor", "symbol", "day", "amount", "stated", residual.alias("residual")), "dividend-residuals")


def dividend_units(events: DataFrame, prices: DataFrame, notes: DataFrame) -> DataFrame:
    """(event_id, symbol, ex_date, recorded, power, usd_per_share, residual, unique_fit), one row per event of :func:`dividend_residuals`.

    The unit of an amount with words of its own is the power with the least cost: the distance from the identity, and
    ``WORD_COST`` for any power but the stated one; so words decide unless the identity contradicts them by two powers of ten or more. All others take the
    unit chosen for their vendor and ex-date by the shortest path over the identity's residuals and the documented units; without a date
    the documented unit, else 1. ``residual`` is the distance from the identity in the chosen unit, null where it says nothing.
    """
    e = with_documented(dividend_residuals(events, prices), documented_units(notes, "dividend_cash"))
    fit = _fit(e.where("stated is null and day is not null and amount > 0"), F.col("residual"), CASH_POWERS)
    out = e.join(staged_small(fit.select("vendor", "day", F.col("power").alias("chosen"), "unique_fit"), "cash-units"), ["vendor", "day"], "left")
    off = lambda p: F.coalesce(F.least(F.abs(F.col("residual") + p), F.lit(CAP)), F.lit(0.0))
    powers = F.array_union(F.array(*[F.lit(p) for p in CASH_POWERS]), F.array("stated"))
    ranked = F.array_sort(F.transform(powers, lambda p: F.struct((off(p) + F.when(p == F.col("stated"), 0.0).otherwise(WORD_COST)).alias("cost"), (p != F.col("stated")).alias("other"), p.alias("power"))))
    out = out.withColumn("_ranked", F.when(F.col("stated").isNotNull(), ranked))
    power = F.coalesce(F.col("_ranked")[0]["power"], "chosen", "doc", F.lit(0))
    clear = F.col("_ranked")[1]["cost"] - F.col("_ranked")[0]["cost"] > MARGIN
    return out.select(
        "event_id", "symbol", F.col("day").alias("ex_date"), F.col("amount").alias("recorded"), power.alias("power"), (F.col("amount") * F.pow(F.lit(10.0), power)).alias("usd_per_share"),
        F.abs(F.col("residual") + power).alias("residual"), F.coalesce(clear, "unique_fit", F.lit(False)).alias("unique_fit"),
    )
