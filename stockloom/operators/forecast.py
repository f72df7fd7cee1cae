"""The 30-day forecast. It stays an array on its row: no shuffle and no explode."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalar import digest_polar, keyed_digest, round_half_even
from stockloom.functions.values import HORIZON, LEAD_DAYS, Policy
from stockloom.operators.demand import NOISE_KEY


def with_trend(days: Column) -> Column:
    """Add the trend to an array of (date, demand): by comparison with the day before, the first day is stable.

    ``days`` should be a column of its own: it is read once per element.
    """

    def step(day: Column, i: Column) -> Column:
        previous = F.try_element_at(days, i)["demand"]
        trend = F.when(i == 0, "Stable").when(day["demand"] > previous, "Up").when(day["demand"] < previous, "Down")
        return F.struct(day["date"].alias("date"), day["demand"].alias("demand"), F.coalesce(trend, F.lit("Stable")).alias("trend"))

    return F.transform(days, step)


def _calendar(policy: Policy, as_of: str) -> Column:
    """The forecast days with their factors: a constant, since they depend on the run date only."""
    days, pairs = _levels(policy, as_of)
    return F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(day).alias("date"), F.lit(level).alias("level"), F.lit(season).alias("season"))
        for i, (day, (level, season)) in enumerate(zip(days, pairs, strict=True))
    ])


def _levels(policy: Policy, as_of: str) -> tuple[list[datetime.date], list[tuple[float, float]]]:
    """The forecast days, and the weekday and month factor of each: a handful of different pairs."""
    start = datetime.date.fromisoformat(as_of)
    days = [start + datetime.timedelta(days=i) for i in range(HORIZON)]
    level = [policy.weekend_factor if d.weekday() >= 5 else policy.weekday_factor for d in days]
    return days, [(x, policy.month_factors[d.month - 1]) for x, d in zip(level, days, strict=True)]


def steady_forecast(df: DataFrame, policy: Policy, as_of: str) -> DataFrame:
    """``forecast`` without noise, with ``total_30day`` and ``lead_time_demand``.

    A row has as many different daily values as there are pairs of factors. Each is rounded once, as a column; the days only pick
    among them, and the totals add them up in order of the days.
    """
    days, pairs = _levels(policy, as_of)
    kinds = sorted(set(pairs))
    raw = {f"_raw{k}": F.col("demand") * level * season for k, (level, season) in enumerate(kinds)}
    value = {
        f"_value{k}": F.greatest(F.lit(policy.daily_floor), round_half_even(F.col(f"_raw{k}"), 2)) for k in range(len(kinds))
    }
    kind = [kinds.index(p) for p in pairs]
    steps = sorted({(b, a) for b, a in zip(kind, kind[1:], strict=False) if a != b})

    def trend(before: int, after: int) -> Column:
        x, y = F.col(f"_value{before}"), F.col(f"_value{after}")
        return F.when(y > x, "Up").when(y < x, "Down").otherwise("Stable")

    calendar = F.array(*[
        F.struct(
            F.lit(day).alias("date"), F.lit(k + 1).alias("kind"),
            F.lit(2 + steps.index((b, k)) if b is not None and b != k else 1).alias("step"),
        )
        for day, k, b in zip(days, kind, [None, *kind[:-1]], strict=True)
    ])
    out = df.withColumns(raw).withColumns(value)
    out = out.withColumns({
        "_values": F.array(*value), "_trends": F.array(F.lit("Stable"), *(trend(b, a) for b, a in steps)),
        "total_30day": sum((F.col(f"_value{k}") for k in kind), F.lit(0.0)),
        "lead_time_demand": sum((F.col(f"_value{k}") for k in kind[:LEAD_DAYS]), F.lit(0.0)),
    })
    picked = F.transform(calendar, lambda d: F.struct(
        d["date"].alias("date"), F.element_at(F.col("_values"), d["kind"]).alias("demand"),
        F.element_at(F.col("_trends"), d["step"]).alias("trend"),
    ))
    return out.withColumn("forecast", picked).drop(*raw, *value, "_values", "_trends")


def forecast_with_totals(df: DataFrame, policy: Policy, as_of: str, noise: str = "off") -> DataFrame:
    if noise == "off":
        return steady_forecast(df, policy, as_of)
    return forecast_totals(daily_forecast(df, policy, as_of, noise))


def daily_forecast(df: DataFrame, policy: Policy, as_of: str, noise: str = "off", seed: int = 42) -> DataFrame:
    """Add ``forecast``: one element for each of the 30 days from the run date."""
    if noise == "off":
        return steady_forecast(df, policy, as_of).drop("total_30day", "lead_time_demand")
    keys = [F.col(c) for c in NOISE_KEY if c in df.columns]
    blocks = F.array(*map(F.lit, range(-(-HORIZON // 4))))
    pairs = F.array(*map(F.lit, range(-(-HORIZON // 2))))
    out = df.withColumn("_digests", F.transform(
        blocks, lambda b: keyed_digest(keys, F.concat(F.lit("days"), b.cast("string")), seed)
    ))
    # four words of a digest make two pairs of normals
    out = out.withColumn("_pairs", F.transform(
        pairs, lambda p: digest_polar(F.get(F.col("_digests"), (p / 2).cast("int")), 2 * (p % 2))
    ))

    def raw(day: Column) -> Column:
        pair = F.get(F.col("_pairs"), (day["i"] / 2).cast("int"))
        normal = pair["radius"] * F.when(day["i"] % 2 == 0, F.cos(pair["angle"])).otherwise(F.sin(pair["angle"]))
        factor = 1.0 + policy.noise_sd * normal
        if policy.noise_low is not None:
            factor = F.greatest(F.lit(policy.noise_low), F.least(F.lit(policy.noise_high), factor))
        return F.struct(day["date"].alias("date"), (F.col("demand") * day["level"] * day["season"] * factor).alias("raw"))

    def demand(day: Column) -> Column:
        value = F.greatest(F.lit(policy.daily_floor), round_half_even(day["raw"], 2))
        return F.struct(day["date"].alias("date"), value.alias("demand"))

    out = out.withColumn("forecast", F.transform(F.transform(_calendar(policy, as_of), raw), demand))
    return out.withColumn("forecast", with_trend(F.col("forecast"))).drop("_digests", "_pairs")


def demand_sum(days: Column) -> Column:
    return F.aggregate(days, F.lit(0.0), lambda total, d: total + d["demand"])


def first_days(days: Column, n: int = LEAD_DAYS) -> Column:
    return F.slice(days, 1, n)


def forecast_totals(df: DataFrame) -> DataFrame:
    """The 30-day total and the lead-time demand (first seven days)."""
    return df.withColumns({
        "total_30day": demand_sum(F.col("forecast")),
        "lead_time_demand": demand_sum(first_days(F.col("forecast"))),
    })


def stockout_date(days: Column, inventory: Column) -> Column:
    """The first day on which the cumulated forecast exceeds the inventory."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("date").alias("hit"))

    def step(state: Column, d: Column) -> Column:
        total = state["total"] + d["demand"]
        hit = F.coalesce(state["hit"], F.when(total > inventory, d["date"]))
        return F.struct(total.alias("total"), hit.alias("hit"))

    return F.aggregate(days, start, step, lambda state: state["hit"])


def normalize_forecast(df: DataFrame, as_list: str, as_map: str, name: str = "forecast") -> DataFrame:
    """The list form of a stored forecast; a date -> value map is ordered by date and given trends, else it is empty."""
    entries = F.transform(
        F.array_sort(F.map_entries(as_map)),
        lambda e: F.struct(e["key"].try_cast("date").alias("date"), e["value"].alias("demand")),
    )
    empty = F.array().cast("array<struct<date:date,demand:double,trend:string>>")
    out = df.withColumn("_days", entries)
    return out.withColumn(name, F.coalesce(as_list, with_trend(F.col("_days")), empty)).drop("_days")
