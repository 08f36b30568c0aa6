"""Forward labels, walk-forward splits and directional hit metrics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof_forward
from ..functions.columns import rate
from .states import RISK_STATES

HORIZONS = (4, 13, 26, 52)


def label_ends(prices: DataFrame, calendar: DataFrame, horizons=HORIZONS) -> DataFrame:
    """First traded date at or after as_of + h weeks (J8): (as_of, horizon_weeks, end_date)."""
    weeks = F.explode(F.array(*[F.lit(int(h)) for h in sorted(set(horizons))])).alias("horizon_weeks")
    asked = calendar.select("as_of", weeks).withColumn("date", F.date_add("as_of", F.col("horizon_weeks") * 7))
    days = prices.select("date").distinct().select("date", weeks).withColumn("end_date", F.col("date"))
    return asof_forward(asked, days, ["horizon_weeks"], "date", ["end_date"]).drop("date")


def week_spans(known: DataFrame, horizons: list[int]) -> DataFrame:
    """Range minima of prices by seven-day weeks: a sparse table with one row per instrument and week.

    ``_from`` holds the lows from each weekday to the week's end; per horizon ``_whole`` is the low
    of the whole weeks between, from two spans of a power of two, and ``_until`` the lows up to each
    weekday of the last week. Weeks are hash aggregates of the bars; spans double on weekly rows,
    so no frame slides over bars. Weeks without a price are there too, with nulls.
    """
    weekday = F.pmod(F.unix_date("date"), F.lit(7))
    days = range(7)
    weeks = known.groupBy("ticker", F.floor(F.unix_date("date") / 7).alias("week")).agg(
        F.min("price").alias("_1"),
        *[F.min(F.when(weekday >= d, F.col("price"))).alias(f"_f{d}") for d in days],
        *[F.min(F.when(weekday <= d, F.col("price"))).alias(f"_u{d}") for d in days],
    )
    every = weeks.groupBy("ticker").agg(F.min("week").alias("a"), F.max("week").alias("b")).select("ticker", F.explode(F.sequence("a", "b")).alias("week"))
    rows = every.join(weeks, ["ticker", "week"], "left").withColumns(
        {"_from": F.array(*[F.col(f"_f{d}") for d in days]), "_until": F.array(*[F.col(f"_u{d}") for d in days])}
    )
    w = Window.partitionBy("ticker").orderBy("week")
    size = 1
    while 2 * size < max(horizons):
        rows = rows.withColumn(f"_{2 * size}", F.least(f"_{size}", F.lead(f"_{size}", size).over(w)))
        size *= 2
    out = []
    for h in horizons:
        span = 1 << max(0, (h - 1).bit_length() - 1)
        whole = F.least(F.lead(f"_{span}", 1).over(w), F.lead(f"_{span}", h - span).over(w)) if h > 1 else F.lit(None).cast("double")
        out += [whole.alias(f"_whole{h}"), F.lead("_until", h).over(w).alias(f"_until{h}")]
    return rows.select("ticker", "week", "_from", *out)


def path_returns(prices: DataFrame, calendar: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Return and low point of each instrument from each rebalance to each horizon.

    A path of h weeks ends on the weekday it starts on: its low is the least of the rest of the
    first week, the whole weeks between and the last week up to that day. Lows are asked for at
    rebalances only. A gap against the calendar inside the path makes it incomplete (P24).
    """
    horizons = sorted(set(horizons))
    known = prices.where("price is not null").select("ticker", "date", "price")
    # Position of a date in the union calendar: one row per trading day.
    position = known.select("date").distinct().withColumn(
        "idx", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date"))
    )
    w = Window.partitionBy("ticker").orderBy("date")
    pts = known.withColumn("rn", F.row_number().over(w)).join(position, "date")
    asked = calendar.select(F.col("as_of").alias("date")).distinct()
    start = pts.join(asked, "date", "left_semi").withColumn("week", F.floor(F.unix_date("date") / 7)).withColumnRenamed("date", "as_of")
    start = start.join(week_spans(known, horizons), ["ticker", "week"])
    weekday = F.pmod(F.unix_date("as_of"), F.lit(7))
    lows = [
        F.struct(F.lit(h).alias("horizon_weeks"), F.least(F.get("_from", weekday), F.col(f"_whole{h}"), F.get(f"_until{h}", weekday)).alias("_low"))
        for h in horizons
    ]
    start = start.select("ticker", "as_of", F.col("price").alias("start_price"), "idx", "rn", F.inline(F.array(*lows)))
    start = start.join(label_ends(prices, calendar, horizons), ["as_of", "horizon_weeks"])
    end = pts.select(
        "ticker", F.col("date").alias("end_date"), F.col("price").alias("end_price"), F.col("idx").alias("_idx"), F.col("rn").alias("_rn")
    )
    out = start.join(end, ["ticker", "end_date"], "left")
    complete = (F.col("_rn") - F.col("rn")) == (F.col("_idx") - F.col("idx"))
    return out.select(
        "ticker",
        "as_of",
        "horizon_weeks",
        "end_date",
        F.col("end_price").isNotNull().alias("priced"),
        F.coalesce(complete, F.lit(False)).alias("complete"),
        (F.col("end_price") / F.col("start_price") - 1).alias("path_return"),
        (F.least("_low", "end_price") / F.col("start_price") - 1).alias("path_low"),
    )


def class_benchmark(bench_by_class: dict[str, str], fallback: str) -> Column:
    """Benchmark of a class, else the fallback."""
    out = F.lit(fallback)
    for name, ticker in bench_by_class.items():
        out = F.when(F.col("class") == name, ticker).otherwise(out)
    return out


def forward_labels(
    scored: DataFrame,
    prices: DataFrame,
    calendar: DataFrame,
    bench_by_class: dict[str, str],
    fallback: str,
    horizons=HORIZONS,
    drawdown_threshold: float = -0.05,
) -> DataFrame:
    """Features with forward outcomes and success flags, one row per horizon."""
    ret = path_returns(prices, calendar, horizons)
    feats = scored.select(
        "as_of", "ticker", "class", "state", "selected", "veto", "S_score", "S_score_after_veto", "rs_ratio_z",
        class_benchmark(bench_by_class, fallback).alias("benchmark"),
        (F.col("selected") | (F.col("state") == "STAGE_2_BULLISH")).alias("positive_signal"),
        F.col("state").isin(*RISK_STATES).alias("negative_signal"),
    )
    known = prices.where(F.col("ticker").isin(*bench_by_class.values())).select(F.col("ticker").alias("benchmark"), F.lit(True).alias("_known")).distinct()
    feats = feats.join(known, "benchmark", "left").withColumn("benchmark", F.when(F.col("_known"), F.col("benchmark")).otherwise(fallback)).drop("_known")
    feats = feats.withColumn("horizon_weeks", F.explode(F.lit(list(horizons))))
    b = ret.where("priced").select(
        F.col("ticker").alias("benchmark"), "as_of", "horizon_weeks", F.col("path_return").alias("_bench")
    )
    # A row without a start price stays, as an unavailable label.
    df = feats.join(ret, ["ticker", "as_of", "horizon_weeks"], "left").join(b, ["benchmark", "as_of", "horizon_weeks"], "left")
    ok = F.col("priced") & F.col("complete") & F.col("_bench").isNotNull()
    df = df.withColumn("label_available", F.coalesce(ok, F.lit(False)))
    only = lambda c: F.when(F.col("label_available"), c)
    df = df.withColumns(
        {
            "forward_return": only(F.col("path_return")),
            "benchmark_return": only(F.col("_bench")),
            "excess_return": only(F.col("path_return") - F.col("_bench")),
            "drawdown": only(F.col("path_low")),
        }
    )
    pos, neg, ready = F.col("positive_signal"), F.col("negative_signal"), F.col("label_available")

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    df = df.withColumns(
        {
            "actual_positive": flag(ready & (F.col("forward_return") > 0) & (F.col("excess_return") > 0)),
            "avoided_underperformance": flag(neg & ready & (F.col("excess_return") < 0)),
            "failed_followthrough": flag(neg & ready & (F.col("forward_return") <= 0)),
            "avoided_drawdown": flag(neg & ready & (F.col("drawdown") <= drawdown_threshold)),
            "actual_negative": flag(
                ready
                & ((F.col("forward_return") <= 0) | (F.col("excess_return") < 0) | (F.col("drawdown") <= drawdown_threshold))
            ),
        }
    )
    return df.withColumns(
        {
            "positive_success": flag(pos & F.col("actual_positive")),
            "negative_success": F.col("avoided_underperformance") | F.col("failed_followthrough") | F.col("avoided_drawdown"),
        }
    ).drop("priced", "complete", "path_return", "path_low", "_bench")


def label_metrics(labels: DataFrame, group: str | None = "class") -> DataFrame:
    """Confusion counts and rates per direction and horizon, overall and per group.

    Overall and per-group rows come from one pass with grouping sets.
    """
    sides = F.explode(
        F.array(
            F.struct(F.lit("positive").alias("direction"), F.col("positive_signal").alias("signal"), F.col("actual_positive").alias("actual")),
            F.struct(F.lit("negative").alias("direction"), F.col("negative_signal").alias("signal"), F.col("actual_negative").alias("actual")),
        )
    ).alias("d")
    keys = ["horizon_weeks", "direction"] + ([group] if group else [])
    df = labels.select(*([group] if group else []), "horizon_weeks", "label_available", "forward_return", "excess_return", "drawdown", sides).select(
        "*", "d.direction", "d.signal", "d.actual"
    )
    sig, ready, hit = F.col("signal"), F.col("label_available"), F.col("actual")
    called = sig & ready
    loss = F.when(called & (F.col("direction") == "negative"), -F.least("drawdown", F.lit(0.0)))
    aggs = [
        F.count("*").alias("total_count"),
        F.count_if(ready).alias("available_count"),
        F.count_if(sig).alias("signal_count"),
        F.count_if(called).alias("signal_available_count"),
        F.count_if(hit).alias("actual_outcome_count"),
        F.count_if(called & hit).alias("true_positive"),
        F.count_if(called & ~hit).alias("false_positive"),
        F.count_if(~sig & ready & hit).alias("false_negative"),
        F.count_if(~sig & ready & ~hit).alias("true_negative"),
        F.coalesce(F.avg(F.when(called, F.col("forward_return"))), F.lit(0.0)).alias("average_forward_return"),
        F.coalesce(F.avg(F.when(called, F.col("excess_return"))), F.lit(0.0)).alias("average_forward_excess_return"),
        F.coalesce(F.avg(F.when(called, F.col("drawdown"))), F.lit(0.0)).alias("average_post_entry_drawdown"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("average_drawdown_avoided"),
    ]
    if group:
        base = ["horizon_weeks", "direction"]
        g = df.groupingSets([base, [*base, group]], *keys).agg(F.grouping(group).alias("_all"), *aggs)
        g = g.withColumn(group, F.when(F.col("_all") == 1, "all").otherwise(F.col(group))).drop("_all")
    else:
        g = df.groupBy(*keys).agg(*aggs)
    tp, fp, fn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative"))
    return g.withColumns(
        {
            "unavailable_count": F.col("total_count") - F.col("available_count"),
            "missing_label_rate": rate(F.col("total_count") - F.col("available_count"), F.col("total_count")),
            "signal_unavailable_count": F.col("signal_count") - F.col("signal_available_count"),
            "signal_missing_rate": rate(F.col("signal_count") - F.col("signal_available_count"), F.col("signal_count")),
            "hit_rate": rate(tp, F.col("signal_available_count")),
            "precision": rate(tp, tp + fp),
            "recall": rate(tp, tp + fn),
            "f1": rate(2 * tp, 2 * tp + fp + fn),
        }
    )


def _first_from(days: Column, target: Column) -> Column:
    return F.array_min(F.filter(days, lambda d: d >= target))


def _last_before(days: Column, target: Column) -> Column:
    return F.array_max(F.filter(days, lambda d: d < target))


def walk_forward_splits(
    calendar: DataFrame,
    years: int = 10,
    minimum_years: int | None = None,
    minimum_calibration_years: int = 3,
    calibration_years: int = 5,
    validation_years: int = 1,
    holdout_years: int = 1,
) -> DataFrame:
    """Rolling calibration and validation folds before a fixed final holdout (L1).

    One row holds the rebalance dates as an array, bounded by the calendar; each
    fold starts from the previous one, so the few folds unroll as columns. Too
    short or broken histories give no folds.
    """
    if minimum_years is not None and minimum_years > years:
        raise ValueError("minimum_years cannot exceed years")
    if minimum_calibration_years > calibration_years:
        raise ValueError("minimum_calibration_years cannot exceed calibration_years")
    if minimum_years is None and calibration_years + validation_years + holdout_years >= years:
        raise ValueError("no rolling history is left before the final holdout")
    one = calendar.agg(F.array_sort(F.collect_set("as_of")).alias("ds"))
    end, first = F.element_at("ds", -1), F.element_at("ds", 1)
    wanted = F.date_add(F.add_months(end, -12 * years), 1)
    short = first > wanted
    allowed = first <= F.date_add(F.add_months(end, -12 * minimum_years), 1) if minimum_years else F.lit(False)
    one = one.select(
        "ds", end.alias("we"), short.alias("short"), (~short | allowed).alias("ok"), F.when(short, first).otherwise(wanted).alias("target")
    )
    one = one.withColumn("wd", F.filter("ds", lambda d: d >= F.col("target"))).withColumn("ws", F.element_at("wd", 1))
    gaps = F.transform(F.slice("wd", F.lit(2), F.size("wd") - 1), lambda d, i: F.datediff(d, F.element_at("wd", i + 1)))
    smooth = (F.datediff("ws", "target") <= 7) & (F.coalesce(F.array_max(gaps), F.lit(0)) <= 45)
    coverage = F.floor((F.datediff("we", "ws") + 1) / 365.25).cast("int") - (validation_years + holdout_years)
    cal = F.when(F.col("short"), F.least(F.lit(calibration_years), coverage)).otherwise(calibration_years)
    enough = ~F.col("short") | (coverage >= minimum_calibration_years)
    one = one.where(F.col("ok") & smooth & enough).select(
        "wd", "we", "ws", cal.alias("cal"), _first_from(F.col("wd"), F.add_months("we", -12 * holdout_years)).alias("hs")
    )
    one = one.withColumn("cs", F.col("ws")).withColumn("live", F.lit(True))
    folds = []
    for k in range(years):
        one = one.withColumn(f"vs{k}", _first_from(F.col("wd"), F.add_months("cs", F.col("cal") * 12)))
        one = one.withColumns(
            {
                f"cs{k}": F.col("cs"),
                f"ce{k}": _last_before(F.col("wd"), F.col(f"vs{k}")),
                f"ve{k}": _last_before(F.col("wd"), F.least(F.add_months(f"vs{k}", 12 * validation_years), F.col("hs"))),
                "_next": _first_from(F.col("wd"), F.add_months("cs", 12 * validation_years)),
            }
        )
        valid = F.coalesce(
            F.col("live")
            & (F.col(f"vs{k}") < F.col("hs"))
            & (F.col(f"cs{k}") <= F.col(f"ce{k}"))
            & (F.col(f"ce{k}") < F.col(f"vs{k}"))
            & (F.col(f"vs{k}") <= F.col(f"ve{k}"))
            & (F.col(f"ve{k}") < F.col("hs")),
            F.lit(False),
        )
        one = one.withColumn("live", valid).withColumn(f"ok{k}", F.col("live")).withColumn("cs", F.col("_next"))
        folds.append(
            F.when(
                F.col(f"ok{k}"),
                F.struct(
                    F.lit(f"fold_{k + 1:02d}").alias("name"),
                    F.col(f"cs{k}").alias("calibration_start"),
                    F.col(f"ce{k}").alias("calibration_end"),
                    F.col(f"vs{k}").alias("validation_start"),
                    F.col(f"ve{k}").alias("validation_end"),
                    F.col("hs").alias("final_holdout_start"),
                    F.col("we").alias("final_holdout_end"),
                    F.col("cal").alias("calibration_years"),
                ),
            )
        )
    return one.select(F.explode(F.array_compact(F.array(*folds))).alias("f")).select("f.*")


def split_summary(splits: DataFrame, requested_years: int) -> DataFrame:
    """Coverage, history status and the no-lookahead check of the folds, one row (L3)."""
    c = F.col
    clean = (
        (c("calibration_start") <= c("calibration_end"))
        & (c("calibration_end") < c("validation_start"))
        & (c("validation_start") <= c("validation_end"))
        & (c("validation_end") < c("final_holdout_start"))
        & (c("final_holdout_start") <= c("final_holdout_end"))
    )
    s = splits.agg(
        F.count("*").alias("fold_count"),
        F.min("calibration_start").alias("window_start"),
        F.max("final_holdout_end").alias("window_end"),
        F.min("final_holdout_start").alias("holdout_start"),
        F.bool_and(clean).alias("no_lookahead_verified"),
        F.max("calibration_years").alias("effective_calibration_years"),
    )
    wanted = F.date_add(F.add_months("window_end", -12 * requested_years), 1)
    return s.withColumns(
        {
            "status": F.when(c("fold_count") > 0, "ready").otherwise("no_splits"),
            "coverage_years": F.round((F.datediff("window_end", "window_start") + 1) / 365.25, 2),
            "history_window_status": F.when(c("window_start") <= wanted, "full_requested_history").otherwise("accepted_short_history"),
        }
    )


def train_holdout_split(calendar: DataFrame, train_years: int = 5, min_holdout: float = 2, max_holdout: int = 3) -> DataFrame:
    """Fixed training years, then up to three holdout years, one row (L2)."""
    if min_holdout > max_holdout:
        raise ValueError("minimum holdout cannot exceed maximum holdout")
    one = calendar.agg(F.array_sort(F.collect_set("as_of")).alias("ds")).withColumn("train_start", F.element_at("ds", 1))
    one = one.withColumn("holdout_start", _first_from(F.col("ds"), F.add_months("train_start", 12 * train_years)))
    one = one.withColumn("holdout_end", _last_before(F.col("ds"), F.add_months("holdout_start", 12 * max_holdout)))
    years = (F.datediff("holdout_end", "holdout_start") + 1) / 365.25
    return one.select(
        F.when(years >= min_holdout, "ready").otherwise("insufficient_holdout").alias("status"),
        "train_start",
        _last_before(F.col("ds"), F.col("holdout_start")).alias("train_end"),
        "holdout_start",
        "holdout_end",
        F.round(years, 2).alias("holdout_years"),
    )
