"""Candidate rules: search over folds, expanded grid, bootstrap, guardrails, promotion."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof_backward
from ..functions.columns import let, rate, sorted_quantile

# Thresholds of the expanded grid and the order of its rules.
SCORE_AT_LEAST = (0.8, 1.0, 1.2)
SCORE_AT_MOST = (0.0, -0.5, -1.0)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def fold_windows(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """Labels in every window they are mature for (F11): adds fold and window.

    ``splits`` is a handful of folds; they reach the labels as one array value, so
    the labels are not shuffled or paired with anything but the folds they fall in.
    """
    arr = splits.agg(F.array_sort(F.collect_list(F.struct(*splits.columns)))).scalar()
    df = labels.withColumn("_f", F.explode(arr))
    d, e, f = F.col("as_of"), F.col("end_date"), F.col
    cal = d.between(f("_f.calibration_start"), f("_f.calibration_end")) & (e <= f("_f.calibration_end"))
    val = d.between(f("_f.validation_start"), f("_f.validation_end")) & (e < f("_f.final_holdout_start"))
    hold = d.between(f("_f.final_holdout_start"), f("_f.final_holdout_end")) & (e <= f("_f.final_holdout_end"))
    # The holdout is the same in every fold: count it once.
    hold = hold & (f("_f.name") == "fold_01")
    window = F.when(cal, "calibration").when(val, "validation").when(hold, "final_holdout")
    return df.withColumn("window", window).where("window is not null").withColumn("fold", f("_f.name")).drop("_f")


def _rule_values(rules: list[dict]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r["candidate_id"]).alias("candidate_id"),
                F.lit(i).alias("rule_order"),
                F.lit(r.get("positive_min")).cast("double").alias("positive_min"),
                F.lit(r.get("negative_max")).cast("double").alias("negative_max"),
            )
            for i, r in enumerate(rules)
        ]
    )


def rule_cells(windowed: DataFrame, rules: list[dict]) -> DataFrame:
    """Signal and success counts per rule, horizon, fold and window.

    Labels first collapse to counts per threshold band, so rules fan out over the few
    bands and not over the labels.
    """
    lows = sorted({r["positive_min"] for r in rules if r.get("positive_min") is not None})
    highs = sorted({r["negative_max"] for r in rules if r.get("negative_max") is not None})
    s = F.col("S_score_after_veto")
    up = F.concat(F.lit(""), *[_flag(s >= t).cast("int").cast("string") for t in lows])
    down = F.concat(F.lit(""), *[_flag(s <= t).cast("int").cast("string") for t in highs])
    ready = F.col("label_available")
    bands = windowed.groupBy("horizon_weeks", "fold", "window", up.alias("_up"), down.alias("_down")).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("positive_signal") & ready).alias("pos_n"),
        F.count_if(F.col("positive_success")).alias("pos_hit"),
        F.count_if(F.col("negative_signal") & ready).alias("neg_n"),
        F.count_if(F.col("negative_success")).alias("neg_hit"),
    )
    fan = bands.withColumn("r", F.explode(_rule_values(rules)))
    in_up, in_down = F.col("r.positive_min").isNull(), F.col("r.negative_max").isNull()
    for i, t in enumerate(lows):
        in_up = in_up | ((F.col("r.positive_min") == t) & (F.substring("_up", i + 1, 1) == "1"))
    for i, t in enumerate(highs):
        in_down = in_down | ((F.col("r.negative_max") == t) & (F.substring("_down", i + 1, 1) == "1"))

    def total(c: str, mask: Column) -> Column:
        return F.sum(F.when(_flag(mask), F.col(c)).otherwise(0)).alias(c)

    return fan.groupBy("r.candidate_id", "r.rule_order", "r.positive_min", "r.negative_max", "horizon_weeks", "fold", "window").agg(
        F.sum("rows").alias("rows"), total("pos_n", in_up), total("pos_hit", in_up), total("neg_n", in_down), total("neg_hit", in_down)
    )


def candidate_search(
    windowed: DataFrame,
    rules: list[dict],
    min_signals: int = 20,
    max_negative_degradation: float = 0.0,
    min_fold_delta: float = 0.0,
    baseline: str = "baseline",
    splits: DataFrame | None = None,
    horizons: tuple[int, ...] = (),
    evaluate_final_holdout: bool = True,
) -> DataFrame:
    """Candidates against the baseline over the folds; one is selected on calibration
    windows only and then judged on the final holdout (L8-L10).

    The baseline is every label, whether or not a rule is called so. With ``splits`` and
    ``horizons`` also folds and horizons without a mature label count, with zeros. Holdout
    figures are shown for the row that was judged on it, and for no other.
    """
    known = any(r["candidate_id"] == baseline for r in rules)
    rules = rules if known else [*rules, {"candidate_id": baseline}]
    cells = rule_cells(windowed, rules)
    keys = ["candidate_id", "rule_order", "positive_min", "negative_max", "horizon_weeks"]

    def part(c: str, window: str) -> Column:
        return F.sum(F.when(F.col("window") == window, F.col(c)).otherwise(0)).alias(f"{window}_{c}")

    windows = ("calibration", "validation", "final_holdout")
    counts = [f"{w}_{c}" for w in windows for c in ("pos_n", "pos_hit", "neg_n", "neg_hit")] + ["final_holdout_rows", "seen_folds"]
    tot = cells.groupBy(*keys).agg(
        *[part(c, w) for w in windows for c in ("pos_n", "pos_hit", "neg_n", "neg_hit")],
        part("rows", "final_holdout"),
        F.count_distinct("fold").alias("seen_folds"),
    )
    if horizons:
        every = windowed.sparkSession.range(1).select(F.inline(_rule_values(rules)), F.lit(list(horizons)).alias("h"))
        every = every.withColumn("horizon_weeks", F.explode("h")).drop("h")
        tot = every.join(tot.drop("rule_order", "positive_min", "negative_max"), ["candidate_id", "horizon_weeks"], "left").fillna(0, counts)
    folds = splits.agg(F.count(F.lit(1))).scalar() if splits is not None else F.col("seen_folds")
    tot = tot.withColumn("fold_count", folds)
    for w in windows:
        for side in ("pos", "neg"):
            tot = tot.withColumn(f"{w}_{side}_rate", rate(F.col(f"{w}_{side}_hit"), F.col(f"{w}_{side}_n")))
    rates = [f"{w}_{side}_rate" for w in windows for side in ("pos", "neg")]
    base = tot.where(F.col("candidate_id") == baseline).select("horizon_weeks", *[F.col(c).alias(f"base_{c}") for c in rates])
    df = tot.join(base, "horizon_weeks")
    for c in rates:
        df = df.withColumn(c.replace("_rate", "_delta"), F.col(c) - F.col(f"base_{c}"))
    # Worst fold of the validation windows.
    v = cells.where("window = 'validation'").select(
        "candidate_id", "horizon_weeks", "fold",
        rate(F.col("pos_hit"), F.col("pos_n")).alias("p"), rate(F.col("neg_hit"), F.col("neg_n")).alias("n"),
    )
    vb = v.where(F.col("candidate_id") == baseline).select("horizon_weeks", "fold", F.col("p").alias("bp"), F.col("n").alias("bn"))
    worst = (
        v.join(vb, ["horizon_weeks", "fold"])
        .groupBy("candidate_id", "horizon_weeks")
        .agg(F.min(F.least(F.col("p") - F.col("bp"), F.col("n") - F.col("bn"))).alias("min_fold_delta"), F.count(F.lit(1)).alias("_folds"))
    )
    df = df.join(worst, ["candidate_id", "horizon_weeks"], "left").fillna({"min_fold_delta": 0.0})
    if splits is not None:  # a fold without labels counts as no change
        empty = F.coalesce("_folds", F.lit(0)) < F.col("fold_count")
        df = df.withColumn("min_fold_delta", F.when(empty, F.least("min_fold_delta", F.lit(0.0))).otherwise(F.col("min_fold_delta")))
    uses_pos = F.col("positive_min").isNotNull() | F.col("negative_max").isNull()
    uses_neg = F.col("negative_max").isNotNull() | F.col("positive_min").isNull()

    def thin(w: str) -> Column:
        return (uses_pos & (F.col(f"{w}_pos_n") < min_signals)) | (uses_neg & (F.col(f"{w}_neg_n") < min_signals))

    is_base = F.col("candidate_id") == baseline
    early = (
        F.when(is_base, "baseline_reference")
        .when(thin("calibration") | thin("validation"), "rejected_thin_sample")
        .when(F.col("validation_neg_delta") < -max_negative_degradation, "rejected_negative_signal_degraded")
        .when(F.col("validation_pos_delta") < 0, "rejected_positive_signal_degraded")
        .when(F.col("min_fold_delta") < min_fold_delta, "rejected_unstable_folds")
        .otherwise("blocked_final_holdout_not_evaluated")
    )
    df = df.withColumn("gate_status", early).withColumn(
        "calibration_objective_delta", F.col("calibration_pos_delta") + F.col("calibration_neg_delta")
    )
    # Rules x horizons rows: the selection sorts a configured list, not data.
    order = Window.partitionBy(F.lit(1)).orderBy(
        is_base, F.col("gate_status") != "blocked_final_holdout_not_evaluated",
        F.desc("calibration_objective_delta"), "horizon_weeks", "candidate_id",
    )
    df = df.withColumn("selected_by_calibration", (F.row_number().over(order) == 1) & ~is_base)
    judged = F.col("selected_by_calibration") & (F.col("gate_status") == "blocked_final_holdout_not_evaluated")
    better = (uses_pos & (F.col("final_holdout_pos_delta") > 0)) | (uses_neg & (F.col("final_holdout_neg_delta") > 0))
    final = (
        F.when(F.col("final_holdout_rows") == 0, "rejected_final_holdout_no_data")
        .when(thin("final_holdout"), "rejected_final_holdout_thin_sample")
        .when(F.col("final_holdout_neg_delta") < -max_negative_degradation, "rejected_final_holdout_degraded")
        .when(F.col("final_holdout_pos_delta") < 0, "rejected_final_holdout_degraded")
        .when(~better, "rejected_final_holdout_no_improvement")
        .otherwise("passed_final_holdout_research_candidate")
    )
    if not evaluate_final_holdout:
        judged = F.lit(False)
    df = df.withColumn("_judged", judged).withColumn("gate_status", F.when(F.col("_judged"), final).otherwise(F.col("gate_status")))
    label = (
        F.when(F.col("gate_status") == "passed_final_holdout_research_candidate", "candidate")
        .when(F.col("gate_status") == "blocked_final_holdout_not_evaluated", "needs more testing")
        .otherwise("do not promote")
    )
    shown = [c for c in df.columns if c.startswith("final_holdout_")]
    df = df.withColumns({c: F.when(F.col("_judged"), F.col(c)) for c in shown if c != "final_holdout_rows"})
    if not known:
        df = df.where(~is_base)
    rejected = F.col("gate_status").startswith("rejected")
    out = df.withColumns(
        {
            "promotion_label": label,
            "rejection_reasons": F.when(rejected, F.regexp_replace("gate_status", "^rejected_", "")).otherwise(""),
            "final_holdout_evaluated": F.col("_judged") & (F.col("final_holdout_rows") > 0),
            "final_holdout_rows_used": F.when(F.col("_judged"), F.col("final_holdout_rows")).otherwise(0),
            "directions_changed": F.concat_ws(",", F.when(uses_pos, "positive"), F.when(uses_neg, "negative")),
            "live_promotion_allowed": F.lit(False),
        }
    ).drop("_judged", "_folds", "seen_folds", "final_holdout_rows")
    counted = splits if splits is not None else windowed
    ready = counted.agg(F.count(F.lit(1))).scalar()
    return out.where(ready > 0).unionByName(_skip_row(counted, min(horizons) if horizons else None), allowMissingColumns=True)


def _skip_row(counted: DataFrame, horizon: int | None) -> DataFrame:
    """The row of a search that has no folds; none where it has some. Its texts."""
    none = counted.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return none.select(
        F.lit("no_ready_walk_forward_splits").alias("candidate_id"),
        F.lit(horizon).cast("int").alias("horizon_weeks"),
        F.lit("skipped_insufficient_history").alias("gate_status"),
        F.lit("do not promote").alias("promotion_label"),
        F.lit("no_ready_walk_forward_splits").alias("rejection_reasons"),
        F.lit(False).alias("selected_by_calibration"),
        F.lit(False).alias("final_holdout_evaluated"),
        F.lit(0).cast("bigint").alias("final_holdout_rows_used"),
        F.lit(False).alias("live_promotion_allowed"),
    )


def _token(value: float) -> str:
    return str(value).replace("-", "minus_").replace(".", "_")


def grid_rules() -> list[dict]:
    """The nine rules of one scope."""
    rules = []
    for t in SCORE_AT_LEAST:
        rules.append({"suffix": f"positive_score_ge_{_token(t)}", "direction": "positive", "limit": t, "strength": False})
        rules.append({"suffix": f"positive_score_ge_{_token(t)}_rel_strength_ge_0_0", "direction": "positive", "limit": t, "strength": True})
    for t in SCORE_AT_MOST:
        rules.append({"suffix": f"negative_score_le_{_token(t)}", "direction": "negative", "limit": t, "strength": False})
    return rules


def scope_grid(scopes: DataFrame) -> DataFrame:
    """Rules of every scope: ``scopes`` has scope and sector (null for a whole class)."""
    prefix = F.lower(F.regexp_replace(F.coalesce("sector", "scope"), "[ -]", "_"))
    return scopes.withColumn("r", F.explode(_grid_array())).select(
        F.concat(prefix, F.lit("_"), F.col("r.suffix")).alias("candidate_id"), "scope", "sector", "r.direction", "r.limit", "r.strength"
    )


def _grid_array() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r["suffix"]).alias("suffix"), F.lit(r["direction"]).alias("direction"),
                F.lit(float(r["limit"])).alias("limit"), F.lit(r["strength"]).alias("strength"),
            )
            for r in grid_rules()
        ]
    )


def score_cube(labels: DataFrame, split: DataFrame, sectors: list[str] | None = None) -> DataFrame:
    """Label counts and sums per scope, horizon, window, date and score band.

    A label belongs to three scopes: global, its class, its own instrument. It fans out by those
    three only. ``up`` and ``down`` tell how many of the grid's limits a score meets from its first
    one on; limits are nested, so a rule's labels are those of all bands beyond its own. A third of
    the labels may share one scope: counts combine map-side per date.
    """
    one = split.where("status = 'ready'").agg(F.max(F.struct("train_start", "train_end", "holdout_start", "holdout_end"))).scalar()
    df = labels.withColumn("_s", one)
    d, e, f = F.col("as_of"), F.col("end_date"), F.col
    train = d.between(f("_s.train_start"), f("_s.train_end")) & (e <= f("_s.train_end"))
    hold = d.between(f("_s.holdout_start"), f("_s.holdout_end")) & (e <= f("_s.holdout_end"))
    df = df.withColumn("window", F.when(train, "train").when(hold, "holdout")).where("window is not null")
    scopes = F.array(
        F.struct(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("sector")),
        F.struct(F.col("class").alias("scope"), F.lit(None).cast("string").alias("sector")),
        F.struct(F.col("class").alias("scope"), F.col("ticker").alias("sector")),
    )
    df = df.withColumn("_sc", F.explode(scopes))
    if sectors is not None:
        df = df.where(F.col("_sc.sector").isNull() | F.col("_sc.sector").isin(*sectors))
    s = F.col("S_score_after_veto")
    met = lambda conditions: sum((_flag(c).cast("int") for c in conditions), F.lit(0))
    measures = []
    for side in ("positive", "negative"):
        base = F.col(f"{side}_signal") & F.col("label_available")
        measures += [F.count_if(base).alias(f"{side}_n"), F.count_if(base & F.col(f"{side}_success")).alias(f"{side}_hit")]
        measures += [F.sum(F.when(base, F.col(c))).alias(f"{side}_{c}") for c in ("forward_return", "excess_return", "drawdown")]
    return df.groupBy(
        F.col("_sc.scope").alias("scope"), F.col("_sc.sector").alias("sector"), "horizon_weeks", "window", "as_of",
        met(s >= t for t in sorted(SCORE_AT_LEAST)).alias("up"),
        met(s <= t for t in sorted(SCORE_AT_MOST, reverse=True)).alias("down"),
        _flag(F.col("rs_ratio_z") >= 0).alias("strong"),
    ).agg(*measures)


def grid_blocks(labels: DataFrame, split: DataFrame, sectors: list[str] | None = None) -> DataFrame:
    """Baseline and candidate counts per scope, rule, horizon, window and date, off the cube."""
    return blocks_of(score_cube(labels, split, sectors))


def blocks_of(cube: DataFrame) -> DataFrame:
    """The nine rules of every cell's scope: sums over the bands that a rule holds."""
    levels = {"positive": sorted(SCORE_AT_LEAST), "negative": sorted(SCORE_AT_MOST, reverse=True)}
    rules = F.array(*[
        F.struct(F.lit(r["suffix"]).alias("suffix"), F.lit(r["direction"]).alias("direction"),
                 F.lit(levels[r["direction"]].index(r["limit"])).alias("level"), F.lit(r["strength"]).alias("strength"))
        for r in grid_rules()
    ])
    df = cube.withColumn("r", F.explode(rules))
    positive = F.col("r.direction") == "positive"
    of = lambda c: F.when(positive, F.col(f"positive_{c}")).otherwise(F.col(f"negative_{c}"))
    inside = F.when(positive, (F.col("up") > F.col("r.level")) & (~F.col("r.strength") | F.col("strong"))).otherwise(F.col("down") > F.col("r.level"))
    prefix = F.lower(F.regexp_replace(F.coalesce("sector", "scope"), "[ -]", "_"))
    return df.groupBy(
        F.concat(prefix, F.lit("_"), F.col("r.suffix")).alias("candidate_id"), "scope", "sector", F.col("r.direction").alias("direction"),
        "horizon_weeks", "window", "as_of",
    ).agg(
        F.sum(of("n")).alias("base_n"),
        F.sum(of("hit")).alias("base_hit"),
        F.sum(F.when(inside, of("n")).otherwise(0)).alias("cand_n"),
        F.sum(F.when(inside, of("hit")).otherwise(0)).alias("cand_hit"),
        F.sum(F.when(inside, of("forward_return"))).alias("sum_return"),
        F.sum(F.when(inside, of("excess_return"))).alias("sum_excess"),
        F.sum(F.when(inside, of("drawdown"))).alias("sum_drawdown"),
        F.sum(of("drawdown")).alias("base_drawdown"),
    )


GRID_KEYS = ["candidate_id", "scope", "sector", "direction", "horizon_weeks"]


def grid_metrics(blocks: DataFrame) -> DataFrame:
    """Train and holdout rates and deltas of every grid rule."""

    def part(c: str, w: str) -> Column:
        return F.sum(F.when(F.col("window") == w, F.col(c)))

    g = blocks.groupBy(*GRID_KEYS).agg(
        *[F.coalesce(part(c, w), F.lit(0)).alias(f"{w}_{c}") for w in ("train", "holdout") for c in ("base_n", "base_hit", "cand_n", "cand_hit")],
        *[F.coalesce(part(c, "holdout"), F.lit(0.0)).alias(c) for c in ("sum_return", "sum_excess", "sum_drawdown", "base_drawdown")],
    )
    for w in ("train", "holdout"):
        g = g.withColumn(f"{w}_hit_rate", rate(F.col(f"{w}_cand_hit"), F.col(f"{w}_cand_n"))).withColumn(
            f"baseline_{w}_hit_rate", rate(F.col(f"{w}_base_hit"), F.col(f"{w}_base_n"))
        )
        g = g.withColumn(f"{w}_delta", F.col(f"{w}_hit_rate") - F.col(f"baseline_{w}_hit_rate"))
    n, b = F.col("holdout_cand_n"), F.col("holdout_base_n")
    return g.withColumns(
        {
            "holdout_average_return": rate(F.col("sum_return"), n),
            "holdout_average_excess": rate(F.col("sum_excess"), n),
            "holdout_average_drawdown": rate(F.col("sum_drawdown"), n),
            "holdout_drawdown_delta": rate(F.col("sum_drawdown"), n) - rate(F.col("base_drawdown"), b),
            "fold_stability_passed": (F.col("train_delta") >= 0) & (F.col("holdout_delta") >= 0),
        }
    ).drop("sum_return", "sum_excess", "sum_drawdown", "base_drawdown")


def draw(sample: Column, slot: Column, size: Column, seed: int | Column) -> Column:
    """Portable hash draw in [0, size): the same on every engine and every retry."""
    p = 2147483647
    h = (sample * 1000003 + slot * 10007 + seed) % p
    h = (h * h + 12345) % p
    h = (h * 48271 + slot) % p
    return (h * h % p) % size


def block_bootstrap(blocks: DataFrame, keys: list[str], samples: int = 500, seed: int = 164) -> DataFrame:
    """Paired block bootstrap of the hit-rate delta by rebalance date.

    ``blocks`` holds one row per key and date with base_n, base_hit, cand_n, cand_hit.
    A key's array has one entry per rebalance date, so it is bounded by the calendar.
    All draws of a key are made in its row: the array is never copied or shuffled.
    """
    used = blocks.where("base_n > 0")
    arr = used.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("as_of", "base_n", "base_hit", "cand_n", "cand_hit"))).alias("b"),
        F.sum("base_n").alias("baseline_count"),
        F.sum("cand_n").alias("candidate_count"),
        (F.sum("cand_hit") / F.nullif(F.sum("cand_n"), F.lit(0)) - F.sum("base_hit") / F.sum("base_n")).alias("observed"),
    )
    arr = arr.withColumn("block_count", F.size("b"))

    def delta(idx: Column) -> Column:
        def total(field: str) -> Column:
            return F.aggregate(idx, F.lit(0).cast("bigint"), lambda acc, i: acc + F.get("b", i)[field]).alias(field)

        rates = lambda t: F.when(
            (t["cand_n"] > 0) & (t["base_n"] > 0), t["cand_hit"] / t["cand_n"] - t["base_hit"] / t["base_n"]
        )
        return let(F.struct(*[total(c) for c in ("base_n", "base_hit", "cand_n", "cand_hit")]), rates)

    def one(sample: Column) -> Column:
        slots = F.sequence(F.lit(0), F.col("block_count") - 1)
        return let(F.transform(slots, lambda j: draw(sample, j.cast("bigint"), F.col("block_count"), seed).cast("int")), delta)

    draws = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint")), one)
    kept = F.when(F.col("candidate_count") > 0, F.array_sort(F.filter(draws, lambda d: d.isNotNull())))
    out = arr.withColumn("d", kept)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select(
        *keys, "block_count", "baseline_count", "candidate_count", zero(F.col("observed")).alias("mean_delta"),
        zero(sorted_quantile(F.col("d"), 0.025)).alias("ci_low"), zero(sorted_quantile(F.col("d"), 0.975)).alias("ci_high"),
        F.coalesce(F.size("d").cast("bigint"), F.lit(0).cast("bigint")).alias("valid_resamples"),
    )


#: A draw is below this number.
UNIFORM = 2147483647


def binomial_table(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Distribution of the hits among n draws from n outcomes: keys, u, hits.

    ``sides``: keys, n, hit. ``u`` is the probability of ``hits`` or fewer, times UNIFORM. Only
    hits within ten deviations of the mean are listed, a number that grows with the root of n.
    Probabilities come from the ratio of neighbours, summed as logarithms.
    """
    n, hit = F.col("n"), F.col("hit")
    sure = (hit == 0) | (hit == n)
    width = F.when(sure, 0).otherwise(F.ceil(10 * F.sqrt(hit * (1 - hit / n))) + 12)
    odds = hit / F.nullif(n - hit, F.lit(0))
    span = F.sequence(F.greatest(F.lit(0).cast("bigint"), hit - width), F.least(n, hit + width))
    listed = sides.select(*keys, "n", "hit", F.explode(span).alias("hits"))
    whole = Window.partitionBy(*keys)
    upward = whole.orderBy("hits").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("hits") == F.min("hits").over(whole), 0.0).otherwise(F.log((n - F.col("hits") + 1) / F.col("hits") * odds))
    logs = listed.withColumn("step", step).withColumn("log", F.sum("step").over(upward))
    weighted = logs.withColumn("weight", F.exp(F.col("log") - F.max("log").over(whole)))
    share = F.sum("weight").over(upward) / F.sum("weight").over(whole)
    return weighted.withColumn("u", F.floor(share * UNIFORM).cast("bigint")).groupBy(*keys, "u").agg(F.max("hits").alias("hits"))


def _sides(blocks: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Candidates and baseline of each key as two rows: keys, sign, n, hit, salt."""
    t = blocks.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("base_n", "base_hit", "cand_n", "cand_hit")]).where("base_n > 0 and cand_n > 0")
    pair = [
        F.struct(F.lit(sign).alias("sign"), F.col(f"{side}_n").alias("n"), F.col(f"{side}_hit").alias("hit"), F.lit(salt).cast("bigint").alias("salt"))
        for side, sign, salt in (("cand", 1, seed), ("base", -1, seed + 7))
    ]
    return t.select(*keys, F.inline(F.array(*pair)))


def _interval(drawn: DataFrame, keys: list[str]) -> DataFrame:
    """Interval of the two rates' delta from one row per key, sample and side with its drawn hits."""
    deltas = drawn.groupBy(*keys, "sample").agg(
        F.sum(F.col("sign") * F.col("drawn") / F.col("n")).alias("d"),
        F.sum(F.col("sign") * F.col("hit") / F.col("n")).alias("observed"),
        F.max(F.when(F.col("sign") == 1, F.col("n"))).alias("cand_n"),
        F.max(F.when(F.col("sign") == -1, F.col("n"))).alias("base_n"),
    )
    return deltas.groupBy(*keys).agg(
        F.round(F.max("observed"), 6).alias("mean_delta"),
        F.round(F.percentile("d", F.lit(0.025)), 6).alias("ci_low"),
        F.round(F.percentile("d", F.lit(0.975)), 6).alias("ci_high"),
        F.max("cand_n").alias("candidate_sample_count"),
        F.max("base_n").alias("baseline_sample_count"),
    )


def unpaired_bootstrap(blocks: DataFrame, keys: list[str], samples: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap of two hit rates drawn independently.

    A resample of binary outcomes only needs its number of hits, which is binomial. So a sample
    is one portable draw for each side, looked up in the side's table by an as-of join: the work
    is samples x rules, whatever the number of labels behind a rule.
    """
    big = lambda x: F.lit(x).cast("bigint")
    sides, own = _sides(blocks, keys, seed), [*keys, "sign"]
    drawn = sides.withColumn("sample", F.explode(F.sequence(big(0), big(samples - 1))))
    drawn = drawn.withColumn("u", draw(F.col("sample"), big(0), big(UNIFORM), F.col("salt")))
    table = binomial_table(sides, own)
    found = asof_backward(drawn, table, own, "u", ["hits"]).join(table.groupBy(*own).agg(F.min("hits").alias("least")), own)
    sure = (F.col("hit") == 0) | (F.col("hit") == F.col("n"))
    number = F.when(sure, F.col("hit")).otherwise(F.coalesce(F.least(F.col("hits") + 1, F.col("n")), F.col("least")))
    return _interval(found.withColumn("drawn", number), keys)


#: Outcomes drawn in one row.
CHUNK = 4096


def unpaired_row_bootstrap(blocks: DataFrame, keys: list[str], samples: int = 1000, seed: int = 42) -> DataFrame:
    """The same interval with every outcome of every resample drawn.

    A draw below the side's number of hits is a hit. Draws are listed in chunks of CHUNK outcomes
    and summed map-side, so no array grows with the labels of a key and a key's samples spread
    over all tasks.
    """
    big = lambda x: F.lit(x).cast("bigint")
    fan = _sides(blocks, keys, seed).withColumn("sample", F.explode(F.sequence(big(0), big(samples - 1))))
    fan = fan.withColumn("start", F.explode(F.sequence(big(0), F.col("n") - 1, big(CHUNK)))).repartition(*keys, "sign", "sample", "start")
    slots = fan.withColumn("slot", F.explode(F.sequence("start", F.least(F.col("start") + CHUNK, F.col("n")) - 1)))
    hit = (draw(F.col("sample"), F.col("slot"), F.col("n"), F.col("salt")) < F.col("hit")).cast("bigint")
    return _interval(slots.groupBy(*keys, "sample", "sign", "n", "hit").agg(F.sum(hit).alias("drawn")), keys)


def grid_promotion(metrics: DataFrame, bootstrap: DataFrame, min_train: int = 40, min_holdout: int = 20) -> DataFrame:
    """Promotion label of every grid rule with the bootstrap's verdict."""
    b = bootstrap.select("candidate_id", "horizon_weeks", "ci_low", "ci_high", "mean_delta", "valid_resamples")
    df = metrics.join(b, ["candidate_id", "horizon_weeks"], "left").fillna(0, ["ci_low", "ci_high", "mean_delta", "valid_resamples"])
    reason = (
        F.when((F.col("train_cand_n") < min_train) | (F.col("holdout_cand_n") < min_holdout), "thin_sample")
        .when(F.col("holdout_cand_n") == 0, "no_mature_holdout_labels")
        .when(F.col("holdout_delta") <= 0, "holdout_no_improvement")
        .when(~F.col("fold_stability_passed"), "fold_unstable")
        .when(F.col("valid_resamples") <= 0, "bootstrap_insufficient_candidate_blocks")
        .when(F.col("ci_low") < 0, "bootstrap_interval_crosses_zero")
        .otherwise("separate_live_promotion_ticket_required")
    )
    label = (
        F.when(F.col("rejection_reasons").isin("thin_sample", "no_mature_holdout_labels"), "do not promote")
        .when(F.col("rejection_reasons") == "separate_live_promotion_ticket_required", "research_candidate")
        .otherwise("needs more testing")
    )
    return df.withColumn("rejection_reasons", reason).withColumn("promotion_label", label)


def sector_overrides(
    promoted: DataFrame, min_train: int = 40, min_holdout: int = 20, min_delta: float = 0.05, sectors: list[str] | None = None
) -> DataFrame:
    """Sector rules that pass every check, with their weight multiplier."""
    negative = F.when(F.col("direction") == "negative", F.col("holdout_delta")).otherwise(0.0)
    known = F.col("sector").isNotNull() if sectors is None else F.col("sector").isin(*sectors)
    ok = (
        known
        & (F.col("train_cand_n") >= min_train)
        & (F.col("holdout_cand_n") >= min_holdout)
        & (F.col("holdout_delta") >= min_delta)
        & (negative >= 0)
        & (F.col("holdout_drawdown_delta") >= 0)
        & F.col("fold_stability_passed")
        & (F.col("ci_low") >= 0)
        & (F.col("promotion_label") == "research_candidate")
    )
    gain = F.least(F.greatest(F.coalesce("holdout_delta", F.lit(0.0)), F.lit(0.0)), F.lit(0.25))
    return promoted.where(ok).withColumns(
        {
            "sector_weight_multiplier": F.round(1 + gain, 4),
            "promotion_label": F.lit("sector_candidate"),
            "live_promotion_allowed": F.lit(False),
            "promotion_requires": F.lit("separate_reviewed_live_promotion_ticket"),
        }
    )


def override_guardrail(overrides: DataFrame, sectors: list[str], max_multiplier: float = 1.25) -> DataFrame:
    """Fail-closed check of an override table, one row with its reasons."""
    m = F.col("sector_weight_multiplier")
    bad = overrides.agg(
        F.count("*").alias("override_count"),
        F.count_if(~F.coalesce(F.upper("sector").isin(*[s.upper() for s in sectors]), F.lit(False))).alias("a"),
        F.count_if(F.coalesce(F.col("promotion_label") != "sector_candidate", F.lit(True))).alias("b"),
        F.count_if(F.col("live_promotion_allowed")).alias("c"),
        F.count_if(F.coalesce(F.col("promotion_requires") != "separate_reviewed_live_promotion_ticket", F.lit(True))).alias("d"),
        F.count_if(m.isNull() | (m < 1.0) | (m > max_multiplier)).alias("e"),
    )
    names = {
        "a": "non_us_sector_override", "b": "unexpected_promotion_label", "c": "override_live_promotion_true",
        "d": "missing_separate_review_requirement", "e": "weight_multiplier_out_of_bounds",
    }
    reasons = F.concat_ws(",", *[F.when(F.col(k) > 0, v) for k, v in names.items()])
    return bad.select(
        F.when(F.col("override_count") == 0, "pass_no_overrides").when(reasons != "", "fail_closed").otherwise("pass_display_only").alias("status"),
        "override_count",
        reasons.alias("reasons"),
    )


def config_guardrail(configs: DataFrame, min_holdout_rows: int = 20) -> DataFrame:
    """Fail-closed check of candidate configurations, one row each."""
    label = F.lower(F.trim(F.coalesce("promotion_label", F.lit(""))))
    candidate = label.isin("candidate", "research_candidate")
    evaluated = _flag(F.col("final_holdout_evaluated"))
    rows = F.coalesce("final_holdout_rows_used", F.lit(0))
    checks = {
        "config_live_promotion_true": _flag(F.col("live_promotion_allowed")),
        "selected_candidate_live_promotion_true": _flag(F.col("candidate_live_promotion_allowed")),
        "config_not_research_only": ~_flag(F.col("research_only")),
        "missing_separate_ticket_requirement": F.coalesce(F.col("candidate_promotion") != "separate_ticket_required", F.lit(True)),
        "candidate_without_final_holdout": candidate & ~evaluated,
        "insufficient_final_holdout_rows_for_candidate": candidate & (rows < min_holdout_rows),
        "passed_status_without_final_holdout": _flag(F.col("config_status").startswith("passed_final_holdout")) & ~evaluated,
    }
    reasons = F.concat_ws(",", *[F.when(c, name) for name, c in checks.items()])
    return configs.select("config_id", F.when(reasons != "", "fail_closed").otherwise("pass_display_only").alias("status"), reasons.alias("reasons"))


def promotion_gate(summary: DataFrame) -> DataFrame:
    """Review status per ticket: candidate and rejected variants.

    ``summary``: ticket, variant, promotion_label; variants are a configured list.
    """
    label = F.lower(F.trim(F.coalesce("promotion_label", F.lit(""))))
    ok = label == "candidate"
    g = summary.groupBy("ticket").agg(
        F.count_if(ok).alias("candidate_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("variant")))), ", ").alias("candidates"),
        F.array_join(F.array_sort(F.collect_set(F.when(~ok, F.col("variant")))), ", ").alias("rejected"),
    )
    return g.withColumn("status", F.when(F.col("candidate_count") > 0, "ready_for_review").otherwise("blocked_no_candidates")).withColumn(
        "blockers", F.when(F.col("candidate_count") > 0, "").otherwise("No candidate rows were present in the validation summary.")
    )
