"""Decisions over result tables: many strategies at once, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import HARD_GATES, STATE_EDGES
from ..functions.literal import literal_table
from ..functions.windows import previous_value

GATE_DEFAULTS = {
    "dsr_reject": 0.5, "dsr_confident": 0.95, "dd_wf": -0.25, "dd_oos": -0.20, "max_pairwise_corr": 0.7, "max_unexplained": 0,
}
REGIME_SHARE = 0.5


def hard_gates(gates: DataFrame, names=HARD_GATES) -> DataFrame:
    """``gates``: (strategy_id, gates map). Deployable when every hard gate is present and true."""
    passed = [F.coalesce(F.try_element_at("gates", F.lit(n)), F.lit(False)) for n in names]
    verdict = passed[0]
    for p in passed[1:]:
        verdict = verdict & p
    return gates.withColumn("deployable", verdict)


def gate_status(rows: DataFrame, aum_limit: float | None = None, final: bool = True, **limits) -> DataFrame:
    """Status and reasons of each strategy.

    Input: strategy_id, dsr, sharpe_mean, max_dd_walk_forward, max_dd_oos, regime_concentration_flag,
    max_pairwise_corr, capacity (map of capital to status), halt_unexplained_count. Findings have a
    severity and the worst one decides; a breach of capacity is only recorded.
    """
    cfg = {**GATE_DEFAULTS, **limits}
    c = F.col
    tiers = F.map_entries(F.coalesce("capacity", F.create_map().cast("map<double,string>")))
    considered = F.filter(tiers, lambda t: t["key"] <= aum_limit) if aum_limit is not None else tiers
    findings = [
        (F.lit(aum_limit is not None) & (F.size(tiers) == 0), 2, "capacity_report_missing"),
        (F.lit(not final), 2, "final_validation_missing"),
        (c("dsr") < cfg["dsr_reject"], 2, "dsr_rejected"),
        ((c("dsr") >= cfg["dsr_reject"]) & (c("dsr") < cfg["dsr_confident"]), 1, "dsr_gray_zone"),
        (c("sharpe_mean") < 0, 2, "negative_oos_sharpe"),
        (c("max_dd_walk_forward") < cfg["dd_wf"], 2, "drawdown_walk_forward"),
        (c("max_dd_oos") < cfg["dd_oos"], 2, "drawdown_oos"),
        (c("regime_concentration_flag"), 1, "regime_concentration"),
        (c("max_pairwise_corr") > cfg["max_pairwise_corr"], 1, "ensemble_correlation"),
        (F.exists(considered, lambda t: t["value"] == "BREACH"), 0, "capacity_breach"),
        (c("halt_unexplained_count") > cfg["max_unexplained"], 1, "unexplained_halts"),
    ]
    hit = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(name).alias("name"))) for test, level, name in findings]
    found = F.array_compact(F.array(*hit))
    worst = F.array_max(F.transform("found", lambda f: f["level"]))
    return rows.withColumn("found", found).withColumns({
        "reasons": F.transform("found", lambda f: f["name"]),
        "status": F.when(worst == 2, "REJECTED").when(worst == 1, "FLAG_REVIEW").otherwise("APPROVED_CANDIDATE"),
    }).drop("found")


def apply_reviews(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Manual reviews of flagged strategies; anything incomplete or not under review is an error."""
    joined = reviews.join(decisions.select("strategy_id", "status"), "strategy_id", "left")
    complete = (F.length("reviewed_by") > 0) & F.col("review_decision").isin("APPROVE", "REJECT") & (F.length("review_timestamp") > 0)
    error = F.when(F.coalesce(F.col("status") != "FLAG_REVIEW", F.lit(True)), "not_under_review").when(~F.coalesce(complete, F.lit(False)), "incomplete_review")
    return joined.withColumn("error", error).withColumn(
        "final", F.when(F.col("error").isNull(), F.when(F.col("review_decision") == "APPROVE", "APPROVED").otherwise("REJECTED")))


def review_conflicts(updates: DataFrame, current: DataFrame, trusted=None) -> DataFrame:
    """Accept or refuse a batch of review updates: complete payload, expected state, known reviewer,
    and each source run applied to a strategy once, the earliest first. ``update_id`` is unique."""
    required = ("strategy_id", "expected_state", "reviewed_by", "review_decision", "review_timestamp", "source_run_id")
    filled = F.lit(True)
    for name in required:
        filled = filled & (F.length(F.coalesce(F.col(name), F.lit(""))) > 0)
    place = F.struct("review_timestamp", "update_id")
    firsts = updates.groupBy("strategy_id", "source_run_id").agg(F.min(place).alias("first_of_run"))
    rows = updates.join(firsts, ["strategy_id", "source_run_id"]).withColumn("repeat", place != F.col("first_of_run")).drop("first_of_run").join(current.select("strategy_id", "state"), "strategy_id", "left")
    known = trusted if trusted is not None else F.lit(True)
    reason = (
        F.when(~filled | ~F.col("review_decision").isin("APPROVE", "REJECT") | (F.col("expected_state") != "FLAG_REVIEW"), "invalid_payload")
        .when(F.coalesce(F.col("state") != F.col("expected_state"), F.lit(True)), "state_conflict")
        .when(~known, "unknown_reviewer").when(F.col("repeat"), "duplicate_source_run")
    )
    approved = F.when(F.col("review_decision") == "APPROVE", "APPROVED_CANDIDATE").otherwise("REJECTED")
    return rows.withColumn("rejection", reason).withColumn("to_state", F.when(F.col("rejection").isNull(), approved)).drop("repeat")


def invalid_transitions(events: DataFrame) -> DataFrame:
    """State events that leave an edge that does not exist, start elsewhere than the last state, or
    lack actor, time or reason. Every strategy starts in RESEARCH."""
    edges = literal_table(events.sparkSession, STATE_EDGES, "from_state string, to_state string").withColumn("allowed", F.lit(True))
    chained = previous_value(events, ["strategy_id"], ["timestamp", "seq"], "to_state", F.date_trunc("day", "timestamp"), "previous")
    blank = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) == 0
    checked = chained.withColumn("previous", F.coalesce("previous", F.lit("RESEARCH"))).join(edges, ["from_state", "to_state"], "left")
    error = F.when(blank("actor") | F.col("timestamp").isNull() | blank("reason"), "incomplete_event").when(
        F.col("from_state") != F.col("previous"), "broken_chain").when(F.col("allowed").isNull(), "edge_not_allowed")
    return checked.withColumn("error", error).where("error is not null")


def initial_state(rows: DataFrame) -> DataFrame:
    """Operational state after a checked run; never beyond candidate."""
    return rows.withColumn("state", F.when(F.col("status") == "CHECKER_ERROR", "CHECKER_ERROR").when(F.col("status") == "FAILED_VALIDATION", "FAILED_VALIDATION")
                           .when(F.col("review_required"), "FLAG_REVIEW").when(F.col("decision") == "APPROVED", "APPROVED_CANDIDATE").otherwise("REJECTED"))


def deployment_gates(wf_gates: DataFrame, segments: DataFrame, stress: DataFrame, reality: DataFrame, regimes: DataFrame, mining: DataFrame,
                     spread_checked: bool = False) -> DataFrame:
    """All gate booleans of one strategy as a map, from one-row result tables joined together.

    ``spread_checked`` says that quoted spreads were looked at before; no table here can tell.
    """
    of = lambda name, column: F.max(F.when(F.col("segment") == name, F.col(column)))
    seg = segments.agg(
        of("train", "total_return").alias("train_return"), of("validation", "total_return").alias("validation_return"),
        of("out_of_sample", "total_return").alias("oos_return"), of("out_of_sample", "sharpe").alias("oos_sharpe"),
        of("out_of_sample", "max_drawdown").alias("oos_dd"), F.sum("risk_violations").alias("risk"), F.sum("capacity_violations").alias("capacity"))
    worst = stress.agg(F.min("total_return").alias("stress_return"))
    reg = regimes.agg(F.count_if(F.col("total_return") > 0).alias("good_regimes"), F.count(F.lit(1)).alias("regimes"))
    one = F.lit(True)
    row = (
        wf_gates.select("wf_positive", "wf_sharpe_above_one", F.col("wf_drawdown_above_minus_20pct").alias("wf_drawdown_gate"),
                        F.col("stress_positive").alias("wf_stress_positive"), "majority_folds_profitable")
        .join(seg, one).join(worst, one).join(reality.select("pass", "best_ic_tstat"), one).join(reg, one).join(mining.select("dsr"), one)
    )
    c = F.col
    # The names of the gates.
    gates = {
        "ic_signal_found": c("best_ic_tstat") >= 2.0, "wf_positive": c("wf_positive"), "wf_sharpe_above_one": c("wf_sharpe_above_one"),
        "wf_drawdown_gate": c("wf_drawdown_gate"), "wf_stress_positive": c("wf_stress_positive"), "majority_folds_profitable": c("majority_folds_profitable"),
        "static_train_positive": c("train_return") > 0, "static_validation_positive": c("validation_return") > 0, "static_oos_positive": c("oos_return") > 0,
        "static_oos_sharpe_above_one": c("oos_sharpe") > 1, "static_oos_drawdown_gate": c("oos_dd") > -0.20, "static_stress_positive": c("stress_return") > 0,
        "no_risk_violations": c("risk") == 0, "no_capacity_violations": c("capacity") == 0, "oos_positive": c("oos_return") > 0,
        "reality_check_pass": c("pass"), "dsr_above_95": c("dsr") >= 0.95, "spread_check_passed": F.lit(spread_checked),
        "majority_regimes_profitable": c("good_regimes") >= c("regimes") * REGIME_SHARE,
    }
    return row.select(F.create_map(*[v for k, g in gates.items() for v in (F.lit(k), F.coalesce(g, F.lit(False)))]).alias("gates"))


def result_rows(rows: DataFrame) -> DataFrame:
    """Result row by status: measures and decision only where a run succeeded.

    Input: strategy_id, status (SUCCESS, FAILED_VALIDATION or CHECKER_ERROR), gate_status, deployable,
    metrics (struct), max_sensible.
    """
    ok = F.col("status") == "SUCCESS"
    flagged = F.col("gate_status") == "FLAG_REVIEW"
    decided = F.when(ok & ~flagged, F.when(F.col("gate_status") == "REJECTED", "REJECTED").otherwise("APPROVED"))
    out = rows.withColumns({
        "decision": decided, "review_required": ok & flagged, "deployable": ok & (F.col("gate_status") == "APPROVED_CANDIDATE") & F.col("deployable"),
        "metrics": F.when(ok, F.col("metrics")), "max_sensible": F.when(ok, F.col("max_sensible")),
    })
    return initial_state(out)
