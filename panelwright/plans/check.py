"""The whole check of a panel: preflight, search, validation, capacity, cross-validation, gate, result row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..constants import AUM_LEVELS, COST_STRESS_TIERS, SIGNAL_CANDIDATES
from ..functions.symbols import migration_table
from ..operators import audit as Q
from ..operators import capacity as K
from ..operators import cpcv as C
from ..operators import decision as D
from ..operators import panel as P
from ..operators import portfolio as B
from ..operators import stats as S
from ..operators import validate as V
from ..operators import walkforward as W
from ..operators.factors import BENCHMARK, build_signals, unpivot_signals
from ..operators.ranking import lag_for_execution, liquidity_percentile, tier_rates
from ..session import materialise, refuse

# Tiers under which capacity is measured.
CAPACITY_TIERS = ((0.5, 0.0004, 0.0005), (0.0, 0.0015, 0.004))
ROW = ("timestamp", "asset", "price", "funding_rate", "quote_volume")


def signal_book(frame: DataFrame, signal: str, n: int, bars: DataFrame | None = None, slices: DataFrame | None = None, tiers=None, **settings) -> B.Backtest:
    """One book of one factor: over the panel, over some of its bars, or over many slices of it.

    ``bars`` keeps only its timestamps; ``slices`` (slice_id, timestamp) runs every slice on its own.
    """
    rows = unpivot_signals(frame, [signal], keep=tuple(c for c in ROW if c in frame.columns))
    key = "signal"
    if bars is not None:
        rows = rows.join(bars.select("timestamp"), "timestamp", "left_semi")
    if slices is not None:
        key, rows = "slice_id", rows.drop("signal").join(slices.select("slice_id", "timestamp"), "timestamp")
    lagged = lag_for_execution(rows, [key])
    if tiers:
        lagged = tier_rates(liquidity_percentile(lagged, "quote_volume", keys=[key]), tiers)
    names = slices.select("slice_id").distinct() if slices is not None else None
    grid = B.run_grid(frame.sparkSession, **{"signal": signal, "n_long": n, "n_short": n, "tiered": bool(tiers), **settings})
    config = names.join(grid.drop("signal"), F.lit(True)) if names is not None else grid
    config = config.withColumns({"book_id": F.col(key), "run_id": F.col(key)})
    series = B.prepare_series(lagged, [key], "quote_volume" if tiers else None)
    return B.Backtest(series, config.select("book_id", key, *B.BOOK_DEFAULTS), config.select("run_id", "book_id", *B.RUN_DEFAULTS), (key,), 2 * n)


def side_slices(splits: DataFrame) -> DataFrame:
    """Both sides of every cross-validation fold as slices named ``<fold>|<side>``."""
    return splits.withColumn("slice_id", F.concat_ws("|", "fold_id", "side"))


def cost_runs(book: B.Backtest, tiers=COST_STRESS_TIERS) -> DataFrame:
    """The runs of a book at every stressed cost level; the level's position names the run.

    Flat costs take the level's rates; tiers are multiplied by what the level is of the default rates.
    """
    levels = F.array(*[F.struct(F.lit(i).alias("tier"), F.lit(f).alias("fee"), F.lit(s).alias("slip"), F.lit(B.stressed_multiplier(f, s)).alias("times"))
                       for i, (f, s) in enumerate(tiers)])
    flat = lambda level, own: F.when(F.col("tiered"), F.col(own)).otherwise(F.col(level))
    return book.runs.withColumn("cost", F.explode(levels)).withColumns({
        "run_id": F.col("cost.tier").cast("string"), "fee_rate": flat("cost.fee", "fee_rate"), "slip_rate": flat("cost.slip", "slip_rate"),
        "cost_multiplier": F.when(F.col("tiered"), F.col("cost.times")).otherwise(F.col("cost_multiplier"))}).drop("cost")


@dataclass
class Deployment:
    """What a deployment decision rests on; tables are lazy, the chosen signal is a scalar."""

    signal: str
    n_sides: int
    search: W.WalkForward
    book: B.Backtest
    segments: DataFrame
    gates: DataFrame
    errors: DataFrame


def deployment(panel: DataFrame, frame: DataFrame, candidates=SIGNAL_CANDIDATES, n_sides=(3,), vol_target: float = 0.20, min_train_days: float = 365,
               test_days: float = 120, delist_mode: str = "error", benchmark: str = BENCHMARK,
               spread_checked: bool = False, strict: bool = True, **settings) -> Deployment:
    """Search for a signal, validate the one chosen most often on one continuous curve, and collect
    every gate. ``gates`` is one row: the gate map and the hard-gate verdict. Splits and regimes cover
    the bars on which the chosen signal exists, so that its warm-up is no part of the training segment.

    ``errors`` names every bar (book, timestamp, error) on which a book behind a gate cannot be run: those of the test folds,
    the validation curve and the stressed out-of-sample segment. With ``strict`` any of them refuses the deployment; without,
    they are listed and nothing is deployable."""
    search = W.WalkForward(frame, candidates, n_sides, (vol_target,), min_train_days=min_train_days, test_days=test_days, delist_mode=delist_mode, **settings)
    search.require_trials()
    if strict:
        search.require_tests()
    choice = W.mode_choice(search.choices).first()
    signal, n = choice["signal"], choice["n_sides"]
    if signal is None:
        raise ValueError("no viable trial in any fold")
    book = signal_book(frame, signal, n, vol_target=vol_target, **settings)
    warm = frame.where(F.col(signal).isNotNull())
    split = V.date_split(warm)
    volume = "quote_volume" if settings.get("tiered") and "quote_volume" in frame.columns else None
    breaches = B.violations(book.returns, book.trades, book.exits, book.runs, liquidity=volume)
    segments = materialise(V.segment_metrics(book.returns, split, breaches))
    last = signal_book(frame, signal, n, bars=split.where("segment = 'out_of_sample'"), vol_target=vol_target, **settings)
    named = [search.test_errors.select(F.concat(F.lit("test fold "), "fold").alias("book"), "timestamp", "error")]
    named += [b.refusals(delist_mode).select(F.lit(name).alias("book"), "timestamp", "error") for name, b in (("validation", book), ("out of sample", last))]
    errors = materialise(named[0].unionByName(named[1]).unionByName(named[2]))
    if strict:
        refuse(errors.select("book", "error", F.col("timestamp").cast("string")).orderBy("book", "timestamp"), "a book behind the decision cannot be run")
    stress = B.run_summary(B.run_returns(last.terms, cost_runs(last)))
    reality = S.reality_check(S.ic_table(S.bar_ic(S.signal_returns(frame, candidates))))
    regimes = V.regime_performance(book.returns, V.regime_labels(warm, benchmark))
    gates = D.deployment_gates(search.gates, segments, stress, reality, regimes, search.data_mining, spread_checked)
    sound = errors.agg((F.count(F.lit(1)) == 0).alias("sound"))
    verdict = D.hard_gates(gates).join(sound, F.lit(True)).withColumn("deployable", F.col("deployable") & F.col("sound")).drop("sound")
    return Deployment(signal, n, search, book, segments, materialise(verdict), errors)


def check_panel(df: DataFrame, strategy_id: str = "strategy", *, migrations: DataFrame | None = None, manifest: DataFrame | None = None, final: bool = False,
                step_seconds: int = Q.DAY, tolerated_gap_steps: int = 1, allow_gaps: bool = False, aum_limit: float | None = None,
                cv_groups: int = 10, cv_test_groups: int = 2, **search) -> DataFrame:
    """One result row for raw rows with ``ingest_seq``: status, decision, reasons, metrics and capacity.

    ``final`` spends the cross-validation budget; otherwise the gate asks for it. A panel that fails
    preflight gets a row without metrics, naming the rules it breaks.
    """
    spark = df.sparkSession
    dim = migrations if migrations is not None else migration_table(spark)
    raw = materialise(P.ingest(df))
    n = max(search.get("n_sides", (3,)))
    rules = materialise(Q.preflight_rules(
        raw, dim, manifest, min_assets=2 * n, min_periods=30, step_seconds=step_seconds, tolerated_gap_steps=tolerated_gap_steps, allow_gaps=allow_gaps,
        require_funding="funding_rate" in df.columns))
    # The first bar of an asset has no return yet; a missing default signal is no fault of the data.
    broken = rules.where("severity = 'error'" + ("" if "signal" in df.columns else " and rule <> 'bad_signal'"))
    errors = broken.agg(F.array_sort(F.collect_list("rule")).alias("errors"))
    empty = "struct<wf_total_return:double,wf_sharpe:double,wf_drawdown:double,oos_total_return:double,oos_sharpe:double,oos_drawdown:double,dsr:double,turnover:double>"
    if not broken.isEmpty():
        row = errors.select(
            F.lit(strategy_id).alias("strategy_id"), F.lit("FAILED_VALIDATION").alias("status"), F.lit("REJECTED").alias("gate_status"), F.array().cast("array<string>").alias("reasons"),
            F.lit(False).alias("deployable"), F.lit(None).cast(empty).alias("metrics"), F.lit(None).cast("double").alias("max_sensible"), "errors")
        return D.result_rows(row)
    panel = materialise(P.canonical_panel(raw, dim))
    frame = materialise(build_signals(panel, search.get("benchmark", BENCHMARK)))
    found = deployment(panel, frame, **search)
    settings = {k: v for k, v in search.items() if k not in ("candidates", "n_sides", "vol_target", "min_train_days", "test_days", "delist_mode", "benchmark", "spread_checked")}
    settings["vol_target"] = search.get("vol_target", 0.20)
    segment = lambda name, c: F.max(F.when(F.col("segment") == name, F.col(c)))
    base = found.search.summary.where("variant = 'base'")
    mining = found.search.data_mining.select("dsr")
    metrics = base.select(F.col("total_return").alias("wf_total_return"), F.col("sharpe").alias("wf_sharpe"), F.col("max_drawdown").alias("wf_drawdown")).join(
        found.segments.agg(
            segment("out_of_sample", "total_return").alias("oos_total_return"), segment("out_of_sample", "sharpe").alias("oos_sharpe"),
            segment("out_of_sample", "max_drawdown").alias("oos_drawdown"), segment("out_of_sample", "average_turnover").alias("turnover"),
            segment("train", "max_drawdown").alias("train_drawdown")), F.lit(True)).join(mining, F.lit(True))
    if final:
        splits = materialise(side_slices(C.cpcv_splits(frame, cv_groups, cv_test_groups)))
        cv = signal_book(frame, found.signal, found.n_sides, slices=splits, **settings)
        paths = C.cpcv_paths(cv.returns, splits, C.vol_regime(panel), 365.0)
        summary = C.cpcv_summary(paths).select("sharpe_mean", "max_dd_walk_forward", "max_dd_oos", "regime_concentration_flag")
    else:
        summary = metrics.select(F.col("oos_sharpe").alias("sharpe_mean"), F.col("train_drawdown").alias("max_dd_walk_forward"),
                                 F.col("oos_drawdown").alias("max_dd_oos"), F.lit(False).alias("regime_concentration_flag"))
    if "quote_volume" in panel.columns:
        tiered = signal_book(frame, found.signal, found.n_sides, tiers=CAPACITY_TIERS, **settings)
        trades = K.at_capital(tiered.trades.select("timestamp", "asset", "notional", "quote_volume"), AUM_LEVELS)
        curve = K.capacity_curve(trades, tiered.summary, K.impact_overlay(trades, panel))
        capacity = curve.agg(F.map_from_entries(F.collect_list(F.struct("aum", "impact_status"))).alias("capacity"),
                             F.max(F.when(F.col("sensible"), F.col("aum"))).alias("max_sensible"))
    else:
        capacity = spark.range(0, 1, 1, 1).select(F.create_map().cast("map<double,string>").alias("capacity"), F.lit(None).cast("double").alias("max_sensible"))
    members = S.ensemble_precheck(found.search.ensemble_members(3), "fold").agg(F.max("max_pairwise_corr").alias("max_pairwise_corr"))
    unexplained = Q.gap_blocks(panel, dim, step_seconds).agg(F.count_if(F.col("reason") == "unexplained_interior").cast("int").alias("halt_unexplained_count"))
    row = metrics.join(summary, F.lit(True)).join(capacity, F.lit(True)).join(members, F.lit(True)).join(unexplained, F.lit(True)).join(found.gates.select("deployable"), F.lit(True)).withColumn("strategy_id", F.lit(strategy_id))
    gated = D.gate_status(row, aum_limit, final).withColumns({
        "gate_status": F.col("status"), "status": F.lit("SUCCESS"), "errors": F.array().cast("array<string>"),
        "metrics": F.struct("wf_total_return", "wf_sharpe", "wf_drawdown", "oos_total_return", "oos_sharpe", "oos_drawdown", "dsr", "turnover")})
    return D.result_rows(gated.select("strategy_id", "status", "gate_status", "reasons", "deployable", "metrics", "max_sensible", "errors"))
