"""Walk-forward selection: search on a growing past, trade the winner on the next window."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..constants import SIGNAL_CANDIDATES, STD_FLOOR, WALK_FORWARD_STRESS
from ..functions.windows import per_asset, running
from ..session import materialise, refuse
from . import portfolio as B
from . import stats as S
from .factors import unpivot_signals
from .ranking import lag_for_execution
from .validate import series_summary

MIN_RETURNS = 60
NO_SPREAD_SHARPE = -9e9
ROW = ("timestamp", "asset", "price", "funding_rate", "fee_tier", "slip_tier")


def wf_folds(panel: DataFrame, min_train_days: float, test_days: float) -> DataFrame:
    """Folds of an expanding training range and a fixed test range, in bars of the panel."""
    bars = B.series_bars(panel.select("timestamp", F.lit("panel").alias("panel")), ["panel"])
    size = bars.groupBy("panel").agg(F.first("n_bars").alias("n"), F.first("ppy").alias("ppy"))
    periods = lambda d: F.greatest(F.lit(1), F.bround(F.lit(float(d)) * F.col("ppy") / 365.0)).cast("bigint")
    cut = (
        size.withColumns({"train": periods(min_train_days), "test": periods(test_days)}).where("n >= train + test")
        .select("ppy", "test", F.posexplode(F.expr("sequence(train, n - test, test)")).alias("fold", "cursor"))
    )
    at = lambda position: F.max(F.when(F.col("idx") == position, F.col("timestamp")))
    cursor, end = F.col("cursor"), F.col("cursor") + F.col("test") - 1
    return bars.select("idx", "timestamp").join(cut, (F.col("idx") >= cursor - 1) & (F.col("idx") <= end)).groupBy("fold", "cursor", "test", "ppy").agg(
        at(cursor - 1).alias("train_end"), at(cursor).alias("test_start"), at(end).alias("test_end")
    ).select("fold", F.col("cursor").alias("train_bars"), F.col("test").alias("test_bars"), "ppy", "train_end", "test_start", "test_end")


def fold_trials(returns: DataFrame, errors: DataFrame, folds: DataFrame, runs: DataFrame) -> DataFrame:
    """Every (fold, run) with its training Sharpe (not annualised), return and validity.

    A training range always starts at the first bar, so its run is a prefix of the run over the whole
    history: each run is evaluated once. The ends of the folds stand as marks among a run's bars, and the
    running statistics at a mark are those of its fold, so no bar is repeated for the folds after it.
    """
    pairs = folds.select("fold", "train_end").join(runs, F.lit(True))
    bars = returns.where("idx > 0").select("run_id", "timestamp", F.lit(None).cast("int").alias("fold"), "ret")
    marks = pairs.select("run_id", F.col("train_end").alias("timestamp"), F.col("fold").cast("int").alias("fold"), F.lit(None).cast("double").alias("ret"))
    past = running(Window.partitionBy("run_id").orderBy("timestamp", F.col("fold").asc_nulls_first()))
    spread, mean = F.col("spread"), F.col("mean")
    stats = bars.unionByName(marks).withColumns({
        "n_returns": F.count("ret").over(past), "spread": F.stddev_samp("ret").over(past), "mean": F.avg("ret").over(past),
        "train_return": F.product(F.col("ret") + 1).over(past) - 1,
    }).where("fold is not null").select(
        "fold", "run_id", F.nullif("n_returns", F.lit(0)).alias("n_returns"), "train_return",
        F.when(F.col("n_returns") > 0, F.when(spread >= STD_FLOOR, mean / spread).otherwise(F.lit(NO_SPREAD_SHARPE))).alias("score"))
    failed = errors.groupBy("book_id").agg(F.min("timestamp").alias("first_error"))
    rows = pairs.join(stats, ["fold", "run_id"], "left").join(failed, "book_id", "left")
    reason = F.when(F.col("first_error") <= F.col("train_end"), "data_error").when(
        F.coalesce("n_returns", F.lit(0)) < MIN_RETURNS, "insufficient_sample")
    return rows.withColumn("exclusion_reason", reason).withColumns({
        "sharpe": F.when(F.col("exclusion_reason").isNull(), F.col("score")),
        "train_return": F.when(F.col("exclusion_reason").isNull(), F.col("train_return")),
    }).drop("score", "first_error")


def best_trial(trials: DataFrame) -> DataFrame:
    """The valid trial with the highest Sharpe per fold; the first in grid order on ties."""
    order = Window.partitionBy("fold").orderBy(F.col("sharpe").desc(), F.col("ordinal").asc())
    return trials.where("sharpe is not null").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def top_signals(trials: DataFrame, k: int) -> DataFrame:
    """The best trial of each of the k best distinct signals per fold."""
    valid = trials.where("sharpe is not null")
    own = Window.partitionBy("fold", "signal").orderBy(F.col("sharpe").desc(), F.col("ordinal").asc())
    leaders = valid.withColumn("own", F.row_number().over(own)).where("own = 1").drop("own")
    order = Window.partitionBy("fold").orderBy(F.col("sharpe").desc(), F.col("ordinal").asc())
    return leaders.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mode_choice(choices: DataFrame) -> DataFrame:
    """Most frequent winner over the folds, the smallest on ties."""
    return choices.agg(F.mode("signal", True).alias("signal"), F.mode("n_long", True).alias("n_sides"))


class WalkForward:
    """Search and out-of-sample tables of one factor panel; all members are lazy DataFrames.

    ``frame`` holds the factor columns and is read once. Written once: its rows (``table``), folds and trials, which are small and feed the
    choice, the registry and the deflation, and what each backtest writes itself.
    """

    def __init__(self, frame: DataFrame, candidates=SIGNAL_CANDIDATES, n_sides=(2, 3, 4), vol_targets=(0.0,), *, min_train_days: float = 365,
                 test_days: float = 120, stress=WALK_FORWARD_STRESS, delist_mode: str = "error", **settings):
        self.frame, self.candidates, self.n_sides, self.vol_targets = frame, tuple(candidates), tuple(n_sides), tuple(vol_targets)
        self.min_train_days, self.test_days, self.stress, self.delist_mode, self.settings = min_train_days, test_days, stress, delist_mode, settings
        if settings.get("tiered") and not {"fee_tier", "slip_tier"} <= set(frame.columns):
            raise ValueError("a tiered search needs the columns fee_tier and slip_tier")
        self.spark: SparkSession = frame.sparkSession
        self.deepest = 2 * max(self.n_sides)

    @cached_property
    def folds(self) -> DataFrame:
        return materialise(wf_folds(self.table, self.min_train_days, self.test_days))

    @cached_property
    def carried(self) -> list[str]:
        return [c for c in ROW if c in self.frame.columns]

    @cached_property
    def table(self) -> DataFrame:
        """What books read of the panel, every candidate, and its value when it is executed (``late_<candidate>``: the asset's
        last value before, on rows that have one themselves). One row per bar and asset: candidates become rows only on the way
        to sums and filters, so nothing is shuffled or written once per candidate."""
        past = per_asset().rowsBetween(Window.unboundedPreceding, -1)
        late = {f"late_{c}": F.when(F.col(c).isNotNull(), F.last(c, True).over(past)) for c in self.candidates}
        return materialise(self.frame.select(*self.carried, *self.candidates).withColumns(late))

    @property
    def signals(self) -> DataFrame:
        """(signal, sig) rows of all candidates; read by every test."""
        return unpivot_signals(self.table, self.candidates, keep=tuple(self.carried))

    @property
    def executed(self) -> DataFrame:
        """The rows of ``lag_for_execution`` over all candidates."""
        late = self.table.select(*self.carried, *[F.col(f"late_{c}").alias(c) for c in self.candidates])
        return unpivot_signals(late, self.candidates, keep=tuple(self.carried))

    @cached_property
    def grid(self) -> DataFrame:
        order = F.create_map(*[F.lit(v) for i, c in enumerate(self.candidates) for v in (c, i)])
        grid = B.run_grid(self.spark, **self.settings, signal=list(self.candidates), n_long=list(self.n_sides), vol_target=list(map(float, self.vol_targets)))
        sizes, targets = len(self.n_sides), len(self.vol_targets)
        position = (F.array_position(F.array(*[F.lit(n) for n in self.n_sides]), F.col("n_long")) - 1) * targets + F.array_position(
            F.array(*[F.lit(float(v)) for v in self.vol_targets]), F.col("vol_target")) - 1
        return grid.withColumn("n_short", F.col("n_long")).withColumns({
            "book_id": F.concat_ws("|", "signal", "n_long"), "run_id": F.concat_ws("|", "signal", "n_long", "vol_target"),
            "ordinal": F.try_element_at(order, F.col("signal")) * (sizes * targets) + position})

    @cached_property
    def search(self) -> B.Backtest:
        series = B.prepare_series(self.executed, ["signal"], deepest=self.deepest)
        books = self.grid.select("book_id", "signal", *B.BOOK_DEFAULTS).distinct()
        book = B.Backtest(series, books, self.grid.select("run_id", "book_id", *B.RUN_DEFAULTS), ("signal",), self.deepest)
        book.returns = materialise(book.returns)  # read by the trials and by their correlations
        return book

    @cached_property
    def trials(self) -> DataFrame:
        runs = self.grid.select("run_id", "book_id", "signal", "n_long", "vol_target", "ordinal")
        return materialise(fold_trials(self.search.returns, self.search.refusals(self.delist_mode), self.folds, runs))

    @cached_property
    def choices(self) -> DataFrame:
        return best_trial(self.trials)

    def require_trials(self) -> None:
        """Refuse a search with a fold in which no trial is valid."""
        lost = self.folds.join(self.choices, "fold", "left_anti")
        refuse(lost.select("fold", F.col("train_end").cast("string")).orderBy("fold"), "no valid trial in fold")

    @cached_property
    def test_errors(self) -> DataFrame:
        """(fold, timestamp, error) of the chosen books on their test bars. Costs change no book, so these are the errors
        of every stressed level too."""
        return materialise(self.test.refusals(self.delist_mode).select(F.col("book_id").cast("int").alias("fold"), "timestamp", "error"))

    def require_tests(self) -> None:
        """Refuse a search whose choice cannot be held on the test bars of its fold."""
        refuse(self.test_errors.select("fold", "error", F.col("timestamp").cast("string")).orderBy("fold", "timestamp"), "a chosen book cannot be run on its test bars")

    def _test(self, chosen: DataFrame, variants: DataFrame, slice_of) -> B.Backtest:
        """Run chosen trials (fold, signal, n_long, vol_target) on their fold's test bars only."""
        slices = materialise(chosen.select("fold", "signal", "n_long", "vol_target").join(self.folds, "fold").withColumn("slice_id", slice_of))
        inside = (F.col("timestamp") >= F.col("test_start")) & (F.col("timestamp") <= F.col("test_end"))
        rows = self.signals.join(slices.select("signal", "slice_id", "test_start", "test_end"), "signal").where(inside).drop("signal", "test_start", "test_end")
        series = B.prepare_series(materialise(lag_for_execution(rows, ["slice_id"])), ["slice_id"], deepest=self.deepest)
        config = slices.select("slice_id", "n_long", F.col("n_long").alias("n_short"), "vol_target").join(
            variants.drop("n_long", "n_short", "vol_target"), F.lit(True)).withColumns({
                "book_id": F.col("slice_id"), "run_id": F.concat_ws("|", "slice_id", "variant")})
        books = config.select("book_id", "slice_id", *B.BOOK_DEFAULTS).distinct()
        return B.Backtest(series, books, config.select("run_id", "book_id", "variant", *B.RUN_DEFAULTS), ("slice_id",), self.deepest)

    @cached_property
    def variants(self) -> DataFrame:
        """The base costs and each stressed level."""
        def level(name, fee=F.col("fee_rate"), slip=F.col("slip_rate"), times=F.col("cost_multiplier")):
            return F.struct(F.lit(name).alias("variant"), fee.alias("f"), slip.alias("s"), times.alias("m"))

        if self.settings.get("tiered"):
            factors = [B.stressed_multiplier(f, s) for f, s in self.stress]
            stressed = [level(f"cost_x_{m:.2f}", times=F.lit(m)) for m in factors]
        else:
            stressed = [level(f"fee_{f}_slippage_{s}", F.lit(f), F.lit(s)) for f, s in self.stress]
        levels = B.run_grid(self.spark, **self.settings).withColumn("c", F.explode(F.array(level("base"), *stressed)))
        return levels.withColumns({"variant": F.col("c.variant"), "fee_rate": F.col("c.f"), "slip_rate": F.col("c.s"), "cost_multiplier": F.col("c.m")}).drop("c")

    @cached_property
    def test(self) -> B.Backtest:
        return self._test(self.choices, self.variants, F.col("fold").cast("string"))

    @cached_property
    def out_of_sample(self) -> DataFrame:
        """Active test returns of all folds, by cost variant."""
        rows = self.test.returns.where("idx > 0").select("variant", F.col("book_id").cast("int").alias("fold"), "idx", "timestamp", "ret")
        return materialise(rows.join(self.folds.select("fold", "ppy"), "fold"))

    @property
    def summary(self) -> DataFrame:
        return series_summary(self.out_of_sample, "variant", ("fold", "idx"))

    @property
    def fold_results(self) -> DataFrame:
        """One row per fold. A fold in which no trial is valid has no signal and no returns; one whose choice cannot be held
        on every test bar has no test return and says so in ``exclusion_reason``."""
        gained = self.out_of_sample.where("variant = 'base'").groupBy("fold").agg((F.product(F.col("ret") + 1) - 1).alias("test_return"))
        chosen = self.choices.select("fold", "signal", "n_long", "vol_target", "sharpe", "train_return")
        broken = self.test_errors.groupBy("fold").agg(F.count(F.lit(1)).alias("error_bars"))
        rows = self.folds.join(chosen, "fold", "left").join(gained, "fold", "left").join(broken, "fold", "left").fillna(0, ["error_bars"])
        reason = F.when(F.col("signal").isNull(), "no_valid_trial").when(F.col("error_bars") > 0, "data_error")
        return rows.withColumn("exclusion_reason", reason).withColumn("test_return", F.when(reason.isNull(), F.col("test_return")))

    @property
    def gates(self) -> DataFrame:
        base = F.col("variant") == "base"
        totals = self.summary.agg(
            F.max(F.when(base, F.col("total_return"))).alias("total_return"), F.max(F.when(base, F.col("sharpe"))).alias("sharpe"),
            F.max(F.when(base, F.col("max_drawdown"))).alias("max_drawdown"),
            F.min(F.when(~base, F.col("total_return"))).alias("worst_stress"))
        folds = self.fold_results.agg(F.count(F.lit(1)).alias("n_folds"), F.count_if(F.col("test_return") > 0).alias("folds_profitable"))
        return totals.join(folds, F.lit(True)).withColumns({
            "wf_positive": F.col("total_return") > 0, "wf_sharpe_above_one": F.col("sharpe") > 1,
            "wf_drawdown_above_minus_20pct": F.col("max_drawdown") > -0.20, "stress_positive": F.col("worst_stress") > 0,
            "majority_folds_profitable": F.col("folds_profitable") > F.col("n_folds") / 2})

    @cached_property
    def effective(self) -> DataFrame:
        """Effective number of trials over all folds, from the training returns of the valid ones."""
        valid = self.trials.where("sharpe is not null").select("fold", "run_id", "train_end")
        series = self.search.returns.where("idx > 0").select("run_id", "timestamp", "ret").join(valid, "run_id").where("timestamp <= train_end")
        return S.effective_trials(series.select(
            F.lit("walk_forward").alias("search"), F.concat_ws("|fold", "run_id", "fold").alias("id"), "timestamp", "ret"))

    @property
    def data_mining(self) -> DataFrame:
        """The selected path's Sharpe, deflated by the breadth of the search."""
        base = self.out_of_sample.where("variant = 'base'").withColumn("search", F.lit("walk_forward"))
        moments = S.adjusted_moments(base, "search", "ret").withColumn("n_obs", F.col("n")).withColumns({
            "skewness": F.coalesce("skewness", F.lit(0.0)), "kurtosis": F.coalesce("kurtosis", F.lit(3.0))})
        observed = self.summary.where("variant = 'base'").select(F.col("sharpe").alias("observed_sr"), "periods_per_year")
        scored = F.when(F.col("sharpe") > -1e9, F.col("sharpe"))
        breadth = self.trials.agg(F.count(F.lit(1)).alias("raw_n_trials"), F.count("sharpe").alias("valid_n_trials"), F.coalesce(F.var_samp(scored), F.lit(0.0)).alias("v"))
        rows = moments.join(observed, F.lit(True)).join(breadth, F.lit(True)).join(self.effective, "search")
        return S.deflated_sharpe(rows.withColumn("trials_variance", F.col("v") * F.col("periods_per_year")).withColumn("n_trials", F.col("effective_n_trials")))

    def ensemble_members(self, k: int) -> DataFrame:
        """Test returns of the k best distinct signals per fold as (fold, id, timestamp, ret); a signal that cannot be held
        on every test bar of a fold is no member there."""
        book = self._test(top_signals(self.trials, k), self.variants.where("variant = 'base'"), F.concat_ws("~", "fold", "signal"))
        parts = F.split("book_id", "~")
        sound = book.returns.join(book.refusals(self.delist_mode).select("book_id").distinct(), "book_id", "left_anti")
        return sound.where("idx > 0").select(parts[0].cast("int").alias("fold"), parts[1].alias("id"), "timestamp", "ret", "ppy")
