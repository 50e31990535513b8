"""Sliding frames of a panel of many assets, folded over Arrow batches.

A window function folds a sliding frame anew for every row, value by value and aggregate by aggregate. Here the frames of a whole
batch are folded together: step j adds the j-th value of each. The steps are those of Spark's ``sum``, ``avg``, ``stddev_samp``
and ``covar_samp``, oldest value first, so a frame without gaps gives the same doubles as the window function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F


def _numbers(batch, column: str):
    """Values (0 where missing) and where there are some."""
    c = batch.column(column)
    return c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)


def _ages(batch) -> np.ndarray:
    """How many rows of its asset lie before each row of the batch."""
    asset, at = batch.column("asset"), batch.column("timestamp").cast(pa.int64()).to_numpy()
    new = np.ones(len(asset), bool)
    if len(asset) > 1:
        # A null asset is an asset too, as it is to a window.
        same = pc.equal(asset[1:], asset[:-1]).fill_null(False)
        new[1:] = ~pc.or_(same, pc.and_(asset[1:].is_null(), asset[:-1].is_null())).to_numpy(zero_copy_only=False)
    if np.any((at[1:] < at[:-1]) & ~new[1:]):
        raise ValueError("the rows of an asset are not in order of time")
    places = np.arange(len(new))
    return places - np.maximum.accumulate(np.where(new, places, 0))


def _full(known: np.ndarray, ages: np.ndarray, k: int) -> np.ndarray:
    """Rows before which the asset has ``k`` rows, with a value each."""
    seen = np.concatenate(([0], np.cumsum(known)))
    full = ages >= k
    full[k:] &= seen[k:-1] - seen[:-1 - k] == k
    return full


def _moments(x: np.ndarray, k: int):
    """Sum and sample deviation of the ``k`` values before each row, from row ``k`` on."""
    total, mean, squares = np.zeros((3, max(len(x) - k, 0)))
    for j in range(k if len(total) else 0):
        value = x[j:j + len(total)]
        total += value
        delta = value - mean
        step = delta / (j + 1)
        mean += step
        squares += delta * (delta - step)
    return total, np.sqrt(squares / (k - 1))


def _covariance(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Sample covariance of the ``k`` pairs before each row, from row ``k`` on."""
    mean_x, mean_y, products = np.zeros((3, max(len(x) - k, 0)))
    for j in range(k if len(products) else 0):
        dx, dy = x[j:j + len(products)] - mean_x, y[j:j + len(products)] - mean_y
        step = dy / (j + 1)
        mean_x += dx / (j + 1)
        mean_y += step
        products += dx * (dy - step)
    return products / (k - 1)


def _folds(batch, lookbacks, residual, funding) -> dict:
    """Name to (values, where there are some) of every fold, for each row of the batch."""
    ages, out = _ages(batch), {}
    returns, known = _numbers(batch, "asset_return")

    def put(name, values, there, k):
        whole = np.zeros(len(ages), values.dtype)
        whole[k:] = values
        out[name] = whole, there

    def lag(name, values, known, k=1):
        there = ages >= k
        there[k:] &= known[:-k]
        put(name, values[:-k], there, k)

    lag("_return_lag", returns, known)
    for k in lookbacks:
        total, spread = _moments(returns, k)
        full = _full(known, ages, k)
        put(f"_sum_{k}", total, full, k)
        put(f"_std_{k}", spread, full, k)
    if residual:
        (idx, numbered), (bench, _) = _numbers(batch, "idx"), _numbers(batch, "bench_return")
        for k in residual:
            lag(f"_first_idx_{k}", idx, numbered, k)
            put(f"_covar_{k}", _covariance(returns, bench, k), _full(known, ages, k), k)
    if funding:
        rates, paid = _numbers(batch, "funding_rate")
        lag("_funding_lag", rates, paid)
        put("_avg_funding", _moments(rates, funding)[0] / funding, _full(paid, ages, funding), funding)
    return out


def _fold(batches, read, kept, lookbacks, residual, funding):
    """The last rows of a batch, as far as frames reach back, go before the next one."""
    reach = max([*lookbacks, *residual, funding or 1])
    tail = None
    with np.errstate(all="ignore"):
        for batch in batches:
            mine = batch.select(read)
            frame = pa.concat_batches([tail, mine]) if tail is not None else mine
            start = frame.num_rows - batch.num_rows
            folds = {name: pa.array(values[start:], mask=~there[start:]) for name, (values, there) in _folds(frame, lookbacks, residual, funding).items()}
            tail = frame.slice(max(frame.num_rows - reach, 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *folds.values()], names=[*kept, *folds])


def sliding_folds(ordered: DataFrame, lookbacks, residual=(), funding: int | None = None) -> DataFrame:
    """Add the folds of the rows before each row, NULL unless the frame is full of values.

    Rows of an asset must lie in one partition, as they do behind a window over assets. Of ``asset_return``: ``_return_lag``, and per
    lookback ``_sum_k`` and ``_std_k``; per residual lookback ``_covar_k`` with ``bench_return`` (a column that only this step needs, so
    it goes; missing ones count as 0) and ``_first_idx_k``, the ``idx`` k rows before; with ``funding`` the lag and mean of so many rates.
    """
    lookbacks, residual = tuple(lookbacks), tuple(residual)
    read = ["timestamp", "asset", "asset_return", *(["idx", "bench_return"] if residual else []), *(["funding_rate"] if funding else [])]
    kept = [c for c in ordered.columns if not residual or c != "bench_return"]
    added = ["_return_lag double", *[f"_{m}_{k} double" for k in lookbacks for m in ("sum", "std")]]
    for k in residual:
        added += [f"_first_idx_{k} {dict(ordered.dtypes)['idx']}", f"_covar_{k} double"]
    if funding:
        added += ["_funding_lag double", "_avg_funding double"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.select(*kept).schema], *added])
    folded = ordered.sortWithinPartitions("asset", "timestamp").mapInArrow(
        lambda batches: _fold(batches, read, kept, lookbacks, residual, funding), schema)
    return folded.withColumns({f"_n_{k}": F.when(F.col(f"_sum_{k}").isNotNull(), k) for k in lookbacks})
