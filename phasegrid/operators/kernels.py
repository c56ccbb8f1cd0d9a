"""Signal kernels over array rows: Arrow batches in, numpy arrays of equal length inside, rows out.

Batches are worked off in pieces of some hundred signals, so a task's memory does not grow with their rows.

Random draws are made from a hash of the row's key, so a result depends neither
on partitioning nor on the order of rows. Signals that are null, empty, not
finite, constant or too short give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid.functions import dsp, stats
from phasegrid.operators.coupling import _stacked, by_length

Row = tuple
#: Arrow's types of what kernels give.
ARROW = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


def map_signals(df: DataFrame, keys: Sequence[str], samples: str, out: str, kernel: Callable[[list[Row], np.ndarray], Iterator[Row]], least: int = 8) -> DataFrame:
    """``*keys`` and the columns of ``out``: ``kernel(keys of the rows, [row, time])`` yields (row number, *values)."""
    names = list(keys)
    fields = T._parse_datatype_string(out).fields
    schema, types = T.StructType([*(df.schema[k] for k in names), *fields]), [ARROW[f.dataType.simpleString()] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch, len(names)):
                use, x = _stacked(part.column(len(names)))
                if not len(use) or x.shape[1] < least:
                    continue
                own = list(zip(*(part.column(k).take(pa.array(use)).to_pylist() for k in range(len(names))), strict=True))
                rows = list(kernel(own, x))
                if rows:
                    row, *values = zip(*rows, strict=True)
                    at = pa.array(use[list(row)])
                    columns = [pa.array(v, kind, from_pandas=True) for v, kind in zip(values, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(len(names))), *columns], schema.names)

    return df.select(*names, F.col(samples).cast("array<double>").alias("samples")).mapInArrow(run, schema)


def filtered(df, keys, samples, low, high, sfreq):
    """``samples``: band-passed, zero phase."""

    def kernel(own, x):
        for k, y in enumerate(dsp.bandpass(dsp.detrend(x), low, high, sfreq)):
            yield k, y

    return map_signals(df, keys, samples, "samples array<double>", kernel)


def analytic(df, keys, samples, low, high, sfreq):
    """``phase, envelope`` of a band."""

    def kernel(own, x):
        for k, z in enumerate(dsp.analytic(dsp.bandpass(dsp.detrend(x), low, high, sfreq))):
            yield k, np.angle(z), np.abs(z)

    return map_signals(df, keys, samples, "phase array<double>, envelope array<double>", kernel)


def band_powers(df, keys, samples, bands: dict[str, tuple[float, float]], whole: tuple[float, float], sfreq, seconds: float = 4.0):
    """Share of the Welch power of each band in that of ``whole``. Bands may overlap or reach beyond it."""

    def kernel(own, x):
        freqs, power = dsp.welch(dsp.detrend(x), sfreq, int(seconds * sfreq))
        total = dsp.band_area(freqs, power, *whole)
        shares = [dsp.band_area(freqs, power, *b) for b in bands.values()]
        for k in range(len(x)):
            if total[k] > 0:
                yield (k, *(float(s[k] / total[k]) for s in shares))

    return map_signals(df, keys, samples, ", ".join(f"{b} double" for b in bands), kernel)


def coupling_z(df, keys, samples, phase: tuple[float, float], amplitude: tuple[float, float], sfreq, surrogates: int = 120, mask: Callable[[Row, int], np.ndarray] | None = None, least: float = 5.0):
    """``mi, mi_z, pref_phase``: modulation index, its z among circular shifts, centre of the best bin.

    ``mask(key, n)`` tells which samples are valid. The whole signal is filtered,
    then what is valid is put together; shifts act on that. Signals with fewer than
    ``least`` seconds of it give no row.
    """

    def kernel(own, x):
        x = dsp.detrend(x)
        ph = np.angle(dsp.analytic(dsp.bandpass(x, *phase, sfreq)))
        am = np.abs(dsp.analytic(dsp.bandpass(x, *amplitude, sfreq)))
        for k in range(len(x)):
            use = np.ones(x.shape[1], dtype=bool) if mask is None else mask(own[k], x.shape[1])
            if use.sum() >= least * sfreq:
                mi, z, best = dsp.modulation_z(dsp.phase_bins(ph[k][use]), am[k][use], dsp.hashed_shifts("|".join(map(str, own[k])), int(use.sum()), surrogates))
                yield k, mi, z, float(-np.pi + (best + 0.5) * 2 * np.pi / dsp.BINS)

    return map_signals(df, keys, samples, "mi double, mi_z double, pref_phase double", kernel)


def locked_envelopes(df, keys, samples, slow: tuple[float, float], bands: dict[str, tuple[float, float]], sfreq, half: float, height: float = 1.0, distance: float = 0.6):
    """``band, offset, total, n``: sums of z-scored envelopes around slow troughs; mergeable over signals."""

    def kernel(own, x):
        x = dsp.detrend(x)
        so = -dsp.zscore(dsp.bandpass(x, *slow, sfreq))
        env = {b: dsp.zscore(np.abs(dsp.analytic(dsp.bandpass(x, *f, sfreq)))) for b, f in bands.items()}
        w = int(half * sfreq)
        for k in range(len(x)):
            events = dsp.find_peaks(so[k], height, max(1.0, distance * sfreq))
            for b, e in env.items():
                cut = dsp.epochs(e[k], events, w)
                if len(cut):
                    yield k, b, cut.sum(axis=0), len(cut)

    return _by_offset(map_signals(df, keys, samples, "band string, totals array<double>, n long", kernel), [*keys, "band"], int(half * sfreq))


def _by_offset(summed: DataFrame, names: Sequence[str], half: int) -> DataFrame:
    """``*names, offset, total, n`` from the sums of windows as arrays."""
    each = summed.select(*names, "n", F.posexplode("totals").alias("__at", "total"))
    return each.select(*names, (F.col("__at") - half).alias("offset"), "total", "n")


def triggered_z(df, keys, samples, events: str, low, high, sfreq, half: int, surrogates: int = 200, least: int = 30):
    """``z, n_events``: peak-to-peak of the event-triggered average of a band, among averages at random onsets.

    ``events`` is an array column of sample numbers in the same row. Windows must
    lie inside, a start at the first sample included.
    """

    def kernel(own, x):
        x = dsp.bandpass(dsp.detrend(x), low, high, sfreq)
        for k in range(len(x)):
            at = np.array(own[k][-1], dtype=np.int64)
            cut = dsp.epochs(x[k], at, half, strict=False) if len(at) >= least else at[:0]
            if len(cut) < least:
                continue
            u = dsp.hashed_numbers("|".join(map(str, own[k][:-1])), surrogates * len(cut))
            onsets = half + np.floor(u * (x.shape[1] - 2 * half)).astype(np.int64)
            null = np.array([np.ptp(dsp.epochs(x[k], own_onsets, half, strict=False).mean(axis=0)) for own_onsets in onsets.reshape(surrogates, -1)])
            yield k, float((np.ptp(cut.mean(axis=0)) - null.mean()) / (null.std() + 1e-12)), len(cut)

    return map_signals(_with_events(df, events), [*keys, events], samples, "z double, n_events int", kernel, 2 * half + 3).drop(events)


def _with_events(df: DataFrame, events: str) -> DataFrame:
    """A null list of events is an empty one; nulls in a list go."""
    return df.withColumn(events, F.coalesce(F.array_compact(events), F.array().cast("array<int>")))


def event_hierarchy(df, keys, samples, slow, spindle, ripple, sfreq, heights=(1.0, 1.5, 2.0), distances=(0.8, 0.3, 0.02), in_spindle: float = 1.0):
    """``leg, phase``: phase of the slower band at each faster event: spindle peaks on the slow band, ripple peaks inside spindles on the spindle band."""

    def kernel(own, x):
        x = dsp.detrend(x)
        z = {b: dsp.analytic(dsp.bandpass(x, *f, sfreq)) for b, f in (("slow", slow), ("spindle", spindle), ("ripple", ripple))}
        env = {b: dsp.zscore(np.abs(z[b])) for b in ("spindle", "ripple")}
        for k in range(len(x)):
            for at in dsp.find_peaks(env["spindle"][k], heights[1], max(1.0, distances[1] * sfreq)):
                yield k, "slow_spindle", float(np.angle(z["slow"][k, at]))
            for at in dsp.find_peaks(env["ripple"][k], heights[2], max(1.0, distances[2] * sfreq)):
                if env["spindle"][k, at] > in_spindle:
                    yield k, "spindle_ripple", float(np.angle(z["spindle"][k, at]))

    return map_signals(df, keys, samples, "leg string, phase double", kernel)


def time_frequency(df, keys, samples, events: str, freqs: Sequence[float], sfreq, half: int):
    """``freq, offset, total, n``: sums of z-scored envelopes at each frequency (band width max(1, 0.3 f), in units of the rate's scale) around events."""
    def kernel(own, x):
        x = dsp.detrend(x)
        marks = [np.array(row[-1], dtype=np.int64) for row in own]
        for f in freqs:
            width = max(1.0, 0.3 * f)
            env = dsp.zscore(np.abs(dsp.analytic(dsp.bandpass(x, max(0.1, f - width / 2), min(0.49 * sfreq, f + width / 2), sfreq))))
            for k in range(len(x)):
                cut = dsp.epochs(env[k], marks[k], half)
                if len(cut):
                    yield k, float(f), cut.sum(axis=0), len(cut)

    got = map_signals(_with_events(df, events), [*keys, events], samples, "freq double, totals array<double>, n long", kernel, 2 * half + 3)
    return _by_offset(got, [*keys, "freq"], half)


def long_trace(df, keys, samples, sfreq: float, rate: float = 100.0, seconds: float = 180.0):
    """``samples``: at most ``seconds`` of each cleaned signal on a common axis, by linear interpolation."""

    def kernel(own, x):
        for k, row in enumerate(x):
            clean = dsp.clean_trace(row, sfreq)
            if clean is not None:
                n = min(len(row) / sfreq, seconds)
                yield k, np.interp(np.arange(0, n, 1 / rate), np.arange(len(row)) / sfreq, clean)

    return map_signals(df, keys, samples, "samples array<double>", kernel)


@F.pandas_udf(T.DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([stats.spearman_p(r, int(k)) if r == r and k >= 3 else float("nan") for r, k in zip(rho, n, strict=True)])
