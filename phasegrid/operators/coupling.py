"""Phase-amplitude coupling from mergeable accumulators.

A kernel turns each signal row into at most bins x halves sums and counts, so
what is shuffled afterwards does not grow with the signals' length; everything
behind it is aggregation over ``(key, half, bin)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid.functions import dsp

Band = tuple[float, float]


def dft_band(x: np.ndarray, band: Band) -> np.ndarray:
    """Analytic signal of the discrete frequencies low..high of each row."""
    spectrum = np.fft.fft(x, axis=1)
    kept = np.zeros_like(spectrum)
    low, high = int(band[0]), int(band[1])
    kept[:, low : high + 1] = 2 * spectrum[:, low : high + 1]
    return np.fft.ifft(kept, axis=1)


def _stacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(indices of usable rows, their samples): rows of the first usable length; null, empty, constant and non-finite signals are left out."""
    sizes = _lengths(column)
    length = next(iter(sizes[sizes > 0].tolist()), 0)
    use = np.flatnonzero(sizes == length) if length else np.zeros(0, dtype=np.int64)
    flat = column.take(pa.array(use)).flatten().to_numpy(zero_copy_only=False)  # a null among numbers is a NaN here
    x = np.asarray(flat, dtype=np.float64).reshape(len(use), length)
    fine = np.isfinite(x).all(axis=1)
    fine[fine] = x[fine].std(axis=1) >= 1e-9
    return use[fine], x[fine]


def _lengths(column: pa.Array) -> np.ndarray:
    """Lengths of the lists; 0 for a null."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


#: Samples that a kernel takes at once, a signal at least: what it holds does not grow with the rows of an Arrow batch.
PIECE = 1 << 17


def by_length(batch: pa.RecordBatch, samples: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows grouped by signal length, so that kernels get rectangular arrays, in pieces of ``PIECE`` samples."""
    sizes = _lengths(batch.column(samples))
    for n in np.unique(sizes[sizes > 0]):
        own, most = np.flatnonzero(sizes == n), max(1, PIECE // int(n))
        for at in range(0, len(own), most):
            yield batch.take(pa.array(own[at : at + most]))


def phase_amplitude_sums(
    signals: DataFrame, keys: Sequence[str], bands: Sequence[tuple[str, Band, Band]], samples: str = "samples", block: int | None = None, bins: int = dsp.BINS,
    sfreq: float | None = None,
) -> DataFrame:
    """``*keys, leg, half, bin, amp_sum, n``: each signal's amplitude sums and counts by phase bin and half, for each leg (name, phase band, amplitude band).

    ``block``: samples of the interleaved blocks whose parity is the half; all is half 0 without it.
    Bands are discrete frequencies, or Hz where the rate ``sfreq`` is given. Each band's analytic signal is made once, however many legs use it.
    """
    distinct = sorted({b for _, p, a in bands for b in (p, a)})
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_length(whole, len(names)):
                use, x = _stacked(batch.column(len(names)))
                if not len(use):
                    continue
                n = x.shape[1]
                per_hz = n / sfreq if sfreq else 1
                analytic = {b: dft_band(x, (max(1, round(b[0] * per_hz)), round(b[1] * per_hz))) for b in distinct}
                half = (np.arange(n) // block) % 2 if block else np.zeros(n, dtype=np.int64)
                halves = 2 if block else 1
                cells = halves * bins
                for leg, phase, amplitude in bands:
                    at = dsp.phase_bins(np.angle(analytic[phase]), bins) + half * bins + np.arange(len(use))[:, None] * cells
                    count = np.bincount(at.ravel(), minlength=len(use) * cells)
                    total = np.bincount(at.ravel(), weights=np.abs(analytic[amplitude]).ravel(), minlength=len(use) * cells)
                    cell = np.flatnonzero(count)
                    row = pa.array(use[cell // cells])
                    columns = [batch.column(k).take(row) for k in range(len(names))]
                    columns += [pa.array([leg] * len(cell)), pa.array((cell % cells // bins).astype(np.int32)), pa.array((cell % bins).astype(np.int32)), pa.array(total[cell]), pa.array(count[cell])]
                    yield pa.RecordBatch.from_arrays(columns, [*names, "leg", "half", "bin", "amp_sum", "n"])

    out = T.StructType([*(signals.schema[k] for k in names), *T._parse_datatype_string("leg string, half int, bin int, amp_sum double, n long").fields])
    return signals.select(*names, F.col(samples).cast("array<double>").alias("samples")).mapInArrow(run, out)


def curves(sums: DataFrame, keys: Sequence[str], bins: int = dsp.BINS) -> DataFrame:
    """``*keys, bin, mean_amp``: every bin of every key; 0 for an empty bin."""
    total = sums.groupBy(*keys, "bin").agg(F.sum("amp_sum").alias("s"), F.sum("n").alias("n"))
    # one row per key with its filled bins, then all bins again: no join with a table of bins
    packed = total.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", (F.col("s") / F.col("n")).alias("m")))).alias("by_bin"))
    return packed.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "by_bin").select(*keys, "bin", F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0.0)).alias("mean_amp"))


def modulation(curve: DataFrame, keys: Sequence[str], bins: int = dsp.BINS) -> DataFrame:
    """``*keys, mi``: the modulation index of each curve; null where a curve has no mass."""
    share = F.greatest(F.try_divide(F.col("mean_amp"), F.sum("mean_amp").over(Window.partitionBy(*keys))), F.lit(1e-12))
    return curve.withColumn("p", share).groupBy(*keys).agg(((F.log(F.lit(float(bins))) + F.sum(F.col("p") * F.log("p"))) / F.log(F.lit(float(bins)))).alias("mi"))


def bin_centre(bin_of: Column, bins: int = dsp.BINS) -> Column:
    return -F.pi() + (bin_of + 0.5) * (2 * F.pi() / bins)


def preferred(curve: DataFrame, keys: Sequence[str], bins: int = dsp.BINS) -> DataFrame:
    """``*keys, pref_bin, pref_phase``: the first bin of the largest mean amplitude and its centre."""
    best = F.max_by("bin", F.struct(F.col("mean_amp"), -F.col("bin"))).alias("pref_bin")
    return curve.groupBy(*keys).agg(best).withColumn("pref_phase", bin_centre(F.col("pref_bin"), bins))


def aligned(sums: DataFrame, keys: Sequence[str], bins: int = dsp.BINS) -> DataFrame:
    """``*keys, pos, value``: half 1's curve, turned so that half 0's best bin is at bins / 2, without its mean; keys with both halves only."""
    curve = curves(sums, [*keys, "half"], bins)
    arrays = curve.groupBy(*keys, "half").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "mean_amp"))), lambda e: e["mean_amp"]).alias("c"))
    both = arrays.groupBy(*keys).pivot("half", [0, 1]).agg(F.first("c")).dropna(subset=["0", "1"])
    best = F.array_position("0", F.array_max("0")) - 1
    turned = both.select(*keys, best.alias("best"), F.col("1").alias("b"), F.aggregate("1", F.lit(0.0), lambda a, x: a + x).alias("total"))
    value = F.expr(f"element_at(b, cast(pmod(pos - {bins // 2} + best, {bins}) as int) + 1) - total / {bins}")
    return turned.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("pos")).select(*keys, "pos", value.alias("value"))


def comodulogram(signals: DataFrame, keys: Sequence[str], phase_bands: Sequence[Band], amplitude_bands: Sequence[Band], samples: str = "samples") -> DataFrame:
    """``*keys, phase_low, amp_low, mi`` for every pair of a phase and an amplitude band."""
    legs = [(f"{p[0]}|{a[0]}", p, a) for p in phase_bands for a in amplitude_bands]
    mi = modulation(curves(phase_amplitude_sums(signals, keys, legs, samples), [*keys, "leg"]), [*keys, "leg"])
    part = F.split("leg", r"\|")
    return mi.select(*keys, part[0].cast("int").alias("phase_low"), part[1].cast("int").alias("amp_low"), "mi")
