"""Signal and statistics kernels against closed forms, brute force and published values."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phasegrid.functions import dsp, stats
from phasegrid.plans import kernel_queries

FS = 200.0
T = np.arange(0, 60, 1 / FS)


def test_band_pass_keeps_its_band_and_no_phase():
    x = np.sin(2 * np.pi * 1.0 * T)[None]
    y = dsp.bandpass(x, 0.5, 1.5, FS)
    assert np.abs(y - x)[0, 1500:-1500].max() < 0.02
    assert np.abs(dsp.bandpass(np.sin(2 * np.pi * 20 * T)[None], 0.5, 1.5, FS))[0, 1500:-1500].max() < 1e-3


def test_band_pass_is_symmetric_in_time():
    x = np.zeros((1, 4001))
    x[0, 2000] = 1
    y = dsp.bandpass(x, 11, 16, FS)[0]
    assert np.allclose(y, y[::-1], atol=1e-10)


def test_slow_band_is_stable_at_high_rates():
    x = np.random.default_rng(0).standard_normal((2, 20000)).cumsum(axis=1)
    assert np.abs(dsp.bandpass(dsp.detrend(x), 0.5, 1.25, 2000.0)).max() < np.abs(x).max() * 2


def test_notch_takes_out_the_line_only():
    line, other = np.sin(2 * np.pi * 50 * T), np.sin(2 * np.pi * 7 * T)
    y = dsp.notch_comb((line + other)[None], 50, FS)[0]
    assert np.abs(y - other)[2000:-2000].max() < 1e-2


def test_analytic_signal_of_a_tone():
    z = dsp.analytic(np.cos(2 * np.pi * 1.0 * T)[None])[0]
    assert np.allclose(np.abs(z), 1) and np.allclose(np.unwrap(np.angle(z)), 2 * np.pi * T, atol=1e-6)


def test_welch_of_white_noise_and_area():
    f, p = dsp.welch(np.random.default_rng(0).standard_normal((1, 400_000)), FS, 800)
    assert abs(dsp.band_area(f, p, 0, 101)[0] - 1) < 0.02
    assert math.isclose(dsp.band_area(np.arange(5.0), np.array([[0, 1, 4, 9, 16.0]]), 1, 4)[0], 2.5 + 6.5)


def test_resampling_keeps_slow_tones():
    x = np.sin(2 * np.pi * 3 * T)[None]
    for y, step in ((dsp.resample(x, 1, 4), 4), (dsp.decimate(x, 2), 2)):
        assert np.abs(y - x[:, ::step])[0, 200:-200].max() < 5e-3
    assert dsp.resample(x, 2, 2).shape == x.shape


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=0, max_size=60), st.integers(1, 6))
def test_peaks_are_maxima_and_apart(values, distance):
    x = np.array(values, dtype=float)
    peaks = dsp.find_peaks(x, 2, distance)
    assert (np.diff(peaks) >= distance).all()
    for p in peaks:
        left, right = p, p
        while left > 0 and x[left - 1] == x[p]:
            left -= 1
        while right < len(x) - 1 and x[right + 1] == x[p]:
            right += 1
        assert 0 < left and right < len(x) - 1 and x[left - 1] < x[p] > x[right + 1] and x[p] >= 2 and p == (left + right) // 2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_modulation_index_properties(seed):
    r = np.random.default_rng(seed)
    bins, amp = r.integers(0, 18, 500), r.random(500)
    mi = dsp.modulation_index(dsp.phase_curve(bins, amp))
    assert -1e-12 <= mi <= 1
    assert math.isclose(mi, dsp.modulation_index(dsp.phase_curve((bins + 5) % 18, 7 * amp)), abs_tol=1e-12)
    one = np.zeros(18)
    one[3] = 1
    assert dsp.modulation_index(np.ones(18)) == pytest.approx(0, abs=1e-12) and dsp.modulation_index(one) > 0.99
    assert math.isnan(dsp.modulation_index(np.zeros(18)))


def test_bins_at_the_ends():
    assert dsp.phase_bins(np.array([-np.pi, 0.0, np.pi])).tolist() == [0, 9, 17]


def planted(modulated=True):
    r = np.random.default_rng(1)
    slow = 2 * np.pi * 0.8 * T + np.cumsum(r.standard_normal(len(T))) * 0.03  # drifts, so that shifted copies fall out of step
    gain = 1 + 0.9 * np.sin(slow) if modulated else np.ones_like(T)
    return np.cos(slow) * 3 + gain * np.cos(2 * np.pi * 13 * T) + 0.2 * r.standard_normal(len(T))


def test_planted_coupling_is_found():
    for modulated in (True, False):
        x = planted(modulated)[None]
        ph = np.angle(dsp.analytic(dsp.bandpass(x, 0.5, 1.25, FS)))[0]
        am = np.abs(dsp.analytic(dsp.bandpass(x, 11, 16, FS)))[0]
        mi, z, best = dsp.modulation_z(dsp.phase_bins(ph), am, dsp.hashed_shifts("s1", len(am), 120))
        if modulated:
            assert z > 5 and abs(-np.pi + (best + 0.5) * 2 * np.pi / 18 - np.pi / 2) < 0.5
            half = (np.arange(len(am)) // 1000) % 2
            curve = dsp.aligned_curve(dsp.phase_bins(ph), am, half)
            assert abs(curve.mean()) < 1e-12 and curve[9] > 0.3
        else:
            assert abs(mi) < 0.01


def test_epochs_at_the_edges():
    x = np.arange(20.0)
    assert dsp.epochs(x, np.array([5, 6, 15]), 5).shape[0] == 1
    assert dsp.epochs(x, np.array([5, 6, 14, 15]), 5, strict=False)[:, 0].tolist() == [0, 1, 9]


def test_clean_trace_refuses_bad_signals():
    assert dsp.clean_trace(np.full(100, 2.0), FS) is None
    assert dsp.clean_trace(np.array([1.0, np.nan] * 50), FS) is None
    assert dsp.clean_trace(np.array([]), FS) is None
    assert len(dsp.clean_trace(planted(), FS)) == len(T)


def test_robust_z_falls_back():
    z = dsp.robust_z(np.array([[0.0, 0, 0, 0, 5.0]]))[0]
    assert z[-1] == pytest.approx(5 / 2.0) and z[0] == 0


# statistics


def test_wilcoxon_published_and_brute():
    assert stats.wilcoxon(np.arange(1, 16))[1] == pytest.approx(6.103515625e-05)
    x = np.array([1.1, -0.4, 2.2, 0.9, -0.1, 3.0])
    w, p = stats.wilcoxon(x)
    ranks = stats.average_ranks(np.abs(x))
    sums = [sum(r for k, r in enumerate(ranks) if m >> k & 1) for m in range(64)]
    assert p == pytest.approx(min(1, 2 * sum(s <= w for s in sums) / 64))


def test_mann_whitney_brute():
    from itertools import combinations

    x, y = [3.1, 0.2, 5.0], [1.0, 2.0, 6.0, 7.0]
    u, p = stats.mann_whitney(x, y)
    ranks = range(1, 8)
    us = [sum(c) - 6 for c in combinations(ranks, 3)]
    top = max(u, 12 - u)
    assert u == 4 and p == pytest.approx(min(1, 2 * sum(v >= top for v in us) / len(us)))


def test_spearman_and_beta():
    rho, p = stats.spearman([1, 2, 3, 4, 5], [2, 1, 4, 3, 5])
    assert rho == pytest.approx(0.8) and p == pytest.approx(0.10408803866)
    assert stats.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)


def test_rayleigh_published():
    assert stats.rayleigh_p(847, 0.204) == pytest.approx(3.06e-16, rel=0.3)
    assert stats.rayleigh_p(10118, 0.0171) == pytest.approx(0.0515, rel=0.02)


def test_bootstrap_is_fixed_and_covers():
    x = np.random.default_rng(5).random(40)
    low, high = stats.bootstrap_ci(x)
    assert (low, high) == stats.bootstrap_ci(x) and low < x.mean() < high
    assert all(math.isnan(v) for v in stats.bootstrap_ci([1.0]))


def test_recordings_keep_every_hour(spark, tmp_path):
    hours = {1: 23, 2: 25, 3: 48}
    rows = [(u, np.datetime64("2024-01-01T05:30", "us") + np.timedelta64(h, "h"), "purchase" if h == n - 1 else "view", float(h * h % 7)) for u, n in hours.items() for h in range(n)]
    pd.DataFrame([(k, *r) for k, r in enumerate(rows)], columns=["event_id", "user_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    got = {r.user_id: r for r in kernel_queries.recordings(spark, str(tmp_path)).collect()}
    assert {u: len(r.samples) for u, r in got.items()} == hours
    assert all(r.samples == [float(h * h % 7) for h in range(hours[u])] and r.marks == [hours[u] - 1] for u, r in got.items())
    counts = {r.user_id: r["count"] for r in kernel_queries.sos_bandpass(spark, str(tmp_path)).groupBy("user_id").count().collect()}
    assert counts == hours


def test_all_shifts_at_once_equal_a_loop():
    r = np.random.default_rng(6)
    for n in (20, 301):
        bins_of, am = r.integers(0, dsp.BINS, n), r.random(n)
        shifts = dsp.hashed_shifts("key", n, 50)
        assert shifts.min() >= int(0.1 * n) and shifts.max() < max(int(0.9 * n), int(0.1 * n) + 1) and len(set(shifts)) > 5
        want = [dsp.phase_curve(bins_of, np.roll(am, s)) for s in shifts]
        assert np.allclose(dsp.shifted_curves(bins_of, am, shifts), want, atol=1e-12)
    u = dsp.hashed_numbers("key", 4001)
    assert len(u) == 4001 and 0 < u.min() < u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and np.array_equal(u[:9], dsp.hashed_numbers("key", 9))
