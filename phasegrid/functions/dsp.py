"""Signal-processing kernels in numpy over [channel, time] arrays; recursions go over stretches of time, once for all channels."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np


def detrend(x: np.ndarray) -> np.ndarray:
    """Take off the least-squares line of each channel."""
    x = np.atleast_2d(np.asarray(x, dtype=np.float64))
    t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    slope = (x @ t) / max((t @ t), 1e-300)
    return x - x.mean(axis=1, keepdims=True) - slope[:, None] * t


def butter_bandpass(low: float, high: float, sfreq: float, order: int = 3) -> np.ndarray:
    """Second-order sections [b0 b1 b2 1 a1 a2] of a Butterworth band-pass (bilinear transform, warped edges).

    Sections keep the slow band stable at any rate, where one long polynomial loses its poles to rounding.
    """
    edges = 4.0 * np.tan(np.pi * np.array([low, high]) / sfreq)
    width, centre2 = edges[1] - edges[0], edges[0] * edges[1]
    k = np.arange(order)
    prototype = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)) * width / 2
    root = np.sqrt(prototype**2 - centre2 + 0j)
    analog = np.concatenate([prototype + root, prototype - root])
    digital = (4.0 + analog) / (4.0 - analog)
    gain = (width**order * 4.0**order / np.prod(4.0 - analog)).real
    upper = sorted(digital[digital.imag > 1e-12], key=abs)
    pairs = [(p, p.conjugate()) for p in upper]
    real = sorted(digital[np.abs(digital.imag) <= 1e-12].real)
    pairs += list(zip(real[::2], real[1::2], strict=True))
    sections = np.array([[1.0, 0.0, -1.0, 1.0, -(a + b).real, (a * b).real] for a, b in pairs])
    sections[0, :3] *= gain
    return sections


def notch(freq: float, sfreq: float, quality: float = 30.0) -> np.ndarray:
    """A second-order notch as one section."""
    w = 2 * np.pi * freq / sfreq
    gain = 1.0 / (1.0 + np.tan(w / quality / 2))
    return np.array([[gain, -2 * gain * np.cos(w), gain, 1.0, -2 * gain * np.cos(w), 2 * gain - 1]])


#: Samples that a state-space step covers.
STEP = 64


class StateSpace:
    """Second-order sections as one linear system: what a stretch of samples does to the state is an affine map.

    A stretch of ``STEP`` samples is one matrix product; the state goes from stretch
    to stretch, and between blocks of a signal the same way.
    """

    def __init__(self, sections: np.ndarray):
        self.sections, self.size = sections, 2 * len(sections)
        m = STEP
        unit = np.concatenate([np.eye(self.size), np.zeros((1, self.size))])
        x = np.zeros((self.size + 1, m))
        x[-1, 0] = 1.0  # the impulse
        y, ends = np.empty_like(x), []
        state = unit
        for t in range(m):
            y[:, t], state = self._one(x[:, t], state)
            ends.append(state)
        self.free = y[:-1]  # output of each unit state without input
        self.impulse = y[-1]
        self.forced = np.array([e[-1] for e in ends])  # state t + 1 samples after an impulse
        self.power = [np.eye(self.size), *(e[:-1] for e in ends)]  # of the step matrix, acting on rows
        lag = np.arange(m)[:, None] - np.arange(m)[None, :]
        self.response = np.where(lag >= 0, self.impulse[np.maximum(lag, 0)], 0.0).T
        self._powers: dict[int, np.ndarray] = {}

    def _one(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty_like(state)
        for k, (b0, b1, b2, _, a1, a2) in enumerate(self.sections):
            y = b0 * x + state[:, 2 * k]
            out[:, 2 * k] = b1 * x - a1 * y + state[:, 2 * k + 1]
            out[:, 2 * k + 1] = b2 * x - a2 * y
            x = y
        return x, out

    def steady(self, value: np.ndarray) -> np.ndarray:
        """The state in which a constant input leaves the system as it is, a row for each value."""
        out = []
        for b0, b1, b2, _, a1, a2 in self.sections:
            s = (b0 + b1 + b2) / (1 + a1 + a2)
            out += [(s - b0) * value, (b2 - a2 * s) * value]
            value = s * value
        return np.stack(out, axis=1)

    def over(self, n: int) -> np.ndarray:
        """What ``n`` samples do to a state: it is multiplied by this from the right."""
        if n not in self._powers:
            self._powers[n] = np.linalg.matrix_power(self.power[1], n)
        return self._powers[n]

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Output and end state of each row of ``x``, from the given states or zeros."""
        rows, n = x.shape
        state = np.zeros((rows, self.size)) if state is None else state
        y = np.empty_like(x)
        whole = n // STEP * STEP
        if whole:
            parts = x[:, :whole].reshape(rows, -1, STEP)
            pushed = parts @ self.forced[::-1]
            states = np.empty_like(pushed)
            for k in range(parts.shape[1]):
                states[:, k] = state
                state = state @ self.power[STEP] + pushed[:, k]
            y[:, :whole] = (parts @ self.response + states @ self.free).reshape(rows, -1)
        r = n - whole
        if r:
            y[:, whole:] = x[:, whole:] @ self.response[:r, :r] + state @ self.free[:, :r]
            state = state @ self.power[r] + x[:, whole:] @ self.forced[:r][::-1]
        return y, state


@lru_cache(maxsize=128)
def _state_space(raw: bytes) -> StateSpace:
    return StateSpace(np.frombuffer(raw).reshape(-1, 6))


def state_space(sections: np.ndarray) -> StateSpace:
    """The system of these sections, worked out once in a process."""
    return _state_space(np.ascontiguousarray(sections, dtype=np.float64).tobytes())


def edge_of(sections: np.ndarray) -> int:
    """Samples by which both ends are extended: three times the filter's taps."""
    return 3 * int(2 * len(sections) + 1 - min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum()))


def filtfilt(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering with odd extension at both ends (three times the filter's taps)."""
    x = np.atleast_2d(np.asarray(x, dtype=np.float64))
    edge, system = min(edge_of(sections), x.shape[1] - 1), state_space(sections)
    long = np.concatenate([2 * x[:, :1] - x[:, edge:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]], axis=1)
    there = system.run(long, system.steady(long[:, 0]))[0][:, ::-1]
    back = system.run(there, system.steady(there[:, 0]))[0][:, ::-1]
    return back[:, edge : edge + x.shape[1]]


def bandpass(x: np.ndarray, low: float, high: float, sfreq: float, order: int = 3) -> np.ndarray:
    return filtfilt(butter_bandpass(low, high, sfreq, order), x)


def notch_comb(x: np.ndarray, base: float, sfreq: float, top: float | None = None, quality: float = 30.0) -> np.ndarray:
    """Notches at ``base`` and its multiples below ``top`` (half the rate by default)."""
    limit = sfreq / 2 if top is None else min(sfreq / 2, top)
    for f in np.arange(base, limit, base):
        x = filtfilt(notch(f, sfreq, quality), x)
    return np.atleast_2d(x)


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal: negative frequencies off, positive ones doubled."""
    x = np.atleast_2d(np.asarray(x, dtype=np.float64))
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1)


def welch(x: np.ndarray, sfreq: float, segment: int, overlap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided power density): Hann window, means taken off each segment."""
    x = np.atleast_2d(np.asarray(x, dtype=np.float64))
    segment = min(segment, x.shape[1])
    step = segment - (segment // 2 if overlap is None else min(overlap, segment - 1))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    parts = np.lib.stride_tricks.sliding_window_view(x, segment, axis=1)[:, ::step]
    parts = (parts - parts.mean(axis=2, keepdims=True)) * window
    power = (np.abs(np.fft.rfft(parts, axis=2)) ** 2).mean(axis=1) / (sfreq * (window**2).sum())
    power[:, 1 : -1 if segment % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(segment, 1 / sfreq), power


def band_area(freqs: np.ndarray, power: np.ndarray, low: float, high: float) -> np.ndarray:
    """Trapezoid area over low <= f < high."""
    own = (freqs >= low) & (freqs < high)
    return np.trapezoid(power[:, own], freqs[own], axis=1)


def find_peaks(x: np.ndarray, height: float | None = None, distance: float | None = None) -> np.ndarray:
    """Local maxima of one channel (the middle of a plateau), those below ``height`` dropped, then the highest first within ``distance``."""
    x = np.asarray(x, dtype=np.float64)
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    ends = np.append(starts[1:], len(x)) - 1
    level = x[starts]
    top = np.zeros(len(starts), dtype=bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    peaks = (starts[top] + ends[top]) // 2
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is None or not len(peaks):
        return peaks
    gap = int(np.ceil(distance))
    keep = np.ones(len(peaks), dtype=bool)
    for k in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(peaks - peaks[k]) < gap
            near[k] = False
            keep &= ~near
    return peaks[keep]


def lowpass_taps(count: int, cutoff: float, window: np.ndarray) -> np.ndarray:
    """Windowed-sinc taps with unit gain at zero frequency; cutoff as a share of half the rate."""
    t = np.arange(count) - (count - 1) / 2
    taps = cutoff * np.sinc(cutoff * t) * window
    return taps / taps.sum()


def resample(x: np.ndarray, up: int, down: int, taps: np.ndarray | None = None) -> np.ndarray:
    """Polyphase resampling by up/down with a zero-phase anti-alias filter (Kaiser window, beta 5)."""
    x = np.atleast_2d(np.asarray(x, dtype=np.float64))
    common = int(np.gcd(up, down))
    up, down = up // common, down // common
    if up == down:
        return x.copy()
    if taps is None:
        half = 10 * max(up, down)
        taps = lowpass_taps(2 * half + 1, 1.0 / max(up, down), np.kaiser(2 * half + 1, 5.0))
    half = (len(taps) - 1) // 2
    out = -(-x.shape[1] * up // down)
    stuffed = np.zeros((x.shape[0], x.shape[1] * up))
    stuffed[:, ::up] = x
    full = np.array([np.convolve(row, taps * up) for row in stuffed])
    return full[:, half : half + out * down : down][:, :out]


def decimate(x: np.ndarray, factor: int) -> np.ndarray:
    """Keep every ``factor``-th sample behind a zero-phase FIR filter of 20 * factor + 1 Hamming-windowed taps."""
    count = 20 * factor + 1
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(count) / (count - 1))
    return resample(x, 1, factor, lowpass_taps(count, 1.0 / factor, window))


def zscore(x: np.ndarray) -> np.ndarray:
    x = np.atleast_2d(np.asarray(x, dtype=np.float64))
    return (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, keepdims=True) + 1e-12)


def robust_z(x: np.ndarray) -> np.ndarray:
    """(x - median) / (1.4826 MAD + 1e-12); the standard deviation where the MAD is 0."""
    x = np.atleast_2d(np.asarray(x, dtype=np.float64))
    away = x - np.median(x, axis=1, keepdims=True)
    mad = 1.4826 * np.median(np.abs(away), axis=1, keepdims=True)
    return away / (np.where(mad == 0, x.std(axis=1, keepdims=True), mad) + 1e-12)


def clean_trace(x: np.ndarray, sfreq: float, line: float = 60.0) -> np.ndarray | None:
    """One channel without its line and line noise, or None where a value isn't finite or nothing varies."""
    x = np.asarray(x, dtype=np.float64)
    if not len(x) or not np.isfinite(x).all() or x.std() < 1e-12:
        return None
    return filtfilt(notch(line, sfreq), detrend(x))[0] if line < sfreq / 2 else detrend(x)[0]


BINS = 18


def phase_bins(phase: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Left-closed bins of [-pi, pi]; pi itself is in the last one."""
    return np.minimum(bins - 1, np.floor((phase + np.pi) / (2 * np.pi / bins))).astype(np.int64)


def phase_curve(bins_of: np.ndarray, amplitude: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Mean amplitude by bin in one pass; 0 for an empty bin."""
    count = np.bincount(bins_of, minlength=bins)
    return np.bincount(bins_of, weights=amplitude, minlength=bins) / np.maximum(count, 1)


def modulation_index(curve: np.ndarray) -> float:
    """Divergence of the curve from a flat one, 0 to 1; NaN for a curve without mass."""
    total = curve.sum()
    if not total > 0:
        return float("nan")
    p = np.maximum(curve / total, 1e-12)
    return float((np.log(len(p)) + (p * np.log(p)).sum()) / np.log(len(p)))


def hashed_shifts(name: str, n: int, count: int) -> np.ndarray:
    """``count`` shifts of 10 to 90 % of ``n``, drawn from a digest of the name and the shift's number."""
    low = int(0.1 * n)
    high = max(int(0.9 * n), low + 1)
    u = np.array([int(hashlib.md5(f"{name}|{k}".encode(), usedforsecurity=False).hexdigest()[:8], 16) for k in range(count)])
    return low + np.floor((u + 0.5) / 2**32 * (high - low)).astype(np.int64)


def hashed_numbers(name: str, count: int) -> np.ndarray:
    """``count`` numbers from 0 to 1, four from each digest of the name and a number."""
    digests = "".join(hashlib.md5(f"{name}|{k}".encode(), usedforsecurity=False).hexdigest() for k in range(-(-count // 4)))
    return (np.frombuffer(bytes.fromhex(digests), dtype=">u4")[:count] + 0.5) / 2**32


def shifted_curves(bins_of: np.ndarray, amplitude: np.ndarray, shifts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """``phase_curve`` for each circular shift of the amplitude: all shifts at once, by the correlation of each bin's places with it."""
    n = len(amplitude)
    places = np.zeros((bins, n))
    places[bins_of, np.arange(n)] = 1.0
    sums = np.fft.irfft(np.fft.rfft(places, axis=1) * np.fft.rfft(amplitude).conj(), n, axis=1)
    return sums[:, shifts % n].T / np.maximum(places.sum(axis=1), 1)


def modulation_z(bins_of: np.ndarray, amplitude: np.ndarray, shifts: np.ndarray) -> tuple[float, float, int]:
    """(index, its z among circular shifts of the amplitude, preferred bin)."""
    curve = phase_curve(bins_of, amplitude)
    value = modulation_index(curve)
    null = np.array([modulation_index(c) for c in shifted_curves(bins_of, amplitude, shifts)])
    return value, float((value - null.mean()) / (null.std() + 1e-12)), int(curve.argmax())


def aligned_curve(bins_of: np.ndarray, amplitude: np.ndarray, half: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """Curve of the odd blocks, turned so that the even blocks' best bin is in the middle, without its mean."""
    a, b = half == 0, half == 1
    if not a.any() or not b.any():
        return None
    best = int(phase_curve(bins_of[a], amplitude[a], bins).argmax())
    turned = np.roll(phase_curve(bins_of[b], amplitude[b], bins), bins // 2 - best)
    return turned - turned.mean()


def epochs(x: np.ndarray, events: np.ndarray, half: int, strict: bool = True) -> np.ndarray:
    """[event, 2 * half] windows around the events inside the signal; strict leaves out one that starts at its first sample."""
    low = events > half if strict else events >= half
    own = events[low & (events < len(x) - half)]
    return x[own[:, None] + np.arange(-half, half)] if len(own) else np.zeros((0, 2 * half))
