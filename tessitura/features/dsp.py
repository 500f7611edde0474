"""Signal processing in numpy, from published definitions.

Features that need spectra, filters or pitch have no built-in expression in Spark and run per record
in Arrow batches.  Values are close to, not bit-equal with, those of dedicated audio libraries.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import lru_cache
from math import gcd

import numpy as np


def kaiser_lowpass(half: int, cutoff: float, beta: float = 5.0) -> np.ndarray:
    """Windowed-sinc low-pass of 2 * half + 1 taps; cutoff as a share of the Nyquist frequency; unit gain."""
    n = np.arange(-half, half + 1)
    h = cutoff * np.sinc(cutoff * n) * np.kaiser(2 * half + 1, beta)
    return h / h.sum()


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase resampling by the reduced ratio of the rates."""
    if rate <= 0 or target <= 0:
        raise ValueError("sample rates must be positive")
    g = gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return np.asarray(x, np.float32)
    half = 10 * max(up, down)
    h = kaiser_lowpass(half, 1 / max(up, down)) * up
    n_out = -(-len(x) * up // down)
    out = np.zeros(n_out)
    x = np.asarray(x, np.float64)
    # Output k takes input samples i with |k * down - i * up| <= half; a block of outputs at a time.
    for lo in range(0, n_out, 4096):
        at = np.arange(lo, min(lo + 4096, n_out)) * down
        first = -(-(at - half) // up)
        i = first[:, None] + np.arange(2 * half // up + 1)
        tap = at[:, None] - i * up + half
        good = (i >= 0) & (i < len(x)) & (tap >= 0) & (tap <= 2 * half)
        out[lo : lo + len(at)] = np.where(good, h[np.clip(tap, 0, 2 * half)] * x[np.clip(i, 0, len(x) - 1)], 0).sum(axis=1)
    return out.astype(np.float32)


def preprocess(x: np.ndarray, rate: int, target: int = 16000, dbfs: float = -20.0, limit: float = 0.99, crop: float | None = None, pad: bool = False) -> tuple[np.ndarray, int]:
    """Mono, centred, resampled, brought to a level, perhaps cropped; float32."""
    x = np.asarray(x)
    if rate <= 0:
        raise ValueError("sample rate must be positive")
    if x.size == 0:
        raise ValueError("empty audio signal")
    if x.ndim not in (1, 2):
        raise ValueError("unsupported audio shape")
    if not np.isfinite(x).all():
        raise ValueError("non-finite samples")
    if x.ndim == 2:
        x = x.mean(axis=1, dtype=np.float64)
    x = x - x.mean()
    if rate != target:
        x, rate = resample(x, rate, target), target
    level = float(np.sqrt(np.mean(np.square(x, dtype=np.float64))))
    if level >= 1e-12:
        x = x * (10 ** (dbfs / 20) / level)
        top = float(np.abs(x).max())
        if top > limit:
            x = x * (limit / top)
    if crop is not None:
        n, t = len(x), int(crop * rate)
        if n > t:
            x = x[(n - t) // 2 :][:t]
        elif pad and n < t:
            x = np.pad(x, ((t - n) // 2, t - n - (t - n) // 2))
    if not len(x) or not np.isfinite(x).all():
        raise ValueError("unusable processed signal")
    return x.astype(np.float32), rate


def stft(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """Centred short-time spectrum with a periodic Hann window: (bins, frames)."""
    x = np.pad(np.asarray(x, np.float64), n_fft // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    return np.fft.rfft(frames * window, axis=1).T


def istft(spectrum: np.ndarray, n_fft: int, hop: int, length: int) -> np.ndarray:
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    frames = np.fft.irfft(spectrum.T, n_fft, axis=1) * window
    n = n_fft + hop * (len(frames) - 1)
    out, weight = np.zeros(n), np.zeros(n)
    for i, f in enumerate(frames):
        out[i * hop : i * hop + n_fft] += f
        weight[i * hop : i * hop + n_fft] += window * window
    out /= np.maximum(weight, 1e-10)
    return out[n_fft // 2 :][:length]


#: Values of windows that a median filter copies at a time.
FILTER_VALUES = 1 << 20


def median_filter(a: np.ndarray, size: int, axis: int) -> np.ndarray:
    width = [(0, 0)] * a.ndim
    width[axis] = (size // 2, size // 2)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(a, width, mode="symmetric"), size, axis=axis)
    if size % 2 == 0:
        return np.median(view, axis=-1)
    out, high = np.empty(a.shape), max(1, FILTER_VALUES // (size * max(1, a[0].size)))
    for lo in range(0, len(a), high):  # the windows of a long signal are copied a few rows at a time
        out[lo : lo + high] = np.partition(view[lo : lo + high], size // 2, axis=-1)[..., size // 2]
    return out


def harmonic_part(x: np.ndarray, n_fft: int = 2048, hop: int = 512, kernel: int = 31) -> np.ndarray:
    """The harmonic component by median filtering of the spectrogram and a soft mask (Fitzgerald 2010)."""
    s = stft(x, n_fft, hop)
    m = np.abs(s)
    along_time, along_frequency = median_filter(m, kernel, 1) ** 2, median_filter(m, kernel, 0) ** 2
    total = along_time + along_frequency
    mask = np.where(total > 1e-20, along_time / np.maximum(total, 1e-20), 0.5)
    return istft(s * mask, n_fft, hop, len(x))


def harmonics(x: np.ndarray, rate: int, n_fft: int = 1024, hop: int = 128, top: int = 30, least: float = 50.0, most: float | None = None) -> dict[str, float]:
    """The strongest bins of the harmonic part's mean spectrum in order of frequency, and their means and deviations."""
    out = {f"harmonic_{i:02d}_{k}": np.nan for i in range(1, top + 1) for k in ("freq", "amp")}
    f = a = np.zeros(0)
    if len(x):
        a = np.abs(stft(harmonic_part(x), n_fft, hop)).mean(axis=1)
        f = np.fft.rfftfreq(n_fft, 1 / rate)
        held = (f >= least) & (f <= (np.inf if most is None else most))
        f, a = f[held], a[held]
        best = np.sort(np.argsort(-a, kind="stable")[:top])
        f, a = f[best], a[best]
    for i, (x1, x2) in enumerate(zip(f, a), 1):
        out[f"harmonic_{i:02d}_freq"], out[f"harmonic_{i:02d}_amp"] = float(x1), float(x2)
    for k, v in (("freq", f), ("amp", a)):
        out[f"harmonic_{k}_mean"] = float(v.mean()) if len(v) else np.nan
        out[f"harmonic_{k}_std"] = float(v.std()) if len(v) else np.nan
    return out


@lru_cache(maxsize=16)
def mel_filters(rate: int, n_fft: int, n_mels: int = 128) -> np.ndarray:
    """Triangular filters on the Slaney mel scale, scaled to equal area."""

    def to_mel(f):
        return np.where(f < 1000, 3 * f / 200, 15 + 27 * np.log(np.maximum(f, 1e-9) / 1000) / np.log(6.4))

    def to_hz(m):
        return np.where(m < 15, 200 * m / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))

    edges = to_hz(np.linspace(0, to_mel(np.array(rate / 2)), n_mels + 2))
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    slope = edges[:, None] - f[None]
    width = np.diff(edges)
    low, high = -slope[:-2] / width[:-1, None], slope[2:] / width[1:, None]
    return np.maximum(0, np.minimum(low, high)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc(x: np.ndarray, rate: int, n: int = 30, n_fft: int = 1024, hop: int = 128) -> np.ndarray:
    power = np.abs(stft(x, n_fft, hop)) ** 2
    mel = mel_filters(rate, n_fft) @ power
    db = 10 * np.log10(np.maximum(mel, 1e-10))
    db = np.maximum(db, db.max() - 80)
    return cosines(n, len(db)) @ db


@lru_cache(maxsize=16)
def cosines(n: int, wide: int) -> np.ndarray:
    """The first n rows of the orthonormal cosine transform."""
    basis = np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(wide) + 1) / (2 * wide)) * np.sqrt(2 / wide)
    basis[0] /= np.sqrt(2)
    return basis


def delta(a: np.ndarray, order: int = 1, width: int = 9) -> np.ndarray:
    """Local derivative by a least-squares polynomial; at the ends the polynomial of the first or last window."""
    width = min(width, a.shape[1] - (a.shape[1] + 1) % 2)
    half = width // 2
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True).astype(float))
    factor = float(np.prod(np.arange(1, order + 1)))
    view = np.lib.stride_tricks.sliding_window_view(a, width, axis=1)
    middle = view @ fit[order] * factor
    # The order-th derivative of a polynomial of that order is constant, so the ends repeat it.
    return np.concatenate([np.repeat(middle[:, :1], half, axis=1), middle, np.repeat(middle[:, -1:], half, axis=1)], axis=1)


def mfcc_statistics(x: np.ndarray, rate: int, n: int = 30, n_fft: int = 1024, hop: int = 128, deltas: bool = True, emphasis: float = 0.97) -> dict[str, float]:
    """mean, std, min, max, median of each coefficient, and of first and second deltas with 3 frames or more."""
    if not len(x):
        return {}
    x = np.asarray(x, np.float64)
    m = mfcc(np.append(x[0], x[1:] - emphasis * x[:-1]), rate, n, n_fft, hop)
    parts = {"mfcc": m}
    if deltas and m.shape[1] >= 3:
        parts |= {"mfcc_delta": delta(m), "mfcc_delta2": delta(m, 2)}
    how = {"mean": np.mean, "std": np.std, "min": np.min, "max": np.max, "median": np.median}
    each = {(p, k): f(np.ascontiguousarray(a), axis=1).tolist() for p, a in parts.items() for k, f in how.items()}
    return {f"{p}_{i + 1:02d}_{k}": each[p, k][i] for p, a in parts.items() for i in range(len(a)) for k in how}


VOICE = ("f0_mean", "f0_std", "f0_min", "f0_max", "f0_voiced_ratio", "hnr_mean", "hnr_std", "jitter_local", "shimmer_local")


# Costs of a pitch path as published (Boersma 1993): an octave down, an octave's jump, a change of voicing; what is silent, what is voiced.
OCTAVE, JUMP, VOICING, SILENCE, VOICED = 0.01, 0.35, 0.14, 0.03, 0.45
#: Pitch candidates of a frame.
CANDIDATES = 14


def pitch_path(x: np.ndarray, rate: int, low: float = 75.0, high: float = 600.0, step: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time, pitch (0: unvoiced) and autocorrelation of each frame: the cheapest path over the candidates of all frames.

    Candidates are the peaks of the autocorrelation, divided by that of the window, and one for no voice.  The path gains
    their strengths and pays for jumps in octaves and for changes of voicing.
    """
    n = int(3 / low * rate)
    window, hop = np.hanning(n), max(1, int(step * rate))
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[::hop]
    frames = frames - frames.mean(axis=1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()

    def correlate(f):
        r = np.fft.irfft(np.abs(np.fft.rfft(f, size, axis=-1)) ** 2, axis=-1)[..., :n]
        return r / np.maximum(r[..., :1], 1e-20)

    own = np.maximum(correlate(window), 1e-3)
    lags = np.arange(max(1, int(rate / high)), min(int(rate / low), n // 2) + 1)
    some = max(1, FILTER_VALUES // size)
    r = np.concatenate([(correlate(frames[i : i + some] * window) / own)[:, : lags[-1] + 2] for i in range(0, len(frames), some)])
    y0, y1, y2 = r[:, lags - 1], r[:, lags], r[:, lags + 1]
    bend = np.minimum(y0 - 2 * y1 + y2, -1e-12)
    shift = np.clip(0.5 * (y0 - y2) / bend, -0.5, 0.5)
    height, at = y1 - 0.25 * (y0 - y2) * shift, lags + shift
    height = np.where(height > 1, 1 / np.where(height > 1, height, 1), height)  # noise of short lags
    gain = np.where((y1 > y0) & (y1 >= y2) & (y1 > 0), height - OCTAVE * np.log2(low * at / rate), -np.inf)
    best = np.argsort(-gain, axis=1, kind="stable")[:, :CANDIDATES]
    rows = np.arange(len(r))[:, None]
    loud = np.abs(frames).max(axis=1) / max(np.abs(x - x.mean()).max(), 1e-20)
    quiet = VOICED + np.maximum(0, 2 - loud / (SILENCE / (1 + VOICED)))
    gain = np.hstack([quiet[:, None], gain[rows, best]])
    pitch = np.hstack([np.zeros((len(r), 1)), rate / at[rows, best]])
    octaves = np.log2(np.maximum(pitch, 1e-9))
    scale = 0.01 * rate / hop  # costs are for steps of a hundredth of a second
    total, back = gain[0], []
    for t in range(1, len(r)):
        before, now = pitch[t - 1] > 0, pitch[t] > 0
        cost = np.where(before[:, None] & now, JUMP * np.abs(octaves[t - 1][:, None] - octaves[t]), np.where(before[:, None] != now, VOICING, 0.0))
        reached = total[:, None] - scale * cost
        back.append(reached.argmax(axis=0))
        total = reached.max(axis=0) + gain[t]
    chosen = [int(total.argmax())]
    for b in reversed(back):
        chosen.append(int(b[chosen[-1]]))
    chosen = np.array(chosen[::-1])
    which = np.arange(len(r))
    strength = np.hstack([np.zeros((len(r), 1)), height[rows, best]])[which, chosen]
    return (which * hop + n / 2) / rate, pitch[which, chosen], strength


def pulses(x: np.ndarray, rate: int, times: np.ndarray, f0: np.ndarray, least: float = 0.3) -> list[np.ndarray]:
    """Places (in samples, with fractions) of the pulses of each voiced stretch.

    From the highest sample of the period in the stretch's middle one goes on, both ways, to where a period's wave is most
    like the last one, by cross-correlation at lags of 0.8 to 1.25 periods, until none is like it or the stretch ends.
    """
    voiced = np.flatnonzero(f0 > 0)
    out = []
    for part in np.split(voiced, np.flatnonzero(np.diff(voiced) > 1) + 1):
        if not len(part):
            continue
        half = (times[1] - times[0]) / 2 if len(times) > 1 else 1.5 / f0[part[0]]
        lo, hi = (times[part[0]] - half) * rate, (times[part[-1]] + half) * rate

        def period(m):
            return rate / np.interp(m / rate, times[part], f0[part])

        mid = (lo + hi) / 2
        a = max(0, int(mid - period(mid) / 2))
        b = max(a + 1, int(mid + period(mid) / 2))
        marks = [float(a + np.argmax(np.abs(x[a:b])))]
        for way in (1, -1):
            m = marks[0]
            while True:
                p = period(m)
                w, base = max(2, int(round(p))), int(round(m - p / 2))
                lags = np.arange(max(1, int(0.8 * p)) - 1, int(np.ceil(1.25 * p)) + 2)
                start = base + way * lags
                if base < 0 or base + w > len(x) or start.min() < 0 or start.max() + w > len(x):
                    break
                other = np.lib.stride_tricks.sliding_window_view(x, w)[start]
                own = x[base : base + w]
                c = other @ own / np.maximum(np.sqrt((other * other).sum(axis=1) * (own @ own)), 1e-20)
                k = 1 + int(np.argmax(c[1:-1]))
                bend = c[k - 1] - 2 * c[k] + c[k + 1]
                lag = lags[k] + (np.clip(0.5 * (c[k - 1] - c[k + 1]) / bend, -0.5, 0.5) if bend < -1e-12 else 0.0)
                m += way * lag
                if c[k] < least or not lo <= m <= hi:
                    break
                marks.append(float(m))
        out.append(np.sort(marks))
    return out


def _loudness(x: np.ndarray, m: float, reach: float) -> float:
    """Root of the mean square around m under a Hann window that reaches so far on each side."""
    at = np.arange(max(0, int(np.ceil(m - reach))), min(len(x), int(m + reach) + 1))
    w = 0.5 + 0.5 * np.cos(np.pi * (at - m) / max(reach, 1e-9))
    return float(np.sqrt((w * x[at] ** 2).sum() / w.sum())) if w.sum() > 0 else np.nan


def jitter_and_shimmer(x: np.ndarray, rate: int, marks: list[np.ndarray], shortest: float = 0.0001, longest: float = 0.02) -> tuple[float, float]:
    """Mean difference of neighbouring periods by the mean period, and of their amplitudes by the mean amplitude.

    Periods outside the limits, or that differ by more than a factor of 1.3 (amplitudes 1.6), do not count.
    """
    periods, amplitudes, d_period, d_amplitude = [], [], [], []
    for m in marks:
        t = np.diff(m) / rate
        good = (t >= shortest) & (t <= longest)
        pair = good[1:] & good[:-1]
        pair &= np.maximum(t[1:], t[:-1]) <= 1.3 * np.minimum(t[1:], t[:-1])
        periods += list(t[good])
        d_period += list(np.abs(np.diff(t))[pair])
        a = np.array([_loudness(x, p, 0.2 * rate * q) for p, q in zip(m[1:], t)])
        near = pair & (np.maximum(a[1:], a[:-1]) <= 1.6 * np.minimum(a[1:], a[:-1]))
        amplitudes += list(a[good])
        d_amplitude += list(np.abs(np.diff(a))[near])
    jitter = float(np.mean(d_period) / np.mean(periods)) if d_period else np.nan
    shimmer = float(np.mean(d_amplitude) / np.mean(amplitudes)) if d_amplitude and np.mean(amplitudes) > 0 else np.nan
    return jitter, shimmer


def voice_quality(x: np.ndarray, rate: int, low: float = 75.0, high: float = 600.0, step: float = 0.01) -> dict[str, float]:
    """Pitch and harmonicity along a pitch path; jitter and shimmer from pulses.

    What can't be computed stays NaN, and what was computed before a failure is kept.
    """
    out = {f"glottal_{k}": np.nan for k in VOICE}
    x = np.asarray(x, np.float64)
    if x.size == 0 or len(x) < int(3 / low * rate) or not np.ptp(x) > 0:
        return out
    try:
        times, path, strength = pitch_path(x, rate, low, high, step)
        good = path > 0
        if good.any():
            f0 = path[good]
            out |= {"glottal_f0_mean": float(f0.mean()), "glottal_f0_std": float(f0.std()), "glottal_f0_min": float(f0.min()), "glottal_f0_max": float(f0.max()), "glottal_f0_voiced_ratio": float(good.mean())}
            r = np.clip(strength[good], 1e-6, 1 - 1e-6)
            hnr = 10 * np.log10(r / (1 - r))
            out |= {"glottal_hnr_mean": float(hnr.mean()), "glottal_hnr_std": float(hnr.std())}
            out["glottal_jitter_local"], out["glottal_shimmer_local"] = jitter_and_shimmer(x, rate, pulses(x, rate, times, path))
    except (ValueError, IndexError, FloatingPointError):
        pass
    return out


# ------------------------------------------------------------------ features that also exist as column expressions


def energy_positions(x: np.ndarray, step: int = 10) -> np.ndarray:
    shares = np.arange(step, 100, step) / 100
    if not len(x):
        return np.full(len(shares), np.nan)
    run = np.cumsum(np.square(np.asarray(x, np.float64)))
    return np.searchsorted(run, shares * run[-1]) / max(len(x) - 1, 1) if run[-1] > 0 else np.zeros(len(shares))


def entropy(x: np.ndarray, bins: int = 64) -> float:
    if not len(x):
        return np.nan
    if (np.abs(x - x[0]) <= 1e-8 + 1e-5 * abs(x[0])).all():
        return 0.0
    n = equal_bins(x, bins)
    p = n[n > 0] / len(x)
    return float(-(p * np.log2(p)).sum())


def equal_bins(x: np.ndarray, bins: int) -> np.ndarray:
    """The counts of np.histogram for finite samples that are not all equal, without its checks."""
    lo, hi = x.min(), x.max()
    edges = np.linspace(lo, hi, bins + 1)
    at = np.minimum(((x - lo) / (hi - lo) * bins).astype(np.intp), bins - 1)
    at -= x < edges[at]
    at += (x >= edges[at + 1]) & (at < bins - 1)
    return np.bincount(at, minlength=bins)


def partitioned_entropy(x: np.ndarray, partitions=(2, 3, 5, 7, 11, 13, 17), bins: int = 64) -> np.ndarray:
    if not len(x):
        return np.full(sum(partitions), np.nan)
    out = []
    for k in partitions:
        e = np.array([entropy(p, bins) for p in np.array_split(x, k)])
        top = np.nanmax(e) if np.isfinite(e).any() else 0
        out.append(e / top if top > 0 else e)
    return np.concatenate(out)


def crossings(x: np.ndarray) -> np.ndarray:
    return np.diff(np.signbit(x).astype(int)) != 0


def crossing_positions(x: np.ndarray, step: int = 20) -> np.ndarray:
    shares = np.arange(step, 100, step) / 100
    flips = crossings(np.asarray(x, np.float64) - np.mean(x)) if len(x) > 1 else np.zeros(0)
    run = np.cumsum(flips)
    return np.searchsorted(run, shares * run[-1]) / max(len(x) - 1, 1) if len(run) and run[-1] > 0 else np.zeros(len(shares))


#: The families of features, by the prefixes of their names.
FAMILIES = ("harmonic_", "energy_", "entropy_", "zcr_", "mfcc", "glottal_")


def features(x: np.ndarray, rate: int, glottal: bool = True, families: Collection[str] = FAMILIES) -> dict[str, float]:
    """The families of one signal, all unless some are named, under the names that scenarios select by."""
    x = np.asarray(x, np.float64)
    out = harmonics(x, rate) if "harmonic_" in families else {}
    if "energy_" in families:
        out |= {f"energy_area_{10 * (i + 1):02d}": float(v) for i, v in enumerate(energy_positions(x))}
    if "entropy_" in families:
        out |= {f"entropy_c2_{i + 1:02d}": float(v) for i, v in enumerate(partitioned_entropy(x))}
    if "zcr_" in families:
        out |= {f"zcr_b3_{20 * (i + 1):02d}": float(v) for i, v in enumerate(crossing_positions(x))}
        flips = int(crossings(x).sum()) if len(x) > 1 else 0
        out |= {"zcr_total": float(flips), "zcr_rate": flips / max(len(x) - 1, 1)}
    if "mfcc" in families:
        out |= mfcc_statistics(x, rate)
    return out | voice_quality(x, rate) if glottal and "glottal_" in families else out


def feature_names(glottal: bool = True, families: Collection[str] = FAMILIES) -> list[str]:
    names = [f"harmonic_{i:02d}_{k}" for i in range(1, 31) for k in ("freq", "amp")] + [f"harmonic_{k}_{s}" for k in ("freq", "amp") for s in ("mean", "std")]
    names += [f"energy_area_{p}" for p in range(10, 100, 10)] + [f"entropy_c2_{i:02d}" for i in range(1, 59)] + [f"zcr_b3_{p}" for p in range(20, 100, 20)] + ["zcr_total", "zcr_rate"]
    names += [f"{p}_{i:02d}_{k}" for p in ("mfcc", "mfcc_delta", "mfcc_delta2") for i in range(1, 31) for k in ("mean", "std", "min", "max", "median")]
    names += [f"glottal_{k}" for k in VOICE] if glottal else []
    return [n for n in names if n.startswith(tuple(families))]
