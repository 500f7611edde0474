"""Voice quality on made signals whose pitch, jitter, shimmer and harmonicity are known."""

import numpy as np
import pytest

from tessitura.features import dsp

RATE = 16000


def tone(f0, seconds=1.0, harmonics=(1.0, 0.5, 0.3), rate=RATE):
    t = np.arange(int(seconds * rate)) / rate
    return sum(a * np.sin(2 * np.pi * f0 * (k + 1) * t + k) for k, a in enumerate(harmonics))


def train(periods, heights, rate=RATE, width=0.0004):
    """Bumps of the given heights, so far apart (seconds)."""
    at = 0.02 + np.concatenate([[0], np.cumsum(periods)])
    t = np.arange(int((at[-1] + 0.02) * rate)) / rate
    out = np.zeros(len(t))
    for m, h in zip(at, heights):
        out += h * np.exp(-(((t - m) / width) ** 2))
    return out


@pytest.mark.parametrize("f0", [80, 123.4, 200, 310, 480])
@pytest.mark.parametrize("harmonics", [(1.0, 0.5, 0.3), (0.2, 1.0, 0.2), (0.3, 0.2, 1.0)])
def test_pitch_of_tones(f0, harmonics):
    """Also where the second or third harmonic is the loudest."""
    f = dsp.voice_quality(tone(f0, harmonics=harmonics), RATE)
    assert f["glottal_f0_mean"] == pytest.approx(f0, rel=0.005) and f["glottal_f0_std"] < 0.01 * f0
    assert f["glottal_f0_voiced_ratio"] == 1 and f["glottal_jitter_local"] < 0.002 and f["glottal_shimmer_local"] < 0.01 and f["glottal_hnr_mean"] > 20


def test_path_avoids_octave_errors():
    """Every other period is weaker in some frames: single frames prefer the octave below, the path does not follow."""
    x = tone(220, 1.2)
    n = len(x)
    period = RATE / 220
    weak = np.where((np.arange(n) / period).astype(int) % 2, 0.72, 1.0)
    middle = (np.arange(n) > 0.5 * n) & (np.arange(n) < 0.56 * n)
    _, f0, _ = dsp.pitch_path(np.where(middle, weak * x, x), RATE)
    assert np.abs(f0 / 220 - 1).max() < 0.03


def test_glide_is_followed():
    t = np.arange(RATE) / RATE
    x = np.sin(2 * np.pi * (120 * t + 40 * t * t))  # 120 to 200 Hz
    times, f0, _ = dsp.pitch_path(x, RATE)
    assert (f0 > 0).all() and np.abs(f0 / (120 + 80 * times) - 1).max() < 0.02


def test_jitter_and_shimmer_of_pulse_trains():
    rng = np.random.default_rng(0)
    for spread in (0.0, 0.01, 0.03):
        periods = 0.007 * (1 + spread * rng.uniform(-1, 1, 150))
        want = np.abs(np.diff(periods)).mean() / periods.mean()
        f = dsp.voice_quality(train(periods, np.ones(151)), RATE)
        assert f["glottal_jitter_local"] == pytest.approx(want, rel=0.15, abs=0.001)
    for spread in (0.0, 0.05, 0.15):
        heights = 1 + spread * rng.uniform(-1, 1, 151)
        want = np.abs(np.diff(heights)).mean() / heights.mean()
        f = dsp.voice_quality(train(np.full(150, 0.007), heights), RATE)
        assert f["glottal_shimmer_local"] == pytest.approx(want, rel=0.15, abs=0.005)


@pytest.mark.parametrize("ratio", [5, 10, 20])
def test_harmonicity_is_the_ratio_of_tone_and_noise(ratio):
    x = tone(150, 2.0)
    noise = np.random.default_rng(1).normal(0, 1, len(x))
    noise *= np.sqrt((x * x).mean() / (noise * noise).mean() / 10 ** (ratio / 10))
    assert dsp.voice_quality(x + noise, RATE)["glottal_hnr_mean"] == pytest.approx(ratio, abs=2)


def test_silence_and_noise_have_no_pitch():
    x = tone(150, 1.0)
    f = dsp.voice_quality(np.concatenate([x, np.zeros(RATE)]), RATE)
    assert f["glottal_f0_voiced_ratio"] == pytest.approx(0.5, abs=0.05) and f["glottal_f0_mean"] == pytest.approx(150, rel=0.02)
    noise = dsp.voice_quality(np.random.default_rng(2).normal(0, 1, RATE), RATE)
    assert not noise["glottal_f0_voiced_ratio"] > 0.2
    for odd in (np.zeros(0), np.zeros(RATE), np.ones(RATE), np.ones(10)):
        assert all(np.isnan(v) for v in dsp.voice_quality(odd, RATE).values())
