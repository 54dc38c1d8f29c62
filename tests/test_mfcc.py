"""Cepstral coefficients against a plain restatement of their definition, and against values by hand."""

import cmath
import math

import numpy as np

from vocaris.sources import audio


def plain(samples, rate, size, shift, bands, low, high):
    n, hop = int(size * rate), int(shift * rate)
    fft = 1
    while fft < n:
        fft *= 2
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(low) + (mel(high) - mel(low)) * k / (bands + 1)) / 2595) - 1) for k in range(bands + 2)]
    out = []
    for start in range(0, len(samples) - n + 1, hop):
        frame = [samples[start + k] * (0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1))) for k in range(n)]
        power = [abs(sum(x * cmath.exp(-2j * math.pi * b * k / fft) for k, x in enumerate(frame))) ** 2 for b in range(fft // 2 + 1)]
        logs = []
        for m in range(bands):
            a, b, c = edges[m : m + 3]
            logs.append(math.log(sum(p * max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for f, p in ((k * rate / fft, p) for k, p in enumerate(power))) + 1e-10))
        out.append([math.sqrt(2 / bands) * sum(v * math.cos(math.pi * (m + 0.5) * k / bands) for m, v in enumerate(logs)) for k in range(bands)])
    return out


def test_coefficients_equal_their_definition():
    rnd = np.random.default_rng(1)
    x = np.round(1000 * np.sin(np.arange(160) * 0.4) + 50 * rnd.normal(size=160))
    got = audio.mfcc(x, rate=4000, size=0.016, shift=0.008, bands=8, low=50.0, high=1900.0)
    assert np.allclose(got, plain(x.tolist(), 4000, 0.016, 0.008, 8, 50.0, 1900.0), atol=1e-6)
    assert got.shape == (4, 8)


def test_silence_and_short_sounds_by_hand():
    # every band's logarithm is log(1e-10): only the coefficient of the constant is left
    got = audio.mfcc(np.zeros(480))
    assert got.shape == (1, 30) and math.isclose(got[0, 0], math.sqrt(2 / 30) * 30 * math.log(1e-10), rel_tol=1e-12)
    assert np.allclose(got[0, 1:], 0, atol=1e-9)
    assert audio.mfcc(np.zeros(479)).shape == (0, 30)
    # louder by a factor moves the constant alone
    x = np.random.default_rng(2).normal(size=2000) * 1000
    a, b = audio.mfcc(x), audio.mfcc(10 * x)
    assert np.allclose((b - a)[:, 0], math.sqrt(2 / 30) * 30 * math.log(100)) and np.allclose((b - a)[:, 1:], 0, atol=1e-9)
