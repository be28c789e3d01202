"""Chroma by a bank of log-spaced kernels, as many cycles long for each pitch, octave by octave on a signal of half the rate each time.

Short spectra can't tell low notes apart: at 44.1 kHz a transform of 4,096
samples has bins of 11 Hz, and two notes around 41 Hz are 2.5 Hz apart. Here
a kernel is as long as its pitch needs. One bank, that of the highest octave,
serves all octaves, as the signal is halved from one to the next.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from tessella.functions.dsp import HOP, resampled_part

#: The lowest pitch (C1), octaves from there, bins of a semitone.
LOWEST, OCTAVES, FINE = 440 * 2 ** (-45 / 12), 7, 3
BINS = 12 * FINE
#: A kernel has as many cycles as part its pitch from the next bin's.
CYCLES = 1 / (2 ** (1 / BINS) - 1)
#: Rates up to which a signal has frames, and of their highest pitches the share that the rate must be at least.
MOST_RATE, SPARE = 96_000, 2.4


def layout(rate: int) -> tuple[int, int]:
    """(by how much a signal is decimated first, octaves that its rate can hold)."""
    if rate > MOST_RATE:
        raise ValueError(f"constant-Q chroma is for rates of up to {MOST_RATE}, not {rate}")
    octaves = OCTAVES
    while octaves and rate < SPARE * LOWEST * 2**octaves:
        octaves -= 1
    first = 1
    while first < 8 and rate / (2 * first) >= SPARE * LOWEST * 2**octaves:
        first *= 2
    return first, octaves


def reach(rate: int) -> int:
    """Samples on both sides of a frame's centre that its chroma depends on."""
    first, octaves = layout(rate)
    if not octaves:
        return 0
    half = (bank(rate / first, octaves).shape[0] - 1) // 2
    filters = 50 * first * (2 ** (octaves - 1) - 1) + int(np.ceil(24 * first / 0.97))
    return half * first * 2 ** (octaves - 1) + filters + first


@cache
def bank(rate: float, octaves: int) -> np.ndarray:
    """(samples, BINS): windowed complex kernels of the octave that begins ``octaves`` - 1 octaves above the lowest pitch."""
    hz = LOWEST * 2 ** (octaves - 1 + np.arange(BINS) / BINS)
    lengths = CYCLES * rate / hz
    n = np.arange(-int(np.ceil(lengths[0] / 2)), int(np.ceil(lengths[0] / 2)) + 1)[:, None]
    window = np.where(np.abs(n) <= lengths / 2, 0.5 + 0.5 * np.cos(2 * np.pi * n / lengths), 0)
    return window * np.exp(-2j * np.pi * hz / rate * n) / np.sqrt(lengths)


def chroma(x: np.ndarray, start: int, frames: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12) from C, the highest of each frame 1, of frames HOP apart; ``x`` begins at sample ``start`` and holds ``reach`` samples around each centre."""
    first, octaves = layout(rate)
    tones = np.zeros((len(frames), 12))
    if not octaves:
        return tones
    kernels, step = bank(rate / first, octaves), first
    half = (kernels.shape[0] - 1) // 2
    low, y = -(-start // first), x[None]
    if first > 1:
        y = resampled_part(y, start, low, (start + len(x)) // first, first, 1)
    for _ in range(octaves):
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(y[0].astype(np.float64), half), 2 * half + 1)
        at = frames * HOP // step - low
        found = np.abs(windows[np.clip(at, 0, len(windows) - 1)] @ kernels)
        # A pitch class has its own bins and half of the way to its neighbours.
        tones += np.roll(found, FINE // 2, axis=1).reshape(-1, 12, FINE).sum(axis=2)
        above, low, step = low, -(-low // 2), 2 * step
        y = resampled_part(y, above, low, (above + y.shape[1]) // 2, 2, 1)
    peak = tones.max(axis=1, keepdims=True)
    return tones / np.where(peak > 0, peak, 1)
