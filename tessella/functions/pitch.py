"""Pitches of notes: by the first dip of the normalised difference, or by candidates over all thresholds and a hidden Markov model.

The model's states are pitch bins, voiced and unvoiced. Frames of many notes
are decoded in step, so a step is a few operations on arrays of all notes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bins of a semitone.
BINS = 5
#: Octaves a second that a pitch moves at most, the chance that voicing changes from one frame to the next, and the
#: share of a threshold's weight that the deepest dip gets where none is below it: values of the published method.
FASTEST, SWITCH, NO_DIP = 35.92, 0.01, 0.01
#: Notes decoded in step.
TOGETHER = 64


def differences(frames: np.ndarray, longest: int) -> np.ndarray:
    """(frames, longest - 1): the squared difference of each frame with itself 1, 2, ... samples on, over its running mean.

    From energies and a correlation by FFT; what is compared is all of a frame
    but its last ``longest`` samples.
    """
    size = frames.shape[1]
    kept, lags, found = size - longest, np.arange(1, longest), []
    for i in range(0, len(frames), 256):
        whole = frames[i : i + 256]
        n_fft = 1 << (2 * size - 1).bit_length()
        head = np.fft.rfft(whole[:, :kept], n_fft)
        same = np.fft.irfft(np.conj(head) * np.fft.rfft(whole, n_fft), n_fft)[:, 1:longest]
        energy = np.pad(np.cumsum(whole**2, axis=1), ((0, 0), (1, 0)))
        apart = np.maximum(energy[:, kept, None] + energy[:, lags + kept] - energy[:, lags] - 2 * same, 0)
        mean = np.cumsum(apart, axis=1) / lags
        found.append(np.where(mean > 1e-12 * energy[:, -1:], apart / np.where(mean > 0, mean, 1), 1.0))
    return np.concatenate(found)


def refined(dips: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The lags of dips by a parabola through three points."""
    near = np.clip(place, 1, dips.shape[1] - 2)
    left, at, right = (dips[row, near + k] for k in (-1, 0, 1))
    bend = left - 2 * at + right
    shift = np.where((near == place) & (bend > 0), 0.5 * (left - right) / np.where(bend > 0, bend, 1), 0.0)
    return place + 1 + np.clip(shift, -0.5, 0.5)


def lags_of(rate: int, low: float, high: float) -> tuple[int, int]:
    return max(2, int(rate / high)), int(rate / low)


def yin(x: np.ndarray, rate: int, low: float, high: float) -> float | None:
    """The median pitch in Hz, or None if less than 40 % of the frames have one: the first dip below 0.15, followed down to its floor.

    Frames are two longest lags long and begin every half of one.
    """
    shortest, longest = lags_of(rate, low, high)
    if longest <= shortest or len(x) < 2 * longest:
        return None
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(x, np.float64), 2 * longest)[:: max(1, longest // 2)]
    dips = differences(frames, longest)
    floor = np.ones_like(dips, bool)  # places that don't fall any more
    floor[:, :-1] = dips[:, 1:] >= dips[:, :-1]
    begun = np.maximum.accumulate((dips < 0.15) & (np.arange(1, longest) >= shortest), axis=1)
    voiced = np.flatnonzero(begun.any(axis=1))
    if len(voiced) < 0.4 * len(frames):
        return None
    return float(np.median(rate / refined(dips, voiced, (begun & floor).argmax(axis=1)[voiced])))


def below(x: np.ndarray) -> np.ndarray:
    """The weight of all thresholds up to x: a beta distribution of 2 and 18, whose mean is 0.1."""
    x = np.clip(x, 0, 1)
    return 1 - (1 - x) ** 19 - 19 * x * (1 - x) ** 18


def candidates(dips: np.ndarray, rate: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, Hz, probability) of the dips that some threshold picks.

    A threshold picks the first dip below it, so a dip has the weight of the
    thresholds between its depth and that of the deepest before it.
    """
    inner = np.zeros_like(dips, bool)
    inner[:, 1:-1] = (dips[:, 1:-1] < dips[:, :-2]) & (dips[:, 1:-1] <= dips[:, 2:])
    inner[:, : shortest - 1] = False
    depth = np.where(inner, dips, 1.0)
    deepest = np.minimum.accumulate(depth, axis=1)
    earlier = np.concatenate((np.ones((len(dips), 1)), deepest[:, :-1]), axis=1)
    weight = np.where(inner & (depth < earlier), below(earlier) - below(depth), 0.0)
    some = inner.any(axis=1)
    last = np.where(inner, depth, np.inf).argmin(axis=1)
    weight[np.flatnonzero(some), last[some]] += NO_DIP * below(deepest[some, -1])
    frame, place = np.nonzero(weight)
    return frame, rate / refined(dips, frame, place), weight[frame, place]


def _observed(dips: np.ndarray, rate: int, shortest: int, low: float, bins: int):
    """(frames, 2, bins): chances of the voiced and unvoiced bins; and the pitch of the strongest candidate of each."""
    frame, hz, weight = candidates(dips, rate, shortest)
    at = np.rint(12 * BINS * np.log2(hz / low)).astype(np.int64)
    inside = (at >= 0) & (at < bins)
    frame, hz, weight, at = frame[inside], hz[inside], weight[inside], at[inside]
    voiced = np.zeros((len(dips), bins))
    np.add.at(voiced, (frame, at), weight)
    order = np.argsort(weight, kind="stable")
    pitch = np.broadcast_to(low * 2 ** (np.arange(bins) / (12 * BINS)), voiced.shape).copy()
    pitch[frame[order], at[order]] = hz[order]
    rest = np.maximum(1 - voiced.sum(axis=1, keepdims=True), 0) / bins
    return np.stack((voiced, np.broadcast_to(rest, voiced.shape)), axis=1), pitch


def decoded(observed: Sequence[np.ndarray], reach: int) -> list[np.ndarray]:
    """The most likely states (voicing * bins + bin; voiced is 0) of each note's frames; ``reach`` is how many bins a step moves at most."""
    order = sorted(range(len(observed)), key=lambda i: -len(observed[i]))
    lengths = [len(observed[i]) for i in order]
    bins = observed[0].shape[2]
    with np.errstate(divide="ignore"):
        logs = [np.log(observed[i]) for i in order]
        triangle = reach + 1.0 - np.abs(np.arange(-reach, reach + 1))
        move = np.log(triangle / triangle.sum())
        stay, switch = np.log(1 - SWITCH), np.log(SWITCH)
    score = np.stack([x[0] for x in logs]) - np.log(2 * bins)
    back = np.zeros((lengths[0], len(order), 2, bins), np.int32)
    for t in range(1, lengths[0]):
        n = sum(size > t for size in lengths)  # notes that are still sounding come first
        padded = np.pad(score[:n], ((0, 0), (0, 0), (reach, reach)), constant_values=-np.inf)
        reached = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=2) + move[::-1]
        best = reached.argmax(axis=3)
        gain = np.take_along_axis(reached, best[..., None], axis=3)[..., 0]
        came = best + np.arange(bins) - reach
        change = gain[:, ::-1] + switch > gain + stay
        back[t, :n] = np.where(change, came[:, ::-1] + bins * np.array([1, 0])[:, None], came + bins * np.array([0, 1])[:, None])
        score[:n] = np.where(change, gain[:, ::-1] + switch, gain + stay) + np.stack([x[t] for x in logs[:n]])
    paths: list = [None] * len(order)
    for row, (i, size) in enumerate(zip(order, lengths, strict=True)):
        path = np.zeros(size, np.int64)
        path[-1] = score[row].reshape(-1).argmax()
        for t in range(size - 1, 0, -1):
            path[t - 1] = back[t, row].reshape(-1)[path[t]]
        paths[i] = path
    return paths


def pitches(notes: Sequence[np.ndarray], rate: int, low: float, high: float, frame_s: float) -> list[float | None]:
    """For each note the median pitch in Hz of its voiced frames, or None if less than 40 % of them are voiced.

    Frames of ``frame_s`` begin every quarter of one; a shorter note is one
    frame, filled up with zeros.
    """
    shortest, longest = lags_of(rate, low, high)
    size = max(int(frame_s * rate), 2 * longest)
    hop, bins = max(1, size // 4), int(12 * BINS * np.log2(high / low)) + 1
    reach = min(bins - 1, max(1, round(FASTEST * 12 * BINS * hop / rate)))
    out: list[float | None] = []
    for i in range(0, len(notes), TOGETHER):
        seen, hz = [], []
        for x in notes[i : i + TOGETHER]:
            x = np.asarray(x, np.float64)
            x = np.pad(x, (0, max(0, size - len(x))))
            dips = differences(np.lib.stride_tricks.sliding_window_view(x, size)[::hop], longest)
            chances, pitch = _observed(dips, rate, shortest, low, bins)
            seen.append(chances)
            hz.append(pitch)
        for path, pitch in zip(decoded(seen, reach), hz, strict=True):
            voiced = np.flatnonzero(path < bins)
            good = len(voiced) and len(voiced) >= 0.4 * len(path)
            out.append(float(np.median(pitch[voiced, path[voiced]])) if good else None)
    return out
