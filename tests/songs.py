"""A synthetic song of known tempo, key and parts."""

import numpy as np

RATE, BARS, BEAT_S = 44100, 16, 0.5
ROOTS = (41, 46, 48, 41)  # F2 Bb2 C3 F2: F minor
CHORDS = ((65, 68, 72), (65, 70, 73), (63, 67, 72), (65, 68, 72))
MELODY = (72, 77, 68, 65)


def hz(midi, up=0):
    return 440 * 2 ** ((midi + up - 69) / 12)


def tone(freq, seconds, harmonics=4, decay=0.0, vibrato=0.0):
    t = np.arange(int(seconds * RATE)) / RATE
    phase = 2 * np.pi * freq * t + (vibrato * np.sin(2 * np.pi * 5.5 * t) if vibrato else 0)
    x = sum(np.sin(h * phase) / h for h in range(1, harmonics + 1)) * np.exp(-decay * t)
    ramp = np.minimum(1, np.minimum(np.arange(len(x)), np.arange(len(x))[::-1]) / (0.005 * RATE))
    return x * ramp


def kick():
    t = np.arange(int(0.35 * RATE)) / RATE
    return np.sin(2 * np.pi * np.cumsum(45 + 110 * np.exp(-30 * t)) / RATE) * np.exp(-9 * t)


def snare(rng):
    n = int(0.2 * RATE)
    t = np.arange(n) / RATE
    spectrum = np.fft.rfft(rng.standard_normal(n))
    f = np.fft.rfftfreq(n, 1 / RATE)
    spectrum /= np.sqrt(1 + (1000 / np.maximum(f, 1)) ** 8) * np.sqrt(1 + (f / 5000) ** 8)
    noise = np.fft.irfft(spectrum, n)
    return (noise / np.abs(noise).max() + 0.3 * np.sin(2 * np.pi * 190 * t)) * np.exp(-22 * t)


def hat(rng):
    n = int(0.06 * RATE)
    x = np.diff(rng.standard_normal(n + 3), 3)
    return x / np.abs(x).max() * np.exp(-70 * np.arange(n) / RATE)


def stems(up=0, bars=BARS, seed=7):
    """drums, bass, other and vocals as mono arrays, scaled so that the mix peaks at .9."""
    rng = np.random.default_rng(seed)
    out = {s: np.zeros(int(bars * 4 * BEAT_S * RATE)) for s in ("drums", "bass", "other", "vocals")}

    def place(stem, sound, seconds, gain):
        a = round(seconds * RATE)
        n = min(len(sound), len(out[stem]) - a)
        out[stem][a : a + n] += gain * sound[:n]

    k, s, h = kick(), snare(rng), hat(rng)
    for bar in range(bars):
        t0 = bar * 4 * BEAT_S
        for beat in range(4):
            t = t0 + beat * BEAT_S
            place("drums", s if beat % 2 else k, t, 0.6 if beat % 2 else 0.9)
            place("drums", h, t, 0.2)
            place("drums", h, t + BEAT_S / 2, 0.25)
            place("bass", tone(hz(ROOTS[bar % 4], up), 0.9 * BEAT_S, 2), t, 0.5)
        for beat, gain in ((0, 0.5), (2.5, 0.35)):
            for note in CHORDS[bar % 4]:
                place("other", tone(hz(note, up), 1.4 * BEAT_S, 3, 3.0), t0 + beat * BEAT_S, gain / 1.5)
        if bar % 2 == 0:
            for i in range(2):
                place("vocals", tone(hz(MELODY[(bar // 2 + i) % 4], up), 1.8 * BEAT_S, 3, 0.5, 0.3), t0 + 2 * i * BEAT_S, 0.3)
    peak = np.abs(sum(out.values())).max()
    return {name: 0.9 * x / peak for name, x in out.items()}


def frames_of(spark, songs, folder):
    """Block tables (mix, stems) of {song_id: stems}, from Parquet under ``folder``."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessella.sources import wav

    def table(name, parts):
        for song, stem, x in parts:
            pq.write_table(pa.Table.from_batches(wav.blocks_of(song, stem, RATE, np.stack((x, x)).astype(np.float32))), f"{folder}/{name}-{song}-{stem}.parquet")
        return spark.read.schema(wav.BLOCKS).parquet(*[f"{folder}/{name}-{song}-{stem}.parquet" for song, stem, _ in parts])

    mix = table("mix", [(song, "mix", sum(s.values())) for song, s in songs.items()])
    return mix, table("stems", [(song, name, x) for song, s in songs.items() for name, x in s.items()])
