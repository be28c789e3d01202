"""Declared schemas at the borders: kit documents and job records."""

SCHEMA_VERSION = 1
PAD = "pad int, bank string, midi_note int, slice_id string"
PARTS = "isolation double, clarity double, loudness double, loopability double, uniqueness double"
RENDER = "fade_in_ms double, fade_out_ms double, normalize_dbfs double, reverse boolean, playback string"
SLICE = (
    "id string, stem string, kind string, category string, label string, file string, source_start_s double, source_end_s double, "
    f"bars double, beats double, note string, section string, score double, score_parts struct<{PARTS.replace(' ', ':').replace(',:', ', ')}>, "
    f"cluster long, render struct<{RENDER.replace(' ', ':').replace(',:', ', ')}>"
)
ANALYSIS = "rate int, duration_s double, bpm double, key string, key_short string, key_confidence double, time_signature string"


def _struct(fields: str) -> str:
    """'a int, b struct<...>' as the body of a struct type."""
    out, depth = [], 0
    for part in fields.split(", "):
        if depth == 0:
            name, _, kind = part.partition(" ")
            part = f"{name}:{kind}"
        depth += part.count("<") - part.count(">")
        out.append(part)
    return f"struct<{', '.join(out)}>"


KIT = f"schema_version int, kit_name string, analysis {_struct(ANALYSIS)}, pads array<{_struct(PAD)}>, slices array<{_struct(SLICE)}>"
JOB = "id string, name string, status string, stage string, error string, created double, started double, finished double, mode string"
