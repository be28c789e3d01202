"""Word-aligned integer coding with a selector for every 64-bit word.

The top four bits of a word select how many values of how many bits its other
60 bits hold. Values are coded in blocks, and a block begins with a word of its
own, so all blocks of a buffer are packed, or unpacked, in step by numpy: one
step handles the next word of every block. A value that needs more than 60 bits
is an escape: a word that holds its place in a list of raw values.
"""

from __future__ import annotations

import numpy as np

#: (values, bits) by selector. Selector 0 is the escape.
LAYOUT = (
    (1, 0), (60, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
COUNTS = np.array([c for c, _ in LAYOUT])
BLOCK = 256


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uint64 values -> words, the first word of each block (and the end), escaped values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    grid = np.zeros((blocks, block + int(max(COUNTS))), np.uint64)
    full = n // block
    grid[:full, :block] = values[: full * block].reshape(full, block)
    if full < blocks:
        grid[full, : n - full * block] = values[full * block :]
    # The bits of each value, or one more for values that a double rounds up.
    # They are the exponent of the double, whose bias is 1022.
    bits = np.maximum((grid.astype(np.float64).view(np.int64) >> 52) - 1022, 0).astype(np.uint8)
    # The selector at each place: the one of the most values that all fit.
    choice = np.where(bits[:, :block] <= 60, 15, 0).astype(np.uint8)
    most, reach = bits, 1
    for selector in range(14, 0, -1):
        count, width = LAYOUT[selector]
        while reach < count:
            step = min(reach, count - reach)
            most, reach = np.maximum(most[:, : most.shape[1] - step], most[:, step:]), reach + step
        fits = most[:, :block] <= width
        if not fits.any():
            break
        choice[fits] = selector
    lengths = np.full(blocks, block)
    lengths[-1] = n - (blocks - 1) * block
    picked = np.full((blocks, block), 255, np.uint8)
    places = np.zeros((blocks, block), np.int32)
    rows, at, step = np.arange(blocks), np.zeros(blocks, np.int64), 0
    while len(rows):
        s = choice[rows, at]
        picked[rows, step], places[rows, step] = s, at
        at, step = at + COUNTS[s], step + 1
        live = at < lengths[rows]
        rows, at = rows[live], at[live]
    used = picked != 255
    per_block = used.sum(axis=1)
    row, start, selector = np.repeat(np.arange(blocks), per_block), places[used], picked[used]
    words = selector.astype(np.uint64) << np.uint64(60)
    flat, first = grid.reshape(-1), row * grid.shape[1] + start
    for s in range(1, 16):
        count, width = LAYOUT[s]
        here = np.flatnonzero(selector == s) if width else ()
        if len(here):
            from_, word = first[here], words[here]
            for k in range(count):
                word |= flat[from_ + k] << np.uint64(k * width)
            words[here] = word
    escaped = np.flatnonzero(selector == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    heads = np.concatenate(([0], np.cumsum(per_block))).astype(np.uint32)
    return words, heads, grid[row[escaped], start[escaped]]


def unpack(words: np.ndarray, heads: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values again."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[selector]
    ends = np.cumsum(held)
    starts = ends - held
    heads = np.asarray(heads, np.int64)
    block_of = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    # A block's last word may hold more places than the block has values.
    place = starts - starts[heads[:-1]][block_of] + block_of * block if len(words) else starts
    out = np.zeros(n + max(COUNTS), np.uint64)
    for s in range(16):
        here = np.flatnonzero(selector == s)
        if not len(here):
            continue
        count, width = LAYOUT[s]
        if s == 0:
            out[place[here]] = escapes[(words[here] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif width:
            low = np.uint64((1 << width) - 1)
            last = np.minimum((block_of[here] + 1) * block, n)
            for k in range(count):
                inside = place[here] + k < last
                out[place[here][inside] + k] = (words[here][inside] >> np.uint64(k * width)) & low
    return out[:n]
