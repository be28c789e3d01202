"""Token ids by a public byte-level BPE vocabulary.

The vocabulary splits a text into words before it merges bytes, so the ids of
a text are those of its words in a row. Texts are cut into words here, about
``AT_ONCE`` bytes at a time by Arrow where that is sure to be right, and each
distinct word goes to the tokenizers library once; a worker remembers the ids of
the words it has met by 128 bits of hash, in about ``REMEMBERED`` bytes, and when
these are full the half that it has met most often. A text that holds one of the
vocabulary's special strings goes to the library whole.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from . import common

#: Bytes of remembered words, about, at which a worker drops the rarer half.
REMEMBERED = 40 << 20
#: What a remembered word takes besides its ids: two halves of its hash, its number, and what is known of it.
_WORD_BYTES = 36
#: Bytes of text that are encoded at a time.
AT_ONCE = 1 << 20
_MARKS = (",", ".")
_BLANK = ("", "\u180e", "\u200b", "\ufeff")

_encoders: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Grown:
    """An array that grows."""

    def __init__(self, kind: type) -> None:
        self.room, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, values) -> None:
        values = np.asarray(values, self.room.dtype)
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate((self.room[: self.n], np.zeros(self.n // 4 + len(values), self.room.dtype)))
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


class Encoder:
    """Whole texts to ids."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.tokenizer = Tokenizer.from_file(path)
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_pattern = "|".join(map(re.escape, special)) or None
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # in the order of the hashes
        self._empty()

    def _empty(self) -> None:
        self.check, self.uses = _Grown(np.uint64), _Grown(np.int32)
        self.start, self.length, self.ids = _Grown(np.int32), _Grown(np.int32), _Grown(np.uint32)
        self.odd, self.sign, self.mark = _Grown(bool), _Grown(bool), _Grown(bool)

    @property
    def held(self) -> int:
        return _WORD_BYTES * self.uses.n + 4 * self.ids.n

    def _forget(self) -> None:
        """Drop the words that were met least often, half of them at least."""
        n = self.uses.n
        uses = self.uses.room[:n]
        stay = uses > np.partition(uses, n // 2)[n // 2]
        keep = np.flatnonzero(stay)
        lengths = self.length.room[keep].astype(np.int64)
        before = np.cumsum(lengths) - lengths
        ids = self.ids.room[np.repeat(self.start.room[keep] - before, lengths) + np.arange(int(lengths.sum()))]
        known = {m: getattr(self, m).room[keep] for m in ("check", "odd", "sign", "mark")} | {"uses": uses[keep] // 2, "start": before, "length": lengths, "ids": ids}
        own = stay[self.numbers]
        self.hashes, self.numbers = self.hashes[own], (np.cumsum(stay) - 1)[self.numbers[own]].astype(np.int32)
        self._empty()
        for name, values in known.items():
            getattr(self, name).extend(values)

    def _codes(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words; those not met before are learnt."""
        data, at = common.utf8(words)
        data, at = data.tobytes(), at.tolist()
        found = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]), np.uint64).reshape(-1, 2)
        place = np.searchsorted(self.hashes, found[:, 0])
        codes = np.full(len(found), -1, np.int32)
        inside = np.flatnonzero(place < len(self.hashes))
        inside = inside[self.hashes[place[inside]] == found[inside, 0]]
        numbers = self.numbers[place[inside]]
        same = self.check.room[numbers] == found[inside, 1]
        codes[inside[same]] = numbers[same]

        unknown = np.flatnonzero(codes < 0)
        if not len(unknown):
            return codes
        codes[unknown] = self.uses.n + np.arange(len(unknown))
        gc.disable()  # the objects of the library make no cycles
        for i in range(0, len(unknown), 20_000):
            self._learn(words.take(pa.array(unknown[i : i + 20_000])).to_pylist())
        gc.enable()
        self.check.extend(found[unknown, 1])
        fresh, numbers = found[unknown, 0], codes[unknown]
        order = np.argsort(fresh)
        place = np.searchsorted(self.hashes, fresh[order])
        self.hashes, self.numbers = np.insert(self.hashes, place, fresh[order]), np.insert(self.numbers, place, numbers[order])
        return codes

    def _learn(self, words: list[str]) -> None:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        self.start.extend(self.ids.n + np.cumsum(lengths) - lengths)
        self.length.extend(lengths)
        self.ids.extend(np.fromiter(chain.from_iterable(got), np.uint32))
        self.uses.extend(np.zeros(len(words), np.int32))
        last = [w[-1:] for w in words]
        # A cut before or after an odd piece may fall inside a word, and
        # one behind a sign does if a comma or full stop follows.
        self.odd.extend([((w[1:2] if w[:1] == " " else w[:1]).isspace() or x in _BLANK or x.isspace()) and w != "\n" for w, x in zip(words, last, strict=True)])
        self.sign.extend([not x.isalnum() for x in last])
        self.mark.extend([w[:1] in _MARKS for w in words])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (and the last's end). Nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        special = np.zeros(len(texts), bool)
        if self.special_pattern:
            special = pc.match_substring_regex(texts, self.special_pattern).to_numpy(zero_copy_only=False).astype(bool)
        lengths, parts, i = np.zeros(len(texts), np.int64), [], 0
        while i < len(texts):
            j = i
            if special[i]:
                parts.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32))
            elif sizes[i] > AT_ONCE:
                cuts = _safe_cuts(text := texts[i].as_py())
                parts += [self._encode(pa.array([text[a:b]]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                lengths[i] = sum(len(x) for x in parts[len(parts) - len(cuts) + 1 :])
            else:
                size = 0
                while j < len(texts) and not special[j] and size + sizes[j] <= AT_ONCE:
                    size += sizes[j]
                    j += 1
                ids, at = self._encode(texts[i:j].cast(pa.string()))
                parts.append(ids)
                lengths[i:j] = np.diff(at)
            if special[i]:
                lengths[i] = len(parts[-1])
            i = max(j, i + 1)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return ids, np.concatenate(([0], np.cumsum(lengths)))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of one text or several small ones, without special strings."""
        if self.held > REMEMBERED:
            self._forget()
        cut = texts
        for sign, to in ((" ", "\x01 "), (",", "\x01,"), (".", "\x01."), ("\n", "\x01\n\x01")):
            cut = pc.replace_substring(cut, sign, to)
        cut = pc.split_pattern(cut, "\x01")
        at = cut.offsets.to_numpy().astype(np.int64)
        pieces = cut.flatten().dictionary_encode()
        codes = self._codes(pieces.dictionary)[pieces.indices.to_numpy()]

        awkward = self.odd.room[codes]
        ends = np.concatenate((at[:-1], at[1:] - 1))  # an empty first or last piece does no harm
        awkward[ends[self.length.room[codes[ends]] == 0]] = False
        awkward[:-1] |= self.sign.room[codes[:-1]] & self.mark.room[codes[1:]]
        count = np.concatenate(([0], np.cumsum(awkward)))
        bad = count[at[1:]] > count[at[:-1]]
        bad |= pc.match_substring(texts, "\x01").to_numpy(zero_copy_only=False)
        if bad.any():
            each = np.split(codes, at[1:-1])
            for i in np.flatnonzero(bad):
                words = self.words(texts[i].as_py())
                distinct = dict.fromkeys(words)
                numbers = dict(zip(distinct, self._codes(pa.array(list(distinct), pa.string())).tolist(), strict=True))
                each[i] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            codes = np.concatenate(each)
            at = np.concatenate(([0], np.cumsum([len(x) for x in each])))

        self.uses.room[: self.uses.n] += np.bincount(codes, minlength=self.uses.n).astype(np.int32)
        lengths = self.length.room[codes]
        after = np.cumsum(lengths, dtype=np.int64)
        n = int(after[-1]) if len(after) else 0
        kind = np.int32 if n < 2**31 else np.int64
        shift = (self.start.room[codes] - (after - lengths)).astype(kind)
        ids = self.ids.room[np.repeat(shift, lengths) + np.arange(n, dtype=kind)]
        return ids, np.concatenate(([0], after))[at]


#: Between these letters and the blank the vocabulary's words part, whatever stands around them.
_SAFE = re.compile("[A-Za-z](?= [A-Za-z])")


def _safe_cuts(text: str) -> list[int]:
    """Places 0 to len(text) that part words, about ``AT_ONCE`` // 4 characters from each other where there are such places."""
    cuts, step = [0], AT_ONCE // 4
    while cuts[-1] + step < len(text) and (found := _SAFE.search(text, cuts[-1] + step)):
        cuts.append(found.end())
    return [*cuts, len(text)] if cuts[-1] < len(text) else cuts


def gathered(batches, column: str = "text"):
    """Arrow batches joined until they hold ``AT_ONCE`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch[column].nbytes
        if size >= AT_ONCE:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
