"""Exact byte-level BPE ids with a memory of pre-tokens.

The vocabulary's pre-token pattern lets a pre-token begin with one space and never puts a
space before a visible character anywhere else; so a text can be cut before
every space that is followed by a visible character, and the parts, called units, encode alone as they do in
the text. Units of characters whose classes are certain are cut further, into the pattern's pre-tokens; others stay whole. The
cuts of many texts are found at once from the classes of their bytes, Arrow finds the distinct parts, and each part that the worker
does not remember is encoded by the library once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import memory

#: Parts that a worker remembers, of up to so many bytes: about 140 bytes each, 140 MB in all.
REMEMBERED_UNITS = 1_000_000
REMEMBERED_BYTES = 48
UNITS_PER_CALL = 512
SLICE_CHARS = 4 << 20

#: Where a unit begins; the visible characters are those up to U+024F.
_CUT = re.compile(rb"(?= (?:[!-~]|\xc2[\xa1-\xbf]|[\xc3-\xc8]|\xc9[\x80-\x8f]))")

# Classes of bytes. Letters beyond ASCII are those from U+00C0 to U+024F but for two signs; a unit with any other byte or character is not cut.
_OTHER, _LETTER, _DIGIT, _SIGN, _LINE, _SPACE = range(6)
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[33:127] = _SIGN
_CLASSES[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_CLASSES[48:58] = _DIGIT
_CLASSES[10], _CLASSES[32] = _LINE, _SPACE
_CLASSES[0x80:0xC0] = _CLASSES[0xC3:0xCA] = _LETTER


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _cuts(data: np.ndarray, begins: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of the texts in ``data`` begin, of which each text begins at one of ``begins``, and which parts are units that are not cut."""
    n = len(data)
    kind = _CLASSES[data]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    after = np.zeros(n + 2, np.uint8)  # the byte behind each within its text, else 0
    after[: n - 1] = data[1:]
    after[np.flatnonzero(first[1:])] = 0
    other = kind == _OTHER
    beyond = np.flatnonzero(data >= 0xC2)
    if len(beyond):
        lead, follow = data[beyond], after[beyond]
        other[beyond] |= ((lead == 0xC3) & ((follow == 0x97) | (follow == 0xB7))) | ((lead == 0xC9) & (follow >= 0x90))
    space = np.flatnonzero(kind == _SPACE)
    follow, second = after[space], after[np.minimum(space + 1, n)]
    good = ((follow > 32) & (follow < 127)) | ((follow >= 0xC3) & (follow <= 0xC8)) | ((follow == 0xC2) & (second >= 0xA1)) | ((follow == 0xC9) & (second < 0x90))
    other[space[~good]] = True
    unit = first[:n].copy()
    unit[space[good]] = True
    raw = data.tobytes() if specials else b""
    for special in specials:  # stays within one unit, which is not cut
        at = raw.find(special)
        while at >= 0:
            other[at] = True
            unit[at + 1 : at + len(special)] &= first[at + 1 : at + len(special)]
            at = raw.find(special, at + 1)
    part = unit.copy()
    part[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
    # of several line ends the last is a pre-token of its own if something visible follows
    line = np.flatnonzero((kind[1:] == _LINE) & (kind[:-1] == _LINE)) + 1
    part[line[(after[line] > 32)]] = True
    # 's, 't, 'm, 'd, 're, 've and 'll where no sign and no space stands before
    quote = np.flatnonzero(data == 39)
    quote = quote[part[quote] & (kind[quote] == _SIGN)]
    if len(quote):
        one, two = after[quote], np.where(after[quote] > 0, after[np.minimum(quote + 1, n)], 0)
        short = np.isin(one, list(b"stmd"))
        long = (np.isin(one, list(b"rv")) & (two == 101)) | ((one == 108) & (two == 108))
        part[quote[short | long] + 1] = False
        for ends in (quote[short] + 2, quote[long] + 3):
            part[ends[ends < n]] = True
    starts = np.flatnonzero(unit)
    whole = np.logical_or.reduceat(other, starts) if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero(part)
    inside = whole[np.cumsum(unit[at]) - 1]
    kept = ~inside | unit[at]
    return at[kept], inside[kept]


class Encoder:
    """Ids of texts as 32-bit integers in the machine's (little-endian) order."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if t.content]
        # a byte-level vocabulary writes each byte as one character
        self.sizes = np.zeros(self.library.get_vocab_size(), np.int64)
        for piece, i in self.library.get_vocab().items():
            self.sizes[i] = len(piece)
        # the same model without the pattern, for parts that are one pre-token; its own memory would only be filled with parts that come once
        from tokenizers import Tokenizer, pre_tokenizers

        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        if hasattr(self.bare.model, "_resize_cache"):
            self.bare.model._resize_cache(0)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.byte_names = {b: chr(256 + i) for i, b in enumerate(hidden)}  # as byte-level vocabularies name bytes; others are their own names
        self.units: dict[bytes, bytes] = {}

    def _pre_tokens(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of parts that are one pre-token each, by one call for many."""
        new: dict[bytes, bytes] = {}
        names = self.byte_names | {255: "\n"}  # no text has this byte
        plain = [p for p in parts if p.isascii()]
        beyond = [p for p in parts if not p.isascii()] if len(plain) < len(parts) else []
        for of, i in [(plain, i) for i in range(0, len(plain), UNITS_PER_CALL)] + [(beyond, i) for i in range(0, len(beyond), UNITS_PER_CALL)]:
            some = of[i : i + UNITS_PER_CALL]
            text = b"\xff".join(some).decode("latin-1")
            if of is plain:  # of printing characters, spaces and line ends
                text = text.replace("\n", names[10]).replace(" ", names[32]).replace("\xff", "\n")
            else:
                text = text.translate(names)
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            ends, reached = np.cumsum(list(map(len, some))), np.cumsum(self.sizes[ids])
            at = np.searchsorted(reached, ends)
            if not len(ids) or reached[-1] != ends[-1] or (reached[at] != ends).any():
                raise ValueError("the vocabulary leaves bytes out")
            packed, cuts = ids.tobytes(), [0, *(4 * at + 4).tolist()]
            new.update(zip(some, [packed[a:b] for a, b in zip(cuts, cuts[1:])]))
        return new

    def _learn(self, parts: list[bytes], whole: list[bool]) -> list[bytes]:
        """Ids of parts that are not known; of those that are units which are not cut, ``whole``, from the library with its pattern."""
        new = self._pre_tokens([p for p, w in zip(parts, whole) if not w])
        odd = [p for p, w in zip(parts, whole) if w]
        for i in range(0, len(odd), UNITS_PER_CALL):
            some = odd[i : i + UNITS_PER_CALL]
            found = self.library.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)
            new.update((p, np.array(e.ids, np.int32).tobytes()) for p, e in zip(some, found, strict=True))
        self.units.update(new if max(map(len, new)) <= REMEMBERED_BYTES else {p: v for p, v in new.items() if len(p) <= REMEMBERED_BYTES})
        return [new[p] for p in parts]

    def _slice(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``data``, and how many of them stand before each of ``begins``, which are where texts begin."""
        if len(self.units) > REMEMBERED_UNITS:
            self.units = {}
        at, whole = _cuts(data, np.concatenate([[0], begins]), self.specials)
        offsets = np.append(at, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.units.get, parts))
        gaps = [i for i, v in enumerate(values) if v is None]
        if gaps:
            odd = np.zeros(len(parts), bool)
            odd[coded.indices.to_numpy()[whole]] = True
            for i, v in zip(gaps, self._learn([parts[i] for i in gaps], odd[gaps].tolist())):
                values[i] = v
        ids = pa.array(values, pa.large_binary()).take(coded.indices)
        before = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) // 4
        return np.frombuffer(ids.buffers()[2], np.int32, int(before[-1])), before[np.searchsorted(at, begins)]

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin and the last ones end; each text's are followed by ``end_id``. A null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        found, before, a, n = [], [], 0, 0
        while a < len(data):  # the end of a slice is the beginning of a text or of a unit
            b = len(data)
            if b - a > 2 * SLICE_CHARS:
                near = int(ends[np.searchsorted(ends, a + SLICE_CHARS)])
                if near > a + 2 * SLICE_CHARS:
                    cut = _CUT.search(memoryview(data[:near]), a + SLICE_CHARS)
                    near = cut.start() if cut else near
                b = near
            ids, starts = self._slice(data[a:b], ends[np.searchsorted(ends, a) : np.searchsorted(ends, b)] - a)
            found.append(ids)
            before.append(starts + n)
            a, n = b, n + len(ids)
        at = np.concatenate([*before, np.full(len(ends) - sum(map(len, before)), n, np.int64)])
        ids = found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.int32), *found])
        if end_id is not None:
            ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
        return ids, at

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        packed, at = ids.tobytes(), (4 * ends).tolist()
        return [packed[a:b] for a, b in zip(at, at[1:])]


def encoder(path: str) -> Encoder:
    """The worker's encoder; a worker keeps it from task to task of this kind."""
    kept = memory("encoders")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def groups(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``size`` bytes each."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = min(len(texts), int(np.searchsorted(total, (total[start - 1] if start else 0) + size)) + 1)
        yield start, stop
        start = stop
