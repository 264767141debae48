"""CRC-32 of all words and pairs of words of many texts at a time, on arrays of bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Longer words are hashed one by one.
LONGEST = 64
#: Texts are worked off about so many bytes at a time.
STRETCH = 4 << 20


def _byte_table() -> np.ndarray:
    """What a byte does to the register of CRC-32 (reflected polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_STEP = _byte_table()


def _shift_tables() -> np.ndarray:
    """[n, k, b]: the register after n zero bytes if byte k of it was b and the others 0. The register is linear, so four look-ups add up to any."""
    out = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(LONGEST):
        out[n + 1] = _STEP[out[n] & 255] ^ (out[n] >> 8)
    return out


_SHIFT = _shift_tables().ravel()

_BYTES = np.arange(256)
#: A-Z to a-z; all other bytes as they are.
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words once in lower case: 0-9, a-z and all of characters beyond ASCII.
_INSIDE = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that a CRC has in that of a text with n more bytes."""
    at = n.astype(np.int32) * 1024
    out = _SHIFT[at + (crc & 255)]
    for k in (1, 2, 3):
        out ^= _SHIFT[at + (256 * k) + ((crc >> np.uint32(8 * k)) & 255)]
    return out


def _singles(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC of each word: all words together byte by byte, the longest first, so that those still going are in front."""
    short = np.minimum(sizes, LONGEST + 1).astype(np.int16)
    order = np.argsort(-short, kind="stable")
    counts = np.bincount(short, minlength=LONGEST + 2)
    left = len(starts) - np.cumsum(counts)  # words of more than i bytes
    state, at = np.full(len(starts), 0xFFFFFFFF, np.uint32), starts[order]
    for i in range(LONGEST):
        m = int(left[i])
        if not m:
            break
        state[:m] = _STEP[(state[:m] ^ data[at[:m] + i]) & 255] ^ (state[:m] >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    for i in np.flatnonzero(sizes > LONGEST):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    return out


def _features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(singles, pairs, first) of texts data[bounds[i] : bounds[i + 1]] in lower case: CRCs of the words, of each word with the next one (its value at a text's last word means nothing), and each text's first word."""
    inside = _INSIDE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    before[cuts], after[cuts - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sizes, first = ends - starts, np.searchsorted(starts, bounds)
    singles = _singles(data, starts, sizes)
    pairs = np.zeros_like(singles)
    if len(starts) > 1:
        spaced = _shifted(singles[:-1], np.ones(len(starts) - 1)) ^ np.uint32(zlib.crc32(b" "))
        short = sizes[1:] <= LONGEST
        pairs[:-1][short] = _shifted(spaced[short], sizes[1:][short]) ^ singles[1:][short]
        for i in np.flatnonzero(~short):
            pairs[i] = zlib.crc32(data[starts[i + 1] : ends[i + 1]], int(spaced[i]))
    return singles, pairs, first


def stretches(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, singles, pairs, first) for texts [start, end), about STRETCH bytes at a time. A longer text comes in several stretches of its own, cut between words; the CRC of a pair that a cut parts comes with the later one.

    Entry i of singles and pairs belongs to text start + k for first[k] <= i < first[k + 1]; a text's last pair is none. In a later stretch of one text,
    the word before the cut comes again with pairs only: first[0] is 1 there, and its pair stands at 0.
    """
    wide = pa.types.is_large_string(texts.type)
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + STRETCH, side="right")) - 1)
        at, last = int(bounds[start]), int(bounds[end])
        if last - at <= STRETCH:
            data = _LOWER[whole[at:last]]
            yield start, end, *_features(data, bounds[start : end + 1] - at)
        else:
            yield from ((start, start + 1, *part) for part in _long(_LOWER[whole[at : int(bounds[start + 1])]]))
            end = start + 1
        start = end


def _long(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A text in parts that end behind a word; each later part begins with the last word of those before."""
    outside = np.flatnonzero(~_INSIDE[data])
    at, back = 0, 0  # the part's begin, and how far before it the repeated word begins
    while at < len(data):
        i = int(np.searchsorted(outside, at + STRETCH))
        end = int(outside[i]) if i < len(outside) else len(data)
        part = data[at - back : end]
        singles, pairs, first = _features(part, np.array([0, len(part)]))
        yield singles, pairs, np.array([min(1, len(singles)) if back else 0, first[1]])
        inside = np.flatnonzero(_INSIDE[part])
        if len(inside):
            tail = int(inside[-1]) + 1
            gaps = np.flatnonzero(~_INSIDE[part[:tail]])
            begin = int(gaps[-1]) + 1 if len(gaps) else 0
            back = len(part) - begin
        at = end
