"""Words of many texts at once, as numbers: what is between white space, with A-Z as a-z."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are hashed at a time.
CHUNK = 1 << 18

#: A word of more bytes has a hash of its own kind: sums of powers modulo 2^64 take some long words for each other.
LONG_WORD = 32

_ONE = np.uint64(1)
#: Odd multipliers of the hashes.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * by
    return h ^ (h >> np.uint64(29))


_BYTES = np.arange(256)
#: A value for each byte, A-Z as a-z; which bytes are between words; powers of an odd number by position, and of its inverse.
_VALUES = mixed(np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) * MIX[1] + MIX[2], MIX[0])
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_BETWEEN = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        base, inverse = int(MIX[1]), pow(int(MIX[1]), -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.append(_ONE, np.full(n, x, np.uint64))) for x in (base, inverse)]
    return _POWERS


def word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (64 bits), start and last byte of every word of texts that follow each other; ``begins``: where texts begin.

    Words of up to ``LONG_WORD`` bytes are hashed all at once, longer ones by xxh3 each.
    """
    apart = _BETWEEN[data]
    opens, closes = ~apart, ~apart
    opens[1:] &= apart[:-1]
    closes[:-1] &= apart[1:]
    inside = begins[(begins > 0) & (begins < len(data))]
    opens[inside] = ~apart[inside]
    closes[inside - 1] = ~apart[inside - 1]
    start, last = np.flatnonzero(opens), np.flatnonzero(closes)
    power, inverse = _powers(len(data))
    total = np.cumsum(_VALUES[data] * power[: len(data)])
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    h = mixed((total[last] - before) * inverse[start], MIX[0])
    for k in np.flatnonzero(last - start >= LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(LOWER[data[start[k] : last[k] + 1]].tobytes())
    return h, start, last


def _pieces(data: np.ndarray, chunk: int) -> Iterator[np.ndarray]:
    """One long text in pieces that end between words."""
    at = 0
    while at < len(data):
        end = at + chunk
        while end < len(data) and not _BETWEEN[data[end - 1 : end + chunk]].any():
            end += chunk
        if end < len(data):
            end += int(np.argmax(_BETWEEN[data[end - 1 : end + chunk]]))
        yield data[at:end]
        at = end


def parts(texts: pa.Array, chunk: int | None = None) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Texts from and upto, with their bytes and where each begins: some texts in one part, or one long text in several. Null is empty."""
    chunk = chunk or CHUNK
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
        cuts = offsets[at : upto + 1]
        part = data[cuts[0] : cuts[-1]]
        if len(part) > 2 * chunk:
            yield at, upto, [(p, np.array([0])) for p in _pieces(part, chunk)]
        else:
            yield at, upto, [(part, cuts[:-1] - cuts[0])]
        at = upto


def spelled(data: np.ndarray) -> np.ndarray:
    """The bytes of all words in turn, with A-Z as a-z."""
    return LOWER[data[~_BETWEEN[data]]]


def counts(start: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many words, by their starts, each text has."""
    return np.diff(np.append(np.searchsorted(start, begins), len(start)))
