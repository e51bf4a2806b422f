"""Vectorised work on the UTF-8 bytes of many texts at once.

A batch of texts is one byte array with offsets, as Arrow stores it; words,
hashes of words and n-grams, and the anchors of windows come out of a few
passes of numpy over it, without a Python object for each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Word separators: space, tab, line feed, vertical tab, form feed, return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All bytes but digits, letters and those over 127.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
WORDS_AT_ONCE = 1 << 14
REACH = 1 << 20  # bytes that these words may stand in
SHORT = 32  # bytes of a word
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


#: A random value for each byte, one table for each of the two hash functions.
BYTES = [mix(np.arange(1 + 256 * k, 257 + 256 * k, dtype=U) * BASES[0]) for k in range(2)]


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; a null
    counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def lists(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values and the n + 1 offsets of a list column of int64 without
    nulls among the values; a null list counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    lengths = np.asarray(array.value_lengths().fill_null(0)).astype(np.int64)
    return np.asarray(array.drop_null().flatten()), np.concatenate([[0], np.cumsum(lengths)])


def binary(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The Arrow column of these bytes."""
    return pa.Array.from_buffers(kind or pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 offsets of each text's words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 (in UTF-8) in lower case."""
    out = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    out[after] += (32 * ((data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97))).astype(np.uint8)
    return out


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = BASES[which]
        inverse = U(pow(int(base), -1, 1 << 64))
        one = np.ones(1, U)
        have = tuple(np.multiply.accumulate(np.concatenate([one, np.full(size - 1, b, U)])) for b in (base, inverse))
        _powers[which] = have
    return have[0][:n], have[1][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands.
    A polynomial in an odd base modulo 2**64 serves short words only: of long
    ones there are pairs that it gives the same value in any base (Thue-Morse
    words), so words over ``SHORT`` bytes are hashed by XXH3 one by one.
    Works on some thousand words at a time, so memory follows the reach of
    these (words should come in the order of the text)."""
    out = np.empty(len(starts), U)
    long = np.flatnonzero(ends - starts > SHORT)
    if len(long):
        view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
        out[long] = np.fromiter((digest(view[s:e], which) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), U, len(long))
        short = np.flatnonzero(ends - starts <= SHORT)
        out[short] = _short_hashes(data, starts[short], ends[short], which)
        return out
    return _short_hashes(data, starts, ends, which)


def _short_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    out = np.empty(len(starts), U)
    for first in range(0, len(starts), WORDS_AT_ONCE):
        part = slice(first, first + WORDS_AT_ONCE)
        low, high = int(starts[part].min()), int(ends[part].max())
        if high - low > REACH:  # long words between them: each word by itself
            size = ends[part] - starts[part]
            place = repeat_ranges(starts[part], size)
            stop = np.cumsum(size)
            out[part] = _polynomial(data[place], stop - size, stop, which)
        else:
            out[part] = _polynomial(data[low:high], starts[part] - low, ends[part] - low, which)
    return out


def _polynomial(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    up, down = powers(len(data) + 1, which)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTES[which][data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def grams(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of each run of k values, put together from those of runs whose
    lengths are powers of two.  What joins two is mixed each time, so that no
    sum of products is left in which different runs could cancel out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, power, size = None, 0, hashes, 1
    while True:
        if k & size:
            out = power[:n] if out is None else mix(out * BASES[which] + power[done : done + n])
            done += size
        if 2 * size > k:
            return mix(out)
        power = mix(power[:-size] * BASES[which] + power[size:])
        size *= 2


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of each ``width`` neighbours, the leftmost of
    equals, in about log2(width) passes."""
    at = np.arange(len(h), dtype=np.int32)
    span = 1
    while span < width:
        step = min(span, width - span)
        less = h[step:] < h[:-step]
        h = np.where(less, h[step:], h[:-step])
        at = np.where(less, at[step:], at[:-step])
        span += step
    return at


def anchors(h: np.ndarray, stops: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of ``window`` values are pinned.

    ``h`` has a hash for each run of ``gram`` values and ``stops`` the end of
    the text that each value belongs to.  A window's anchor is the run with the
    least hash in it.  It depends on the window's content alone, so equal
    windows have equal runs at equal places.  Returns the anchors' places, and
    for each the least and the most places that its windows start before it.
    """
    n = len(stops) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    starts = np.flatnonzero(np.arange(window, window + n, dtype=np.int64) <= stops[:n])
    if not len(starts):
        return starts, starts, starts
    at = sliding_argmin(h, window - gram + 1)[starts].astype(np.int64)
    new = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new - 1, [len(at) - 1]])
    return at[first], at[first] - starts[last], at[first] - starts[first]


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the intervals."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def repeat_ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for length[0] values, then the same for the next."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    offsets = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(begin - offsets, length)
