"""Vectorised words of UTF-8 text: 64-bit hashes, starts and ends from a few NumPy passes over bytes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_SPAN = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, so that order and low bits of hashes are as good as random."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length()) + 1
        for key, base in (("up", _BASE), ("down", _INV)):
            a = np.full(size, U64(base), np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def prefix_of(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over 64-bit codes; ``span`` reads the hash of any range of them."""
    up, _ = _grown(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def prefix(data: np.ndarray) -> np.ndarray:
    """The same over bytes."""
    return prefix_of(_CODE[data])


def down(at: int) -> np.uint64:
    """What brings a range that starts at ``at`` to start at 0."""
    return _grown(at + 1)[1][at]


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * _grown(len(sums))[1][start]


def words(data: bytes, lower: bool = True, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word; A-Z are taken as a-z first if ``lower``. Long texts go span by span."""
    if lower:
        data = data.lower()
    raw = np.frombuffer(data, np.uint8)
    found, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + _SPAN)
        if stop < len(raw):
            gap = np.flatnonzero(gaps[raw[at:stop]])
            while not len(gap) and stop < len(raw):
                stop = min(len(raw), stop + _SPAN)
                gap = np.flatnonzero(gaps[raw[at:stop]])
            stop = at + int(gap[-1]) + 1 if len(gap) and stop < len(raw) else stop
        part = raw[at:stop]
        edge = np.empty(len(part) + 2, np.int8)
        edge[0] = edge[-1] = 1
        edge[1:-1] = gaps[part]
        step = np.diff(edge)
        start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        found.append((mix(span(prefix(part), start, end)), start + at, end + at))
        at = stop
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]


def chunks(texts: list, size: int = _SPAN):
    """(first index, [bytes]) of runs of texts of about ``size`` bytes; null is empty."""
    first, run, n = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t
        run.append(b)
        n += len(b)
        if n >= size:
            yield first, run
            first, run, n = i + 1, [], 0
    if run:
        yield first, run


def doc_words(run: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of text i are hashes[bounds[i]:bounds[i + 1]]."""
    joined = b"\n".join(run)
    h, start, _ = words(joined, lower)
    offsets = np.zeros(len(run) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in run], out=offsets[1:])
    return h, np.searchsorted(start, offsets)


def planes(a: np.ndarray, width: int = 8) -> bytes:
    """Little-endian bytes, grouped by significance: the mostly empty high ones then compress to nothing."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(b: bytes, width: int = 8) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8").astype(np.uint64)
