"""Hashes of words and of word windows of many texts at once, in NumPy."""

from __future__ import annotations

import numpy as np

#: Fixed by the task: ASCII white space separates words.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are hashed at once.
PIECE = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def release() -> None:
    """Hand freed memory back to the system; later stages run in the same Python workers."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, PIECE + 1), base, np.uint64)
        held[0] = 1
        held = _powers[int(base)] = np.cumprod(held, dtype=np.uint64)
    return held[:n]


def _hash_piece(b: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_BLANK[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if lower:
        b = _LOWER[b]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power(_BASE, len(b)), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INVERSE, len(b) + 1)[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64))


def word_hashes(blob: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a text of any length; A-Z count as a-z if ``lower``."""
    b = np.frombuffer(blob, np.uint8)
    found, at = [], 0
    while at < len(b):
        end = min(len(b), at + PIECE)
        if end < len(b):
            blanks = np.flatnonzero(_BLANK[b[at:end]])
            while not len(blanks) and end < len(b):  # a word longer than a piece
                lo, end = end, min(len(b), end + PIECE)
                blanks = np.flatnonzero(_BLANK[b[lo:end]]) + (lo - at)
            if len(blanks):
                end = at + int(blanks[-1]) + 1
        s, h = _hash_piece(b[at:end], lower)
        found.append((s + at, h))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([s for s, _ in found]), np.concatenate([h for _, h in found])


def blocks(texts: list[str | None], size: int = PIECE):
    """Indices of texts in runs of about ``size`` characters."""
    run, held = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        held += len(t or "")
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def words_of(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts, one after another, and where each text's words begin (one entry more than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    starts, h = word_hashes(b"\n".join(raw), lower)
    return h, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; a text of fewer words has them all as one, an empty one none."""
    h, at = words_of(texts)
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            s = s * _STEP + h[j : len(h) - k + 1 + j]
        s = mix(s)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            part = np.sort(s[a : b - k + 1])
            keep = np.empty(len(part), bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            out.append(part[keep])
        elif n:
            one = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    one = one * _STEP + x
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(h[:0])
    return out


#: ASCII letters and all bytes of characters beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Letters:
    """The runs of letters of several texts, lower-cased: their places, hashes and where each text's runs begin."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        self.b = np.frombuffer(b"\n".join(raw), np.uint8)
        edge = np.diff(_LETTER[self.b].astype(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.at = np.searchsorted(self.starts, np.cumsum([0] + [len(r) + 1 for r in raw]))
        self.total = np.zeros(len(self.b) + 1, np.uint64)
        np.cumsum(_BYTE[self.b] * _power(_BASE, len(self.b)), out=self.total[1:])
        self.back = _power(_INVERSE, len(self.b) + 1)

    def hashes(self) -> np.ndarray:
        """The hash of every run."""
        h = (self.total[self.ends] - self.total[self.starts]) * self.back[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))

    def prefix_hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which runs have more than n bytes, and the hashes of their first n."""
        long = np.flatnonzero(self.ends - self.starts > n)
        s = self.starts[long]
        return long, mix((self.total[s + n] - self.total[s]) * self.back[s] + np.uint64(1000 + n))

    def spelling(self, runs: np.ndarray) -> str:
        return bytes(self.b[self.starts[runs] : self.ends[runs]]).decode("utf-8", "replace")
