"""Words and shingles of whole Arrow batches as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about this many bytes (a longer text is a run by itself).
RUN_BYTES, RUN_TEXTS = 1_000_000, 1000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence: that of ``a``, then ``b``."""
    return mixed(a * _U(0xD6E8FEB86659FD93) + b)


def _power(name: str, base: int, n: int) -> np.ndarray:
    """The first powers of ``base``; those for runs are kept, those for longer texts are not."""
    if len(_powers[name]) >= n:
        return _powers[name][:n]
    size = 1 << (n - 1).bit_length()
    out = np.full(size, base, _U)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if size <= 1 << 20:
        _powers[name] = out
    return out[:n]


@dataclass
class Words:
    """Words of some texts: ``hashes``, and where they start and end in ``data`` (bytes); the words
    of text i are first[i]:first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of a text column of bounded bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    at = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and (total + n > RUN_BYTES or i - at >= RUN_TEXTS):
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Words by the six ASCII white-space characters; null is a text without words."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    if lower:
        data = _LOWER[data]
    offsets = offsets - offsets[0]
    n = len(data)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)  # a text begins or ends here
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:n]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    up = _power("up", _BASE, n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTES[data] * up[:n], out=sums[1:])
    down = _power("down", pow(_BASE, -1, 1 << 64), n + 1)
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of all shingles; a text with fewer words is one shingle, without words none."""
    h, first, counts = words.hashes, words.first, words.counts
    whole = np.flatnonzero(counts >= width)
    n = len(h)
    if n < width:
        owner, out = np.zeros(0, np.int64), np.zeros(0, _U)
    else:
        m = n - width + 1
        out = h[:m]
        for k in range(1, width):
            out = joined(out, h[k:m + k])
        spread = words.owner
        inside = spread[:m] == spread[width - 1:]
        owner, out = spread[:m][inside], out[inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short) == 0:
        return owner, out
    few = []
    for i in short.tolist():
        x = h[first[i]:first[i] + 1]
        for k in range(first[i] + 1, first[i + 1]):
            x = joined(x, h[k:k + 1])
        few.append(mixed(x ^ _U(0x5851F42D4C957F2D + int(counts[i])))[0])
    owner, out = np.concatenate([owner, short]), np.concatenate([out, np.array(few, _U)])
    order = np.argsort(owner, kind="stable")
    return owner[order], out[order]


def distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of shingles, sorted by owner and hash."""
    if len(hashes) == 0:
        return owner, hashes
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], hashes[keep]
