"""Words of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of a word up to which sums of powers tell words apart; two letters in turns as of Thue and Morse would meet from 1,024 on.
_PLAIN = 256
_powers = {"p": np.ones(1, U), "q": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        for name, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["p"][:n], _powers["q"][:n]


def chunks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together, at least one text each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of other characters than ASCII white space) of all texts in
    order, and where each text's words begin, with the end after the last."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    p, q = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * p[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * q[starts])
    for i in np.flatnonzero(ends - starts > _PLAIN).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    offsets = np.cumsum([0] + [len(x) + 1 for x in parts])
    return hashes, np.searchsorted(starts, offsets)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n words."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, U)
    for i in range(n):
        out = out * U(0xD6E8FEB86659FD93) + words[i : i + count]
    return mix(out)
