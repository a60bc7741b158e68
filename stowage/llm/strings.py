"""Runs of bytes inside long byte strings, found and hashed in numpy without a Python object for each."""

from __future__ import annotations

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of bytes; they hang on the bytes and the length alone."""
    power, inverse = powers(len(flat))
    sums = np.empty(len(flat) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    return mix((sums[starts + sizes] - sums[starts]) * inverse[starts] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def words(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs without white space."""
    blank = np.empty(len(flat) + 2, bool)
    blank[0] = blank[-1] = True
    blank[1:-1] = BLANK[flat]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def pieces_of(text: bytes, most: int) -> list[bytes]:
    """``text`` cut after white space into parts of about ``most`` bytes; a longer run without white space stays whole."""
    out, at = [], 0
    while len(text) - at > most:
        part = np.frombuffer(text, np.uint8, offset=at + most)
        found = np.flatnonzero(BLANK[part[: 1 << 16]])
        if not len(found):
            found = np.flatnonzero(BLANK[part])
        if not len(found):
            break
        cut = at + most + int(found[0]) + 1
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


CHUNK_BYTES = 1 << 19


def word_hashes_all(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's words: A-Z lower-cased, split at ASCII white space. Long texts are read in parts."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    raw, group, held = [], [], 0

    def flush() -> None:
        nonlocal raw, group, held
        flat = LOWER[np.frombuffer(b"\n".join(raw), np.uint8)]
        starts, sizes = words(flat)
        hashes = run_hashes(flat, starts, sizes)
        ends = np.searchsorted(starts, np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))).tolist()
        begin = 0
        for k, end in zip(group, ends, strict=True):
            out[k].append(hashes[begin:end])
            begin = end
        raw, group, held = [], [], 0

    for k, text in enumerate(texts):
        for part in pieces_of((text or "").encode("utf-8", "surrogatepass"), CHUNK_BYTES):
            raw.append(part)
            group.append(k)
            held += len(part)
            if held >= CHUNK_BYTES:
                flush()
    if raw:
        flush()
    return [p[0] if len(p) == 1 else np.concatenate(p) for p in out]
