"""Word and shingle hashes of whole texts, vectorised over a batch.

A word is hashed as a polynomial over random byte values modulo 2^64, taken from one running sum, so
no Python object is made for a word. A shingle combines the hashes of consecutive words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}

# Lower-cases A-Z and makes each of the six ASCII white-space bytes a blank.
PLAIN = bytes(32 if c in (32, 9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))
# As PLAIN, and every other ASCII character that is no letter or digit is a blank too.
ALNUM = bytes(
    c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tables():
    if not _TABLES:
        seeds = mixed(np.arange(1, 513, dtype=np.uint64) * np.uint64(_BASE))
        values = seeds[:256].copy()
        values[32] = 0
        power = np.full(BLOCK + 2, _BASE, dtype=np.uint64)
        power[0] = 1
        inverse = np.full(BLOCK + 2, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        _TABLES.update(
            values=values, power=np.cumprod(power), inverse=np.cumprod(inverse), step=seeds[256:] | np.uint64(1)
        )
    return _TABLES


def _hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a block that begins and ends with a blank."""
    t = _tables()
    a = np.frombuffer(block, dtype=np.uint8)
    blank = a == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    if len(block) <= BLOCK:
        run = np.cumsum(t["values"][a] * t["power"][: len(a)])
        raw = (run[end - 1] - run[start - 1]) * t["inverse"][start]
    else:  # a word longer than the block: its bytes are summed piece by piece
        raw = np.array([_long_word(a[s:e]) for s, e in zip(start, end)], dtype=np.uint64)
    return mixed(raw), start


def _long_word(a: np.ndarray) -> int:
    t, total, shift = _tables(), 0, 1
    for at in range(0, len(a), BLOCK):
        piece = a[at : at + BLOCK]
        total += shift * int((t["values"][piece] * t["power"][: len(piece)]).sum(dtype=np.uint64))
        shift = shift * int(t["power"][BLOCK]) % (1 << 64)
    return total % (1 << 64)


def _blocks(text: bytes):
    """A text in pieces cut at blanks."""
    at = 0
    while at < len(text):
        stop = at + BLOCK - 2
        if stop < len(text):
            cut = text.rfind(b" ", at, stop)
            stop = cut if cut > at else (text.find(b" ", stop) if text.find(b" ", stop) >= 0 else len(text))
        yield b" " + text[at:stop] + b" "
        at = stop + 1 if stop < len(text) else stop


def words_of(texts: list[bytes], table: bytes = PLAIN):
    """Yields (first text, word hashes, bounds): text first + i has the words bounds[i]:bounds[i + 1]."""
    i = 0
    while i < len(texts):
        if len(texts[i]) + 2 > BLOCK:
            parts = [_hashes(b)[0] for b in _blocks(texts[i].translate(table))]
            words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield i, words, np.array([0, len(words)])
            i += 1
            continue
        j, total = i, 1
        while j < len(texts) and total + len(texts[j]) + 1 <= BLOCK:
            total += len(texts[j]) + 1
            j += 1
        joined = (b" " + b" ".join(texts[i:j]) + b" ").translate(table)
        at = np.cumsum([1] + [len(x) + 1 for x in texts[i:j]])
        words, start = _hashes(joined)
        yield i, words, np.searchsorted(start, at)
        i = j


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` words; the whole sequence as one where there are fewer."""
    n = len(words)
    if n == 0:
        return words
    w = min(n, width)
    step = _tables()["step"]
    total = words[: n - w + 1] * step[0]
    for k in range(1, w):
        total = total + words[k : n - w + 1 + k] * step[k]
    return mixed(total + np.uint64(w))
