"""Periodic runs of words: online dyadic square catching.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at
least `max(least, 2 * q)` words that no neighbouring word extends.

Method. Words are appended to a stream. Whenever a block of b = 1, 2, 4, ... words at a multiple of b
is complete, a catcher waits there for the squares whose period lies in [2b, 4b) (for b = 1 in [1, 4)).
Each appended word completes one window of b words, the last b of the stream, at every level; the two
catchers whose periods fit compare it with their block (three at the lowest level). A match means that
the words around the block come again q later: the suffixes before the block and the words after the
window are compared further, and where q equal words stand in a row, a square is reported. A run of
period q has a block of its level among its first words, so no square is missed. A catcher stays silent
where the catcher before it has matched at the same distance; so a long run is reported once a distance,
not once a word. Squares with the same ends are the same run, whose period is the smallest reported.

The words of a batch of texts are appended together, level by level, in numpy: the comparisons are those
above, two a word and level, so n words cost about 2 n log n. Windows are compared by 64-bit names, made
of the names of their halves; the lengths of equal stretches by differences of one running polynomial.
Both find every true equality. Every run is then compared byte by byte; if names have ever coincided, the
text is done again with word numbers, stretch by stretch.

Texts are independent, so there is no shuffle. A task holds a batch of about one megabyte of text, or one
longer text whole: about sixty bytes a word.

Edge cases: a null or empty text, or one of blanks only, has no run and collapses to the empty text. Any
bytes but the six ASCII blanks are part of words. Rows are independent: null and repeated ids, ties and
extra columns pass through; new columns take a free name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import documents, free_name, mapped, small_batches, utf8
from barloom.llm.words import _blocks, mixed, words_of

LEAST = 12
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
# Each of the six ASCII white-space bytes becomes a blank; all else stays.
BLANKS = bytes(32 if c in (32, 9, 10, 11, 12, 13) else c for c in range(256))
_ODD = np.uint64(0x9FB21C651E98DF25)
_SPLIT = np.uint64(0xD1B54A32D192ED03)


def plain(text: bytes) -> bytes:
    """The words of a text, one blank behind each; cut into pieces so that long texts stay cheap."""
    parts = (piece.split() for piece in _blocks(text.translate(BLANKS)))
    return b"".join(b" ".join(words) + b" " for words in parts if words)


def word_starts(text: bytes) -> np.ndarray:
    """Start of each word of a plain text, and the end."""
    ends = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32) + 1
    return np.concatenate([[0], ends])


class _Stream:
    """Appended words, and whether stretches of them are equal."""

    def __init__(self, words: np.ndarray, exact: bool):
        self.words, self.exact = words, exact
        if not exact:
            power = np.full(len(words) + 1, _ODD)
            power[0] = 1
            self.power = np.cumprod(power)
            self.sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * self.power[:-1], out=self.sums[1:])

    def same(self, i: np.ndarray, t: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the `length` words from i are those from t."""
        if self.exact:
            w = self.words
            return np.array(
                [np.array_equal(w[a : a + n], w[b : b + n]) for a, b, n in zip(i, t, length)], dtype=bool
            )
        s = self.sums
        return (s[i + length] - s[i]) * self.power[t - i] == s[t + length] - s[t]

    def reach(self, i: np.ndarray, t: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, at most `most`, are equal behind (or before) i and t, by halving."""
        low, high = np.zeros_like(i), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            shift = middle if back else 0
            equal = self.same(i[open_] - shift, t[open_] - shift, middle)
            low[open_] = np.where(equal, middle, low[open_])
            high[open_] = np.where(equal, high[open_], middle - 1)


def squares(words: np.ndarray, longest: int, least: int, exact: bool = False):
    """Stretches (start, end, period) found by the catchers; no text holds more than `longest` words."""
    stream, names, n, b = _Stream(words, exact), words, len(words), 1
    found = []
    while (1 if b == 1 else 2 * b) * 2 <= longest:
        first = 1 if b == 1 else 2 * b
        blocks = np.repeat(names[::b], b)
        for r in range((4 * b - first) // b):
            start = first + r * b
            if start >= len(names):
                break
            hit = np.flatnonzero(names[start:] == blocks[: len(names) - start])
            i, t = hit // b * b, hit + start
            told = i >= b
            told[told] = names[i[told] - b] == names[t[told] - b]
            i, t = i[~told], t[~told]
            if not len(i):
                continue
            q = t - i
            left = stream.reach(i, t, np.minimum(i, b - 1), back=True)
            # q equal words in a row make the square; a short period needs more of them.
            asked = np.maximum(np.maximum(least - q, q) - left, b)
            keep = t + asked <= n
            i, t, q, left, asked = (x[keep] for x in (i, t, q, left, asked))
            keep = stream.same(i, t, asked)
            i, t, q, left = (x[keep] for x in (i, t, q, left))
            if len(i):
                right = stream.reach(i, t, n - t, back=False)
                found.append(np.stack([i - left, t + right, q]))
        if 2 * b > n:
            break
        names = mixed(names[: n - 2 * b + 1] + _SPLIT * mixed(names[b : n - b + 1] + np.uint64(b)))
        b *= 2
    return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)


def _merged(found: np.ndarray) -> np.ndarray:
    """One run for squares with the same ends: that with the smallest period. By start, then period."""
    start, end, period = found[:, np.lexsort((found[2], found[1], found[0]))]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    return np.stack([start, end, period])[:, np.lexsort((period, start))]


def _true(text: bytes, starts: np.ndarray, runs: np.ndarray) -> bool:
    return all(text[starts[s] : starts[e - q]] == text[starts[s + q] : starts[e]] for s, e, q in runs.T)


def runs_of(texts: list[bytes], least: int = LEAST) -> Iterator[np.ndarray]:
    """For each plain text its runs: rows start, end, period; a column a run, by start, then period."""
    for first, words, bounds in words_of(texts, BLANKS):
        counts = np.diff(bounds)
        # A word that occurs nowhere else parts the texts.
        marks = mixed(np.arange(1, len(counts) + 1, dtype=np.uint64) * _SPLIT)
        stream = np.insert(words, bounds[1:], marks)
        at = bounds[:-1] + np.arange(len(counts))
        found = squares(stream, int(counts.max(initial=0)), least)
        owner = np.searchsorted(at, found[0], "right") - 1
        for k in range(len(counts)):
            runs = _merged(found[:, owner == k] - np.array([[at[k]], [at[k]], [0]]))
            if runs.shape[1]:
                text = texts[first + k]
                if not _true(text, word_starts(text), runs):
                    numbers: dict[bytes, int] = {}
                    own = np.array([numbers.setdefault(w, len(numbers)) for w in text.split()], np.uint64)
                    runs = _merged(squares(own, len(own), least, exact=True))
            yield runs


def collapsed(text: bytes, runs: np.ndarray) -> bytes:
    """The words in no run, or among the first period's words of every run they are in."""
    if not runs.shape[1]:
        return text[:-1]
    starts = word_starts(text)
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, runs[0] + runs[2], 1)
    np.add.at(depth, runs[1], -1)
    keep = np.cumsum(depth)[: len(starts) - 1] == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    return b"".join(text[starts[a] : starts[z]] for a, z in edges.reshape(-1, 2))[:-1]


def with_runs(
    df: DataFrame, least: int = LEAST, rewrite: Callable[[bytes, object], bytes] | None = None,
    *, text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """The table with `runs` (start, length, period) and `collapsed`, the text without repetitions.

    `rewrite(plain text, key)` may change a text first. Column names taken get an underscore.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    names = [*df.columns, free_name(df, "runs"), free_name(df, "collapsed")]
    # Plain names while in Python, whatever the table's columns are called.
    inner = [f"c{i}" for i in range(len(names))]
    text_at, key_at = inner[df.columns.index(text)], inner[df.columns.index(key)] if rewrite else None

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in small_batches(batches, text_at, 1 << 20):
            texts = [plain(t) for t in utf8(batch, text_at)]
            if rewrite:
                texts = [rewrite(t, k) for t, k in zip(texts, batch.column(key_at).to_pylist())]
            runs = list(runs_of(texts, least))
            rest = [collapsed(t, r) for t, r in zip(texts, runs)]
            whole = np.concatenate(runs, axis=1)
            offsets = np.cumsum([0] + [r.shape[1] for r in runs])
            fields = [pa.array(x) for x in (whole[0], whole[1] - whole[0], whole[2])]
            listed = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind))
            )
            columns = [*batch.columns, listed, pa.array(rest, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, inner)

    inside = df.toDF(*inner[:-2])
    added = [T.StructField(inner[-2], T._parse_datatype_string(RUN)), T.StructField(inner[-1], T.StringType())]
    return mapped(inside, run, T.StructType([*inside.schema.fields, *added])).toDF(*names)


def planted(text: bytes, key: object) -> bytes:
    """The query's rewriting of a plain text: a tenth of the documents end periodically.

    A row without an id stays as it is.
    """
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, text.count(b" ")
    if key is None or h % 10 or not n:
        return text
    starts, a = word_starts(text), g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    head, unit = text[: starts[a]], text[starts[a] : starts[a + p]]
    return head + unit * whole + text[starts[a] : starts[a + rest]]


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # The longest run; of equal ones that with the smallest start, then period.
    best = F.element_at(
        F.array_sort(
            F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("length")))
        ), 1,
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    found = F.when(F.size("runs") > 0, best)
    return with_runs(docs, rewrite=planted).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        found["start"].alias("start"), found["length"].alias("length"), found["period"].alias("period"),
        F.floor(found["length"] * 1000 / found["period"]).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
