"""Byte-pair encoding and decoding, with tree concatenation for long text.

A text above LEAF characters is halved, at any character, until its parts are leaves; leaves are encoded
by themselves and put together again by text, as in a binary tree. The leaves of a text above LONG bytes
are rows of their own, so other tasks encode them. A join is exact:

* The vocabulary's pattern splits text from left to right and never looks back, so from a border of the
  left half that later text cannot move, and until a border that is also one of the right half, the two
  halves' text is split anew. The window around the join grows until it shows both borders; tokens
  before the first and after the second stay.
* A match that lies over the join (unsplit text, without end perhaps) is joined by its tokens: the last
  of the left and the first of the right half are decoded and encoded anew in a window that grows until
  its first token is the left half's and its last the right half's. A token sequence is the encoding of
  its bytes if each adjacent pair of tokens is the encoding of the pair's bytes; every pair of the
  joined sequence is a pair of one of the three encodings.

The strings of added tokens become their ids first, as the tokenizers library does by default.

Edge cases: null and empty texts have no tokens; a text cut into leaves is told from an equal one by a
row number, so repeated rows and null ids do no harm; an empty table gives no rows; other columns are
ignored. Texts hold whole characters, so decoding gives them back.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import column, documents, filled, mapped, small_batches

LONG = 64 << 10
LEAF = 4 << 10
WINDOW = 8
# Characters on each side of a join that are looked at first.
AROUND = 48
# Characters behind a match that can still change it: two, of a contraction; one more to be sure.
BEHIND = 3
VOCABULARY = "byte_bpe_50k.json"

# The characters with the property White_Space.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")


def _stretches(text: str):
    """The text cut before and after all but the last blank of each run of blanks, and not inside a
    run that ends the text: so the pattern needs no look-ahead."""
    at = 0
    for run in _RUN.finditer(text):
        last = run.end() if run.end() == len(text) else run.end() - 1
        yield text[at : run.start()]
        yield text[run.start() : last]
        at = last
    yield text[at:]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in vocabularies of this kind: bytes that are visible in
    Latin-1 stand for themselves, the others follow from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def little_endian(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encoder and decoder of one vocabulary file, made once in a worker."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], _byte_of()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        special = set(self.added.values())
        ids = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i not in special}
        self.bytes = [b""] * (max([*ids.values(), *special]) + 1)
        for raw, i in ids.items():
            self.bytes[i] = raw
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        self.split_added = (
            re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
            if self.added else None
        )
        # The merge order is the order of ids here, so the rank encoder gives the same tokens; it is
        # checked once against the tokenizers library, which is used, and kept, only if it differs.
        import public_tokenizers

        # Without the look-ahead the pattern is faster; _stretches makes up for it.
        simple = public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", "")
        self.ranked = tiktoken.Encoding("simple", pat_str=simple, mergeable_ranks=ids, special_tokens={})
        reference = Tokenizer.from_file(path)
        self._splitter = reference.pre_tokenizer
        probe = "Don't stop  the naïve 12345 \n\n über-ﬁne   tests, 'll we?\t ñandú…  \u3000\u3000x\x1c\x1c y \n"
        self.reference = None
        if self._plain(probe) != reference.encode(probe, add_special_tokens=False).ids:
            self.reference = reference

    def _plain(self, text: str) -> list[int]:
        if self.reference is not None:
            return self.reference.encode(text, add_special_tokens=False).ids
        if not _RUN.search(text):
            return self.ranked.encode_ordinary(text)
        return [i for part in _stretches(text) for i in self.ranked.encode_ordinary(part)]

    def encode(self, text: str) -> list[int]:
        if self.split_added and any(t in text for t in self.added):
            out: list[int] = []
            for part in self.split_added.split(text):
                if part in self.added:
                    out.append(self.added[part])
                elif part:
                    out += self._plain(part)
            return out
        return self._plain(text)

    def borders(self, text: str, start: int = 0, whole: bool = True) -> list[int]:
        """Where the pattern's matches end from `start` on; only those that no text behind moves, if the
        text goes on."""
        ends = [start + e for _, (_, e) in self._splitter.pre_tokenize_str(text[start:])]
        return ends if whole else [e for e in ends if e <= len(text) - BEHIND]

    def merge(self, raw: bytes) -> list[int]:
        """The tokens of bytes that the pattern does not split."""
        return self.ranked._encode_single_piece(raw) if raw else []

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def raw(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def join_tokens(left: list[int], right: list[int], c: Codec, window: int = WINDOW) -> list[int]:
    """The tokens of two adjoining stretches of unsplit text, from the tokens of each."""
    if not left or not right:
        return left + right
    reach = window
    while True:
        a, b = max(0, len(left) - reach), min(len(right), reach)
        new = c.merge(c.raw(left[a:]) + c.raw(right[:b]))
        agree_left = a == 0 or new[0] == left[a]
        agree_right = b == len(right) or new[-1] == right[b - 1]
        # One token over the whole window would have no pair of its own to vouch for a side.
        if agree_left and agree_right and (len(new) > 1 or (a == 0 and b == len(right))):
            return left[:a] + new + right[b:]
        reach *= 2


def concat_tree(parts: list[list[int]], c: Codec, window: int = WINDOW) -> list[int]:
    while len(parts) > 1:
        parts = [
            join_tokens(parts[i], parts[i + 1], c, window) if i + 1 < len(parts) else parts[i]
            for i in range(0, len(parts), 2)
        ]
    return parts[0] if parts else []


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _first(ids: list[int], size: int, c: Codec) -> int:
    """How many of the first tokens hold `size` bytes."""
    n = 0
    while size > 0:
        size -= len(c.bytes[ids[n]])
        n += 1
    return n


def _last(ids: list[int], size: int, c: Codec) -> int:
    """How many of the last tokens hold `size` bytes."""
    n = 0
    while size > 0:
        n += 1
        size -= len(c.bytes[ids[-n]])
    return n


def _fixed_border(text: str, least: int) -> int:
    """A border of the last `least` characters that text around them cannot move, or 0: one before a
    blank between two characters that are not white."""
    at = len(text) - 1
    while at > max(1, len(text) - least):
        at = text.rfind(" ", max(1, len(text) - least), at)
        if at < 0:
            return 0
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
    return 0


def join_texts(left: tuple[str, list[int]], right: tuple[str, list[int]], c: Codec,
               around: int = AROUND) -> tuple[str, list[int]]:
    """Two adjoining texts with their tokens as one text with its tokens."""
    (a, left_ids), (b, right_ids) = left, right
    if not a or not b:
        return a + b, left_ids + right_ids
    reach, keep = around, 0
    while True:
        keep = keep or _fixed_border(a, reach)
        if keep or reach >= len(a):
            whole = reach >= len(b)
            tail, ahead = a[keep:], b[:reach]
            own = {0, *c.borders(ahead, 0, whole)}
            new = c.borders(tail + ahead, 0, whole)
            stop = next((i for i, e in enumerate(new) if e - len(tail) in own), None)
            if stop is not None:
                break
        reach *= 2
    new = new[: stop + 1]
    taken = new[-1] - len(tail)
    head = left_ids[: len(left_ids) - _last(left_ids, _size(tail), c)]
    middle_left = left_ids[len(head) :]
    used = _first(right_ids, _size(b[:taken]), c)
    window, middle, start = tail + ahead, [], 0
    for end in new:
        over = end - len(tail)
        if start < len(tail) < end and end - start > around and over in own and (
            c.borders(tail[start:])[0] == len(tail) - start and c.borders(ahead[:over])[0] == over
        ):
            x = middle_left[len(middle_left) - _last(middle_left, _size(tail[start:]), c) :]
            y = right_ids[: _first(right_ids, _size(b[:over]), c)]
            middle += join_tokens(x, y, c)
        else:
            middle += c.merge(window[start:end].encode())
        start = end
    return a + b, head + middle + right_ids[used:]


def halved(text: str, leaf: int = LEAF) -> list[str]:
    """The text cut in halves until no part is above `leaf` characters, in order; neighbours are halves
    of one part, as join_tree joins them."""
    parts = 1
    while -(-len(text) // parts) > leaf:
        parts *= 2
    cuts = [len(text) * i // parts for i in range(parts + 1)]
    return [text[i:j] for i, j in zip(cuts, cuts[1:])]


def join_tree(nodes: list[tuple[str, list[int]]], c: Codec, around: int = AROUND) -> list[int]:
    while len(nodes) > 1:
        nodes = [
            join_texts(nodes[i], nodes[i + 1], c, around) if i + 1 < len(nodes) else nodes[i]
            for i in range(0, len(nodes), 2)
        ]
    return nodes[0][1] if nodes else []


def leaves(text: str, c: Codec, leaf: int = LEAF):
    """Yields (run, kind, leaf): strings of added tokens, and the leaves of the runs between them."""
    for run, part in enumerate(c.split_added.split(text) if c.split_added else [text]):
        if part in c.added:
            yield run, "added", part
        elif part:
            for piece in halved(part, leaf):
                yield run, "text", piece


def tree_encode(text: str, c: Codec, leaf: int = LEAF, around: int = AROUND) -> list[int]:
    """The tokens of a whole text through its leaves, in one task."""
    if len(text) <= leaf:
        return c.encode(text)
    return _joined([(r, k, p, c.encode(p)) for r, k, p in leaves(text, c, leaf)], c, around)


def _joined(encoded, c: Codec, around: int = AROUND) -> list[int]:
    """Joins the runs of one text from rows (run, kind, leaf, ids) in order."""
    out: list[int] = []
    for _, rows in groupby(encoded, key=lambda row: row[0]):
        out += join_tree([(piece, ids) for _, _, piece, ids in rows], c, around)
    return out


def _leaf_rows(path: str, leaf: int):
    def run(batches):
        import pyarrow as pa

        c = codec(path)
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("run", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("leaf", pa.string())])
        for batch in small_batches(batches, "text"):
            for row, doc, text in zip(*(batch.column(n).to_pylist() for n in ("row", "doc_id", "text"))):
                out = [
                    {"row": row, "doc_id": doc, "run": r, "seq": seq, "kind": kind, "leaf": piece}
                    for seq, (r, kind, piece) in enumerate(leaves(text, c, leaf))
                ]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _encode_leaves(path: str):
    def run(batches):
        import pyarrow as pa

        c = codec(path)
        for batch in batches:
            out = [little_endian(c.encode(leaf)) for leaf in batch.column("leaf").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("row", "doc_id", "run", "seq", "kind")), pa.array(out, pa.binary())],
                ["row", "doc_id", "run", "seq", "kind", "ids"],
            )

    return run


def _join_leaves(path: str, finish):
    """Joins the leaves of one text and finishes it; a group is the tokens of a single text."""

    def run(pdf):
        import pandas as pd

        c = codec(path)
        pdf = pdf.sort_values("seq")
        stored = [np.frombuffer(b, dtype="<u4").tolist() for b in pdf["ids"]]
        # The tokens of a leaf hold its text.
        rows = [(r, k, c.decode(ids), ids) for r, k, ids in zip(pdf["run"], pdf["kind"], stored)]
        return pd.DataFrame(finish(c, pdf["row"].iloc[0], pdf["doc_id"].iloc[0], _joined(rows, c)))

    return run


def _encode_rows(path: str, finish, schema, leaf: int):
    def run(batches):
        import pyarrow as pa

        c = codec(path)
        for batch in small_batches(batches, "text"):
            out = []
            for row, doc, text in zip(*(batch.column(n).to_pylist() for n in ("row", "doc_id", "text"))):
                out += finish(c, row, doc, tree_encode(text, c, leaf))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def tokenized(docs: DataFrame, finish, fields: dict[str, str], id_col: str = "doc_id", text_col: str = "text",
              path: str | None = None, long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """Encodes every text and returns the rows that finish(codec, row number, doc_id, ids) makes of it.

    `fields` names the columns of these rows: long, string or binary.
    """
    import pyarrow as pa

    path = path or vocabulary_path()
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in fields.items()])
    ddl = ", ".join(f"{n} {k}" for n, k in fields.items())
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        column(docs, id_col).cast("long").alias("doc_id"),
        filled(column(docs, text_col)).alias("text"),
    )
    short = mapped(rows.where(F.octet_length("text") <= long), _encode_rows(path, finish, arrow, leaf), ddl)
    cut = mapped(
        rows.where(F.octet_length("text") > long), _leaf_rows(path, leaf),
        "row long, doc_id long, run long, seq long, kind string, leaf string",
    )
    encoded = mapped(
        cut.repartition("row", "seq"), _encode_leaves(path),
        "row long, doc_id long, run long, seq long, kind string, ids binary",
    )
    return short.unionByName(encoded.groupBy("row").applyInPandas(_join_leaves(path, finish), ddl))


def _digests(c: Codec, row, doc, ids) -> list[dict]:
    stored = little_endian(ids)
    return [{
        "doc_id": None if doc is None or doc != doc else int(doc), "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(stored).hexdigest(),
        "decoded_sha256": hashlib.sha256(c.decode(np.frombuffer(stored, "<u4").tolist()).encode()).hexdigest(),
    }]


def op5_bpe(spark, sf_dir):
    return tokenized(
        documents(spark, sf_dir), _digests,
        {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"},
    )


ORACLE: dict[str, str] = {}
