import hashlib
import random
import re

import numpy as np
import pytest

from barloom.llm import exact_dedup, near_dedup, words
from tests.llm.helpers import AWKWARD, DOCS, clashing, docs


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_word_hashes_tell_words_apart_and_blocks_do_not_matter(monkeypatch):
    texts = [b"a b  c\ta", b"", b" The the\x0bTHE ", b"x" * 300 + b" y", b"ab ba aab aba"]
    whole = {}
    for first, got, bounds in words.words_of(texts):
        for i in range(len(bounds) - 1):
            whole[first + i] = got[bounds[i] : bounds[i + 1]].tolist()
    by_word = {}
    for i, t in enumerate(texts):
        split = t.lower().split()
        assert len(split) == len(whole[i])
        for w, h in zip(split, whole[i]):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(words, "BLOCK", 24)
    monkeypatch.setattr(words, "_TABLES", {})
    small = {}
    for first, got, bounds in words.words_of(texts):
        for i in range(len(bounds) - 1):
            small[first + i] = got[bounds[i] : bounds[i + 1]].tolist()
    assert small == whole


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_labels_equal_brute_force(spark, counters):
    r = random.Random(3)
    rows = AWKWARD + [(100 + i, r.choice(["hot  text", "hot\ttext", f"text {r.randrange(12)}"])) for i in range(300)]
    got = _rows(exact_dedup.exact_labels(clashing(docs(spark, rows)), counters=counters))
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
        groups.setdefault(digest, []).append(i)
    for digest, ids in groups.items():
        own = [g for g in got if g[4] == digest]
        known = [i for i in ids if i is not None]
        assert {g[1] for g in own} == {min(known) if known else None}
        assert {g[2] for g in own} == {len(ids)} and sorted(map(str, (g[0] for g in own))) == sorted(map(str, ids))
        assert [g[0] for g in own if g[3]] == [min(known) if known else None]


def test_heavy_digests_are_few_and_complete(spark):
    rows = [(i, f"t{i % 7}" if i % 2 else "hot") for i in range(400)]
    tagged = docs(spark, rows).selectExpr("text as digest", "struct(doc_id is null as none, doc_id, doc_id as row) as place")
    got = {r.digest: r.group_size for r in exact_dedup.heavy_digests(tagged, 4).collect()}
    assert got["hot"] == 200 and len(got) <= 4


def test_without_copies_keeps_one_row_and_all_columns(spark):
    table = clashing(docs(spark, AWKWARD))
    got = exact_dedup.without_copies(table)
    assert got.columns == table.columns
    texts = [re.sub(r"\s+", " ", r.text or "") for r in got.collect()]
    assert sorted(texts) == sorted({re.sub(r"\s+", " ", t or "") for _, t in AWKWARD})
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.without_copies(empty).count() == 0 and exact_dedup.exact_labels(empty).count() == 0


def _near_brute(rows):
    sets, ids = [], []
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m.group().lower(), t or "").split()
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        sets.append(s)
        ids.append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return {(ids[k], len(sets[k]), low.get(find(k), ids[k]) if sets[k] else ids[k]) for k in range(len(rows))}


@pytest.mark.parametrize("region", [8, 512])
def test_near_labels_equal_brute_force(spark, region):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = list(AWKWARD)
    for i in range(60):  # a crowd of near copies: each close to the base, many not to each other
        copy = list(base)
        for _ in range(r.randrange(1, 5)):
            copy[r.randrange(120)] = word()
        rows.append((1000 + i, " ".join(copy)))
    for i in range(12):  # pairs about the threshold
        one = [word() for _ in range(60)]
        two = list(one)
        for _ in range(r.randrange(0, 4)):
            two[r.randrange(60)] = word()
        rows += [(2000 + 2 * i, " ".join(one)), (2001 + 2 * i, " ".join(two).upper())]
    got = near_dedup.near_labels(clashing(docs(spark, rows)), region=region).collect()
    assert len(got) == len(rows)
    assert {(g.doc_id, g.n_shingles, g.component_id) for g in got} == _near_brute(rows)
    assert all(g.kept == (g.doc_id == g.component_id) for g in got)


def test_near_copies_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_dedup.near_labels(empty).count() == 0 and near_dedup.without_near_copies(empty).columns == empty.columns


def test_without_near_copies_drops_rows_not_ids(spark):
    base = [f"word{k}" for k in range(60)]
    near, other = " ".join([*base[:-1], "last"]), " ".join(f"other{k}" for k in range(60))
    rows = AWKWARD + [
        (10, " ".join(base)), (None, near), (None, other), (None, "a clean text without an id of its own"),
        (11, near), (11, "another clean text that shares the id eleven"), (11, None), (12, other), (12, other), (13, other),
    ]
    table = clashing(docs(spark, rows))
    got = near_dedup.without_near_copies(table)
    assert got.columns == table.columns

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def linked(t, u):
        both = len(grams(t) & grams(u))
        return both and 100 * both >= 75 * len(grams(t) | grams(u))

    want = [(i, t) for i, t in rows if not any(linked(t, u) and d is not None and (i is None or d < i) for d, u in rows)]
    assert len(rows) - len(want) == 5
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_components_of_a_path_and_a_star(spark):
    key = lambda i: bytes([0, i])
    links = [(key(i), key(i + 1)) for i in range(9)] + [(key(40), key(40 + i)) for i in range(1, 9)]
    got = near_dedup.components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert {(bytes(g.key)[1], bytes(g.root)[1]) for g in got} == {(i, 0) for i in range(1, 10)} | {(40 + i, 40) for i in range(1, 9)}


def test_signatures_estimate_similarity():
    by, rng = near_dedup._coefficients(), np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = np.unique(pool[:900]), np.unique(pool[100:])
    x, y = (np.frombuffer(near_dedup.signature(s, by), ">u2") for s in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.15
