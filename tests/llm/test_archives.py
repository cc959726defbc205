"""WARC archives, periodic runs and whitening against brute force."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from glob import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import periodic, warc, whitening
from tests.llm.helpers import AWKWARD, clashing, docs

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"
AWKWARD_PAGES = [
    (3, "http://a/é?x=1 2#t", "same"), (1, "u\r\nX-Evil: 1", "same"), (2, None, None), (4, "", ""),
    (5, "http://b", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (5, "http://b", "other"), (6, "c", "é☃" * 9000),
    (None, "n", "same"), (None, "n", "lone"), (None, "n", "lone"), (1, "twice", "same"), (7, "d", "\x00\r\n\r\n\r\n"),
]


def expected(pages, least=0):
    out = []
    for key, _, html in pages:
        data = (html or "").encode()
        ids = [k for k, _, h in pages if (h or "").encode() == data and k is not None]
        first = min(ids) if ids and len(data) >= least else key
        refers = None if first == key else first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((key, len(data), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def got_records(spark, path):
    records = warc.read_records(spark, path)
    return sorted(
        (tuple(r) for r in records.select(
            warc._key(F.col("record_id"), "long"), "payload_bytes", "payload_digest", "record_type",
            warc._key(F.col("refers_to"), "long"),
        ).collect()), key=str)


@pytest.mark.parametrize("least, heavy", [(0, 1024), (0, 1), (5, 1024)])
def test_warc_against_brute_force(spark, monkeypatch, least, heavy):
    monkeypatch.setattr(warc, "HEAVY", heavy)
    pages = clashing(spark.createDataFrame(AWKWARD_PAGES, PAGES).repartition(3))
    assert got_records(spark, warc.archived(pages, least)) == expected(AWKWARD_PAGES, least)


def test_warc_files_are_gzip_and_members_stand_alone(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 7}</p>") for i in range(50)], PAGES).coalesce(1)
    raw, path = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write_monolithic(warc.decided(pages), raw)
    (mono,) = glob(f"{raw}/archive=*/*.gz")
    stream = zlib.decompressobj(31)
    whole = stream.decompress(open(mono, "rb").read())
    assert stream.eof and not stream.unused_data and whole.count(b"WARC/1.1\r\n") == 50
    warc.normalise(spark, raw, path)
    (file,) = glob(f"{path}/archive=*/kind=warc/part*")
    data = open(file, "rb").read()
    assert gzip.decompress(data) == whole
    records = warc.read_records(spark, path, payload=True).orderBy("offset").collect()
    assert [r.offset for r in records] == [0, *np.cumsum([r.length for r in records])[:-1].tolist()]
    assert records[-1].offset + records[-1].length == len(data)
    by_id = {r.record_id: r for r in records}
    for r in records:
        piece = gzip.decompress(data[r.offset : r.offset + r.length])
        assert piece.startswith(b"WARC/1.1\r\n") and piece.endswith(b"\r\n\r\n")
        stored = by_id[r.refers_to] if r.refers_to else r
        i = int(r.record_id.rsplit(":", 1)[1])
        assert stored.payload == f"<p>{i % 7}</p>".encode() and (r.payload is None) == (r.record_type == "revisit")


def test_warc_damage_is_found(spark, tmp_path):
    raw = str(tmp_path / "raw")
    warc.write_monolithic(warc.decided(spark.createDataFrame([(1, "u", "text")], PAGES)), raw)
    (mono,) = glob(f"{raw}/archive=*/*.gz")
    record = gzip.decompress(open(mono, "rb").read())
    entry = {"id": "<urn:pages:id:1>"}
    assert warc._read(record, entry)[-1] == b"text"
    with pytest.raises(ValueError):
        warc._read(record.replace(b"text\r\n\r\n", b"tent\r\n\r\n"), entry)
    with pytest.raises(ValueError):
        warc._read(record, {"id": "<urn:pages:id:2>"})
    with pytest.raises(EOFError):
        list(warc._inflated(open(mono, "rb").read()[:-30]))
    with pytest.raises(EOFError):
        list(warc.split_records([record[:-3]]))


def test_records_across_chunks_and_large_members():
    rng = random.Random(5)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.randrange(300))) for _ in range(40)]
    records = [
        b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in bodies
    ]
    stream = b"".join(records)
    for size in (1, 7, 1000, len(stream)):
        assert list(warc.split_records(stream[i : i + size] for i in range(0, len(stream), size))) == records
    assert b"".join(warc._inflated(b"".join(map(warc.member, records)))) == stream
    for size in (0, 1, (1 << 24) - 1, 1 << 24, (1 << 24) + 5):
        piece = warc.member(b"\0" * size)
        assert piece[-1] == 0 and gzip.decompress(piece) == b"\0" * size


def test_op11_on_tables(spark, tmp_path):
    frame = spark.createDataFrame(AWKWARD_PAGES, PAGES)
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((tuple(r) for r in warc.op11_warc(spark, str(tmp_path)).collect()), key=str) == expected(AWKWARD_PAGES)
    frame.limit(0).write.parquet(f"{tmp_path}/empty/pages.parquet")
    empty = warc.op11_warc(spark, f"{tmp_path}/empty")
    assert empty.count() == 0 and empty.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def runs_by_hand(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in out.items())


def collapsed_by_hand(words, runs):
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_against_all_periods():
    rng = random.Random(11)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 6])
            words = [rng.choice("abcdef"[:letters]) for _ in range(n)]
            if n > 5 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 2))
                words = [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]
            texts.append(words)
        least = rng.choice([2, 4, 12])
        plain = [periodic.plain(" \t".join(w).encode()) for w in texts]
        for words, text, runs in zip(texts, plain, periodic.runs_of(plain, least)):
            assert [(s, q, e) for s, e, q in runs.T.tolist()] == runs_by_hand(words, least)
            assert periodic.collapsed(text, runs).decode() == collapsed_by_hand(words, runs_by_hand(words, least))


def test_equal_names_of_different_words_are_found_out(monkeypatch):
    words = ("a b c d e f g h " * 3).split() + ["z"] + ("a b c x e f g h " * 2).split()

    def blind(texts, table):  # a hash that takes d and x for the same word
        for i, t in enumerate(texts):
            ids = np.array([ord(w) if w != "x" else ord("d") for w in t.decode().split()], np.uint64)
            yield i, ids, np.array([0, len(ids)])

    monkeypatch.setattr(periodic, "words_of", blind)
    words[24] = "x"
    text = periodic.plain(" ".join(words).encode())
    right = [(s, e, q) for s, q, e in runs_by_hand(words)]
    (runs,) = periodic.runs_of([text])
    assert [tuple(r) for r in runs.T.tolist()] == right


def op12_by_hand(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_hand(words)
    best = min(((s - e, s, q, e) for s, q, e in runs), default=None)
    four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, q, e in runs)
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed_by_hand(words, runs)))
    return (doc_id, len(runs), *four, *digests)


def test_op12_against_brute_force(spark, tmp_path):
    short = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000")
    extra = docs(spark, [*AWKWARD, (8, "\x1c a\x85b a\xa0b " * 9), (9, "ab " * 700), (10, "a b\n" * 300 + "c")])
    clashing(extra.unionByName(short)).withColumns({"runs": F.lit(1), "collapsed": F.lit(2)}).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((op12_by_hand(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in want) > 10
    assert sorted((tuple(r) for r in periodic.op12_periodic(spark, str(tmp_path)).collect()), key=str) == want


def test_runs_keep_other_columns(spark):
    frame = clashing(docs(spark, AWKWARD)).withColumns({"runs": F.lit("r"), "collapsed": F.lit("c")})
    out = periodic.with_runs(frame)
    assert out.columns == [*frame.columns, "runs_", "collapsed_"]
    assert out.where("runs = 'r' and collapsed = 'c'").count() == len(AWKWARD)
    assert out.where("doc_id = 6").first()["runs_"] == [(0, 2000, 1)]
    assert periodic.with_runs(frame.limit(0)).count() == 0


def test_long_period_in_a_long_text():
    unit = [f"w{i}" for i in range(70_000)]
    words = ["head", *unit, *unit, *unit[:100], "tail"]
    (runs,) = periodic.runs_of([periodic.plain(" ".join(words).encode())])
    assert runs.T.tolist() == [[1, 140_101, 70_000]]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_divide_and_conquer_matches_eigenvalues():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 33):
        b = rng.standard_normal((n, n))
        q = np.linalg.qr(b)[0]
        for a in (b @ b.T, np.eye(n), np.ones((n, n)), q @ np.diag(10.0 ** -np.linspace(0, 12, n)) @ q.T,
                  np.diag(np.r_[np.ones(n // 2), np.zeros(n - n // 2)])):
            a = (a + a.T) / 2
            values, vectors = whitening.components(a, 8)
            scale = max(np.linalg.norm(a), 1e-300)
            assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:8], atol=1e-13 * scale)
            assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale
            assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def check_whitening(rows, vectors):
    """rows of the query against numpy on the usable vectors."""
    x = np.floor(np.asarray(vectors, dtype=np.float32).astype(float) * 1024).astype(int) + 100000
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    z = x - np.array(sums) / n
    values, basis = np.linalg.eigh(z.T @ z / n)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    assert len(rows) == n * min(8, x.shape[1])
    deviation = sorted(sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x)
    for k, e in enumerate(values):
        mine = [r for r in rows if r.component == k + 1]
        assert {r.n for r in mine} == {n} and sorted(r.deviation for r in mine) == deviation
        want = np.sort(np.abs(z @ basis[:, k] / math.sqrt(e)))
        assert np.allclose(np.sort([abs(r.whitened) for r in mine]), want, atol=1e-8)
        assert all(math.isclose(r.explained, e / np.trace(z.T @ z / n), rel_tol=1e-9) for r in mine)
        assert abs(np.dot([r.whitened for r in mine], [r.whitened for r in mine]) / n - 1) < 1e-9
    assert all(r.identity_error < 1e-9 for r in rows)


def test_op13_against_numpy(spark, tmp_path):
    rows = whitening.op13_whitening(spark, SF).collect()
    vectors = [r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()]
    check_whitening(rows, vectors)
    rng = np.random.default_rng(4)
    good = [[float(c) for c in v] for v in rng.normal(size=(40, 3)).astype(np.float32)]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    table = [(None if i % 9 == 0 else i // 2, v, 0) for i, v in enumerate([*good, *bad, good[0]])]
    frame = spark.createDataFrame(table, VECTORS).withColumn("x", F.lit("x")).repartition(5)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    check_whitening(whitening.op13_whitening(spark, str(tmp_path)).collect(), [*good, good[0]])


def test_whitening_edges(spark, tmp_path):
    for name, vectors in (("none", []), ("bad", [None, [], [float("nan")]])):
        spark.createDataFrame([(1, v, 0) for v in vectors], VECTORS).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert whitening.op13_whitening(spark, f"{tmp_path}/{name}").count() == 0
    spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(3)], VECTORS).write.parquet(f"{tmp_path}/one/embeddings.parquet")
    rows = whitening.op13_whitening(spark, f"{tmp_path}/one").collect()
    assert {(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {
        (1, 0, None, None, None), (2, 0, None, None, None)
    }
    wide = spark.createDataFrame([(1, [0.0] * 2049, 0)], VECTORS)
    with pytest.raises(ValueError):
        whitening.fitted(wide)


def test_exact_squares_of_large_numbers():
    rng = np.random.default_rng(9)
    for size, n in ((1 << 12, 10), (1 << 30, 1 << 20), (1 << 41, 1 << 40)):
        m = rng.integers(-size, size, (20, 5))
        sums = [int(s) * n // 20 for s in m.sum(axis=0)]
        want = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in m]
        assert [int(d) for d in whitening._squares(m, n, sums)] == want
