import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import bpe, chat, packing, sharding, tiff
from barloom.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, DOCS, clashing, docs

TURNS = [
    (1, 0, "user", "hi <s> </s> [INST] <\\s> \\ [\\\\NEXT]"), (1, 1, "assistant", "a"), (1, 2, "assistant", "[NEXT] b"), (1, 3, "user", ""),
    (1, 4, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (2, None, "user", "first"), (None, 0, "assistant", "é日"),
    (3, 0, "[INST]", "role of its own"),
]


def test_chat_reads_back_what_it_formats(spark):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    made = chat.formatted(table.withColumn("rows", F.lit(1)).withColumn("formatted", F.lit("x")))
    back = {r.conv_id: r for r in made.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [t[2:] for t in own]
        spans = [back[conv].formatted[s.start : s.start + s.length] for s in back[conv].loss_spans]
        learned = [t[3] for t in own if t[2] == "assistant"]
        assert len(spans) == len(learned)
    assert back[1].formatted.count("</s>") == 4 and back[1].formatted.count("[NEXT]") == 1
    assert made.limit(0).count() == 0 and chat.formatted(table.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["</s>", "<\\/s>", "[INST][/INST]", "<<s>", "[\\[NEXT]", "\\<s>\\", "plain"])
def test_escapes_are_reversible(spark, text):
    row = spark.range(1).select(F.lit(text).alias("t")).select(chat.escaped(F.col("t")).alias("e")).select("e", chat.unescaped(F.col("e")).alias("b")).first()
    assert row.b == text and not any(m in row.e for m in ("<s>", "</s>", "[INST]", "[/INST]", "[NEXT]"))


@pytest.mark.parametrize("options", [{}, {"ranges": 8, "samples_per_range": 2, "least_rows": 5}])
def test_shards_are_even_and_slots_gapless(spark, options):
    r = random.Random(1)
    rows = AWKWARD + [(100 + i, "hot" if i % 3 == 0 else "t" * r.randrange(200)) for i in range(600)]
    got = sharding.sharded(clashing(docs(spark, rows)), shards=4, **options).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(g.doc_id), g.size, g.text_crc32) for g in got) == want
    loads = [sum(g.size for g in got if g.shard == s) for s in range(4)]
    assert max(loads) - min(loads) <= 2 * max(g.size for g in got)
    for s in range(4):
        own = sorted(g.slot for g in got if g.shard == s)
        assert own == list(range(len(own)))
    assert sharding.sharded(spark.createDataFrame([], DOCS)).count() == 0


def test_codecs_of_strips_and_tiles():
    r = random.Random(1)
    for n in (0, 1, 300, 6000, 20000):
        for values in (2, 256):
            data = bytes(r.randrange(values) for _ in range(n))
            assert tiff.unlzw(tiff.lzw(data), n) == data and tiff.unpack_bits(tiff.pack_bits(data), n) == data
    for kind in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS):
        for predictor in (1, 2):
            for tiled in (False, True):
                for order in "<>":
                    pages = [np.frombuffer(r.randbytes(h * w), np.uint8).reshape(h, w) for h, w in ((3, 5), (70, 130))]
                    got = list(tiff.read_pages(tiff.write_tiff(pages, kind, predictor, tiled, order)))
                    assert [g[0] for g in got] == [0, 1] and all((g[6] == p).all() for g, p in zip(got, pages))


def test_files_that_claim_too_much(spark):
    good = tiff.write_tiff([np.arange(16, dtype=np.uint8).reshape(4, 4)], tiff.DEFLATE)

    def changed(tag, value):
        at = good.index(struct.pack("<H", tag), struct.unpack_from("<I", good, 4)[0])
        out = bytearray(good)
        struct.pack_into("<I", out, at + 8, value)
        return bytes(out)

    files = [
        (1, changed(tiff.SAMPLES, 0)), (2, changed(tiff.WIDTH, 2_000_000)), (3, changed(tiff.HEIGHT, 2**31)),
        (4, changed(tiff.COMPRESSION, 7)), (5, changed(tiff.ROWS_PER_STRIP, 0)), (6, changed(tiff.STRIP_OFFSETS, 2**31)), (7, good),
    ]
    both = bytearray(changed(tiff.WIDTH, 2_000_000))
    at = bytes(both).index(struct.pack("<H", tiff.HEIGHT), struct.unpack_from("<I", good, 4)[0])
    struct.pack_into("<I", both, at + 8, 2_000_000)
    files.append((8, bytes(both)))
    got = {r.doc_id: r for r in tiff.tiff_pages(spark.createDataFrame(files, "doc_id long, media binary")).collect()}
    assert got[7].page == 0 and not got[7].error
    assert all(got[i].page == -1 and got[i].error for i in (1, 2, 3, 4, 5, 6, 8))


def test_op8_against_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in AWKWARD] + [(100 + k, f"line {k} " * (k * k * 40)) for k in range(30)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = tiff.op8_tiff(spark, str(tmp_path)).collect()
    forms = set()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        data = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        lines = [data[k : k + 576] for k in range(0, len(data), 576)]
        counts = [data.count(b) for b in range(256)]
        steps = sum(a != b for line in lines for a, b in zip(line, line[1:]))
        mean = sum(b * n for b, n in enumerate(counts)) / len(data)
        feature = f"pages={-(-len(lines) // 64)};width=576;mean={mean:.4f};values={sum(n > 0 for n in counts)};steps={steps}"
        grid = np.frombuffer(data, np.uint8).reshape(-1, 576)
        form = zlib.crc32(raw)
        tiled = len(lines) >= 64 and form // 6 % 2 == 1
        forms.add((form % 3, form // 3 % 2, tiled, len(lines) > 64))
        media = tiff.write_tiff(
            [grid[k : k + 64] for k in range(0, len(lines), 64)], (tiff.PACKBITS, tiff.LZW, tiff.DEFLATE)[form % 3], 1 + form // 3 % 2, tiled
        )
        want.append((i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(forms) > 8


def test_pages_of_stored_texts_and_broken_files(spark):
    rows = AWKWARD + [(50, "é" * 40000)]
    pages = tiff.tiff_pages(tiff.tiff_stored(clashing(docs(spark, rows)))).collect()
    joined = {}
    for p in sorted(pages, key=lambda p: (str(p.doc_id), p.media_bytes, p.page)):
        joined.setdefault((p.doc_id, p.media_bytes), []).append(p)
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert any(b"".join(bytes(p.pixels) for p in ps[: len(ps)]).startswith(padded) for (d, _), ps in joined.items() if d == i)
        assert any(p.doc_id == i and p.last and p.so_far_sha256 == hashlib.sha256(padded).hexdigest() for p in pages)
    good = tiff.write_tiff([np.zeros((4, 4), np.uint8)], tiff.LZW)
    circle = bytearray(good)
    circle[-4:] = circle[4:8]
    files = [(1, None), (2, b""), (3, b"II*\0"), (4, good[:-30]), (5, bytes(circle)), (6, good)]
    got = {r.doc_id: r for r in tiff.tiff_pages(spark.createDataFrame(files, "doc_id long, media binary")).collect()}
    assert all(got[i].page == -1 and got[i].error for i in (1, 2, 3, 4, 5)) and got[6].page == 0
    assert tiff.tiff_pages(tiff.tiff_stored(spark.createDataFrame([], DOCS))).count() == 0


def test_differencing_balances():
    r = np.random.default_rng(1)
    for _ in range(20):
        sizes = r.integers(1, 1024, r.integers(1, 60))
        at = packing.pack(sizes)
        assert np.bincount(at, weights=sizes).max() <= 1024
    loads = np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])
    assert abs(loads[0] - loads[1]) <= 2
    assert len(packing.pack(np.array([], int))) == 0


def test_pieces_cover_every_token_once(spark):
    rows = AWKWARD + [(i, "the cat sat " * i) for i in range(100, 400, 20)]
    got = packing.packed(clashing(docs(spark, rows)), tokens=True).collect()
    reference = Tokenizer.from_file(bpe.vocabulary_path())
    want = {}
    for i, t in rows:
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            piece = ids[at : at + 1024].tobytes()
            key = (i, at, len(piece) // 4, zlib.crc32(piece), len(ids))
            want[key] = want.get(key, 0) + 1
    have = {}
    for g in got:
        key = (g.doc_id, g.start, g.length, g.ids_crc32, g.doc_tokens)
        have[key] = have.get(key, 0) + 1
        assert zlib.crc32(bytes(g.ids)) == g.ids_crc32
    assert have == want
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packed(spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline_on_awkward_rows(spark):
    rows = AWKWARD + [(20, "one two three four five six seven eight nine ten a@b.example.com"), (21, "One two three four five six seven eight nine ten a@b.example.com")]
    table = clashing(docs(spark, rows))
    held = table
    for name, stage in corpus_pipeline.STAGES:
        held = corpus_pipeline.landed(stage(spark, held, ""))
        if name != "packing":
            assert held.columns == table.columns
        if name == "pii":
            assert held.where("text like '%a@b.example%'").count() == 0
            ids = [r.doc_id for r in held.collect()]
            assert sorted(ids) == [4, 5, 6, 20]
    assert {r.doc_id for r in held.collect()} == {4, 5, 6, 20}


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
