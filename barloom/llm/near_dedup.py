"""Near-duplicate documents by a MinHash LSH forest, with links confirmed on full shingle sets.

Every document has the set of its distinct five-word shingles. Documents with equal sets are one
class. A class has TREES labels of DEPTH MinHash values each; a tree is the order of the labels. Classes
that share the first START values of a tree's label are a region. A region with more than REGION
members is split by one more value, and again, so crowded parts of an order are compared only with
neighbours of a longer common prefix. Inside a part, classes are candidates if their whole signatures
agree in at least LIKELY of all values.

Links are confirmed on the full sets and linked classes joined to components, in three rounds:

1. star: in each part, the class with the most likely partners is paired with them, then the next of
   those left, so a part gives fewer pairs than it has members, and a crowd falls into few components.
2. centres: where a region has several parts, their centres are paired with the one that has most.
3. across: every likely pair of a region whose classes are still in different components is compared
   by its full sets where the region's rows meet; only links leave the task.

Round 3 looks at whole regions again, whatever their size, but only across components: members outside
the largest component of a region are compared with all, in blocks, each pair in the first tree whose
region holds both. So no likely pair of one region stays untried unless its classes are already in one
component, and a pair of similarity 0.75 shares a region with probability
1 - (1 - 0.75^START)^TREES, 0.99998.

Edge cases: a document with fewer than five words has its whole sequence as one shingle; null, empty
and blank texts have none and are linked with nothing; repeated rows are one class; component_id is
the smallest doc_id that is not null; documents that share that id are all kept; an empty table gives
no rows; other columns are ignored by `near_labels` and kept by `without_near_copies`.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import column, documents, filled, free_name, landed, mapped, small_batches, utf8
from barloom.llm.words import mixed, shingles, words_of

WIDTH = 5
TREES, DEPTH, START = 20, 6, 3
VALUES = TREES * DEPTH
REGION = 512
# The share of equal values has a standard deviation of 0.04 at similarity 0.75: 4.2 below.
LIKELY = 70
ABOVE, OF = 75, 100


def _coefficients() -> np.ndarray:
    seeds = mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return ((seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(shingles(words, WIDTH))


def signature(found: np.ndarray, by: np.ndarray) -> bytes:
    """The MinHash values of a set, 16 bits each."""
    folded = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 8192):
        least = np.minimum(least, (by * folded[None, at : at + 8192]).min(axis=1))
    spread = mixed(least.astype(np.uint64) + (np.arange(VALUES, dtype=np.uint64) << np.uint64(32)))
    return (spread >> np.uint64(48)).astype(">u2").tobytes()


def _features(batches):
    import pyarrow as pa

    by = _coefficients()
    for batch in small_batches(batches, "text"):
        texts = utf8(batch, "text")
        n, keys, marks = [], [], []
        for _, words, bounds in words_of(texts):
            for a, b in zip(bounds[:-1], bounds[1:]):
                found = shingle_set(words[a:b])
                n.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                marks.append(signature(found, by) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("rid"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())],
            ["doc_id", "rid", "n_shingles", "key", "sig"],
        )


def _sets(batches):
    import pyarrow as pa

    for batch in small_batches(batches, "text"):
        keys, sets = [], []
        for _, words, bounds in words_of(utf8(batch, "text")):
            for a, b in zip(bounds[:-1], bounds[1:]):
                found = shingle_set(words[a:b]).tobytes()
                keys.append(hashlib.blake2b(found, digest_size=16).digest())
                sets.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "shingles"])


def _regions(classes: DataFrame, region: int) -> DataFrame:
    """(rkey, part, parts, key, sig): members of regions with several members; `parts` tells whether
    the region was split."""
    label = lambda t, d: F.substring("sig", t * DEPTH * 2 + 1, d * 2)
    # A tree's number is in the hash, so labels of different trees do not meet.
    numbered = F.posexplode(F.array(*[F.xxhash64(F.lit(t), label(t, START)) for t in range(TREES)]))
    rows = classes.select("key", numbered.alias("tree", "rkey"))
    counts = rows.groupBy("rkey").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    several = rows.join(counts, "rkey").join(classes.select("key", "sig"), "key")
    members = landed(several.withColumn("part", F.col("rkey")).withColumn("parts", F.col("m") > region))
    crowded = members.where("parts")
    if crowded.isEmpty():
        return members.select("rkey", "part", "parts", "tree", "key", "sig")
    rest, done = crowded, None
    for depth in range(START + 1, DEPTH + 2):
        if depth <= DEPTH:  # one more value of the label
            more = F.expr(f"substring(sig, tree * {DEPTH * 2} + 1, {depth * 2})")
            rest = rest.withColumn("part", F.xxhash64("rkey", more))
        else:  # equal labels: any even split
            rest = rest.withColumn("part", F.xxhash64("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("m") / region))))
        sized = rest.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
        rest = rest.drop("m").join(sized, "part")
        if depth <= DEPTH:
            small = rest.where(F.col("m") <= region)
            done = small if done is None else done.unionByName(small)
            rest = rest.where(F.col("m") > region)
    columns = ["rkey", "part", "parts", "tree", "key", "sig"]
    # The members of whole regions are read where they were written; only the others are written again.
    return members.where("not parts").select(*columns).unionByName(landed(done.unionByName(rest).select(*columns)))


def _grouped(batches, columns):
    """Yields the rows of one (first two columns) group after the other, from sorted rows."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch.select(columns)])
        if held is not None:
            table = pa.concat_tables([held, table])
        a, b = (table[c].to_numpy() for c in columns[:2])
        cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        edges = [0, *cut.tolist()]
        table = table.combine_chunks()
        for s, e in zip(edges[:-1], edges[1:]):
            yield table.slice(s, e - s)
        held = table.slice(edges[-1])
    if held is not None:
        yield held


def _agreement(sig: np.ndarray) -> np.ndarray:
    """How many values of each two signatures are equal."""
    if len(sig) <= 64:
        return (sig[:, None, :] == sig[None, :, :]).sum(axis=2)
    out = np.zeros((len(sig), len(sig)), np.uint8)
    for q in range(sig.shape[1]):
        out += sig[:, q][:, None] == sig[:, q][None, :]
    return out


def _signatures(table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=">u2").reshape(table.num_rows, VALUES).astype(np.uint16)


def _stars(batches):
    """Round 1: (a, b, rkey, likely): star pairs; with a = b the centre of a part of a split region."""
    import pyarrow as pa

    out: list[tuple] = []
    for table in _grouped(batches, ["rkey", "part", "parts", "key", "sig"]):
        m = table.num_rows
        split = table["parts"][0].as_py()
        if m == 1 and not split:
            continue
        keys = table["key"].to_pylist()
        likely = _agreement(_signatures(table)) >= LIKELY
        np.fill_diagonal(likely, False)
        degree = likely.sum(axis=1)
        order = sorted(range(m), key=lambda i: (-degree[i], keys[i]))
        if split:
            out.append((keys[order[0]], keys[order[0]], table["rkey"][0].as_py(), int(degree[order[0]])))
        left = degree > 0
        for i in order:
            if not left[i]:
                continue
            left[i] = False
            near = np.flatnonzero(likely[i] & left)
            left[near] = False
            # With no partner left, the likeliest of those taken.
            for j in near if len(near) else [int(np.argmax(likely[i]))]:
                out.append((min(keys[i], keys[j]), max(keys[i], keys[j]), 0, 0))
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*set(out)), _PAIR_KINDS())], ["a", "b", "rkey", "likely"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*set(out)), _PAIR_KINDS())], ["a", "b", "rkey", "likely"])


def _PAIR_KINDS():
    import pyarrow as pa

    return pa.binary(), pa.binary(), pa.int64(), pa.int64()


def _cross_likely(table):
    """Yields (i, others): likely partners of i, one of the few, in other components of a block."""
    few = table["few"].to_numpy(zero_copy_only=False)
    if not few.any():
        return
    turn = table["turn"].to_numpy(zero_copy_only=False)
    _, comp = np.unique(np.array(table["comp"].to_pylist(), dtype=object), return_inverse=True)
    sig, tree = _signatures(table), table["tree"][0].as_py()
    starts = np.add.outer(np.arange(tree) * DEPTH, np.arange(START))
    for i in np.flatnonzero(few):
        # Two of the few meet in several blocks and are compared in one.
        other = np.flatnonzero((comp != comp[i]) & (~few | (turn & turn[i])))
        other = other[(sig[other] == sig[i]).sum(axis=1) >= LIKELY]
        if tree and len(other):  # an earlier tree has compared those that share a region there
            met = (sig[other][:, starts] == sig[i][starts]).all(axis=2).any(axis=1)
            other = other[~met]
        if len(other):
            yield i, other, comp


BLOCK_COLUMNS = ["rkey", "block", "tree", "few", "turn", "comp", "key", "sig"]


def _asked(batches):
    """The rows of a block that have a likely partner in another component."""
    import pyarrow as pa

    for table in _grouped(batches, BLOCK_COLUMNS):
        keep = np.zeros(table.num_rows, bool)
        for i, other, _ in _cross_likely(table):
            keep[i] = keep[other] = True
        if keep.any():
            yield from table.filter(pa.array(keep)).to_batches()


def _across(batches):
    """Round 3: (a, b): for each class, one confirmed link to each other component it has links to."""
    import pyarrow as pa

    for table in _grouped(batches, [*BLOCK_COLUMNS, "shingles"]):
        out: set[tuple] = set()
        keys, sets = table["key"].to_pylist(), [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        size = np.array([len(x) for x in sets])
        for i, other, comp in _cross_likely(table):
            other = other[OF * np.minimum(size[other], size[i]) >= ABOVE * np.maximum(size[other], size[i])]
            if not len(other):
                continue
            whole = np.concatenate([sets[j] for j in other])
            at = np.minimum(np.searchsorted(sets[i], whole), size[i] - 1)
            both = np.add.reduceat(sets[i][at] == whole, np.cumsum(size[other]) - size[other], dtype=np.int64)
            linked = other[OF * both >= ABOVE * (size[other] + size[i] - both)]
            _, first = np.unique(comp[linked], return_index=True)
            out.update((min(keys[i], keys[j]), max(keys[i], keys[j])) for j in linked[first])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])


def _confirmed(batches):
    import pyarrow as pa

    for batch in batches:
        linked = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if OF * min(len(x), len(y)) < ABOVE * max(len(x), len(y)):
                linked.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(OF * both >= ABOVE * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    first = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return landed(mapped(pairs.join(first, "a").join(second, "b"), _confirmed, "a binary, b binary, linked boolean"))


def components(links: DataFrame) -> DataFrame:
    """(key, root): the smallest key of each component of `links` (a, b); keys without links are left out.

    Each step ties the neighbours of a key to the smallest of them, first those above it, then those
    below, until nothing changes; a step costs a few shuffles of the links and the number of steps is
    about the logarithm of the longest path.
    """
    edges = landed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("low"))
        tied = large.join(small, "u")
        new = landed(
            tied.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(small.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        )
        told = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == seen:
            return new.select(F.col("u").alias("key"), F.col("v").alias("root"))
        seen, edges = told, new


def _mixed_blocks(members: DataFrame, roots: DataFrame, region: int) -> DataFrame:
    """Members of regions that hold several components, in blocks. The members outside a region's
    largest component are the few; each block has some of them and some of the others."""
    placed = members.select("rkey", "tree", "key", "sig").join(roots, "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
    placed = landed(placed)
    sizes = placed.groupBy("rkey", "comp").agg(F.count(F.lit(1)).alias("n"))
    told = (
        sizes.groupBy("rkey")
        .agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"))
        .where("n_main < n_all")
        .select(
            "rkey", "main", F.ceil(F.col("n_main") / region).alias("main_blocks"),
            F.ceil((F.col("n_all") - F.col("n_main")) / region).alias("few_blocks"),
        )
    )
    rows = placed.join(told, "rkey").withColumn("few", F.col("comp") != F.col("main"))
    spot = F.xxhash64("key")
    few_at, main_at = F.pmod(spot, "few_blocks"), F.pmod(spot, "main_blocks")
    # A block is (x, y): the few of part x with the main of part y, or with the few of part y.
    main = rows.where("not few").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1))).select(
        "rkey", F.xxhash64("x", main_at).alias("block"), "tree", "few", F.lit(False).alias("turn"), "comp", "key", "sig"
    )
    few = rows.where("few").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("main_blocks") - 1))).select(
        "rkey", F.xxhash64(few_at, "y").alias("block"), "tree", "few", (F.col("y") == 0).alias("turn"), "comp", "key", "sig"
    )
    cross = (
        rows.where("few and few_blocks > 1")
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1))).where(F.col("y") != few_at)
        .select(
            "rkey", F.xxhash64(F.lit("few"), F.least("y", few_at), F.greatest("y", few_at)).alias("block"),
            "tree", "few", F.lit(True).alias("turn"), "comp", "key", "sig",
        )
    )
    return main.unionByName(few).unionByName(cross)


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """The id, the text and a hash of both; rows with the same id and text have the same fate."""
    doc_id, text = column(docs, id_col).cast("long"), filled(column(docs, text_col))
    return doc_id, text, F.xxhash64(doc_id, text)


def near_classes(docs: DataFrame, id_col: str, text_col: str, region: int = REGION) -> tuple[DataFrame, DataFrame]:
    """Features of all documents, and (key, doc, component_id) of all classes that have shingles."""
    doc_id, text, rid = _row_key(docs, id_col, text_col)
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), rid.alias("rid"))
    features = landed(
        mapped(rows.select("doc_id", "rid", "text"), _features, "doc_id long, rid long, n_shingles long, key binary, sig binary")
    )
    classes = landed(
        features.where("n_shingles > 0").groupBy("key", "sig").agg(F.min("doc_id").alias("doc"), F.min("rid").alias("rid"))
    )
    members = _regions(classes, region)
    by_part = members.repartition("rkey", "part").sortWithinPartitions("rkey", "part", "tree", "key")
    found = landed(mapped(by_part, _stars, "a binary, b binary, rkey long, likely long"))
    pairs = found.where("a <> b").select("a", "b").distinct()
    centres = found.where("a = b")
    if not centres.isEmpty():
        top = centres.groupBy("rkey").agg(F.max_by("a", F.struct("likely", "a")).alias("b"))
        more = centres.select("rkey", "a").join(top, "rkey").where("a <> b")
        pairs = pairs.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    pairs = landed(pairs)
    # Whatever a later round may pair has a likely partner in its region; members of split regions
    # may have it in another part.
    active = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(members.where("parts").select("key")).distinct()
    wanted = classes.join(active, "key", "left_semi").select("rid")
    sets = landed(
        mapped(rows.join(wanted, "rid", "left_semi").select("text"), _sets, "key binary, shingles binary")
        .dropDuplicates(["key"])
    )
    tried = _confirm(pairs, sets)
    roots = components(tried.where("linked").select("a", "b"))
    blocks = _mixed_blocks(members.join(active, "key", "left_semi"), roots, region)
    schema = "rkey long, block long, tree int, few boolean, turn boolean, comp binary, key binary, sig binary"
    in_blocks = lambda rows: rows.repartition("rkey", "block").sortWithinPartitions("rkey", "block")
    asked = landed(mapped(in_blocks(blocks), _asked, schema))
    new = landed(mapped(in_blocks(asked.join(sets, "key")), _across, "a binary, b binary"))
    if not new.isEmpty():
        known = roots.select(F.col("key").alias("a"), F.col("root").alias("b"))
        roots = components(known.unionByName(new))
    rooted = classes.select("key", "doc").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    return features, landed(rooted.join(smallest, "root").select("key", "doc", "component_id"))


def _labels(docs: DataFrame, id_col: str, text_col: str, region: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, rid), a row for each row of `docs`."""
    features, classes = near_classes(docs, id_col, text_col, region)
    joined = features.select("doc_id", "n_shingles", "key", "rid").join(classes.select("key", "component_id"), "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "rid"
    )


def near_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", region: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of `docs`."""
    return _labels(docs, id_col, text_col, region).drop("rid")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with their columns."""
    doc, row = free_name(docs, "near_id"), free_name(docs, "near_row")
    lost = _labels(docs, id_col, text_col, REGION).where(~F.col("kept"))
    # An id alone, or a missing one, may stand for several texts.
    gone = landed(lost.select(F.col("doc_id").alias("id"), "rid").distinct())
    doc_id, _, rid = _row_key(docs, id_col, text_col)
    held = docs.withColumn(doc, doc_id).withColumn(row, rid)
    same = (held[row] == gone["rid"]) & held[doc].eqNullSafe(gone["id"])
    # They grow with the input, so they are never broadcast, however few they are here.
    return held.join(gone.hint("merge"), same, "left_anti").select([column(held, c) for c in docs.columns])


def op6_near_dedup(spark, sf_dir):
    return near_labels(documents(spark, sf_dir))


ORACLE: dict[str, str] = {}
