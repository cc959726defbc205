"""Language identification by prediction by partial matching.

Each language has a context tree of bytes with contexts of 0 to ORDER bytes. With frozen counts, byte
b after context c costs -log2(n(c, b) / (n(c) + t(c))) bits where n counts occurrences and t distinct
successors; if b never followed c, the escape costs -log2(t(c) / (n(c) + t(c))) and the context loses
its oldest byte; a byte never seen at all costs 8 bits more. A context the language never saw costs
nothing to leave. A text's language is the one with the shortest code, the first by name in a tie.

The trees are one trie of byte strings with a count for each language. String ids are computed for all
positions at once: the string of k + 1 bytes that ends at i is the child, by byte i, of the string of
k bytes that ends at i - 1, so each order is one table look-up; positions whose longest string is
unknown fall back together.

Training reads a sample of the labelled rows: each language's rows with a probability of SAMPLE over
the number of its rows, so about SAMPLE documents of each language whatever the input; whole texts.
Strings are counted in the tasks, summed by a shuffle, and the trie keeps the strings that are
frequent enough for it to hold at most NODES, which bounds what is broadcast. There may be at most
LABELS different labels; more raise an error.

Edge cases: a text that is null or has no letter is `und` with score 0, as is every text when nothing
is labelled; null and empty texts train nothing; a null doc_id is not held out; repeated rows are
predicted alike; an empty table gives no rows; other columns are ignored; long texts are scored in
windows whose context reaches back into the window before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import column, documents, mapped, small_batches

ORDER = 3
SAMPLE = 1000
LABELS = 1000
NODES = 1 << 17
SPAN = 1 << 18
LEAST_SCORE = 0.5


class Trie:
    """Byte strings of 1 to order + 1 bytes with counts [string, language], and their exact costs."""

    def __init__(self, langs: list[str], strings: list[bytes], counts: np.ndarray, order: int):
        self.langs, self.order, n_lang = langs, order, len(langs)
        seen = sorted({s[0] for s in strings if len(s) == 1})
        # Class 1 is every byte that was never seen; id 0 means "no such string" on each level.
        self.classes = np.ones(256, dtype=np.int64)
        self.classes[seen] = np.arange(2, len(seen) + 2)
        width = self.width = len(seen) + 2
        level: list[dict[bytes, int]] = [{} for _ in range(order + 1)]
        level[0] = {bytes([b]): int(self.classes[b]) for b in seen}
        for s in sorted(strings, key=len):
            if len(s) > 1 and s[:-1] in level[len(s) - 2] and s[1:] in level[len(s) - 2]:
                level[len(s) - 1][s] = len(level[len(s) - 1]) + 1
        row = {s: i for i, s in enumerate(strings)}
        self.child = []  # child[k][id of k + 1 bytes * width + class] -> id of k + 2 bytes
        for k in range(order):
            size = width if k == 0 else len(level[k]) + 1
            table = np.zeros(size * width, dtype=np.int32)
            for s, i in level[k + 1].items():
                table[level[k][s[:-1]] * width + self.classes[s[-1]]] = i
            self.child.append(table)
        self.cost, self.leave = [], []  # cost[k][string]: of its last byte; leave[k][context of k bytes]
        for k in range(order + 1):
            names = level[k]
            size = width if k == 0 else len(names) + 1
            n = np.zeros((size, n_lang))
            for s, i in names.items():
                n[i] = counts[row[s]]
            contexts = 1 if k == 0 else (width if k == 1 else len(level[k - 1]) + 1)
            parent = np.zeros(size, dtype=np.int64)
            if k:
                for s, i in names.items():
                    parent[i] = level[k - 1][s[:-1]]
            total = np.zeros((contexts, n_lang))
            kinds = np.zeros((contexts, n_lang))
            np.add.at(total, parent, n)
            np.add.at(kinds, parent, n > 0)
            if k:  # id 0 is no context
                total[0] = kinds[0] = 0
            with np.errstate(divide="ignore", invalid="ignore"):
                own = -np.log2(n / (total + kinds)[parent])
                leave = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
            below = np.full((size, n_lang), 8.0)
            if k:
                for s, i in names.items():
                    below[i] = self.cost[k - 1][level[k - 1][s[1:]]]
            cost = np.where(n > 0, own, leave[parent] + below)
            if k:
                cost[0] = 0
            self.cost.append(cost.astype(np.float32))
            self.leave.append(leave.astype(np.float32))

    def costs(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each byte under each language; a text begins at each of `starts`."""
        c = self.classes[data]
        ids = [c]
        for k in range(self.order):
            back = np.empty_like(ids[k])
            back[0], back[1:] = 0, ids[k][:-1]
            back[starts] = 0
            ids.append(self.child[k][back * self.width + c].astype(np.int64))
        out = self.cost[self.order][ids[self.order]]
        rest = np.flatnonzero(ids[self.order] == 0)
        fresh = np.zeros(len(data), dtype=bool)
        fresh[starts] = True
        for k in range(self.order, 0, -1):
            if not len(rest):
                break
            context = np.where(fresh[rest] | (rest == 0), 0, ids[k - 1][rest - 1])
            out[rest] += self.leave[k][context]
            known = ids[k - 1][rest] != 0
            found = rest[known]
            out[found] += self.cost[k - 1][ids[k - 1][found]]
            rest = rest[~known]
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text under each language, in bits."""
        out = np.zeros((len(texts), len(self.langs)))
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= SPAN):
                size += len(texts[j])
                j += 1
            if size <= SPAN:
                data = np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8)
                lens = np.array([len(t) for t in texts[i:j]])
                at = np.cumsum(lens) - lens
                full = np.flatnonzero(lens)
                if len(full):
                    got = self.costs(data, at[full])
                    out[i + full] = np.add.reduceat(got, at[full], axis=0, dtype=np.float64)
            else:  # one long text, span by span
                data = np.frombuffer(texts[i], dtype=np.uint8)
                for at in range(0, len(data), SPAN):
                    lead = min(at, self.order)
                    got = self.costs(data[at - lead : at + SPAN], np.array([0]))
                    out[i] += got[lead:].sum(axis=0, dtype=np.float64)
            i = j
        return out


def _count_strings(order: int):
    def run(batches):
        import pyarrow as pa

        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[str, list[np.ndarray]] = {}

        def summed(lang):
            keys, n = np.unique(np.concatenate(fresh.pop(lang)), return_counts=True)
            if lang in held:
                keys, where = np.unique(np.concatenate([keys, held[lang][0]]), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([n, held[lang][1]])).astype(np.int64)
            held[lang] = keys, n

        def added(lang, data, new):
            """Strings as integers: their length above their bytes."""
            for k in range(min(order + 1, len(data))):
                code = np.full(len(data) - k, k + 1, dtype=np.int64)
                for j in range(k + 1):
                    code = (code << 8) | data[j : len(data) - k + j]
                # The window before has counted the strings that end in its last bytes.
                fresh.setdefault(lang, []).append(code[max(0, new - k) :])
            if sum(map(len, fresh.get(lang, ()))) > 4 * SPAN:
                summed(lang)

        for batch in small_batches(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                data = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.int64)
                for at in range(0, len(data), SPAN):
                    lead = min(at, order)
                    added(lang, data[at - lead : at + SPAN], lead)
        for lang in [*fresh]:
            summed(lang)
        for lang, (keys, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], ["lang", "string", "n"])

    return run


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
        order: int = ORDER, sample: int = SAMPLE, nodes: int = NODES) -> Trie | None:
    """The trie of a sample of about `sample` rows of each label; None where nothing is labelled."""
    lang, text, doc = column(labelled, lang_col), column(labelled, text_col), column(labelled, id_col)
    known = labelled.select(lang.alias("lang"), text.alias("text"), doc.alias("doc_id")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LABELS + 1).collect()
    if len(rows) > LABELS:
        raise ValueError(f"more than {LABELS} different labels")
    if not rows:
        return None
    rates = labelled.sparkSession.createDataFrame([(r.lang, r.n) for r in rows], known.select("lang", F.lit(0).cast("long").alias("n")).schema)
    part = (F.xxhash64(F.lit("language sample"), "doc_id", "text") / F.lit(2.0**64)) + 0.5
    # At most LABELS rows, so the texts are sampled where they lie and never shuffled.
    chosen = known.join(F.broadcast(rates), "lang").where(part * F.col("n") < sample).select("lang", "text")
    strings = (
        mapped(chosen, _count_strings(order), "lang string, string long, n long")
        .groupBy("lang", "string").agg(F.sum("n").alias("n"))
    )
    # The most frequent strings by their count over all languages, shorter ones first in a tie, so
    # that a kept string has its own prefix and suffix kept.
    top = strings.groupBy("string").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "string").limit(nodes)
    got = strings.join(top, "string").select("lang", "string", "n").toPandas()
    if not len(got):
        return None
    langs = sorted(got["lang"].unique())
    keys, row = np.unique(got["string"].to_numpy(), return_inverse=True)
    counts = np.zeros((len(keys), len(langs)))
    np.add.at(counts, (row, np.searchsorted(langs, got["lang"])), got["n"].to_numpy())
    return Trie(langs, [_unpacked(int(k)) for k in keys], counts, order)


def _unpacked(key: int) -> bytes:
    raw = key.to_bytes((key.bit_length() + 7) // 8, "big")
    return raw[1:]


def _score(model, letters: str):
    def run(batches):
        import pyarrow as pa

        trie = model.value
        for batch in small_batches(batches, "text"):
            texts = [b.encode() if ok else b"" for b, ok in zip(batch.column("text").to_pylist(), batch.column(letters).to_pylist())]
            bits = trie.bits(texts)
            best = bits.argmin(axis=1)
            score = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
            none = np.array([not t for t in texts], dtype=bool)
            names = np.array(trie.langs, dtype=object)[best]
            names[none], score[none] = "und", 0.0
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] not in ("text", letters)]
            keep = [n for n in batch.schema.names if n not in ("text", letters)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, trie: Trie | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score): score is the likeliest language's share of all likelihoods."""
    text = column(docs, text_col)
    rows = docs.select(
        column(docs, id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    if trie is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(trie)
    return mapped(rows, _score(model, "letters"), f"doc_id {kind}, lang_pred string, score double")


def held_out(doc):
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame) -> Trie | None:
    return fit(docs.where(~held_out(column(docs, "doc_id"))))


def op4_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = predict(docs, trained(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, trie: Trie | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows with a recognised language: some letter, and a score of at least `least`."""
    text = column(docs, "text")
    if trie is None:  # nothing to tell languages by: a letter is enough
        return docs.where(text.rlike(r"\p{L}"))
    model = docs.sparkSession.sparkContext.broadcast(trie)
    place = docs.columns.index("text")
    # Plain names on the way through Python, whatever the columns are called.
    lettered = docs.where(text.rlike(r"\p{L}")).toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        import pyarrow as pa

        for part in small_batches(batches, f"c{place}"):
            bits = model.value.bits([t.encode() for t in part.column(place).to_pylist()])
            score = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
            yield part.filter(pa.array(score >= least))

    return mapped(lettered, run, lettered.schema).toDF(*docs.columns)


ORACLE: dict[str, str] = {}
