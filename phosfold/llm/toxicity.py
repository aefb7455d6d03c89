"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and their prefixes, hashed into 2**20 buckets. Spark
counts each bucket's toxic and other documents among the labelled rows. The machine's inputs are the
buckets whose own odds differ between the classes, and those that change the odds of documents
which hold one of these, such as a group mention beside an insult, though their own odds are even.
With every bucket as an input, most of which stand in a few rows only, the machine learns its rows
by heart (measured: see the README). The machine adds a weight for each input and, for each pair of
inputs, the product of their factor vectors, so that pairs of terms can count for more or less than
both alone. It is fitted by Adam on at most `most_rows` labelled rows of at most `most_bytes` in all, those
with the smallest hashes of doc_id; every document is scored on its whole text.

Null and empty texts have no terms and get the machine's constant; labels without a document, of a
null doc_id or a null label are not used, of repeated ones the largest counts, and of documents with
one id one is learned from; without any label every score is 0.5; repeated rows get equal results;
an empty table gives an empty table; other columns are ignored. Very long texts go whole: beside the text a
task holds its words once, and its distinct words and terms.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 1 << 20
PREFIXES = (3, 5, 7)
REMEMBERED = 500_000
#: Pairs of a seed and a bucket that a task counts before it hands them on.
PAIRS = 1 << 20
EDGES = ".,;:!?\"'()[]{}<>|*#$%&/\\-_=+~^`@"


def word_terms(word: str) -> list[int]:
    """Buckets of a word and its prefixes."""
    word = word.strip(EDGES)
    if not word:
        return []
    return [zlib.crc32(f"{n} {word[:n]}".encode()) % BUCKETS for n in (0, *PREFIXES) if n < len(word)] + [zlib.crc32(b"w " + word.encode()) % BUCKETS]


def terms(text: str | None) -> set[int]:
    found: set[int] = set()
    for word in set((text or "").lower().split()):
        found.update(word_terms(word))
    return found


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most_rows: int, most_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", most_lines: int | None = None) -> DataFrame:
    """(text, y) of labelled rows that `train`, a condition on doc_id, lets through, in the order of their ids' hashes.

    At most `most_rows` rows, and no more once their texts reach `most_bytes` or would pass `most_lines` lines;
    texts with more than an eighth of these are not learnt from. Of documents with one
    id the one with the smallest hash is taken. The sample is written once and read by all that fits on it.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    found = materialize(found.select("doc_id", F.xxhash64("doc_id").alias("nth"), "y", "text"), "sample")
    order = Window.orderBy("nth", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.select("doc_id", "nth", F.octet_length("text").alias("n"))
    if most_lines is not None:
        lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
        sizes = found.select("doc_id", "nth", F.octet_length("text").alias("n"), lines.alias("lines")).where(F.col("lines") <= most_lines // 8)
        sizes = sizes.withColumn("all_lines", F.coalesce(F.sum("lines").over(order), F.lit(0)) + F.col("lines")).where(F.col("all_lines") <= most_lines)
    sizes = sizes.withColumn("held", F.coalesce(F.sum("n").over(order), F.lit(0)))
    within = sizes.where(F.col("held") < most_bytes).select("doc_id")
    return found.join(F.broadcast(within), "doc_id").orderBy("nth", "doc_id").select("text", "y")


def bucket_counts(sample: DataFrame) -> DataFrame:
    """(bucket, n, hot): documents and toxic documents of each bucket."""

    def count(stream):
        for batch in stream:
            rows = [np.fromiter(terms(t), np.int64) for t in batch.column(0).to_pylist()]
            y = batch.column(1).to_numpy()
            hot = [r for r, v in zip(rows, y) if v]
            bucket, n = np.unique(np.concatenate(rows) if rows else np.empty(0, np.int64), return_counts=True)
            toxic = np.zeros(BUCKETS, np.int64) if not hot else np.bincount(np.concatenate(hot), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n), pa.array(toxic[bucket])], names=["bucket", "n", "hot"])

    return sample.mapInArrow(count, "bucket long, n long, hot long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("hot").alias("hot"))


def separating_buckets(sample: DataFrame, counts: DataFrame, inputs: int, least: int = 3, z: float = 3.0) -> np.ndarray:
    """At most `inputs` buckets whose odds differ most between the classes, by at least `z` standard errors."""
    sizes = sample.agg(F.count("*"), F.sum("y")).first()
    rows, hot = float(sizes[0] or 0), float(sizes[1] or 0)
    a, b = F.col("hot") + 0.5, F.col("n") - F.col("hot") + 0.5
    c, d = F.lit(hot + 1) - a, F.lit(rows - hot + 1) - b
    apart = F.abs(F.log(a) + F.log(d) - F.log(b) - F.log(c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    best = counts.where(F.col("n") >= least).withColumn("z", apart).where(F.col("z") >= z).orderBy(F.desc("z"), "bucket").limit(inputs)
    return np.array([r[0] for r in best.select("bucket").collect()], np.int64)


def added(keys: np.ndarray, n: np.ndarray, new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key with those of new keys, one each."""
    if not new:
        return keys, n
    more, times = np.unique(np.concatenate(new), return_counts=True)
    every = np.concatenate([keys, more])
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if every.size else np.empty(0, np.int64)
    return every[first], np.add.reduceat(np.concatenate([n, times])[order], first) if first.size else n


def companion_buckets(sample: DataFrame, counts: DataFrame, seeds: np.ndarray, inputs: int, least: int = 6) -> np.ndarray:
    """At most `inputs` buckets that change the odds of documents with some seed, whatever their odds on their own.

    For each seed and each bucket of at least `least` documents a likelihood-ratio test compares the
    seed's documents with and without the bucket; what it says must hold after as many tests as
    there are pairs, which fewer documents can hardly bring about.
    """
    if not seeds.size:
        return seeds
    common = np.sort(np.union1d(counts.where(F.col("n") >= least).select("bucket").toArrow()["bucket"].to_numpy(), seeds))
    place = np.full(BUCKETS, -1, np.int32)
    place[common] = np.arange(common.size)
    kept = sample.sparkSession.sparkContext.broadcast((place, place[seeds]))

    def rows(keys, n, wide):
        pair, hot = keys >> 1, n * (keys & 1)
        return pa.RecordBatch.from_arrays([pa.array((pair // wide).astype(np.int32)), pa.array((pair % wide).astype(np.int32)), pa.array(n), pa.array(hot)], names=["seed", "bucket", "n", "hot"])

    def count(stream):
        place, first = kept.value
        wide, none = int(place.max()) + 1, np.empty(0, np.int64)
        keys, n, new, size = none, none, [], 0
        for batch in stream:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = place[np.fromiter(terms(text), np.int64)].astype(np.int64)
                own = own[own >= 0]
                for p in own[np.isin(own, first)].tolist():
                    # a seed, a bucket and whether the document is toxic
                    new.append((p * wide + own) * 2 + int(bool(y)))
                    size += own.size
                    if size >= PAIRS:
                        keys, n = added(keys, n, new)
                        new, size = [], 0
                        if keys.size >= PAIRS:
                            yield rows(keys, n, wide)
                            keys, n = none, none
        yield rows(*added(keys, n, new), wide)

    # the seed beside itself counts the seed's documents
    pairs = materialize(sample.mapInArrow(count, "seed int, bucket int, n long, hot long").groupBy("seed", "bucket").agg(F.sum("n").alias("n"), F.sum("hot").alias("hot")), "pairs")
    whole = pairs.where("seed = bucket").select("seed", F.col("n").alias("all"), F.col("hot").alias("all_hot"))
    beside = pairs.where("seed != bucket").join(F.broadcast(whole), "seed")
    part = lambda o, row, column: F.when(o > 0, o * F.log(o * F.col("all") / (row * column))).otherwise(0.0)
    n, hot, cold, cold_all = F.col("n"), F.col("hot"), F.col("n") - F.col("hot"), F.col("all") - F.col("all_hot")
    gain = part(hot, n, F.col("all_hot")) + part(cold, n, cold_all) + part(F.col("all_hot") - hot, F.col("all") - n, F.col("all_hot")) + part(cold_all - cold, F.col("all") - n, cold_all)
    tests = beside.count()
    found = beside.select("bucket", gain.alias("gain")).where(F.col("gain") >= float(np.log(max(1, tests)) + 3)).groupBy("bucket").agg(F.max("gain").alias("gain"))
    return common[[r[0] for r in found.orderBy(F.desc("gain"), "bucket").limit(inputs).collect()]]


class Machine:
    """Constant, weights and factor vectors of a factorization machine with 0/1 inputs."""

    def __init__(self, buckets: np.ndarray, factors: int = 8, seed: int = 1):
        self.buckets = buckets
        self.position = {int(b): i for i, b in enumerate(buckets)}
        rng = np.random.default_rng(seed)
        self.parts = [np.zeros(1), np.zeros(buckets.size), rng.normal(0, 0.01, (buckets.size, factors))]
        self.words: dict[str, tuple[int, ...]] = {}

    def inputs(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        for word in set((text or "").lower().split()):
            known = self.words.get(word)
            if known is None:
                known = tuple(self.position[b] for b in word_terms(word) if b in self.position)
                if len(self.words) < REMEMBERED and len(word) < 64:
                    self.words[word] = known
            if known:
                found.update(known)
        return np.fromiter(sorted(found), np.int64)

    def margin(self, x: np.ndarray) -> float:
        constant, weights, vectors = self.parts
        v = vectors[x]
        return float(constant[0] + weights[x].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(self.inputs(text)), -30, 30))))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, rounds: int = 40, rate: float = 0.2, shrink: float = 1e-5, batch: int = 256, seed: int = 1) -> Machine:
        """Adaptive gradient steps on the log loss of `batch` rows at a time with a squared penalty."""
        if not len(rows):
            return self
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.parts[0][:] = np.log(share / (1 - share))
        rng = np.random.default_rng(seed)
        order, parts = rng.permutation(len(rows)), []
        for at in range(0, order.size, batch):
            pick = order[at : at + batch]
            many = np.array([rows[i].size for i in pick])
            used, ids = np.unique(np.concatenate([rows[i] for i in pick]), return_inverse=True)
            parts.append((used, ids, np.repeat(np.arange(pick.size), many), y[pick]))
        constant, weights, vectors = self.parts
        steps = [np.full_like(p, 1e-6) for p in self.parts]
        k = vectors.shape[1]
        sums = lambda of, values, size: np.stack([np.bincount(of, values[:, j], size) for j in range(k)], 1)
        for _ in range(rounds):
            for at in rng.permutation(len(parts)):
                used, ids, of, truth = parts[at]
                w, v = weights[used], vectors[used]
                each = v[ids]
                total = sums(of, each, truth.size)
                margin = constant[0] + np.bincount(of, w[ids], truth.size) + 0.5 * ((total * total).sum(1) - np.bincount(of, (each * each).sum(1), truth.size))
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - truth) / truth.size
                e = error[of]
                g_w = np.bincount(ids, e, used.size)
                grads = [error.sum(), g_w + shrink * w, sums(ids, e[:, None] * total[of], used.size) - g_w[:, None] * v + shrink * v]
                for p, g, s, at_p in zip(self.parts, grads, steps, (slice(None), used, used)):
                    s[at_p] += g * g
                    p[at_p] -= rate * g / np.sqrt(s[at_p])
        return self


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, most_rows: int = 20_000, most_bytes: int = 256 << 20, inputs: int = 4096, seeds: int = 64, beside: int = 256, factors: int = 8, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine fitted on a bounded sample of the labelled rows."""
    sample = labelled_sample(docs, labels, label, train_rows, most_rows, most_bytes, id_col, text_col)
    counts = materialize(bucket_counts(sample), "counts")
    own = separating_buckets(sample, counts, inputs)
    machine = Machine(np.unique(np.concatenate([own, companion_buckets(sample, counts, own[:seeds], beside)])), factors)
    empty = docs.sparkSession.sparkContext.broadcast(machine)

    def encode(stream):
        for batch in stream:
            x = [empty.value.inputs(t).astype(np.int32) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())), batch.column(1)], names=["x", "y"])

    table = sample.mapInArrow(encode, "x array<int>, y int").toArrow()
    rows = [np.array(x, np.int64) for x in table["x"].to_pylist()]
    return machine.fit(rows, table["y"].to_numpy().astype(np.float64))


def score_texts(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(stream):
        for batch in stream:
            scores = pa.array([shared.value.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op1_toxicity(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = held_out(F.col("doc_id"), 3, 1)
    machine = train(docs, labels, ~out)
    scored = score_texts(docs, machine)
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
