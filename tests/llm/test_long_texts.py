"""Very long texts and urls go whole through every operator, in bounded memory beside the text."""

import hashlib
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from phosfold.llm import bpe, common, decontaminate, huffman, interleave, near_copies, quality, sharding, simhash, suffix_dedup, toxicity, url_rules

ROOT = Path(__file__).resolve().parents[2]
ITEM = "the seventh keeper of the lighthouse counted every ship that passed the harbour twice before supper"
LONG = " ".join(f"w{i * 7919 % 50021} t{i % 31}." for i in range(300_000))


@pytest.fixture(scope="module")
def rows(spark):
    """A text of 3 MB, the same with a passage at its end, and short ones."""
    frame = spark.createDataFrame([(1, "short text here"), (4, None)], "doc_id long, text string")
    long = spark.range(300_000).select(F.concat(F.lit("w"), F.col("id") * 7919 % 50021, F.lit(" t"), F.col("id") % 31, F.lit(".")).alias("s"), "id")
    whole = long.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "s"))), lambda x: x["s"]), " ").alias("text"))
    return common.materialize(frame.union(whole.select(F.lit(2), "text")).union(whole.select(F.lit(3), F.concat("text", F.lit(" " + ITEM)))), "long")


def test_searches(spark, rows):
    item = spark.createDataFrame([(9, ITEM.replace("ships", "ship").replace("harbour", "harbor"))], "item_id long, text string")
    assert [(r.doc_id, r.distance) for r in decontaminate.leaks(rows, item).collect()] == [(3, 1)]
    found = {r.doc_id: r for r in simhash.near_duplicates(rows).collect()}
    words = LONG.encode().split()
    bits = np.zeros(64, np.int64)
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42)
        bits += (h >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.int64)
    assert found[2].fp & (1 << 64) - 1 == sum(1 << k for k in range(64) if bits[k] * 2 > len(words) - 2)
    assert found[2].component_id == found[3].component_id == 2
    assert sorted(r.doc_id for r in near_copies.keep_one(rows).collect()) == [1, 2, 4]


def test_files(spark, rows):
    from tokenizers import Tokenizer

    path, folder = huffman.word_vocabulary(), common.work_path(spark, "long")
    stored = common.materialize(huffman.encoded(rows, path), "long")
    huffman.write_segments(stored, folder, path, huffman.id_counts(stored, path))
    got = {r.doc_id: r for r in huffman.read_segments(spark, folder).collect()}
    ids = np.array([*Tokenizer.from_file(path).encode(LONG, add_special_tokens=False).ids, 1], "<u4")
    assert (got[2].n_tokens, got[2].ids_crc32) == (ids.size, zlib.crc32(ids.tobytes()))
    assert [got[i].start for i in (2, 3, 4)] == [got[1].n_tokens, got[1].n_tokens + ids.size, got[3].start + got[3].n_tokens]
    media = {r.payload_sha256 for r in interleave.describe_media(interleave.store_media(rows)).collect()}
    raw = LONG.encode()
    assert hashlib.sha256(raw + b" " * (-len(raw) % 192)).hexdigest() in media


@pytest.mark.parametrize("group", [1, 2, 1000])
def test_starts_over_groups_of_parts(spark, monkeypatch, group):
    monkeypatch.setattr(huffman, "GROUP", group)
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), (F.col("id") % 40).cast("int")).alias("text"))
    path, folder = huffman.word_vocabulary(), common.work_path(spark, "groups")
    stored = common.materialize(huffman.encoded(texts, path), "groups")
    huffman.write_segments(stored, folder, path, huffman.id_counts(stored, path), segment=60, part=500)
    got = sorted(huffman.read_segments(spark, folder).collect(), key=lambda r: r.doc_id)
    assert spark.read.parquet(f"{folder}/segments").select("part").distinct().count() > 4
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()] and len(got) == 300


def test_classifiers(spark, rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        model = module.train(rows, labels, F.lit(True))
        got = {r.doc_id: r.score for r in module.score_texts(rows, model).collect()}
        assert set(got) == {1, 2, 3, 4} and all(0 <= v <= 1 for v in got.values())


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_pairs_of_buckets_in_parts(spark, monkeypatch, most):
    """Companions are the same whatever a task holds before it hands its counts on."""
    texts = [(" ".join(["oaf"] * (i % 2) + ["tribe"] * (i // 2 % 2) + [f"plain{i % 7}"]), int(i % 4 == 3)) for i in range(400)]
    sample = spark.createDataFrame(texts, "text string, y int")
    counts = common.materialize(toxicity.bucket_counts(sample), "counts")
    seeds = np.array(toxicity.word_terms("oaf"), np.int64)
    whole = toxicity.companion_buckets(sample, counts, seeds, 256)
    # the word's own bucket; the first of its terms stands in every text
    assert toxicity.word_terms("tribe")[-1] in whole
    monkeypatch.setattr(toxicity, "PAIRS", most)
    assert toxicity.companion_buckets(sample.repartition(3), counts, seeds, 256).tolist() == whole.tolist()


def test_pair_counts_add_up():
    none = np.empty(0, np.int64)
    keys, n = toxicity.added(none, none, [np.array([5, 3, 5]), np.array([3])])
    assert (keys.tolist(), n.tolist()) == ([3, 5], [2, 2])
    keys, n = toxicity.added(keys, n, [np.array([4, 5])])
    assert (keys.tolist(), n.tolist()) == ([3, 4, 5], [2, 1, 3])
    assert toxicity.added(none, none, [])[0].size == 0 and toxicity.added(none, none, [none])[0].size == 0


def test_urls(spark):
    url = "http://A.Example.NET/en/" + "seg/" * 200_000 + "?" + "&".join(f"k{i}=v" for i in range(50_000))
    pages = spark.createDataFrame([(1, url), (2, "http://m.net/x"), (3, None)], "page_id long, url string")
    host, path = url_rules.host_and_path(F.col("url"))
    got = {r.page_id: r for r in pages.select("page_id", host.alias("h"), path.alias("p"), *(c.alias(n) for c, n in zip(url_rules.listed_rule(host, path), ("r", "v")))).collect()}
    assert (got[1].h, len(got[1].p), got[1].r, got[1].v) == ("a.example.net", 4 + 800_000, "example.net/en/", "allow")
    assert (got[2].r, got[2].v) == ("net/", "block")


def test_shards(rows):
    got = {r.doc_id: r for r in sharding.shard_rows(rows, 2).collect()}
    assert (got[2].size, got[2].text_crc32) == (len(LONG.encode()) + 8, zlib.crc32(LONG.encode()))


def test_slices_by_bytes(monkeypatch):
    texts = ["é" * 30, None, "", "a" * 500, *["b" * 10] * 20, "c" * 130, ""]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    for most in (1, 50, 100, 1 << 20):
        monkeypatch.setattr(common, "TEXT_AT_ONCE", most)
        parts = list(common.slices(batch, 1))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
        assert all(sum(len((t or "").encode()) for t in p.column(1).to_pylist()[1:]) <= most for p in parts)
    assert [p.num_rows for p in common.slices(batch.slice(0, 0), 1)] == [0]


def test_repeats_over_slices(spark):
    """Passages and copies that meet only in other slices of a batch are found all the same."""
    passage, rng = "a passage that stands in several texts of a batch " * 5, np.random.default_rng(1)
    words = lambda: " ".join(map(str, rng.integers(0, 10**9, 60_000)))
    texts = [words() + chr(65 + i) + passage * (i % 5 == 0) + chr(77 + i) + words() for i in range(12)]
    assert sum(map(len, texts)) > 3 * common.TEXT_AT_ONCE
    docs = spark.createDataFrame([*enumerate([*texts, texts[4], None, ""])], "doc_id long, text string").coalesce(1)
    want = {i: (len(passage), 1) if i % 5 == 0 else (len(texts[4]), 1) if i == 4 else (0, 0) for i in range(12)} | {12: (len(texts[4]), 1), 13: (0, 0), 14: (0, 0)}
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.removal_report(docs, filter_bits=16).collect()} == want
    left = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs, filter_bits=16).collect()}
    assert left == {i: t.replace(passage, "") for i, t in enumerate(texts)} | {4: "", 12: "", 13: None, 14: ""}


def test_tokens_let_go_of_words(spark):
    """A worker that goes on to other stages keeps no words of the last one."""
    docs = spark.createDataFrame([(1, "remembered words of a text"), (2, None)], "doc_id long, text string").coalesce(1)

    class Held:
        def mapInArrow(self, call, _):
            return call

        def select(self, *_):
            return self

        schema = docs.schema

    path = bpe.byte_vocabulary()
    call = bpe.token_report(Held(), path, forget=True)
    out = list(call(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": pa.array(["remembered words of a text", None])})])))
    assert out[0].to_pydict()["n_tokens"] == [r.n_tokens for r in bpe.token_report(docs, path).orderBy("doc_id").collect()]
    assert not bpe.encoder(path).words and not bpe.encoder(path).chunks


@pytest.mark.parametrize("hot", [False, True])
def test_memory_beside_a_batch(hot):
    """What a task takes for the scans doesn't grow with the bytes of a batch."""
    code = f"""
import resource
import numpy as np
import pyarrow as pa
from types import SimpleNamespace
from phosfold.llm import suffix_dedup
used = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
scan = suffix_dedup._scan(SimpleNamespace(mapInArrow=lambda f, _: f), 200, 100, SimpleNamespace(value=suffix_dedup._ALL) if {hot} else None)
words = np.random.default_rng(0).integers(0, 10**9, 4_000_000).astype(str)
batch = lambda n: pa.RecordBatch.from_pydict({{"text": pa.array([" ".join(words[i : i + 400]) for i in range(0, n, 400)], pa.string())}})
small, large = batch(400_000), batch(4_000_000)
for _ in scan(iter([small])):
    pass
before = used()
for _ in scan(iter([large])):
    pass
print(large.nbytes / 1e6, used() - before)
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    size, more = map(float, run.stdout.split())
    assert size > 38 and more < 60


@pytest.mark.parametrize(("call", "most"), [("simhash.fingerprint(text)", 25), ("near_copies.shingles(text)", 25), ("huffman.tokenizer(huffman.word_vocabulary()).encode([text])", 40), ("decontaminate.normal(text)", 15), ("toxicity.terms(text)", 15)])
def test_memory_beside_a_text(call, most):
    """At most so many bytes for each byte of a text of words, beside what a small text takes."""
    code = f"""
import resource
from phosfold.llm import decontaminate, huffman, near_copies, simhash, toxicity
used = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
make = lambda n: ' '.join(f'w{{i * 7919 % 50021}} t{{i % 31}}.' for i in range(n))
text = make(10)
{call}
text = make(1_000_000)
before = used()
{call}
print((used() - before) / len(text))
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    assert float(run.stdout) < most
