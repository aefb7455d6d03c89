"""Training-data operators against plain versions, on odd inputs and on the small test tables."""

import collections
import hashlib
import itertools
import os
import random
import statistics
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from phosfold.llm import bpe, common, decontaminate, huffman, interleave, near_copies, quality, registry, sharding, simhash, suffix_dedup, toxicity, url_rules  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} other{i % 31}." for i in range(9000))
PASSAGE = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(260))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two"), (6, "Same text twice here."), (6, "Same text twice here."), (7, "Same text twice here."),
    (None, "no id at all here"), (None, None), (8, LONG), (9, LONG + " tail"), (10, "x" * 900), (11, PASSAGE + " left " + "é" * 300), (12, "right " + PASSAGE),
    (13, "é<|endoftext|>\x00 \U0001f600 it's 12  34"), (14, "ab" * 400 + "\n\n"),
]
COLUMNS = ["text", "_d", "_w", "_may", "_spans", "score", "fp", "n", "d", "w", "part", "a", "x", "size", "shard", "component_id"]


def documents(spark, rows):
    """With more columns whose names clash with those that operators make."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit(7) for c in COLUMNS if c != "text"})


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, ODD).limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, odd, none, docs):
    for table in (odd, docs):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        values = [plain_fingerprint(t) for _, t in rows]
        group = list(range(len(rows)))

        def find(i):
            while group[i] != i:
                i = group[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if (values[i] ^ values[j]).bit_count() <= 3:
                    group[max(find(i), find(j))] = min(find(i), find(j))
        least = {}
        for i, (d, _) in enumerate(rows):
            least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
        want = collections.Counter((d, values[i], least[find(i)]) for i, (d, _) in enumerate(rows))
        got = simhash.near_duplicates(table, tile_rows=16)
        assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def words_of(name):
    return " ".join(f"{name}{i}" for i in range(30))


@pytest.mark.parametrize("block", [1 << 21, 400])
def test_pipeline_stage_against_jaccard(spark, odd, none, docs, block):
    import corpus_pipeline as cp

    words = [f"w{i}" for i in range(120)]
    copies = [(100 + k, " ".join(words[:k] + ["new"] + words[k + 1 :])) for k in (0, 20, 50, 110)]
    copies += [(200 + k, " ".join([f"x{k}" if i in (20, 30) else w for i, w in enumerate(words)])) for k in range(4)]
    # ids that stand for several texts, rows without an id, and equal rows
    copies += [(300, words_of("a")), (300, words_of("b")), (301, words_of("b")), (301, words_of("c")), (None, words_of("c")), (None, words_of("d")), (None, words_of("d")), (302, words_of("e")), (302, words_of("e"))]
    for table in (odd, docs, documents(spark, copies)):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        sets = [plain_shingles(t) for _, t in rows]
        group = list(range(len(rows)))
        pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
        for _ in rows:
            for i, j in pairs:
                group[i] = group[j] = min(group[i], group[j])
        least = {g: min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None) for g in group}
        got = near_copies.near_copies(table, block)
        assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter((d, least[g]) for (d, _), g in zip(rows, group))
        if block > 400:
            kept = cp.without_near_duplicates(spark, table, SF)
            assert kept.columns == table.columns
            member = {row: g for row, g in zip(rows, group)}
            stayed = [(r.doc_id, r.text) for r in kept.collect()]
            # one row of each group, and that of the group's smallest id
            assert sorted(member[r] for r in stayed) == sorted(set(group)) and all(r[0] == least[member[r]] for r in stayed)
    assert near_copies.keep_one(none).count() == 0


def test_close_pairs():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:1000] ^ np.uint64(5), rng.integers(0, 1 << 63, 2000, dtype=np.uint64)])
    got = {(int(i), int(j)) for x, y in simhash.close_pairs(a, b, 3) for i, j in zip(x, y)}
    want = {(int(i), int(j)) for x, y in simhash._exact(a, b, 3) for i, j in zip(x, y)}
    assert got == want and len(want) >= 1000


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert {x: got.get(x, x) for x in root} == root


def test_rounds_of_components(spark):
    """A round of stars by few exchanges gives the edges that the plain definition gives."""
    rng = random.Random(3)
    edges = {(max(p), min(p)) for p in (rng.sample(range(60), 2) for _ in range(90))}
    e = spark.createDataFrame(sorted(edges), "u long, v long")
    beside = collections.defaultdict(set)
    for u, v in edges:
        beside[u].add(v)
        beside[v].add(u)
    large = {(y, min(x, *beside[x])) for x in beside for y in beside[x] if y > x}
    got = common.large_star(e)
    assert {tuple(r) for r in got.collect()} == large
    below = collections.defaultdict(set)
    for u, v in large:
        below[u].add(v)
    small = {(x, min(vs)) for u, vs in below.items() for x in (u, *vs) if x != min(vs)}
    got = common.small_star(got).distinct()
    assert {tuple(r) for r in got.collect()} == small


def test_components_shuffle_little(spark, monkeypatch):
    """Few exchanges a round: the driver keeps books for every task of each."""
    plans = []
    write = common.materialize

    def watched(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(df, *args)

    monkeypatch.setattr(common, "materialize", watched)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        common.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # the plan shows an exchange that is used twice at each place
    assert len(plans) > 2 and max(plans[1:]) <= 7


def plain_removal(texts, length):
    seen = collections.Counter()
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()


def test_suffix_dedup(spark, odd, none, docs):
    for table, length in ((odd, 200), (docs, 200), (odd.where("length(text) < 2000 or text is null"), 16)):
        rows = table.select("doc_id", "text").collect()
        table = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
        want = collections.Counter((r.doc_id, *p) for r, p in zip(rows, plain_removal([r.text for r in rows], length)))
        assert collections.Counter(map(tuple, suffix_dedup.removal_report(table, length=length, filter_bits=12).collect())) == want
    assert suffix_dedup.removal_report(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0
    left = suffix_dedup.remove_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert {r.doc_id: r.text for r in left.where("doc_id in (11, 12)").collect()} == {11: " left ", 12: "right "}
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(odd, length=1000)


@pytest.mark.parametrize("rounds", (1, 3))
def test_doubling_rounds(spark, monkeypatch, rounds):
    monkeypatch.setattr(suffix_dedup, "ROUNDS", rounds)
    rng = random.Random(rounds)
    for length in (4, 9, 13):
        steps = suffix_dedup.offsets(length)
        assert len(steps) == rounds and sorted(steps[:-1]) == steps[:-1]
        runs = [(i, bytes(rng.choice(b"ab") for _ in range(length + rng.randint(0, 9))), rng.random() < 0.7) for i in range(12)] + [(12, b"a" * (length + 5), True)]
        seen = collections.Counter(c[j : j + length] for _, c, _ in runs for j in range(len(c) - length + 1))
        want = sorted((i, j) for i, c, is_open in runs for j in range(len(c) - length + 1) if is_open and seen[c[j : j + length]] > 1)
        found = suffix_dedup._doubled(spark.createDataFrame(runs, "run long, content binary, open boolean"), length)
        assert sorted((r.id >> 13, r.id >> 4 & 511) for r in found.collect()) == want and want


def test_runs_cover_every_start(monkeypatch):
    rng = np.random.default_rng(0)
    for raw in (rng.integers(0, 3, 5000, dtype=np.uint8).tobytes(), b"a" * 3000, b"abc" * 900):
        _, s, n = suffix_dedup.runs(raw, 200, 100)
        assert np.array_equal(np.concatenate([np.arange(a, a + b) for a, b in zip(s, n)]), np.arange(len(raw) - 199))
    monkeypatch.setattr(suffix_dedup, "STARTS_AT_ONCE", 100)
    assert [at for at, _ in suffix_dedup.pieces(b"x" * 450, 200)] == [0, 100, 200]


@pytest.mark.parametrize("keys", [None, 1 << 63, ~0])
def test_short_texts_are_filed_together(monkeypatch, keys):
    """A group of short texts is named at once and files what each text files alone."""
    rng, calls, names = random.Random(4), [], suffix_dedup.names
    hot = None if keys is None else np.array([keys & (1 << 64) - 1], np.uint64)
    raws = [bytes(rng.choice((b"a", b"ab", bytes(range(256)))[i % 3]) for _ in range(rng.choice((200, 201, 300, 399)))) for i in range(600)]
    texts = [(raw, *suffix_dedup.digest(raw), rng.choice((0, 7)), rng.choice((1, 2))) for raw in raws]
    monkeypatch.setattr(suffix_dedup, "names", lambda raw, k: calls.append(len(raw)) or names(raw, k))
    for k in (100, 180, 200):
        calls.clear()
        found = suffix_dedup._file(texts, 200, k, hot)
        assert sum(calls) == sum(map(len, raws)) and len(calls) <= 1 + sum(calls) // suffix_dedup.BYTES_AT_ONCE
        alone = [suffix_dedup._file([t], 200, k, hot) for t in texts]
        if hot is not None:
            for i, one in enumerate(alone):
                one["of"] = one["of"] + i
        assert all(np.array_equal(v, np.concatenate([one[c] for one in alone])) for c, v in found.items()) and found["a"].size


def test_first_rank_pairs_are_made_together(spark, monkeypatch):
    """The runs of a batch are named a group at a time, and a run's pairs lie in it."""
    rng, calls, names = random.Random(5), [], suffix_dedup.names
    rows = [(i, bytes(rng.choice(b"ab") for _ in range(rng.randint(13, 30))), i % 3 > 0) for i in range(600)]
    monkeypatch.setattr(suffix_dedup, "names", lambda raw, k: calls.append(1) or names(raw, k))

    class Left:
        def mapInArrow(self, call, _):
            self.call = call
            return spark.createDataFrame([], "id long, r1 long, r2 long")

    suffix_dedup._doubled(left := Left(), 13)
    batch = pa.RecordBatch.from_pydict({"run": [r[0] for r in rows], "content": pa.array([r[1] for r in rows], pa.binary()), "open": [r[2] for r in rows]})
    got = {i: (r1, r2) for b in left.call(iter([batch])) for i, r1, r2 in zip(*b.to_pydict().values())}
    assert len(calls) <= 1 + len(rows) // suffix_dedup.RUNS_AT_ONCE
    at = [sum(o for b, o in enumerate(suffix_dedup.offsets(13)) if p >> b & 1) for p in range(8)]
    want = {}
    for run, raw, is_open in rows:
        h = names(raw, 2).view(np.int64)
        for j in range(len(raw) - 12):
            for p in range(4):
                want[(run << 13) + (j << 4) + 8 * is_open + p] = (h[j + at[2 * p]], h[j + at[2 * p + 1]])
    assert got == want


def test_bpe(spark, odd, none, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.byte_vocabulary())
    for table in (odd, docs):
        got = collections.Counter(map(tuple, bpe.token_report(table, bpe.byte_vocabulary()).collect()))
        want = collections.Counter()
        for r in table.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want[(r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))] += 1
        assert got == want
    assert bpe.token_report(none, bpe.byte_vocabulary()).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(odd, bpe.byte_vocabulary()), bpe.byte_vocabulary())
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter((i, t or "") for i, t in ODD)


def test_bpe_streams_in_constant_memory(monkeypatch):
    from tokenizers import Tokenizer

    coder, library = bpe.Encoder(bpe.Vocabulary(bpe.byte_vocabulary()), remembered=50), Tokenizer.from_file(bpe.byte_vocabulary())
    rng = random.Random(4)
    letters = list("abcthe  \n\t 019'sllré中\U0001f600\x1c\xa0\u3000.,!ΣĠ") + ["<|endoftext|>", "'ll", "   ", "\n\n", "\r\n", " \t"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(1500)] + ["".join(rng.choices("aethinorsb", k=5000)), "=" * 3000, "ab" * 2000]
    for t in texts:
        assert coder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(coder.words) <= 50
    # a cut that comes byte by byte, and slices of any size, give the same ids
    assert list(coder.stream(bytes([b]) for b in b"ab" * 2000)) == library.encode("ab" * 2000, add_special_tokens=False).ids
    texts += ["!\x1c" * 40, "a!\x1cb \x1d!" * 30]
    for slice_size in (1, 7, 60):
        monkeypatch.setattr(bpe, "SLICE", slice_size)
        for t in texts[: 400 if slice_size > 1 else 100] + texts[-3:]:
            assert coder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
            assert all(p.size <= max(4 * slice_size, 4) for p in coder.pieces(t)) or slice_size < 60
    monkeypatch.undo()
    # emitted ids are final: what follows cannot change them
    ids = iter(coder.stream(itertools.chain(iter([b"x" * 600]), iter(lambda: b"yz" * 300, None))))
    assert len(list(itertools.islice(ids, 5000))) == 5000
    decoder, ids = bpe.Decoder(coder.v), [rng.randrange(coder.v.size) for _ in range(2000)]
    assert "".join(decoder.feed([i]) for i in ids) + decoder.close() == library.decode(ids, skip_special_tokens=False)


def test_huffman(spark, odd, none, docs):
    from tokenizers import Tokenizer

    path = huffman.word_vocabulary()
    library = Tokenizer.from_file(path)
    for table in (odd, docs, none):
        stored = common.materialize(huffman.encoded(table, path), "t")
        folder = common.work_path(spark, "t")
        huffman.write_segments(stored, folder, path, huffman.id_counts(stored, path), block=7, segment=50, part=3000)
        got = huffman.read_segments(spark, folder).collect()
        rows = table.collect()
        ids = collections.defaultdict(list)
        for r in rows:
            ids[r.doc_id].append(library.encode(r.text or "", add_special_tokens=False).ids + [1])
        assert len(got) == len(rows)
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda i: (i is not None, i))
        crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
        assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((i, len(x), crc(x)) for i, xs in ids.items() for x in xs)


def test_tokenizer_file_is_checked():
    with pytest.raises(ValueError):
        huffman.WordTokenizer(bpe.byte_vocabulary())
    with pytest.raises(ValueError):
        bpe.Vocabulary(huffman.word_vocabulary())


def test_code_lengths():
    import heapq

    for seed in range(12):
        rng = np.random.default_rng(seed)
        counts = (rng.pareto(1, int(rng.integers(2, 300))) * 10).astype(np.int64)
        for limit in (10, 24):
            size = huffman.code_lengths(counts, limit)[counts > 0]
            assert size.size < 2 or (size.max() <= limit and abs((2.0 ** -size.astype(float)).sum() - 1) < 1e-12)
        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        total = 0
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            total += x
            heapq.heappush(heap, x)
        if size.size > 1:
            assert total == (counts * huffman.code_lengths(counts, 24)).sum()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, np.int64), 2)


def test_sharding(spark, odd, none, docs):
    for table, shards in ((odd, 4), (docs, 24), (none, 3), (spark.createDataFrame([(5, "same")] * 400, "doc_id long, text string"), 7)):
        got = sharding.shard_rows(table, shards, points=8).collect()
        want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in table.collect())
        assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        sizes = collections.Counter(r.shard for r in got)
        assert not got or max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
        for s, n in sizes.items():
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n))


def test_ring_against_single_keys():
    """The plan over arc counts puts each key where the keys' own walk does."""
    ends, owners = sharding.ring(5, 6)
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 12, owners.size)
    room = sharding.capacities(int(counts.sum()), 5)
    want, waiting, left = {}, [(a, a, r) for a in range(owners.size) for r in range(counts[a])], list(room)
    while waiting:
        onward = []
        for at, arc, rank in sorted(waiting):
            if left[owners[at]]:
                left[owners[at]] -= 1
                want[arc, rank] = owners[at]
            else:
                onward.append(((at + 1) % owners.size, arc, rank))
        waiting = onward
    got = {(arc, r): s for arc, low, high, s, _ in sharding.place(counts, owners, room) for r in range(low, high)}
    assert got == want
    # a sixth shard moves no more than about its share and the overflow
    at = lambda n: {k: int(sharding.ring(n, 64)[1][np.searchsorted(sharding.ring(n, 64)[0], np.uint64(k)) % (64 * n)]) for k in range(1 << 61, 1 << 63, 1 << 57)}
    assert all(b in (a, 5) for a, b in zip(at(5).values(), at(6).values()))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://net", "http://net/", "http://my.net/a", "https://example.com/de/", "https://EXAMPLE.com", "http://a.org/fr/b", "http://fr.org/frx", "x://internet/", "http://spam.biz/p1?ref=1", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(2, "no scheme"), (None, "http://net/")], "page_id long, url string").withColumns({"rule": F.lit("x"), "host": F.lit("y")})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, labels).where("page_id is not null").collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4] == ("net", "", None, "allow") and got[5] == ("net", "/", "net/", "block") and got[6] == ("my.net", "/a", "net/", "block")
    assert got[7] == ("example.com", "/de/", "example.com/de/", "block") and got[8][2:] == (None, "allow")
    assert got[9] == ("a.org", "/fr/b", "org/fr/", "allow") and got[10][2] is None and got[11][2] is None
    assert got[13] == ("b:", "//c/d", None, "allow")
    assert url_rules.judge(pages, labels).count() == pages.count() and url_rules.judge(pages.limit(0), labels).count() == 0
    bad = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'fine'}{i % 3}.biz/{'shop' if i % 2 else 'news'}/{i}?id={i}") for i in range(200)], "page_id long, url string")
    marks = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(0, 150)], "doc_id long, quality int, toxic int")
    judged = url_rules.judge(bad, marks).collect()
    assert all((r.verdict == "block") == bool(r.page_id % 2) for r in judged)
    # combinations that a shorter rule covers are dropped
    assert {r.mined_rule for r in judged if r.mined_rule} == {"path=shop"}


def plain_rules(rows, least, lift, z, sure, chance):
    """All combinations of tokens, counted one by one."""
    share = sum(bad for _, bad in rows) / len(rows)
    seen, hits = collections.Counter(), collections.Counter()
    for held, bad in rows:
        for k in range(1, len(held) + 1):
            for some in itertools.combinations(sorted(held), k):
                seen[some] += 1
                hits[some] += bad
    tried = sum(n >= least for n in seen.values())
    z = max(z, statistics.NormalDist().inv_cdf(1 - chance / max(1, tried)))
    found = {s: hits[s] / n for s, n in seen.items() if hits[s] >= least and hits[s] / n >= max(sure, lift * share) and hits[s] / n - share >= z * (share * (1 - share) / n) ** 0.5}
    return {s: c for s, c in found.items() if not any(set(p) < set(s) for p in found)}


def test_mined_rules_against_counting(spark):
    rng = random.Random(8)
    urls = [(i, f"http://{rng.choice(['www.', 'm.', ''])}{rng.choice(['win', 'news', 'shop', 'blog'])}.{rng.choice(['biz', 'info'])}/{rng.choice(['a', 'b', 'c'])}/{rng.choice(['x', 'y'])}/{i}?{rng.choice(['ref', 'id'])}={i}") for i in range(900)]
    # a pair of tokens matters and neither of the two does much on its own; one token matters alone
    chance = lambda u: 0.9 if "win" in u and "/a/" in u else 0.6 if "?ref" in u and "biz" in u else 0.2
    marks = [(i, int(rng.random() >= chance(u)), 0) for i, u in urls]
    pages, labels = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = {}
    for i, u in urls:
        host, *path = u.split("?")[0].split("//")[1].split("/")
        held[i] = {f"host={h}" for h in host.split(".")} | {f"path={p}" for p in path if not p.isdigit()} | {"query=" + u.split("?")[1].split("=")[0]}
    want = plain_rules([(held[i], 1 - q) for i, q, _ in marks], 20, 1.25, 2.58, 0.5, 0.01)
    assert any(len(s) > 1 for s in want) and min(want.values()) >= 0.5
    for r in url_rules.judge(pages, labels).collect():
        fired = [(c, -len(s), " ".join(s)) for s, c in want.items() if set(s) <= held[r.page_id]]
        assert (r.verdict, r.mined_rule) == (("block", max(fired)[2]) if fired else ("allow", None))
        assert not fired or r.confidence == pytest.approx(max(fired)[0])
    # nor with labels that have nothing to do with the urls
    fair = spark.createDataFrame([(i, int(rng.random() < 0.6), 0) for i, _ in urls], "doc_id long, quality int, toxic int")
    assert url_rules.judge(pages, fair).where("verdict = 'block'").count() == 0
    # with labels of one kind no rule stands out
    assert url_rules.judge(pages, labels.withColumn("quality", F.lit(0))).where("verdict = 'block'").count() == 0


def test_decontaminate(spark, odd, none, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(docs, items).collect()}
    texts = {r.item_id: decontaminate.normal(r.text) for r in items.collect()}
    whole = {r.doc_id: decontaminate.normal(r.text) for r in docs.collect()}
    assert {k for k, d in got.items() if d == 0} == {(d, i) for d, t in whole.items() for i, b in texts.items() if b in t}
    item = "The quick brown fox jumps over the lazy dog while seven wizards quietly juggle boxes of liquor jugs near the zoo."
    near = item.replace("brown", "brwn").replace("lazy", "Lazzy").replace("seven", " seven\n")
    far = item.replace("brown fox", "red hen").replace("wizards", "plumbers")
    tests = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (1, item)], "item_id long, text string")
    rows = documents(spark, [(1, "aa " + near + " bb"), (2, far), (3, item), (3, item), (None, near), *[(i, t) for i, t in ODD if i and i > 3]])
    found = collections.Counter((r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(rows, tests).collect())
    assert found == {(1, 1, 2): 1, (3, 1, 0): 2, (None, 1, 2): 1}
    assert collections.Counter((r.doc_id, r.distance) for r in decontaminate.leaks(rows, tests, block_bytes=100).collect()) == {(1, 2): 1, (3, 0): 2, (None, 2): 1}
    kept = decontaminate.drop_leaks(rows, tests)
    assert kept.columns == rows.columns and kept.count() == rows.count() - 4
    assert decontaminate.leaks(none, tests).count() == 0 and decontaminate.leaks(odd, tests.limit(0)).count() == 0


def test_short_items(spark):
    tests = spark.createDataFrame([(1, "Who  was Ada?"), (2, "\u65e5\u672c\u306e\u9996\u90fd\u306f\u4f55\u51e6\u3067\u3059\u304b"), (3, "cat"), (4, " "), (5, "x" * 19)], "item_id long, text string")
    texts = ["so: who was\nada? yes", "\u554f\u984c\u3001\u65e5\u672c\u306e\u9996\u90fd\u306f\u4f55\u51e6\u3067\u3059\u304b\u3068\u805e\u304f", "concatenate, cats", "concat cat", "who was adam?", "x" * 20, "x" * 19, "", None]
    rows = documents(spark, list(enumerate(texts)))
    found = collections.Counter(tuple(r) for r in decontaminate.leaks(rows, tests).collect())
    assert found == {(0, 1, 0, 16, 0): 1, (1, 2, 0, 14, 0): 1, (3, 3, 0, 10, 0): 1, (6, 5, 0, 19, 0): 1}
    assert {r.doc_id for r in decontaminate.drop_leaks(rows, tests).collect()} == {2, 4, 5, 7, 8}


def test_myers():
    rng = random.Random(2)
    for _ in range(300):
        p, t = "".join(rng.choices("abc", k=rng.randint(1, 30))), "".join(rng.choices("abc", k=rng.randint(1, 60)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        best = min(row[1:])
        assert decontaminate.myers(p, t, len(p)) == ((best, row.index(best, 1)) if best <= len(p) else None)


def test_interleave(spark, odd, none, tmp_path):
    want = sorted(hashlib.sha256(p).hexdigest() for p in {interleave.payload_of(t)[1] for _, t in ODD})
    for bits in (6, 27):  # a filter that every digest passes as well
        got = interleave.describe_media(interleave.store_media(odd.repartition(3), filter_bits=bits))
        assert sorted(r.payload_sha256 for r in got.collect()) == want
    rows = interleave.document_sequences(odd)
    resolved = interleave.resolve(rows, got).where("kind = 'media'")
    assert resolved.count() == len(ODD) and resolved.where("medium is null").count() == 0
    # sequences keep their texts, but for white space around them, in front of their medium
    texts = collections.Counter((r.id, *(p.text for p in r.parts)) for r in rows.collect())
    assert texts == collections.Counter((i, *([t.strip()] if (t or "").strip() else []), None) for i, t in ODD)
    assert interleave.document_sequences(none).count() == 0 and interleave.describe_media(interleave.store_media(none)).count() == 0
    page = "<html><title>T</title><script>var x='<p>no</p>'</script><p>one &amp; two</p><figure><img src='media:sha256:aa' alt='alt'><figcaption>cap <b>tion</b></figcaption></figure>three<img src=b.png alt=four><img><!-- no --></html>"
    parts = interleave.parse(page)
    assert [(p["position"], p["kind"], p["text"], p["ref"], p["caption"]) for p in parts] == [
        (0, "text", "T", None, None), (1, "text", "one & two", None, None), (2, "media", None, "media:sha256:aa", "cap tion"), (3, "text", "three", None, None), (4, "media", None, "b.png", "four"),
    ]
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (1, page)], "page_id long, html string").withColumn("parts", F.lit(1))
    media = spark.createDataFrame([("aa", 5, 1)], "digest string, size int, position int")
    found = interleave.resolve(interleave.interleaved(pages), media)
    assert collections.Counter((r.id, r.position, r.medium and r.medium["size"]) for r in found.where("kind = 'media'").collect()) == {(1, 2, 5): 2, (1, 4, None): 2}
    with pytest.raises(ValueError):
        interleave.from_pgm(b"P6\n1 1\n255\nabc")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def rows_of(spark, name):
    df = registry.QUERIES[name](spark, SF)
    return [r.asDict() for r in df.collect()], df.columns


def test_contracts_of_rows(spark, docs):
    """The registered queries' columns against plain versions, over the whole small table."""
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    raws = {i: t.encode() for i, t in texts.items()}
    got, _ = rows_of(spark, "op2_huffman")
    library, start = Tokenizer.from_file(huffman.word_vocabulary()), 0
    ids = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(texts)
    for r in sorted(got, key=lambda r: r["start"]):
        x = ids[r["doc_id"]]
        assert r == {"doc_id": r["doc_id"], "start": start, "n_tokens": len(x), "ids_crc32": zlib.crc32(np.array(x, "<u4").tobytes())}
        start += len(x)

    got, _ = rows_of(spark, "op4_sharding")
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len(b) + 8, zlib.crc32(b)) for i, b in raws.items()} and len(got) == len(raws)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)} and {r["shard"] for r in got} == set(range(24))
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values()) and len({len(x) for x in by_shard.values()}) <= 2

    got, _ = rows_of(spark, "op6_interleave")
    for r in got:
        raw = raws[r["doc_id"]]
        padded = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        stored = b"P5\n192 %d\n255\n" % (len(padded) // 192) + padded
        assert {k: v for k, v in r.items() if k != "feature"} == {"doc_id": r["doc_id"], "n_bytes": len(raw), "payload_bytes": len(padded), "payload_sha256": sha(padded), "tail_crc32": zlib.crc32(padded[-16:]), "media_bytes": len(stored), "media_sha256": sha(stored)}
        mean = np.frombuffer(padded, np.uint8).mean()
        assert f" mean={mean:.4f} " in r["feature"]
    assert len(got) == len(raws)
    same = collections.defaultdict(set)
    for r in got:
        same[texts[r["doc_id"]]].add(r["feature"])
    assert all(len(f) == 1 for f in same.values())

    got, _ = rows_of(spark, "op8_bpe")
    library = Tokenizer.from_file(bpe.byte_vocabulary())
    for r in got:
        x = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r == {"doc_id": r["doc_id"], "n_tokens": len(x), "ids_sha256": sha(",".join(map(str, x))), "decoded_sha256": sha(library.decode(x, skip_special_tokens=False))}
    assert len(got) == len(raws)

    got, columns = rows_of(spark, "op9_suffix_dedup")
    assert columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {tuple(r.values()) for r in got} == {(i, *p) for i, p in zip(texts, plain_removal(texts.values(), 200))}

    got, columns = rows_of(spark, "op10_simhash")
    assert {(r["doc_id"], r["fingerprint"]) for r in got} == {(i, f"{plain_fingerprint(t):016x}") for i, t in texts.items()} and columns == ["doc_id", "fingerprint", "component_id"]


def test_contracts_of_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got, _ = rows_of(spark, "op5_url_rules")
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        rest = pages[r["page_id"]].url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut : min([rest.find(c, cut) for c in "?#" if c in rest[cut:]] + [len(rest)])]
        fits = [(len(h + p), h + p, v) for h, p, v in url_rules.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else "block" if r["mined_rule"] else "allow")
    got, _ = rows_of(spark, "interleaved_pages")
    parts = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["position"]):
        parts[r["page_id"]].append((r["position"], r["kind"], r["text"], r["ref"], r["caption"]))
    assert {i: [tuple(p.values()) for p in interleave.parse(r.html)] for i, r in pages.items() if interleave.parse(r.html)} == parts


def test_leaks_against_all_passages(spark, docs):
    """Items with up to their budget of edits, put into documents, against the distance to every passage."""
    rng = random.Random(11)
    items = {r.item_id: decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()}
    texts = [r.text for r in docs.orderBy(F.length("text")).limit(60).collect()]
    rows = []
    for k, t in enumerate(texts):
        item = items[rng.choice(sorted(items))]
        edits, chars = rng.randint(0, int(len(item) * 0.08)), list(item)
        for _ in range(edits):
            at = rng.randrange(len(chars))
            kind = rng.randrange(3)
            chars[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("abcxyz")]
        rows.append((k, f"{t or ''} {''.join(chars)} {t or ''}"[:4000] if k % 3 else t))

    def nearest(p, t):
        row = np.zeros(len(t) + 1, np.int64)
        codes, steps = np.array([ord(c) for c in t], np.int64), np.arange(len(t) + 1)
        for i, c in enumerate(p):
            new = np.concatenate([[i + 1], np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)])
            row = np.minimum.accumulate(new - steps) + steps
        return int(row[1:].min()) if len(t) else len(p)

    want = {(k, i): d for k, t in rows for i, p in items.items() if (d := nearest(p, decontaminate.normal(t))) <= int(len(p) * 0.05)}
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), tests).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in found} == want and len(want) > 15 and max(want.values()) > 2


def held_out_auc(rows, labels):
    scores = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in scores if y], [s for s, y in scores if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.85), ("op7_quality", "quality", 0.95)])
def test_held_out(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = registry.QUERIES[name](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert held_out_auc(rows, labels) >= least


def test_pairs_matter_without_effects_of_their_own(spark):
    """An insult is toxic beside a group mention only; the mention is as common in toxic texts as elsewhere."""
    rng = random.Random(6)
    rows = []
    for i in range(1600):
        words = rng.choices([f"plain{k}" for k in range(40)], k=12)
        insult, group, slur = i % 4 == 0, i % 2 == 0 if i % 4 else i % 8 == 0, i % 4 == 1
        # toxic: an insult with the mention, or a slur without it
        toxic = insult and group or slur and not group
        words += ["oaf"] * insult + ["tribe"] * group + ["slurry"] * slur
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), F.lit(True))
    buckets = set(machine.buckets.tolist())
    assert set(toxicity.word_terms("tribe")) & buckets
    assert machine.score("the oaf of the tribe") > 0.7 > 0.5 > machine.score("the oaf alone")
    # the answer lies in the pair: the linear part of the mention alone says next to nothing
    assert abs(machine.score("tribe") - machine.score("plain")) < 0.2


def test_sample_bounds(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    sample = lambda **k: toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), **k).collect()
    every = sample(most_rows=1000)
    assert sample(most_rows=1000) == every and len(every) == docs.where("doc_id < 200").select("doc_id").distinct().count()
    few = sample(most_rows=1000, most_bytes=20_000)
    assert 0 < len(few) < len(every) and few == every[: len(few)] and sum(len(r.text.encode()) for r in few[:-1]) < 20_000
    twice = docs.union(docs).union(docs.withColumn("text", F.concat("text", F.lit(" x"))))
    assert len(toxicity.labelled_sample(twice, labels, "toxic", F.lit(True), 1000).collect()) == len(every)


def test_field_climbs_whole_chains():
    """The gradient over packed chains is that of the plain likelihood."""
    rng = np.random.default_rng(3)
    first = np.array([0, 1, 61, 64, 70])
    x, state = rng.normal(size=(70, 4)), rng.integers(0, 2, 70)
    field = quality.Field(4)
    field._climb(x, state, first, 1, 0.1, 0.0)

    def loss(weights, pairs):
        total = 0.0
        for a, z in zip(first, first[1:]):
            lean = x[a:z] @ weights
            score = (lean * state[a:z]).sum() + sum(pairs[i, j] for i, j in zip(state[a:z], state[a + 1 : z]))
            alpha = np.array([0.0, lean[0]])
            for t in range(1, z - a):
                alpha = np.array([np.logaddexp(alpha[0] + pairs[0, b], alpha[1] + pairs[1, b]) + b * lean[t] for b in (0, 1)])
            total += np.logaddexp(*alpha) - score
        return total

    # the first step of Adam has the gradient's sign and the rate's size
    at = [np.zeros(4), np.zeros((2, 2))]
    for k, moved in enumerate((field.weights, field.pairs)):
        for i in np.ndindex(at[k].shape):
            up, down = [p.copy() for p in at], [p.copy() for p in at]
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            slope = (loss(*up) - loss(*down)) / 2e-5
            assert moved[i] == pytest.approx(-0.1 * np.sign(slope), rel=1e-3)
    before = loss(field.weights, field.pairs)
    field._climb(x, state, first, 200, 0.05, 0.0)
    assert loss(field.weights, field.pairs) < before


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_inputs(spark, odd, none, module):
    label = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(i, i % 2) for i in range(4, 15)] + [(4, None), (None, 1), (4, 1)], f"doc_id long, {label} int").withColumn("text", F.lit("x"))
    model = module.train(odd, labels, F.lit(True))
    rows = module.score_texts(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and len({r.score for r in rows if r.doc_id in (6, 7)}) == 1
    assert module.score_texts(none, model).count() == 0
    blank = module.train(odd, labels.limit(0), F.lit(True))
    assert {r.score for r in module.score_texts(odd, blank).collect()} == {0.5}


def test_line_features():
    texts = [b"", b"ab\nCD 12\n\nab", "é!|%\n".encode()]
    x, length, first = quality.line_features(texts)
    assert first.tolist() == [0, 1, 5, 7] and length.tolist() == [0, 2, 5, 0, 2, 5, 0]
    quality_slice = quality.SLICE
    try:
        quality.SLICE = 3
        assert np.array_equal(quality.line_features(texts)[0], x)
    finally:
        quality.SLICE = quality_slice


def test_field_is_fitted_without_texts_in_the_driver(spark):
    """The driver gets numbers for each line; the field is that of the texts themselves."""
    rng = random.Random(4)
    texts = ["\n".join("".join(rng.choices("ab C1.|", k=rng.randint(0, 30))) for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    sample = toxicity.labelled_sample(docs, labels, "quality", F.lit(True), 1000)
    known = quality.described(sample)
    assert not any(kind in ("string", "binary") for _, kind in known.dtypes)
    rows = sample.collect()
    whole = quality.Field(quality.line_features([b""])[0].shape[1]).fit([r.text for r in rows], np.array([r.y for r in rows], float))
    field = quality.train(docs, labels, F.lit(True))
    assert np.array_equal(field.weights, whole.weights) and np.array_equal(field.pairs, whole.pairs) and (field.slope, field.offset) == (whole.slope, whole.offset)


def test_marginals_against_enumeration():
    import itertools

    field = quality.Field(1)
    field.pairs = np.array([[0.7, -0.3], [0.2, 0.9]])
    lean = np.array([0.5, -1.0, 2.0, 0.3, -0.7])
    first = np.array([0, 4, 5])
    weight = lambda s: np.exp(sum(lean[i] * s[i] for i in range(4)) + sum(field.pairs[a, b] for a, b in zip(s, s[1:])))
    every = list(itertools.product((0, 1), repeat=4))
    want = [sum(weight(s) for s in every if s[i]) / sum(map(weight, every)) for i in range(4)] + [1 / (1 + np.exp(0.7))]
    assert field.marginals(lean, first) == pytest.approx(want)


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES:
        seen.append(common.materialize(stage(spark, seen[-1], SF), name))
        if name != cp.STAGES[-1][0]:
            assert seen[-1].columns == docs.columns
    good, once, cut, clean, tokens = seen[1:]
    assert 0 < good.count() < docs.count()
    # one document of each group stays
    groups = {r.doc_id: r.component_id for r in near_copies.near_copies(good).collect()}
    assert {r.doc_id for r in once.collect()} == set(groups.values())
    report = {r.doc_id: r for r in suffix_dedup.removal_report(once).collect()}
    for r in cut.collect():
        assert r.n_chars == len(r.text) and len(r.text.encode()) <= report[r.doc_id].n_bytes - report[r.doc_id].n_removed
    leaked = {r.doc_id for r in decontaminate.leaks(cut, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - leaked
    assert {r.doc_id for r in tokens.collect()} == {r.doc_id for r in clean.collect()}
    assert {tuple(r) for r in cp.run(spark, SF).collect()} == {tuple(r) for r in tokens.collect()}
    nothing = docs.limit(0)
    for _, stage in cp.STAGES:
        nothing = stage(spark, nothing, SF)
    assert nothing.count() == 0


def test_quality_of_texts_of_many_lines(monkeypatch):
    rng = random.Random(7)
    texts = ["\n".join(rng.choice(("", "a b a", "| x | 12", "Some words here.", "##!!", "w" * 40, "é é")) for _ in range(n)) for n in (1, 2, 5, 300, 1000)] + ["", "\n", "\n\n", "one line " * 50, "é" * 700]
    field = quality.Field(quality.line_features([b""])[0].shape[1])
    field.weights = np.random.default_rng(3).normal(0, 0.4, field.weights.size)
    field.pairs, field.slope, field.offset = np.array([[0.7, -0.2], [-0.4, 0.9]]), 1.3, -0.2
    want = field.scores(texts)
    whole = [quality.line_features([t.encode()]) for t in texts]
    assert np.allclose(want, [1 / (1 + np.exp(-(1.3 * field.share(field.marginals(x @ field.weights, f), n, f)[0] - 0.2))) for x, n, f in whole])
    for lines, size in ((1, 50), (3, 1 << 20), (64, 90)):
        monkeypatch.setattr(quality, "LINES", lines)
        monkeypatch.setattr(quality, "SLICE", size)
        for t, (x, n, _) in zip(texts, whole):
            parts = list(quality.sliced_features(t.encode()))
            assert np.allclose(np.vstack([p for p, _ in parts]), x) and np.array_equal(np.concatenate([k for _, k in parts]), n)
        assert np.allclose(field.scores(texts), want, rtol=1e-9)


def test_quality_of_a_million_lines_in_bounded_memory():
    import tracemalloc

    field = quality.Field(quality.line_features([b""])[0].shape[1])
    text = "ab\n" * 1_000_000
    tracemalloc.start()
    score = field.scores([text])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 90 << 20 and abs(score - 0.5) < 1e-6


def test_bounded_ring_moves_little():
    """A 25th shard moves little more than its share of the rows, though full shards hand rows on."""
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 20_000, dtype=np.uint64))

    def placed(shards):
        ends, owners = sharding.ring(shards)
        arcs = np.searchsorted(ends, keys) % ends.size
        counts = np.bincount(arcs, minlength=ends.size)
        firsts, at = np.concatenate([[0], np.cumsum(counts)[:-1]]), np.empty(keys.size, int)
        by_arc = np.argsort(arcs, kind="stable")
        for arc, low, high, shard, _ in sharding.place(counts, owners, sharding.capacities(keys.size, shards)):
            at[by_arc[firsts[arc] + low : firsts[arc] + high]] = shard
        return at

    before, after = placed(24), placed(25)
    moved, between = (before != after).mean(), ((before != after) & (after != 24)).mean()
    assert moved < 0.1 and between < 0.06
