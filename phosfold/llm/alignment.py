"""Alignment of two tokenizers' ids over the same bytes, by whitespace-token anchors.

A text with a space before it is tokenised in full by a byte-level vocabulary (A) and by a
sentencepiece model with byte fallback (B, which adds the space). An anchor is a byte offset where an
A token and a B token end and space-marked tokens of both begin; that both ends are the same offset is
verified on the tokens' bytes, never taken from the text. Anchors split a document into windows of ids. What
two windows of ids have in common is worked out once for each distinct tuple of ids and remembered up to
a fixed number of them: the groups between common ends, and the id pairs that end together.

Texts are tokenised part by part; a part begins with a space behind another character, and no cut of A
and no piece of B reaches over such a place (checked when the files are read).

Links are counted over all documents. The number of distinct id pairs has no small bound, so only the
commonest ones, at most `hot_pairs`, are broadcast; links of rarer pairs meet their counts in a join.
The largest count of each B id is one long per id of B's vocabulary.

Null and empty texts, and those whose bytes B does not give back (U+2581 becomes a space), have no
tokens and count for nothing. Repeated rows, equal ids and rows without an id are rows like any other;
an empty table gives an empty table; other columns are ignored. Texts are read in slices that end
before a space, so a very long text costs a slice, its longest stretch without a space and its distinct pairs.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, Encoder, Vocabulary
from .common import materialize, mixed, powers

#: Characters of a part of a text, and those that go through the aligner together.
SLICE, TOGETHER = 1 << 19, 1 << 20
#: Windows that a worker remembers.
REMEMBERED = 250_000
#: Id pairs whose counts are broadcast (16 MB).
HOT_PAIRS = 1 << 20
SHIFT = 20
MARK = "▁"


class Pieces:
    """Ids of parts by the sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, self.token_bytes = self.model, []
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"{path} has a piece with a space behind other characters: {piece!r}")
            self.token_bytes.append(bytes([int(piece[3:5], 16)]) if m.is_byte(i) else piece.replace(MARK, " ").encode())
        if self.model.encode(" a  b ", out_type=str) != self.model.encode(" a", out_type=str) + [MARK, MARK + "b", MARK]:
            raise ValueError(f"{path} does not keep white space as it is")
        self.kind = "H" if len(self.token_bytes) <= 1 << 16 else "I"
        self.space = [m.piece_to_id(MARK)]

    def encode(self, part: str) -> bytes | None:
        """Ids of a part that begins with a space; None if their bytes are not the part's."""
        ids = self.model.encode(part[1:]) if len(part) > 1 else self.space
        return np.array(ids, self.kind).tobytes() if b"".join(map(self.token_bytes.__getitem__, ids)) == part.encode() else None


def parts(text: str):
    """The text with a space before it, in parts that begin with a space behind another character."""
    text, at = " " + text, 0
    while at < len(text):
        stop = at + SLICE
        while stop < len(text) and not (text[stop] == " " and not text[stop - 1].isspace()):
            stop = text.find(" ", stop + 1) if text.find(" ", stop + 1) > 0 else len(text)
        yield text[at:stop]
        at = stop


class Aligner:
    """Both tokenizers, and what is remembered of windows."""

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED):
        import tiktoken

        v = Vocabulary(a_path)
        self.a, self.b, self.remembered = Encoder(v, remembered), Pieces(b_path), remembered
        # where ids are in the order of the merges, they are the ranks that the faster library takes
        order = [made & (1 << SHIFT) - 1 for _, made in sorted((x >> SHIFT, x) for x in v.pairs.values())]
        ranks = {t: i for i, t in enumerate(v.token_bytes) if i not in v.special.values()}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if order == sorted(set(order)) else None
        random = np.random.default_rng(11)
        self.tables = []
        for token_bytes in (v.token_bytes, self.b.token_bytes):
            sizes = np.array([len(t) for t in token_bytes], np.int64)
            spaced = np.array([t[:1] == b" " for t in token_bytes])
            self.tables.append((sizes, spaced, random.integers(0, 1 << 63, len(token_bytes), np.uint64) * np.uint64(2) + np.uint64(1)))
        # an id within a group, at the end of one and at the end of a window
        a_text, b_text = ([f"{i}{mark}" for mark in marks for i in range(len(t))] for t, marks in ((v.token_bytes, ",|"), (self.b.token_bytes, (",", ";", "\n"))))
        self.written, self.b_from = a_text + b_text, len(a_text)
        #: Number of each window by its ids of A, a mark that is no id, and its ids of B; the groups of each as text; its links; where they begin.
        self.windows: dict[bytes, int] = {}
        self.between = b"\xff" * max(np.dtype(k).itemsize for k in (self.a.kind, self.b.kind))
        self.texts: list[str] = []
        self.links, self.begins = np.empty(0, np.int64), np.zeros(1, np.int64)

    def a_ids(self, part: str) -> bytes:
        if self.fast is None or len(part) > 2 * SLICE:
            return b"".join(self.a.slices(part, 0, len(part)))
        return np.array(self.fast.encode_ordinary(part), self.a.kind).tobytes()

    def groups(self, *windows: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For windows of ids of A and of B: their groups as text, all their links as a << SHIFT | b, and how many each has."""
        kinds = [np.dtype(self.a.kind), np.dtype(self.b.kind)]
        ids = [np.frombuffer(b"".join(w), k).astype(np.int64) for w, k in zip(windows, kinds)]
        last = [np.cumsum(np.fromiter(map(len, w), np.int64, len(w))) // k.itemsize - 1 for w, k in zip(windows, kinds)]
        joined = [b"".join(map(t.__getitem__, i.tolist())) for t, i in zip((self.a.v.token_bytes, self.b.token_bytes), ids)]
        ends = [np.cumsum(sizes[i]) for i, (sizes, _, _) in zip(ids, self.tables)]
        if joined[0] != joined[1] or not np.array_equal(ends[0][last[0]], ends[1][last[1]]):
            raise ValueError("the tokenizers give different bytes between two anchors")
        ending = []
        for mine, others in (ends, ends[::-1]):
            ending.append(others[np.minimum(np.searchsorted(others, mine), others.size - 1)] == mine)
        group = [np.cumsum(e) - e for e in ending]
        codes = [ids[0] + ending[0] * len(self.a.v.token_bytes), ids[1] + ending[1] * len(self.b.token_bytes) + self.b_from]
        codes[1][last[1]] += len(self.b.token_bytes)
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        texts = "".join(map(self.written.__getitem__, np.concatenate(codes)[order].tolist())).split("\n")[:-1]
        return texts, ids[0][ending[0]] << SHIFT | ids[1][ending[1]], np.diff(np.append(0, group[0][last[0]] + 1))

    def split(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows begin in `a` and in `b`."""
        at, starts = [], []
        for ids, (sizes, spaced, _) in ((a, self.tables[0]), (b, self.tables[1])):
            size = sizes[ids]
            at.append(np.flatnonzero(spaced[ids]))
            starts.append((np.cumsum(size) - size)[at[-1]])
        place = np.minimum(np.searchsorted(starts[1], starts[0]), starts[1].size - 1)
        shared = starts[1][place] == starts[0]
        return at[0][shared], at[1][place[shared]]

    def numbered(self, ids: list[np.ndarray], at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(first window with each distinct tuple of ids, which of them each window has)."""
        h = np.zeros(at[0].size, np.uint64)
        ends = [np.append(i[1:], x.size) for i, x in zip(at, ids)]
        for x, begin, end, (_, _, values) in zip(ids, at, ends, self.tables):
            up, down = powers(x.size + 1)
            sums = np.zeros(x.size + 1, np.uint64)
            np.cumsum(values[x] * up[: x.size], out=sums[1:])
            h = mixed(h + (sums[end] - sums[begin]) * down[begin])
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        for x, begin, end in zip(ids, at, ends):  # equal hashes must be equal ids
            many, like = end - begin, first[which]
            same = np.array_equal(many, many[like])
            if not same or not np.array_equal(x[np.arange(x.size) + np.repeat(begin[like] - begin, many)], x):
                keys: dict[tuple[bytes, ...], int] = {}
                tuples = [tuple(y[i:j].tobytes() for y, i, j in zip(ids, *w)) for w in zip(zip(*at), zip(*ends))]
                which = np.array([keys.setdefault(t, len(keys)) for t in tuples])
                return np.unique(which, return_index=True)[1], which
        return first, which

    def align(self, a: list[bytes], b: list[bytes]):
        """For parts with ids `a` and `b`: the groups of each as text, and its distinct links as (part, link, how often)."""
        raw = [b"".join(a), b"".join(b)]
        ids = [np.frombuffer(r, k) for r, k in zip(raw, (self.a.kind, self.b.kind))]
        at = list(self.split(*ids))
        first, which = self.numbered(ids, at)
        begin = [(i[first] * x.itemsize).tolist() for i, x in zip(at, ids)]
        end = [(np.append(i[1:], x.size)[first] * x.itemsize).tolist() for i, x in zip(at, ids)]
        (a_raw, b_raw), between = raw, self.between
        keys = [a_raw[i:j] + between + b_raw[k:n] for i, j, k, n in zip(begin[0], end[0], begin[1], end[1])]
        number = list(map(self.windows.get, keys))
        new = [w for w, n in enumerate(number) if n is None]
        texts, links, begins = self.texts, self.links, self.begins
        if new:
            found, more, many = self.groups(*([r[i[w] : j[w]] for w in new] for r, i, j in zip(raw, begin, end)))
            here = dict(zip((keys[w] for w in new), range(len(texts), len(texts) + len(new))))
            for w, n in zip(new, here.values()):
                number[w] = n
            texts, links, begins = texts + found, np.concatenate([links, more]), np.concatenate([begins, begins[-1] + np.cumsum(many)])
            if len(self.windows) + len(new) <= self.remembered:
                self.windows |= here
                self.texts, self.links, self.begins = texts, links, begins
        number = np.array(number)[which]
        part_at = np.searchsorted(at[0], np.cumsum([0, *(len(x) // ids[0].itemsize for x in a)]))
        written = list(map(texts.__getitem__, number.tolist()))
        count = begins[number + 1] - begins[number]
        all_links = links[np.arange(int(count.sum())) + np.repeat(begins[number] - (np.cumsum(count) - count), count)]
        part = np.repeat(np.repeat(np.arange(len(a)), np.diff(part_at)), count)
        both = np.sort(part << (2 * SHIFT) | all_links)
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        edges = part_at.tolist()
        return [written[i:j] for i, j in zip(edges, edges[1:])], both[new] >> (2 * SHIFT), both[new] & (1 << (2 * SHIFT)) - 1, np.diff(np.append(new, both.size))


class _Document:
    """What a document's parts have given so far."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = 0
        self.sha = hashlib.sha256()
        self.links, self.times, self.merged = [], [], 0

    def add(self, n_a, n_b, groups, links, times):
        self.sha.update(((";" if self.n_groups else "") + ";".join(groups)).encode())
        self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + int(times.sum())
        self.links.append(links)
        self.times.append(times)
        if len(self.links) > 1 and sum(x.size for x in self.links) > 2 * self.merged + (1 << 16):
            self.merge()

    def merge(self):
        links, which = np.unique(np.concatenate([np.empty(0, np.int64), *self.links]), return_inverse=True)
        self.times = [np.bincount(which, np.concatenate([np.empty(0), *self.times]), links.size).astype(np.int64)]
        self.links, self.merged = [links], links.size

    def row(self):
        if len(self.links) != 1:
            self.merge()
        return self.n_a, self.n_b, self.n_groups, self.sha.hexdigest() if self.n_groups else "", self.links[0], self.times[0]


def aligned(texts, aligner: Aligner):
    """A finished document for each text, in order; parts of many texts go through the aligner together."""
    waiting, held, size = [], [], 0

    def flush():
        if held:
            groups, part, links, times = aligner.align([h[1] for h in held], [h[2] for h in held])
            cuts = np.searchsorted(part, np.arange(len(held) + 1))
            for k, (doc, a, b) in enumerate(held):
                doc.add(len(a) // np.dtype(aligner.a.kind).itemsize, len(b) // np.dtype(aligner.b.kind).itemsize, groups[k], links[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]])
            held.clear()

    for text in texts:
        doc, text = _Document(), text or ""
        waiting.append(doc)
        # a text of several parts is tried as a whole before any of them counts
        whole = len(text) < SLICE or all(aligner.b.encode(p) is not None for p in parts(text))
        for p in parts(text) if text and whole else ():
            if (b := aligner.b.encode(p)) is None:
                break
            held.append((doc, aligner.a_ids(p), b))
            size += len(p)
            if size >= TOGETHER:
                flush()
                size = 0
        if not held:
            yield from (d.row() for d in waiting)
            waiting = []
    flush()
    yield from (d.row() for d in waiting)


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner, read once."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links, times) for every row: its distinct links as a << 20 | b and how often each is there."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    columns = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "links": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}

    def run(stream):
        for batch in stream:
            ids, found, at = batch.column(0), aligned(batch.column(1).to_pylist(), aligner(a_path, b_path)), 0
            while out := list(islice(found, 500)):
                arrays = [pa.array([r[k] for r in out], t) for k, t in enumerate(columns.values())]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(out)), *arrays], names=["doc_id", *columns])
                at += len(out)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>, times array<long>")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n) over the links of all documents; each batch is summed before the shuffle."""

    def run(stream):
        for batch in stream:
            pairs, which = np.unique(batch.column(0).flatten().to_numpy(), return_inverse=True)
            n = np.bincount(which, batch.column(1).flatten().to_numpy(), pairs.size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    return links.select("links", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _least_hot(counts: DataFrame, hot_pairs: int) -> int:
    """The smallest power of two so that at most `hot_pairs` pairs are that common."""
    sizes = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2(F.col("n"))).cast("int").alias("k")).count().collect()}
    total, k = 0, max(sizes, default=0)
    while k >= 0 and total + sizes.get(k, 0) <= hot_pairs:
        total, k = total + sizes.get(k, 0), k - 1
    return 1 << (k + 1)


def alignment_report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
    sc = docs.sparkSession.sparkContext
    first = materialize(linked(docs, a_path, b_path, id_col, text_col), "links")
    counts = materialize(pair_counts(first), "pairs")
    b_of = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    best = counts.groupBy(b_of.alias("b")).agg(F.max("n").alias("n")).toArrow()
    tops = np.zeros(int(best["b"].to_numpy().max(initial=0)) + 1, np.int64)
    tops[best["b"].to_numpy()] = best["n"].to_numpy()
    least = _least_hot(counts, hot_pairs)
    hot = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(hot["pair"].to_numpy())
    shared = sc.broadcast((hot["pair"].to_numpy()[order], hot["n"].to_numpy()[order], tops))
    fields = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]

    def weigh(stream):
        pairs, n, top = shared.value
        for batch in stream:
            lists = batch.column(5)
            links, times = lists.flatten().to_numpy(), batch.column(6).flatten().to_numpy()
            many = np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(len(batch)), many)
            at = np.minimum(np.searchsorted(pairs, links), max(0, pairs.size - 1))
            known = pairs[at] == links if pairs.size else np.zeros(links.size, bool)
            count = np.where(known, n[at] if pairs.size else 0, 0)
            best = known & (count == top[links & (1 << SHIFT) - 1])
            sums = [pa.array(np.bincount(of, w, len(batch)).astype(np.int64)) for w in (times, times * best)]
            # sums of counts are kept exact beyond 2**53
            ends = np.cumsum(many)
            total = np.concatenate([[0], np.cumsum(count * times)])
            cold = np.concatenate([[0], np.cumsum(~known)])
            offsets = pa.array(np.concatenate([[0], cold[ends]]), pa.int32())
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~known], pa.int64())) for x in (links, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), *sums, pa.array(total[ends] - total[ends - many]), *rest], names=[*fields, "n_links", "n_best", "count_sum", "links", "times"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema if f.name in fields)
    weighed = first.select(*fields, "links", "times").mapInArrow(weigh, schema + ", n_links long, n_best long, count_sum long, links array<long>, times array<long>")
    weighed = materialize(weighed.withColumn("row", F.monotonically_increasing_id()), "weighed")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least <= 1:  # every pair was broadcast
        return weighed.select(columns)
    tops_of = docs.sparkSession.createDataFrame(best) if best.num_rows else counts.select(b_of.alias("b"), "n")
    rare = weighed.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", F.col("x.links").alias("pair"), F.col("x.times").alias("times"))
    top = F.broadcast(tops_of.withColumnRenamed("n", "top"))  # a row for each id of B
    rare = rare.join(counts.where(F.col("n") < least), "pair").join(top, b_of == F.col("b"))
    rare = rare.groupBy("row").agg(F.sum(F.expr("if(n = top, times, 0)")).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    some = F.size("links") > 0
    joined = weighed.where(some).join(rare, "row").withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})
    return weighed.where(~some).select(columns).unionByName(joined.select(columns))


def op11_alignment(spark, sf_dir):
    import public_tokenizers

    return alignment_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
