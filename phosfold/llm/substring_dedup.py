"""Removal of repeated stretches of words by compressed full-text indexes of shards.

A window is `width` (50) consecutive words of one document; a word goes if a window that covers it also
starts in a document with a smaller id. So the first document keeps a repeated passage.

1. Every window is filed under its smallest-hash stretch of `gram` words, so neighbouring windows form
   runs. A name that one document alone has needs nothing more (a first pass over names and ids; names
   are 64-bit hashes, and a chance collision only lets a run through to the exact steps).
2. Equal runs, known by a 64-bit digest of their bytes, are one class; its owner is the smallest id that has it. The
   owners' runs go to shards by name, so all windows that may be equal meet in one shard.
3. Each shard builds an FM-index of its runs' words (`fm_index`) and streams the runs through backward
   search: where the match reaches the width, the interval gives the smallest owner of that window.
4. Windows whose smallest owner is below a document's own id are its repeated ones.

Names with more than `crowd` classes would make a shard too large: the windows of their runs are filed again
by longer stretches (nine tenths of the width, at last the width itself, where a name is one window and equal
runs become one before they meet), and go through the same steps.

Ids are whole numbers. Rows without an id neither lose words nor take any from others; rows with equal ids
take none from each other; equal rows get equal results. Null and empty texts have no words; an empty table
gives an empty table; other columns are ignored. Long texts go in pieces; of a text the places of its words
are held, 16 bytes each. Words of more than 256 bytes are known by their SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_filter, key_filter, materialize, mixed, powers
from .fm_index import FmIndex

WIDTH, GRAM = 50, 12
LONG_WORD = 256
#: Bytes that are scanned together, words of a piece of a long text, words that are hashed at once.
GROUP, PIECE, AT_ONCE = 1 << 20, 1 << 16, 1 << 14
SHARD_WORDS = 1 << 18
CROWD = 1024
_U = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(13).integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1)


def places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    begin, end, before = [], [], True
    for at in range(0, len(raw), GROUP):
        gap = _GAP[np.frombuffer(raw, np.uint8, min(GROUP, len(raw) - at), at)]
        was = np.concatenate([[before], gap[:-1]])
        begin.append(np.flatnonzero(was & ~gap) + at)
        end.append(np.flatnonzero(gap & ~was) + at)
        before = bool(gap[-1])
    return np.concatenate([np.empty(0, np.int64), *begin]), np.concatenate([np.empty(0, np.int64), *end, [len(raw)] if not before else []]).astype(np.int64)


def word_hashes(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out, size = np.empty(begin.size, _U), end - begin
    long = np.flatnonzero(size > LONG_WORD)
    out[long] = [xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(begin[long].tolist(), end[long].tolist())]
    wide = np.flatnonzero(begin[1:] - end[:-1] > LONG_WORD) + 1
    cuts = np.unique(np.concatenate([np.arange(0, begin.size, AT_ONCE), long, long + 1, wide, [begin.size]]))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if size[i] <= LONG_WORD:
            first, stop = int(begin[i]), int(end[j - 1])
            up, down = powers(stop - first)
            sums = np.zeros(stop - first + 1, _U)
            np.cumsum(_BYTE[np.frombuffer(raw, np.uint8, stop - first, first)] * up[: stop - first], out=sums[1:])
            b = begin[i:j] - first
            out[i:j] = mixed((sums[end[i:j] - first] - sums[b]) * down[b])
    return out


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k neighbouring hashes."""
    if h.size < k:
        return np.empty(0, _U)
    up, down = powers(h.size)
    sums = np.zeros(h.size + 1, _U)
    np.cumsum(h * up[: h.size], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: h.size - k + 1])


def runs(h: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(name of each window's run, place of its sampled stretch), for all windows."""
    g, w = gram_hashes(h, gram), width - gram + 1
    many = g.size - w + 1
    if many < 1:
        return np.empty(0, _U), np.empty(0, np.int64)
    bits = _U(max(1, int(g.size - 1).bit_length()))
    keyed = (g >> bits << bits) | np.arange(g.size, dtype=_U)
    keyed = np.concatenate([keyed, np.full(-g.size % w, ~_U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(keyed, axis=1).ravel()
    back = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[:many], ahead[w - 1 : w - 1 + many]) & ((_U(1) << bits) - _U(1))).astype(np.int64)
    return g[at], at


def short(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\x00" + hashlib.sha256(word).hexdigest().encode()


class _Group:
    """Pieces of texts that are scanned together; a gap stands between them."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], width: int, gram: int):
        self.raw = b" ".join(p for _, _, p in pieces)
        self.begin, self.end = places(self.raw)
        self.width = width
        sizes = np.array([len(p) + 1 for _, _, p in pieces])
        self.cuts = np.searchsorted(self.begin, np.append(0, np.cumsum(sizes)))
        self.hashes = word_hashes(self.raw, self.begin, self.end)
        name, at = runs(self.hashes, width, gram)
        piece = np.repeat(np.arange(len(pieces)), np.diff(self.cuts))
        start = np.arange(name.size)
        piece = piece[: name.size]
        inside = start + width <= self.cuts[piece + 1]
        name, at, start, piece = name[inside], at[inside], start[inside], piece[inside]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])])) if start.size else np.empty(0, np.int64)
        self.name, self.start, self.many, self.piece = name[new], start[new], np.diff(np.append(new, start.size)), piece[new]
        self.doc = np.array([d for d, _, _ in pieces])[self.piece]
        self.place = self.start - self.cuts[self.piece] + np.array([s for _, s, _ in pieces])[self.piece]
        self.long = np.append(0, np.cumsum(self.end - self.begin > LONG_WORD))

    def keep(self, mask: np.ndarray) -> None:
        for c in ("name", "start", "many", "piece", "doc", "place"):
            setattr(self, c, getattr(self, c)[mask])

    def contents(self) -> list[bytes]:
        stop = self.start + self.many + self.width - 1
        plain = (self.long[stop] == self.long[self.start]).tolist()
        spans = zip(plain, self.begin[self.start].tolist(), self.end[stop - 1].tolist())
        return [self.raw[i:j] if p else b" ".join(map(short, self.raw[i:j].split())) for p, i, j in spans]


def _groups(texts: list[str | None], width: int, gram: int):
    held, size = [], 0
    for doc, text in enumerate(texts):
        raw = (text or "").encode()
        if len(raw) <= GROUP:
            pieces = [(doc, 0, raw)]
        else:
            begin, end = places(raw)
            pieces = ((doc, s, raw[begin[s] : end[min(begin.size, s + PIECE + width - 1) - 1]]) for s in range(0, begin.size, PIECE))
        for piece in pieces:
            held.append(piece)
            size += len(piece[2]) + 1
            if size >= GROUP:
                yield _Group(held, width, gram)
                held, size = [], 0
    if held:
        yield _Group(held, width, gram)


def digest(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63)


def owner_keys(a: np.ndarray, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mixed(a.view(_U) ^ (x.view(_U) * _U(0x9E3779B97F4A7C15)) ^ (owner.view(_U) * _U(0xC2B2AE3D27D4EB4F))).view(np.int64)


def _batch(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in types.items()], names=list(types))


_NAMES = {"a": pa.int64(), "doc_id": pa.int64()}
_RUNS = {"a": pa.int64(), "x": pa.int64(), "doc_id": pa.int64(), "d": pa.int64(), "s": pa.int64(), "n": pa.int64()}
_CONTENTS = {"a": pa.int64(), "x": pa.int64(), "doc_id": pa.int64(), "content": pa.binary()}
_FOUND = {"a": pa.int64(), "x": pa.int64(), "j": pa.int64(), "many": pa.int64(), "least": pa.int64()}


def _schema(types: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {'binary' if pa.types.is_binary(t) else 'long'}" for c, t in types.items())


def _scan(texts: DataFrame, width: int, gram: int, hot=None, owners=None) -> DataFrame:
    """Names of all runs; with `hot`, the runs whose name is in that filter; with `owners`, the contents of those of class owners."""
    types = _NAMES if hot is None else _RUNS if owners is None else _CONTENTS

    def run(stream):
        for batch in stream:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            marks = np.array([digest(t) for t in texts], np.int64) if types is _RUNS else None
            for group in _groups(texts, width, gram):
                if hot is not None:
                    group.keep(in_filter(hot.value, group.name))
                out = {"a": group.name.view(np.int64), "doc_id": ids[group.doc]}
                if hot is not None:
                    contents = group.contents()
                    out["x"] = np.array([xxhash.xxh3_64_intdigest(c) for c in contents], _U).view(np.int64)
                if types is _RUNS:
                    out |= {"d": marks[group.doc], "s": group.place, "n": group.many}
                elif types is _CONTENTS:
                    mine = np.flatnonzero(in_filter(owners.value, owner_keys(out["a"], out["x"], out["doc_id"])))
                    mine = mine[np.unique(np.stack([out["a"], out["x"], out["doc_id"]])[:, mine], axis=1, return_index=True)[1]] if mine.size else mine
                    out = {c: v[mine] for c, v in out.items()} | {"content": [contents[i] for i in mine.tolist()]}
                yield _batch(out, types)

    return texts.mapInArrow(run, _schema(types))


def indexed(a: list[int], x: list[int], owner: list[int], contents: list[bytes], width: int) -> dict[str, np.ndarray]:
    """What a shard's index says of its runs: stretches of starts with the same smallest owner."""
    numbers: dict[bytes, int] = {b"": 0}
    ids = [[numbers.setdefault(w, len(numbers)) for w in c.split()] for c in contents]
    size = np.array([len(i) for i in ids], np.int64)
    text = np.array([i for s in ids for i in (*s, 0)], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    of = np.repeat(np.arange(size.size), size + 1)
    found = FmIndex(text, len(numbers), np.array(owner, np.int64)[of], width).least_owners(text, begin, size)
    start = np.arange(text.size) - begin[of]
    real = start + width <= size[of]
    found, of, start = found[real], of[real], start[real]
    new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (of[1:] != of[:-1])]))
    return {"a": np.array(a, np.int64)[of[new]], "x": np.array(x, np.int64)[of[new]], "j": start[new], "many": np.diff(np.append(new, of.size)), "least": found[new]}


_FILED = {"a2": pa.int64(), "x2": pa.int64(), "doc_id": pa.int64(), "content": pa.binary(), "a": pa.int64(), "x": pa.int64(), "j": pa.int64()}


def _filed_again(contents: DataFrame, width: int, gram: int) -> DataFrame:
    """The windows of runs in shorter runs that share a longer stretch, with the place of each in its run."""

    def run(stream):
        for batch in stream:
            a, x, owner = (batch.column(k).to_numpy() for k in range(3))
            texts = batch.column(3).to_pylist()
            for at in range(0, len(texts), 2000):
                group = _Group([(k, 0, c) for k, c in enumerate(texts[at : at + 2000], at)], width, gram)
                pieces = group.contents()
                hashed = np.array([xxhash.xxh3_64_intdigest(c) for c in pieces], _U).view(np.int64)
                yield _batch({"a2": group.name.view(np.int64), "x2": hashed, "doc_id": owner[group.doc], "content": pieces, "a": a[group.doc], "x": x[group.doc], "j": group.place}, _FILED)

    return contents.mapInArrow(run, _schema(_FILED))


def _least(contents: DataFrame, sizes: DataFrame, width: int, grams: list[int], crowd: int) -> DataFrame:
    """(a, x, j, many, least) for runs (a, x, doc_id, content); `sizes` has the number of classes and words of each name."""
    sc = contents.sparkSession.sparkContext
    words = sizes.agg(F.sum("words")).first()[0] or 0
    crowds = sc.broadcast(key_filter(sizes.where(F.col("classes") > crowd).select("a"), "a", 20))

    def side(crowded: bool):
        def run(stream):
            for batch in stream:
                yield batch.filter(pa.array(in_filter(crowds.value, batch.column(0).to_numpy()) == crowded))

        return contents.mapInArrow(run, _schema(_CONTENTS)) if grams else contents

    def shard(table: pa.Table) -> pa.Table:
        a, x, owner, content = (table.column(c).to_pylist() for c in _CONTENTS)
        out = indexed(a, x, owner, content, width)
        return pa.table({c: pa.array(out[c], t) for c, t in _FOUND.items()})

    spread = F.pmod(F.xxhash64("a"), F.lit(max(1, -(-words // SHARD_WORDS)))).cast("int")
    found = side(False).select(*_CONTENTS).groupBy(spread.alias("shard")).applyInArrow(shard, _schema(_FOUND))
    if not grams:
        return found
    filed = materialize(_filed_again(side(True), width, grams[0]), "filed")
    classes = filed.groupBy(F.col("a2").alias("a"), F.col("x2").alias("x")).agg(F.min("doc_id").alias("doc_id"), F.first("content").alias("content"))
    classes = materialize(classes, "classes")
    more = _least(classes, classes.groupBy("a").agg(F.count("*").alias("classes"), F.sum(F.lit(2 * width)).alias("words")), width, grams[1:], crowd)
    more = more.select(F.col("a").alias("a2"), F.col("x").alias("x2"), F.col("j").alias("ahead"), "many", "least")
    more = filed.select("a2", "x2", "a", "x", "j").distinct().join(more, ["a2", "x2"])
    return found.unionByName(more.select("a", "x", (F.col("j") + F.col("ahead")).alias("j"), "many", "least"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD, filter_bits: int = 27) -> DataFrame:
    """(doc_id, d, spans): for each document with repeated windows its id, its text's digest and its windows as first start * 256 + number of starts."""
    if not 1 <= gram <= width <= 250:
        raise ValueError("gram must be from 1 to width, width at most 250: a run's number of starts is kept in 8 bits")
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(f"doc_id is not null and octet_length(text) >= {2 * width - 1}")
    names = _scan(texts, width, gram).groupBy("a").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("a")
    hot = sc.broadcast(key_filter(names, "a", filter_bits))
    found = materialize(_scan(texts, width, gram, hot), "runs")

    classes = found.groupBy("a", "x").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.first("n").alias("n"))
    shared = classes.groupBy("a").agg(F.min("owner").alias("low"), F.max("last").alias("high"), F.count("*").alias("classes"))
    classes = materialize(classes.join(shared.where("low < high").select("a", "classes"), "a"), "classes")

    def keyed(stream):
        for batch in stream:
            yield _batch({"k": owner_keys(*(batch.column(k).to_numpy().copy() for k in range(3)))}, {"k": pa.int64()})

    owners = sc.broadcast(key_filter(classes.select("a", "x", "owner").mapInArrow(keyed, "k long"), "k", filter_bits))
    contents = materialize(_scan(texts, width, gram, hot, owners), "contents")
    sizes = classes.groupBy("a").agg(F.first("classes").alias("classes"), F.sum(F.col("n") + (width - 1)).alias("words"))
    least = _least(contents, sizes, width, sorted({max(gram, width * 9 // 10), width}), crowd)
    hits = found.join(least, ["a", "x"]).where(F.col("least") < F.col("doc_id"))
    spans = hits.select("doc_id", "d", (F.shiftleft(F.col("s") + F.col("j"), 8) + F.col("many")).alias("sn"))
    return spans.groupBy("doc_id", "d").agg(F.collect_set("sn").alias("spans"))


def covered(spans, width: int) -> np.ndarray:
    """Disjoint [first, stop) rows of the words that the windows cover."""
    raw = np.sort(np.asarray(spans, np.int64))
    if not raw.size:
        return np.empty((0, 2), np.int64)
    start = raw >> 8
    stop = np.maximum.accumulate(start + (raw & 255) + (width - 1))
    cut = np.flatnonzero(start[1:] > stop[:-1]) + 1
    return np.stack([start[np.append(0, cut)], stop[np.append(cut - 1, start.size - 1)]], axis=1)


def kept_words(raw: bytes, spans, width: int):
    """(number of words, number removed, kept words in parts of bounded number)."""
    begin, end = places(raw)
    gone = covered(spans if spans is not None else [], width)
    edges = [0, *gone.ravel().tolist(), begin.size]

    def parts():
        for i, j in zip(edges[::2], edges[1::2]):
            for at in range(i, j, PIECE):
                yield raw[begin[at] : end[min(j, at + PIECE) - 1]].split()

    return begin.size, int((gone[:, 1] - gone[:, 0]).sum()), parts()


def _with_spans(rows: DataFrame, text_at: int, id_at: int, width: int, gram: int, crowd: int, filter_bits: int, run, schema) -> DataFrame:
    """`run(batch, spans or None)` over all rows; only rows that the fixed-size filter of digests lets through are shuffled to meet their spans."""
    names = rows.columns
    spans = materialize(repeated_runs(rows, names[id_at], names[text_at], width, gram, crowd, filter_bits), "spans")
    some = rows.sparkSession.sparkContext.broadcast(key_filter(spans.select("d").distinct(), "d", filter_bits))
    mark_at = max((len(c) - len(c.lstrip("_")) for c in names), default=0) + 1
    d, may, found = ("_" * mark_at + n for n in ("d", "may", "spans"))

    def mark(stream):
        for batch in stream:
            keys = np.array([digest(t) for t in batch.column(text_at).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys), pa.array(in_filter(some.value, keys))], names=[*batch.schema.names, d, may])

    def plain(stream):
        for batch in stream:
            yield run(pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names), [None] * len(batch))

    def cut(stream):
        for batch in stream:
            yield run(pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names), batch.column(batch.num_columns - 1).to_pylist())

    marked = rows.mapInArrow(mark, T.StructType([*rows.schema.fields, T.StructField(d, T.LongType()), T.StructField(may, T.BooleanType())]))
    key = "_" * mark_at + "id"
    of = spans.select(F.col("doc_id").alias(key), F.col("d").alias("_" * mark_at + "of"), F.col("spans").alias(found))
    hit = marked.where(F.col(may)).join(of, (F.col(names[id_at]).cast("long") == F.col(key)) & (F.col(d) == F.col("_" * mark_at + "of")), "left").select(*names, found)
    return hit.mapInArrow(cut, schema).unionByName(marked.where(~F.col(may)).select(*names).mapInArrow(plain, schema))


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD, filter_bits: int = 27) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def report(batch, spans):
        out = []
        for text, s in zip(batch.column(1).to_pylist(), spans):
            many, removed, parts = kept_words((text or "").encode(), s, width)
            sha, lead = hashlib.sha256(), b""
            for part in parts:
                sha.update(lead + b" ".join(part))
                lead = b" "
            out.append((many, removed, sha.hexdigest()))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return _with_spans(rows, 1, 0, width, gram, crowd, filter_bits, report, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD, filter_bits: int = 27) -> DataFrame:
    """`docs` without repeated words; a text that loses words is its kept words with single spaces, others stay as they are. A column n_chars is counted again."""
    text_at = docs.columns.index(text_col)

    def cut(batch, spans):
        texts = []
        for text, s in zip(batch.column(text_at).to_pylist(), spans):
            if s:
                text = b" ".join(b" ".join(p) for p in kept_words(text.encode(), s, width)[2]).decode()
            texts.append(text)
        columns = list(batch.columns)
        columns[text_at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = _with_spans(docs, text_at, docs.columns.index(id_col), width, gram, crowd, filter_bits, cut, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op13_substring_dedup(spark, sf_dir):
    return removal_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
