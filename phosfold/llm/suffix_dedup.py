"""Exact repeated-string removal by prefix doubling with early discarding.

A byte goes if a string of `length` bytes (200) that covers it also starts anywhere else in the
table, the same document included; all occurrences go, and matches never cross documents.

Prefix doubling ranks the positions of all documents by ever longer prefixes and stops ranking a
position once its rank is unique. Ranking every byte would move the corpus many times over, so
positions are discarded early, on samples that miss nothing:

1. Each string of `length` bytes is filed under its smallest-hash substring of half that length.
   Neighbouring strings mostly share it, so a document becomes a few runs of strings, each run
   with the rank name of its half-length prefix at the sampled position. A name that occurs once
   discards its whole run; a run that occurs twice as a whole is repeated past the threshold.
2. Runs that share a name and differ are named again at nine tenths of the length.
3. The positions that are left are ranked by prefixes of growing width (25, 50, 100, 200 bytes):
   in each round Spark sorts the pairs of ranks that lie the ranked width apart (at last: what is
   left to the length), equal pairs get one rank, and unique ranks are discarded.

Names are 64-bit hashes and always compared in pairs (two names, or a name and a content hash);
the ranks that follow from them are exact.
Nothing is sampled away: samples only decide what is proved unique or repeated early.

Texts are known by an 87-bit digest, so equal texts share one result, ids may be null or repeated,
and a batch files each distinct text once. Null and empty texts have no bytes and no spans; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, in_filter, key_filter, materialize, slices

STARTS_AT_ONCE = 1 << 19
#: Bytes of short texts that are named together, one after another: arrays that stay in a core's cache.
BYTES_AT_ONCE = 1 << 15
#: Rounds of prefix doubling; the first width is the length divided by 2 ** ROUNDS.
ROUNDS = 3
#: Runs whose first rank pairs a task makes at once.
RUNS_AT_ONCE = 1 << 8
#: Runs with their bytes that a task holds before it hands them on.
ROWS_AT_ONCE = 1 << 12
_U = np.uint64
_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int):
    """Random byte values, the powers of an odd base and of its inverse, modulo 2**64, places, and two arrays to work in."""
    if _POWERS.get("up", np.empty(0)).size < n:
        size = 1 << max(16, n.bit_length())
        base = 0x9E3779B97F4A7C15
        _POWERS["bytes"] = np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        _POWERS["up"] = np.cumprod(np.full(size, base, _U))
        _POWERS["down"] = np.cumprod(np.full(size, pow(base, -1, 1 << 64), _U))
        _POWERS["at"] = np.arange(size, dtype=_U)
        _POWERS["work"] = np.empty((2, size), _U)
    return _POWERS["bytes"], _POWERS["up"], _POWERS["down"], _POWERS["at"], _POWERS["work"]


def names(raw: bytes | memoryview, k: int) -> np.ndarray:
    """A 64-bit name of every k-byte substring."""
    n = len(raw)
    if n < k:
        return np.empty(0, _U)
    values, up, down, _, work = _tables(n)
    sums = np.take(values, np.frombuffer(raw, np.uint8), mode="clip", out=work[0, :n])
    sums *= up[:n]
    np.cumsum(sums, out=sums)
    h = sums[k - 1 :].copy()
    h[1:] -= sums[: n - k]
    h *= down[: n - k + 1]
    high = work[1, : h.size]
    h ^= np.right_shift(h, _U(29), out=high)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, _U(32), out=high)
    return h


def runs(raw: bytes | memoryview, length: int, k: int, sizes: np.ndarray | None = None):
    """(name, first start, number of starts) of the runs of `length`-byte strings that share their sampled k-byte substring.

    With `sizes`, `raw` is texts of so many bytes, at least `length`, one after another, and runs end with their text.
    """
    h = names(raw, k)
    w = length - k + 1
    many = h.size - w + 1
    if many < 1:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    *_, at, work = _tables(len(raw))
    # hash above, position below: the smallest hash wins, the leftmost of equal ones
    least, other = work[:, : h.size]
    np.bitwise_and(h, ~_U(0xFFFFF), out=least)
    least |= at[: h.size]
    width = 1
    while width < w:
        step = min(width, w - width)
        least, other = np.minimum(least[:-step], least[step:], out=other[: least.size - step]), least
        width += step
    ends = np.array([len(raw)]) if sizes is None else np.cumsum(sizes)
    new = np.ones(many, bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[ends[:-1]] = True
    start = np.flatnonzero(new)
    stop = ends[np.searchsorted(ends, start, side="right")] - (length - 1)
    inside = start < stop
    start, stop = start[inside], stop[inside]
    stop[:-1] = np.minimum(stop[:-1], start[1:])
    return h[(least[start] & _U(0xFFFFF)).astype(np.int64)], start, stop - start


def pieces(raw: bytes, length: int):
    """(offset, bytes) that split the starts of `raw`, so that memory stays bounded for any text."""
    for at in range(0, max(0, len(raw) - length + 1), STARTS_AT_ONCE):
        yield at, memoryview(raw)[at : at + STARTS_AT_ONCE + length - 1]


def _stretches(texts, length: int):
    """Groups of (number of the text, offset, bytes): short texts together, pieces of long texts alone or with them."""
    held, size = [], 0
    for nth, (raw, *_) in enumerate(texts):
        for at, part in pieces(raw, length):
            held.append((nth, at, part))
            size += len(part)
            if size >= BYTES_AT_ONCE:
                yield held
                held, size = [], 0
    if held:
        yield held


def digest(raw: bytes) -> tuple[int, int]:
    """A digest of 64 and 23 bits."""
    d = xxhash.xxh3_128_intdigest(raw)
    return (d & (1 << 64) - 1) - (1 << 63), (d >> 64) & 0x7FFFFF


def _pack(w, n, s):
    """23 bits of the digest, 8 bits for the number of starts, 32 bits for the first start."""
    return (w << 40) | (n << 32) | s


#: A key filter that every key passes.
_ALL = np.full(1, ~_U(0))

_RUN = {"a": pa.int64(), "x": pa.int64(), "d": pa.int64(), "pk": pa.int64(), "c": pa.int32()}


def _once(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One row for equal runs of a batch, with weight 2, and rows that say where they all stand.

    Runs that a batch holds twice are repeated whatever other tasks find, so their places need not
    meet the other runs of their name: neighbouring ones are joined and filed under their place.
    This keeps long periodic texts and common passages from sending a row for each repetition.
    """
    a, x, d, pk, c = (rows[i] for i in _RUN)
    if not a.size:
        return rows
    order = np.lexsort((x, a))
    new = np.flatnonzero(np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (x[order][1:] != x[order][:-1])]))
    total, size = np.add.reduceat(c[order], new), np.diff(np.append(new, order.size))
    one, member = order[new], order[np.repeat(size > 1, size)]
    at, begin = pk[member] >> 40, pk[member] & 0xFFFFFFFF
    order = np.lexsort((begin, at, d[member]))
    of, at, begin, stop = d[member][order], at[order], begin[order], (begin + (pk[member] >> 32 & 0xFF))[order]
    apart = np.ones(of.size, bool)
    apart[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1]) | (begin[1:] != stop[:-1])
    cut = np.flatnonzero(apart)
    of, at, begin, stop = of[cut], at[cut], begin[cut], stop[np.append(cut[1:], of.size) - 1] if cut.size else stop
    parts = -(-(stop - begin) // 255)
    which = np.repeat(np.arange(cut.size), parts)
    begin = begin[which] + 255 * (np.arange(which.size) - np.repeat(np.cumsum(parts) - parts, parts))
    many = np.minimum(255, stop[which] - begin)
    place = (of[which].view(_U) ^ (begin.astype(_U) * _U(0x9E3779B97F4A7C15))).view(np.int64)
    known = (place, begin, of[which], _pack(at[which], many, begin), np.full(which.size, 2))
    picked = (a[one], x[one], d[one], pk[one], np.minimum(total, 2))
    return {i: np.concatenate([p, q]).astype(np.int32 if i == "c" else np.int64) for i, p, q in zip(_RUN, picked, known)}


def _file(texts, length: int, k: int, hot: np.ndarray | None):
    """Runs of a batch of (bytes, digest, digest bits, start, weight); with `hot`, only those of names in it, and with the places of their bytes."""
    out = {c: [] for c in [*_RUN, *(["of", "i", "j"] if hot is not None else [])]}
    d, w, base, c = (np.array([t[i] for t in texts], np.int64) for i in range(1, 5))
    hashed = xxhash.xxh3_64_intdigest
    for held in _stretches(texts, length):
        raw = b"".join([part for *_, part in held])
        sizes = np.array([len(part) for *_, part in held])
        a, s, n = runs(raw, length, k, sizes)
        if hot is not None:
            hit = in_filter(hot, a)
            a, s, n = a[hit], s[hit], n[hit]
        to = s + n + (length - 1)
        ends = np.cumsum(sizes)
        stretch = np.searchsorted(ends, s, side="right")
        of = np.array([nth for nth, *_ in held])[stretch]
        # from places in the group to places in the text
        shift = (np.array([at for _, at, _ in held]) - ends + sizes)[stretch]
        out["a"].append(a.view(np.int64))
        out["x"].append(np.array([hashed(raw[i:j]) for i, j in zip(s.tolist(), to.tolist())], _U).view(np.int64))
        out["d"].append(d[of])
        out["pk"].append(_pack(w[of], n, s + shift + base[of]))
        out["c"].append(c[of].astype(np.int32))
        if hot is not None:
            for name, v in (("of", of), ("i", s + shift), ("j", to + shift)):
                out[name].append(v)
    return {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()}


def _distinct_texts(batch: pa.RecordBatch, length: int):
    """The texts of each slice that no earlier row of the batch has, with weight 2 if the batch holds them more than once."""

    def raws():
        for part in slices(batch, 0):
            yield [t for t in part.column(0).cast(pa.large_binary()).to_pylist() if t and len(t) >= length]

    count = Counter(digest(raw) for part in raws() for raw in part)
    for part in raws():
        keyed = ((raw, digest(raw)) for raw in part)
        yield [(raw, *key, 0, min(c, 2)) for raw, key in keyed if (c := count.pop(key, 0))]


def _scan(texts: DataFrame, length: int, k: int, hot=None) -> DataFrame:
    def rows(batch):
        for texts in _distinct_texts(batch, length):
            yield from filed(texts)

    def filed(texts):
        if hot is None:
            yield _once(_file(texts, length, k, None))
            return
        # the first of equal runs, with their bytes, which are cut out as rows are handed on
        found = _file(texts, length, k, hot.value)
        if not found["a"].size:
            return
        order = np.lexsort((np.arange(found["a"].size), found["x"], found["a"]))
        a, x = found["a"][order], found["x"][order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (x[1:] != x[:-1])]))
        first, weight = order[new], np.minimum(2, np.add.reduceat(found["c"][order], new)).astype(np.int32)
        for at in range(0, first.size, ROWS_AT_ONCE):
            some = first[at : at + ROWS_AT_ONCE]
            spans = zip(*(found[c][some].tolist() for c in ("of", "i", "j")))
            yield {c: found[c][some] for c in _RUN} | {"c": weight[at : at + ROWS_AT_ONCE], "content": [texts[of][0][i:j] for of, i, j in spans]}

    schema = "a long, x long, d long, pk long, c int" + (", content binary" if hot is not None else "")
    return texts.mapInArrow(batches(_RUN | ({"content": pa.binary()} if hot is not None else {}), rows), schema)


def _graded(rows: DataFrame) -> DataFrame:
    """Rows whose name occurs again: `whole` if the same run occurs again, `split` if other runs share the name."""
    by_name, by_run = Window.partitionBy("a"), Window.partitionBy("a", "x")
    shared = rows.withColumns({"all": F.sum("c").over(by_name), "x0": F.min("x").over(by_name), "x1": F.max("x").over(by_name)}).where("all > 1")
    return shared.withColumns({"whole": F.sum("c").over(by_run) > 1, "split": F.expr("x0 != x1")}).drop("all", "x0", "x1")


def _spans(rows: DataFrame) -> DataFrame:
    return rows.select("d", F.shiftrightunsigned("pk", 40).cast("int").alias("w"), F.col("pk").bitwiseAND(F.lit((1 << 40) - 1)).alias("sn"))


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 200, filter_bits: int = 27) -> DataFrame:
    """(d, w, spans): for each text with repeated strings its digest and its runs as starts * 2**32 + first start."""
    if not 4 <= length <= 500:
        raise ValueError("length must be from 4 to 500: a run's number of starts is kept in 8 bits")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= length)
    half, most = length // 2, length * 9 // 10
    first = materialize(_graded(_scan(texts, length, half)).where("whole or split").select("a", "d", "pk", "whole", "split"), "runs")
    hot = spark.sparkContext.broadcast(key_filter(first.where("split").select("a").distinct(), "a", filter_bits))

    found = _scan(texts, length, half, hot).groupBy("a", "x").agg(F.sum("c").alias("n"), F.min(F.struct("d", "pk", "content")).alias("r"))
    by_name = Window.partitionBy("a")
    found = found.withColumns({"x0": F.min("x").over(by_name), "x1": F.max("x").over(by_name)}).where("x0 != x1")
    second_in = found.select("r.*", F.expr("n = 1").alias("open"))
    columns = _RUN | {"open": pa.bool_(), "content": pa.binary()}

    def again(batch):
        for part in (batch.slice(at, ROWS_AT_ONCE) for at in range(0, batch.num_rows, ROWS_AT_ONCE)):
            content, d, pk, is_open = (part.column(c).to_pylist() for c in ("content", "d", "pk", "open"))
            texts = [(raw, i, p >> 40 & 0x7FFFFF, p & 0xFFFFFFFF, 1 if once else 2) for raw, i, p, once in zip(content, d, pk, is_open)]
            rows = _file(texts, length, most, _ALL)
            of, i, j = (rows.pop(c) for c in ("of", "i", "j"))
            for at in range(0, of.size, ROWS_AT_ONCE):
                some = slice(at, at + ROWS_AT_ONCE)
                spans = zip(of[some].tolist(), i[some].tolist(), j[some].tolist())
                yield {c: rows[c][some] for c in _RUN} | {"open": rows["c"][some] == 1, "content": [content[t][i:j] for t, i, j in spans]}

    second = _graded(second_in.mapInArrow(batches(columns, again), "a long, x long, d long, pk long, c int, open boolean, content binary"))
    nth = F.row_number().over(Window.partitionBy("a", "x").orderBy(F.desc("whole"), "d", "pk"))
    second = second.where("(whole and open) or split").withColumn("nth", nth).withColumn("run", F.monotonically_increasing_id())
    second = materialize(second, "runs")

    left = second.where("split and nth = 1").select("run", "content", F.expr("open and not whole").alias("open"))
    found = _doubled(left, length).select(F.shiftright("id", 13).alias("run"), F.shiftright("id", 4).bitwiseAND(F.lit(511)).alias("j"))
    third = found.join(second.select("run", "d", "pk"), "run").select("d", F.expr("(pk & ~((1L << 40) - 1)) | (1L << 32) | ((pk & ((1L << 32) - 1)) + j)").alias("pk"))

    spans = _spans(first.where("whole")).unionByName(_spans(second.where("whole and open"))).unionByName(_spans(third))
    return spans.groupBy("d", "w").agg(F.collect_set("sn").alias("spans"))


def offsets(length: int) -> list[int]:
    """The offset of each round: the width ranked so far, at the end what is left to `length`."""
    width = -(-length // (1 << ROUNDS))
    return [width << i for i in range(ROUNDS - 1)] + [length - (width << (ROUNDS - 1))]


def _doubled(left: DataFrame, length: int) -> DataFrame:
    """The ids of the starts in `left(run, content, open)` whose `length`-byte string occurs again there, if open.

    An id holds the run, 9 bits of the start within it, a bit for open and 3 bits of a part. A start
    has 2 ** ROUNDS parts of the first width; each round sorts the rank pairs of two parts that lie
    the round's offset apart, gives equal pairs one rank (the smallest id that has them), discards
    parts whose rank is unique and brings the ranks of a start's parts together for the next pair.
    """
    steps, width = offsets(length), -(-length // (1 << ROUNDS))
    at = [sum(o for bit, o in enumerate(steps) if p >> bit & 1) for p in range(1 << ROUNDS)]
    columns = {"id": pa.int64(), "r1": pa.int64(), "r2": pa.int64()}

    def first_pairs(batch):
        for part in (batch.slice(i, RUNS_AT_ONCE) for i in range(0, batch.num_rows, RUNS_AT_ONCE)):
            content = part.column("content").to_pylist()
            h, sizes = names(b"".join(content), width).view(np.int64), np.array([len(c) for c in content])
            n = sizes - (length - 1)
            of = np.repeat(np.arange(n.size), n)
            j = np.arange(of.size) - (np.cumsum(n) - n)[of]
            place = (np.cumsum(sizes) - sizes)[of] + j
            run, is_open = (part.column(c).to_numpy(zero_copy_only=False)[of] for c in ("run", "open"))
            start = (run << 13) + (j << 4) + 8 * is_open
            yield {
                "id": np.concatenate([start + p for p in range(len(at) // 2)]),
                "r1": np.concatenate([h[place + o] for o in at[::2]]),
                "r2": np.concatenate([h[place + o] for o in at[1::2]]),
            }

    pairs, by_pair = left.mapInArrow(batches(columns, first_pairs), "id long, r1 long, r2 long"), Window.partitionBy("r1", "r2")
    for more in range(ROUNDS - 1, -1, -1):
        ranked = pairs.select("id", F.min("id").over(by_pair).alias("rank"), F.count("*").over(by_pair).alias("n")).where("n > 1")
        if not more:
            return ranked.where("id & 8 != 0").select("id")
        halves = ranked.select(F.expr("(id & ~7L) | ((id & 7) >> 1)").alias("id"), F.expr("if(id & 1 = 0, rank, null)").alias("r1"), F.expr("if(id & 1 = 1, rank, null)").alias("r2"))
        pairs = halves.groupBy("id").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2")).where("r1 is not null and r2 is not null")


def merged(spans, length: int) -> np.ndarray:
    """Disjoint [start, stop) rows of the bytes that the runs cover."""
    raw = np.asarray(spans, np.int64)
    if not raw.size:
        return np.empty((0, 2), np.int64)
    order = np.argsort(raw & 0xFFFFFFFF, kind="stable")
    start = (raw & 0xFFFFFFFF)[order]
    stop = np.maximum.accumulate(start + (raw >> 32)[order] + (length - 1))
    cut = np.flatnonzero(start[1:] > stop[:-1]) + 1
    return np.stack([start[np.append(0, cut)], stop[np.append(cut - 1, start.size - 1)]], axis=1)


def _with_spans(docs: DataFrame, text_col: str, length: int, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` that may have repeated strings, with their spans as last column, and the rest, which the fixed-size filter of digests keeps out of the shuffle."""
    spark = docs.sparkSession
    spans = materialize(repeated_spans(docs, text_col, length, filter_bits), "spans")
    some = spark.sparkContext.broadcast(key_filter(spans.select("d").distinct(), "d", filter_bits))
    text_at = docs.columns.index(text_col)
    # names that no column of the table has
    mark_at = max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0) + 1
    d_col, w_col, may_col, spans_col = ("_" * mark_at + n for n in ("d", "w", "may", "spans"))

    def mark(stream):
        for batch in (part for whole in stream for part in slices(whole, text_at)):
            keys = [digest((t or "").encode()) for t in batch.column(text_at).to_pylist()]
            d, w = pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32())
            may = pa.array(in_filter(some.value, d.to_numpy())) if len(keys) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, d, w, may], names=[*batch.schema.names, d_col, w_col, may_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(d_col, T.LongType()), T.StructField(w_col, T.IntegerType()), T.StructField(may_col, T.BooleanType())])
    marked = docs.mapInArrow(mark, schema)
    hit = marked.where(F.col(may_col)).join(spans.select(F.col("d").alias(d_col), F.col("w").alias(w_col), F.col("spans").alias(spans_col)), [d_col, w_col], "left")
    return hit.select(*docs.columns, spans_col), marked.where(~F.col(may_col)).select(*docs.columns)


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 200, filter_bits: int = 27) -> DataFrame:
    """`docs` without its repeated strings. A character that loses a byte goes as a whole; a column n_chars is counted again."""
    hit, rest = _with_spans(docs, text_col, length, filter_bits)
    at = hit.columns.index(text_col)

    def cut(stream):
        for batch in (part for whole in stream for part in slices(whole, at)):
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    raw, kept, last = text.encode(), [], 0
                    for i, j in merged(spans, length).tolist():
                        kept.append(raw[last:i].decode(errors="ignore"))
                        last = j
                    text = "".join([*kept, raw[last:].decode(errors="ignore")])
                texts.append(text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = hit.mapInArrow(cut, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns).unionByName(rest)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, filter_bits: int = 27) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hit, rest = _with_spans(rows, "text", length, filter_bits)
    columns = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}

    def report(stream):
        for batch in (part for whole in stream for part in slices(whole, 1)):
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, last, h = memoryview((text or "").encode()), 0, hashlib.sha256()
                gone = merged(spans or [], length)
                for i, j in gone.tolist():
                    h.update(raw[last:i])
                    last = j
                h.update(raw[last:])
                out.append((len(raw), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), h.hexdigest()))
            arrays = [pa.array([r[k] for r in out], t) for k, t in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *columns])

    kind = rows.schema["doc_id"].dataType.simpleString()
    done = hit.mapInArrow(report, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    none = F.lit(0).cast("long")
    plain = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return done.unionByName(rest.select("doc_id", F.octet_length(plain).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(plain, 256).alias("kept_sha256")))


def op9_suffix_dedup(spark, sf_dir):
    return removal_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
