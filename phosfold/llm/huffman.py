"""Token ids in a canonical length-limited Huffman code, with independent blocks.

Global counts of all ids give the code lengths (package-merge, at most `limit` bits); the lengths
alone give the canonical code. Each document is coded in blocks of `block` ids; its bits begin at
a byte, and a checkpoint holds the bit offset of each block. A file holds segments: whole
documents in ascending order of their id, their numbers of ids, checkpoints and bits. Segments
are Parquet rows below `segments`, so any store that Spark writes holds them; the code lengths lie
beside them in `code`, and what is needed for reading is read from the folder alone. Parts are ranges
of ids of about `PART` bytes each, which rows of one id, or without one, share by their content. Blocks are decoded side by side, one
table lookup an id; no block needs another one.

Encoding with the tokenizer's library depends on words between spaces and line breaks only, for
tokenizers that drop white space; so each worker remembers a fixed number of words it has seen.

Null and empty texts have just the end id; rows with equal ids keep one order by their bits; rows
without an id come first; an empty table gives an empty table; other columns are ignored. A very long text is one document of
a segment of its own, whose ids and bits a task holds whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import materialize, work_path

LIMIT = 20
BLOCK = 256
SEGMENT = 1 << 20
PART = 32 << 20
#: Parts whose segments' places are summed up in one task.
GROUP = 1024
#: What a tokenizer file must say for words to be encoded apart (fixed values).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
REMEMBERED = 500_000


class WordTokenizer:
    """A tokenizers file whose pre-tokenizer drops white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split, letters = [*(file["pre_tokenizer"] or {}).get("pretokenizers", []), None, None][:2]
        if not split or not letters or (file["normalizer"] or {}).get("normalizers") != NORMALIZERS or (split.get("pattern"), split.get("behavior"), split.get("invert")) != ({"Regex": CUT}, "Removed", True) or letters["type"] != "ByteLevel" or letters["add_prefix_space"] or letters["use_regex"]:
            raise ValueError(f"{path} does not lower-case words and drop the white space between them")
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.size = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.words: dict[str, bytes] = {"": b""}
        self.tail = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)\Z")

    def plain(self, word: str) -> bool:
        """Whether the library's normalizer leaves a word as it is and its pattern keeps it in one piece."""
        return word.isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word)) and word == word.lower()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered; letters and the marks behind them are encoded apart.

        Plain words go to the library's model at once, all others through the whole library.
        """
        known, match, plain, merge = self.words, self.tail.match, self.plain, self.model.tokenize
        apart, stems, rest = {}, set(), set()
        for w in words:
            m = match(w)
            if m and plain(m[1]):
                apart[w] = stem, marks = m.groups()
                if stem not in known:
                    stems.add(stem)
                if marks not in known:
                    rest.add(marks)
            elif plain(w):
                stems.add(w)
            else:
                rest.add(w)
        found, odd = {}, list(rest)
        for w in stems:
            found[w] = array(self.code, [t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters))]).tobytes()
        for w, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False)):
            found[w] = array(self.code, e.ids).tobytes()
        for w, b in found.items():
            if len(known) >= REMEMBERED:
                break
            if len(w) < 64:
                known[w] = b
        for w, (stem, marks) in apart.items():
            found[w] = (found[stem] if stem in found else known[stem]) + (found[marks] if marks in found else known[marks])
            if len(marks) == 1 and len(known) < REMEMBERED and len(w) < 64:
                known[w] = found[w]
        return found

    @staticmethod
    def lowered(text: str) -> str:
        """Lower case where that is sure to be what the library's normalizer does; markers of special tokens and letters with special rules are left to it."""
        if "<|" in text or not text.isascii() and ("Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text)):
            return text
        return text.lower()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.lowered(t).replace("\n", " ").split(" ") if t else [] for t in texts]
        known = self.words
        new = self.learn(set().union(*split).difference(known))
        # words beyond what is remembered stay for these texts only
        passing = [w for w in new if w not in known]
        known.update((w, new[w]) for w in passing)
        ids = [np.frombuffer(b"".join(map(known.__getitem__, ws)), self.kind) for ws in split]
        for w in passing:
            del known[w]
        return ids


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (package-merge); 0 for ids that do not occur."""
    lengths = np.zeros(counts.size, np.uint8)
    used = np.flatnonzero(counts)
    if used.size <= 1:
        lengths[used] = 1
        return lengths
    if used.size > 1 << limit:
        raise ValueError(f"{used.size} ids do not fit into {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.int64)
    # items of each level in order of weight; leaves keep their order, so a choice is how many leaves it takes
    levels, merged = [], np.empty(0, np.int64)
    for _ in range(limit):
        weights = np.concatenate([leaf, merged])
        order = np.argsort(weights, kind="stable")
        levels.append(np.cumsum(order < leaf.size))
        weights = weights[order]
        merged = weights[0 : weights.size // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * used.size - 2
    depth = np.zeros(used.size, np.int64)
    for leaves in reversed(levels):
        n = int(leaves[take - 1]) if take else 0
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by id."""
    order = np.lexsort((np.arange(lengths.size), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(lengths.size, np.uint32)
    if order.size:
        size = lengths[order].astype(np.int64)
        top = int(size[-1])
        starts = np.concatenate([[0], np.cumsum(1 << (top - size))[:-1]])
        codes[order] = starts >> (top - size)
    return codes


def pack(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> list[tuple[np.ndarray, bytes]]:
    """(bit offset of each block, bits) of each document; `ids` holds `counts` ids of each, none of them empty."""
    size = lengths[ids].astype(np.int64)
    stops, last = np.cumsum(size), np.cumsum(counts)
    ends = stops[last - 1]
    bits = np.diff(ends, prepend=0)
    # each document begins at a byte
    starts = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    inside = stops - size - np.repeat(ends - bits, counts)
    offset = inside + np.repeat(starts[:-1] * 8, counts)
    wide = codes[ids].astype(np.uint64) << (64 - (offset & 31) - size).astype(np.uint64)
    word, n = offset >> 5, (int(starts[-1]) >> 2) + 2
    sums = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    raw = sums.astype(np.uint64).astype(">u4").tobytes()
    return [(inside[a:b:block], raw[i:j]) for a, b, i, j in zip((last - counts).tolist(), last.tolist(), starts[:-1].tolist(), starts[1:].tolist())]


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every bit pattern of the longest length the id it begins with and that id's length."""
    top = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(lengths.size), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (top - lengths[order].astype(np.int64))
    pad = (1 << top) - int(spans.sum())
    ids = np.concatenate([np.repeat(order, spans), np.zeros(pad, np.int64)]).astype(np.uint32)
    size = np.concatenate([np.repeat(lengths[order], spans), np.ones(pad, np.uint8)]).astype(np.int64)
    return ids, size, top


def unpack(bits: bytes, starts: np.ndarray, many: np.ndarray, table) -> np.ndarray:
    """Ids of blocks that begin at bit `starts` and hold `many` ids, one after the other."""
    ids, size, top = table
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    word = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    order = np.argsort(-many, kind="stable")
    at, left = starts[order].astype(np.int64), many[order]
    out = np.zeros((int(left[0]) if left.size else 0, left.size), np.uint32)
    for step in range(out.shape[0]):
        n = int(np.searchsorted(-left, -step, side="left"))
        here = at[:n]
        pattern = (word[here >> 3] >> (32 - top - (here & 7)).astype(np.uint32)) & np.uint32((1 << top) - 1)
        out[step, :n] = ids[pattern]
        at[:n] = here + size[pattern]
    lanes = np.empty_like(out)
    lanes[:, order] = out
    return lanes.T[np.arange(out.shape[0]) < many[:, None]]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encoded(docs: DataFrame, path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", at_once: int = 256) -> DataFrame:
    """(doc_id, ids) with the end id; ids are the machine's unsigned integers, two bytes each where the vocabulary allows."""

    def run(stream):
        for batch in stream:
            coder = tokenizer(path)
            stop = array(coder.code, [end]).tobytes()
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                ids = [x.tobytes() + stop for x in coder.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def id_counts(stored: DataFrame, path: str) -> np.ndarray:
    """How often every id occurs over all documents; as many numbers as the vocabulary has ids."""

    def run(stream):
        coder = tokenizer(path)
        total = np.zeros(coder.size, np.int64)
        for batch in stream:
            for ids in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(ids, coder.kind), minlength=total.size) if len(ids) > total.size else 0
            short = b"".join(ids for ids in batch.column(0).to_pylist() if len(ids) <= total.size)
            total += np.bincount(np.frombuffer(short, coder.kind), minlength=total.size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    table = stored.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(tokenizer(path).size, np.int64)
    counts[table["id"].to_numpy()] = table["n"].to_numpy()
    return counts


def write_segments(stored: DataFrame, folder: str, path: str, counts: np.ndarray, block: int = BLOCK, segment: int = SEGMENT, part: int = PART) -> None:
    """Write (doc_id, ids) to `folder`, parts and segments in ascending order of doc_id, by the code of the ids' global counts."""
    spark = stored.sparkSession
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    # one row for each id that occurs
    table = [(int(i), int(lengths[i])) for i in used]
    spark.createDataFrame(table, "id int, bits int").coalesce(1).write.parquet(f"{folder}/code")
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))
    kind = tokenizer(path).kind
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) * kind.itemsize // part))
    keys = ["doc_id", "n", "h", "at"]
    rows = stored.select("doc_id", F.octet_length("ids").alias("n"), F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("at"), "ids")
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    names = ["part", "segment", "block", "doc_ids", "counts", "marks", "bits"]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())

    def row(here, number, held):
        at, marks = 0, []
        for _, _, m, b in held:
            marks.append(m + at)
            at += len(b) * 8
        values = (here, number, block, [h[0] for h in held], [h[1] for h in held], np.concatenate(marks), b"".join(h[3] for h in held))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    def gather(stream):
        held, many, here, number = [], 0, TaskContext.get().partitionId(), 0
        size, codes = shared.value
        for batch in stream:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                raws = some.column(1).to_pylist()
                each = np.array([len(r) // kind.itemsize for r in raws], np.int64)
                packed = pack(np.frombuffer(b"".join(raws), kind), each, codes, size, block)
                for i, n, (marks, bits) in zip(some.column(0).to_pylist(), each.tolist(), packed):
                    if many >= segment:
                        yield row(here, number, held)
                        held, many, number = [], 0, number + 1
                    held.append((i, n, marks, bits))
                    many += n
        if held:
            yield row(here, number, held)

    rows.mapInArrow(gather, "part int, segment int, block int, doc_ids array<long>, counts array<long>, marks array<long>, bits binary").write.option("compression", "none").parquet(f"{folder}/segments")


def read_segments(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document of `folder`."""
    code = spark.read.parquet(f"{folder}/code").toArrow()
    lengths = np.zeros(max([0, *code["id"].to_pylist()]) + 1, np.uint8)
    lengths[code["id"].to_numpy()] = code["bits"].to_numpy()
    stored = spark.read.parquet(f"{folder}/segments")
    sizes = stored.select("part", "segment", F.expr("aggregate(counts, 0L, (a, n) -> a + n)").alias("n"))
    # sums before a segment within its group of parts, and one row for each group, which stands for GROUP * PART bytes of ids
    sizes = sizes.withColumn("group", F.floor(F.col("part") / GROUP))
    earlier = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("group").agg(F.sum("n").alias("n")).select("group", earlier(Window.orderBy("group")).alias("before"))
    starts = sizes.withColumn("within", earlier(Window.partitionBy("group").orderBy("part", "segment"))).join(groups, "group")
    starts = starts.select("part", "segment", (F.col("before") + F.col("within")).alias("start"))
    shared = spark.sparkContext.broadcast(lengths)

    def run(stream):
        table = lookup(shared.value)
        for batch in stream:
            for part, segment, block, doc_ids, counts, marks, bits in zip(*(batch.column(c).to_pylist() for c in range(7))):
                counts = np.array(counts, np.int64)
                blocks = -(-counts // block)
                last = np.cumsum(blocks)
                many = np.full(int(last[-1]), block, np.int64)
                many[last - 1] = counts - (blocks - 1) * block
                ids = unpack(bits, np.array(marks, np.int64), many, table).astype("<u4")
                stops = np.cumsum(counts)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip((stops - counts).tolist(), stops.tolist())]
                same = lambda v, k=counts.size: pa.array([v] * k, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [same(part), same(segment), pa.array(doc_ids, pa.int64()), pa.array(stops - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                    names=["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    read = stored.select("part", "segment", "block", "doc_ids", "counts", "marks", "bits").mapInArrow(run, "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "segment"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_huffman(spark, sf_dir):
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_path(spark, "segments")
    stored = materialize(encoded(docs, word_vocabulary()), "ids")
    write_segments(stored, folder, word_vocabulary(), id_counts(stored, word_vocabulary()))
    return read_segments(spark, folder)
