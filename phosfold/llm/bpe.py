"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoding.

A text is read in slices that end between a word and white space, where a cut of the vocabulary's
pattern always ends; inside a cut the merge list decides. How far the
bytes to the right of a token can still change it is bounded by the merge list alone: going
through the merges in order, a symbol depends on what its right part depends on, and a symbol
that a merge takes as its left part depends on the right part and on what that one depends on.
The largest bound over all symbols is the sufficient lookahead. The transducer keeps a window of
bytes of a cut, merges within it, emits the tokens that end at least the lookahead before the window's end
or in a cut that has ended, as these are stable, and starts again behind them. Ids are handed on slice by
slice, so memory is a slice and a window, whatever the text; the decoder takes them up one slice after the
other and keeps the bytes of an unfinished character.

What the transducer gave for short words is remembered up to a fixed number of them, which changes speed and nothing else.

Null and empty texts have no tokens; repeated rows get equal results; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

NONE = 1 << 62
SHIFT = 20
REMEMBERED = 500_000
#: Characters of a slice; a slice without white space inside goes through cut by cut.
SLICE = 1 << 15
#: The cut of byte-level vocabularies; white space as Unicode has it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    return letters | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind = file["pre_tokenizer"] or {}
        if file["normalizer"] or kind.get("type") != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"] or file["model"].get("end_of_word_suffix") or file["model"].get("ignore_merges"):
            raise ValueError(f"{path} is no byte-level vocabulary whose cuts are those of PATTERN")
        letters, ids = byte_letters(), file["model"]["vocab"]
        self.size = max([*ids.values(), *(t["id"] for t in file["added_tokens"])]) + 1
        self.token_bytes = [b""] * self.size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = [0] * 256
        for c, b in letters.items():
            self.byte_ids[b] = ids[c]
        self.pairs: dict[int, int] = {}
        reach = [0] * self.size
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = ids[left], ids[right], ids[left + right]
            self.pairs.setdefault(a << SHIFT | b, rank << SHIFT | c)
            far = len(self.token_bytes[b]) + reach[b]
            reach[c] = max(reach[c], reach[b])
            reach[a] = max(reach[a], far)
        #: Bytes behind a token that can still change it.
        self.lookahead = max(reach)
        self.longest = max(map(len, self.token_bytes))


class Encoder:
    """Text to ids."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.v = vocabulary
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.remembered = remembered
        #: Ids are kept as native unsigned integers of two or four bytes.
        self.kind = "H" if vocabulary.size <= 1 << 16 else "I"
        self.cut = regex.compile(PATTERN)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None
        self.odd, self.gap = re.compile(r"\s"), regex.compile(r"\P{White_Space}\p{White_Space}")

    def forget(self) -> None:
        """Lets go of what is remembered."""
        self.words.clear()
        self.chunks.clear()

    def merge(self, ids: list[int]) -> list[int]:
        """Merges by rank, leftmost first, within one window."""
        get = self.v.pairs.get
        ranks = [get(a << SHIFT | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            i, new = ranks.index(best), best & (1 << SHIFT) - 1
            ids[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << SHIFT | new, NONE)
            if i < len(ranks):
                ranks[i] = get(new << SHIFT | ids[i + 1], NONE)
        return ids

    def stream(self, raw):
        """Ids of one cut, emitted as soon as they are stable; `raw` is its bytes, as a whole or in parts."""
        v, parts = self.v, iter([raw] if isinstance(raw, bytes) else raw)
        window, held, ended = 2 * (v.lookahead + v.longest), b"", False
        while True:
            while not ended and len(held) < window:
                part = next(parts, None)
                ended = part is None
                held += part or b""
            ids = self.merge([v.byte_ids[b] for b in held[:window]])
            if ended and len(held) <= window:
                yield from ids
                return
            stop, at = min(window, len(held)) - v.lookahead, 0
            for i in ids:
                if at + len(v.token_bytes[i]) > stop:
                    break
                at += len(v.token_bytes[i])
                yield i
            held = held[at:]

    def word(self, word: str) -> bytes:
        if (found := self.words.get(word)) is None:
            found = array(self.kind, self.stream(word.encode())).tobytes()
            if len(self.words) < self.remembered and len(word) < 64:
                self.words[word] = found
        return found

    def plain(self, text: str) -> bytes:
        """A slice, cut by the pattern."""
        return b"".join(map(self.word, self.cut.findall(text)))

    def chunk(self, chunk: str) -> bytes | None:
        """What stands behind a single space, or begins with a single line break; None if white space in it may join its neighbours."""
        text = chunk if chunk[:1] == "\n" else " " + chunk
        if self.odd.search(text, 1):
            return None
        found = self.plain(text)
        if len(self.chunks) < self.remembered and len(chunk) < 64:
            self.chunks[chunk] = found
        return found

    def segment(self, text: str) -> bytes:
        if not text:
            return b""
        if not any(two in text for two in ("  ", "\n\n", " \n", "\n ")):
            first, *rest = text.replace("\n", " \n").split(" ")
            if not self.odd.search(first):
                found = list(map(self.chunks.get, rest))
                if None in found:
                    found = [self.chunk(c) if f is None else f for c, f in zip(rest, found)]
                if None not in found:
                    return self.plain(first) + b"".join(found)
        return self.plain(text)

    def slices(self, text: str, at: int, end: int):
        """Ids of text[at:end], which holds no special token, slice by slice."""
        while at < end:
            stop = end
            if end - at > SLICE:
                # the last place in the slice where white space begins, else go on cut by cut until there is one
                gap = max((m.start() + 1 for m in self.gap.finditer(text, at, at + SLICE)), default=None)
                if gap is None:
                    at = yield from self.cut_by_cut(text, at, end)
                    continue
                stop = gap
            yield self.segment(text[at:stop])
            at = stop

    def cut_by_cut(self, text: str, at: int, end: int):
        """Ids of the cuts from `at` on, until one ends behind the slice; gives back where that is."""
        last = at + SLICE
        for m in self.cut.finditer(text, at, end):
            parts = (text[i : min(i + SLICE, m.end())].encode() for i in range(m.start(), m.end(), SLICE))
            ids, held = self.stream(parts), array(self.kind)
            for i in ids:
                held.append(i)
                if len(held) >= SLICE:
                    yield held.tobytes()
                    held = array(self.kind)
            yield held.tobytes()
            at = m.end()
            if at >= last:
                break
        return at

    def pieces(self, text: str | None):
        """Arrays of the text's ids, one after the other, each of a bounded size."""
        kind, at, text = np.dtype(self.kind), 0, text or ""
        found = self.specials.finditer(text) if any(s in text for s in self.v.special) else ()
        for special in [*found, None]:
            for part in self.slices(text, at, special.start() if special else len(text)):
                if part:
                    yield np.frombuffer(part, kind)
            if special:
                yield np.array([self.v.special[special[0]]], kind)
                at = special.end()

    def encode(self, text: str | None) -> np.ndarray:
        return np.concatenate([np.empty(0, self.kind), *self.pieces(text)])


class Decoder:
    """Ids to text, a few at a time; the state between two calls is the bytes of an unfinished character."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.token_bytes.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes_of, ids)))

    def close(self) -> str:
        return self.state.decode(b"", final=True)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, read once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(Vocabulary(path))
    return _LOADED[path]


def round_trip(text: str | None, coder: Encoder, decimals: list[str]) -> tuple[int, str, str]:
    """Number of ids, and digests of the decimal ids and of the decoded text, from one slice after the other."""
    many, written, back, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(coder.v)
    for part in coder.pieces(text):
        ids = part.tolist()
        written.update((("," if many else "") + ",".join(map(decimals.__getitem__, ids))).encode())
        back.update(decoder.feed(ids).encode())
        many += len(ids)
    back.update(decoder.close().encode())
    return many, written.hexdigest(), back.hexdigest()


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row."""

    def run(stream):
        for batch in stream:
            coder = encoder(path)
            ids = pa.array([coder.encode(t).astype(np.int32) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(stream):
        for batch in stream:
            texts = []
            for ids in batch.column(1).to_pylist():
                decoder = Decoder(encoder(path).v)
                texts.append(decoder.feed(ids or []) + decoder.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = tokens.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def token_report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", forget: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; with `forget`, workers keep no words after a task."""

    def run(stream):
        coder = encoder(path)
        decimals = list(map(str, range(coder.v.size)))
        for batch in (part for whole in stream for part in slices(whole, 1)):
            out = [round_trip(t, coder, decimals) for t in batch.column(1).to_pylist()]
            arrays = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if forget:
            coder.forget()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark, sf_dir):
    return token_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_vocabulary())
