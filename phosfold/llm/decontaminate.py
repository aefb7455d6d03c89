"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a document's passage by n * `share` edits. Cut into one
piece more than that, at least one piece of it stands in such a passage unchanged. An automaton
finds all pieces in a document at once; each hit names an item and a diagonal, and Myers'
bit-parallel algorithm finds the smallest edit distance of the item to any passage around it.

Items and texts are compared in lower case and with white space runs as one space. The items are a
query set: they are dealt into blocks of at most `block_bytes`, and each block is held against all
documents, so a block has a size bound whatever the number of items.

Items of fewer than `least` characters match unchanged and as whole words only, where each
character of a script without spaces is a word; null and empty texts match nothing; repeated rows each get their rows; empty tables give an empty table; other
columns are ignored.
"""

from __future__ import annotations

import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 0.05
LEAST = 20
BLOCK_BYTES = 16 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _letter(c: str) -> bool:
    """Whether a word goes on through c: not in Thai to Myanmar, Khmer, Chinese, Japanese and Korean."""
    if "\u0e00" <= c < "\u10a0" or "\u1780" <= c < "\u1800" or "\u2e80" <= c < "\ua4d0" or "\uac00" <= c < "\ufb00" or "\uff66" <= c < "\uffdd" or c >= "\U00020000":
        return False
    return c.isalnum() or unicodedata.category(c)[0] == "M"


def whole(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins and ends where words do."""
    return not any(0 < at < len(text) and _letter(text[at - 1]) and _letter(text[at]) for at in (start, end))


def cut(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of nearly equal length."""
    ends = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:]) if a < b]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of `text` nearest to `pattern`, the first of the nearest; None above `most`."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        ph, mh = down | ~(d | up) & full, up & d
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(x | ph) & full, ph & x
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple], share: float = SHARE, least: int = LEAST):
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            errors = int(len(text) * share) if len(text) >= least else 0
            for offset, piece in cut(text, errors):
                pieces.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, errors, len(text) < least))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def match(self, text: str | None) -> list[tuple]:
        """(item id, distance, end, errors allowed) for each item near some passage of the text."""
        if not self.items or not text:
            return []
        text = normal(text)
        places: dict[int, set[int]] = {}
        exact: dict[int, int] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for k, offset in uses:
                if not self.items[k][3]:
                    places.setdefault(k, set()).add(end + 1 - size - offset)
                elif k not in exact and whole(text, end + 1 - size, end + 1):
                    exact[k] = end + 1
        found = [(self.items[k][0], 0, end, 0) for k, end in exact.items()]
        for k, starts in places.items():
            item_id, item, errors, _ = self.items[k]
            best = None
            low = high = None
            for start in [*sorted(starts), None]:
                # hits on near diagonals share one window
                if low is not None and (start is None or start > high + errors):
                    a = max(0, low - errors)
                    near = myers(item, text[a : high + len(item) + errors], errors)
                    if near and (best is None or near[0] < best[0]):
                        best = (near[0], a + near[1])
                    low = None
                if start is not None:
                    low = start if low is None else low
                    high = start
            if best:
                found.append((item_id, *best, errors))
        return found


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Lists of (id, text) of a bounded size each, in turn."""
    items = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = -(-total * 2 // block_bytes) or 1
    for k in range(many):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(many)) == k) if many > 1 else items
        yield [tuple(r) for r in part.collect()]


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, least: int = LEAST, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, stop, budget) for each document and item near a passage of it; stop is the passage's end in the normal form."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = None
    for block in _blocks(items, item_id_col, item_text_col, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(stream, held=held):
            matcher = Matcher(held.value, share, least)
            for batch in stream:
                hits = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in matcher.match(t)]
                kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in enumerate(kinds)], names=["doc_id", "item_id", "distance", "stop", "budget"])

        part = rows.mapInArrow(run, f"doc_id {kind}, item_id long, distance long, stop long, budget long")
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, least: int = LEAST, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no passage near an item."""
    at = docs.columns.index(text_col)
    for block in _blocks(items, item_id_col, item_text_col, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(stream, held=held):
            matcher = Matcher(held.value, share, least)
            for batch in stream:
                yield batch.filter(pa.array([not matcher.match(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontaminate(spark, sf_dir):
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
