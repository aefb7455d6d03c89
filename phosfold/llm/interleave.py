"""Interleaved document sequences: texts and media of an HTML page in their order.

Parsing yields, for every page, an array of parts: texts, and references to media with the caption
that the page gives them. References name media by digest (`media:sha256:<hex>`); a join on the
digest resolves them against a table of stored media. Payloads stay where they are stored: what is
joined is the digest and what was computed from the stored bytes, never the bytes.

Media hold bytes as 8-bit grey samples in the PGM format, in rows of 192. Each distinct medium is
stored once, however many rows have it.

A caption is the text of the figcaption of the reference's figure, else the alt text; it belongs to
its reference and is no text part. Scripts, styles and comments are left out. Null and empty pages
have no parts; references that no stored medium answers are kept, with null results; repeated rows
get equal results; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_filter, key_filter, materialize

WIDTH = 192
#: Digests that a task remembers to shuffle each medium once.
SEEN = 100_000
PREFIX = "media:sha256:"
PARTS = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"
_PART = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
#: Elements that end a text part, and elements whose text is no content.
BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "article", "section", "header", "footer", "nav", "figure", "pre", "blockquote", "br", "title"}
HIDDEN = {"script", "style", "noscript", "template"}
MEDIA = {"img", "video", "audio", "source", "embed"}


class _Parts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.run: list[str] = []
        self.caption: list[str] | None = None
        self.hidden = 0
        self.figure: list[int] = []

    def flush(self):
        text = "".join(self.run).strip()
        self.run = []
        if text:
            self.parts.append({"position": len(self.parts), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA:
            given = dict(attrs)
            if given.get("src"):
                self.flush()
                self.figure.append(len(self.parts))
                self.parts.append({"position": len(self.parts), "kind": "media", "text": None, "ref": given["src"], "caption": given.get("alt") or None})
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_startendtag(self, tag, attrs):
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split()) or None
            self.caption = None
            for at in self.figure:
                self.parts[at]["caption"] = text or self.parts[at]["caption"]
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[dict]:
    """The parts of a page in their order."""
    if not page:
        return []
    parser = _Parts()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.parts


def interleaved(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, parts) for every page."""

    def run(stream):
        for batch in stream:
            parts = pa.array([parse(t) for t in batch.column(1).to_pylist()], pa.list_(_PART))
            yield pa.RecordBatch.from_arrays([batch.column(0), parts], names=["id", "parts"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, parts {PARTS}")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """(id, position, kind, text, ref, caption, medium) for every part; `media` has one row a digest, and medium holds its other columns."""
    parts = sequences.select("id", F.inline("parts"))
    digest = F.when(F.col("ref").startswith(PREFIX), F.substring("ref", len(PREFIX) + 1, 64))
    known = media.select("digest", F.struct(*[c for c in media.columns if c != "digest"]).alias("medium"))
    return parts.withColumn("digest", digest).join(known, "digest", "left").drop("digest")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and UTF-8 bytes filled with spaces to a positive multiple of the row width."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def to_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(stored: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples."""
    kind, size, most, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit PGM file")
    return width, height, samples


def features(width: int, height: int, samples: bytes) -> str:
    """Mean, spread and mean steps along rows and columns of the samples."""
    grey = np.frombuffer(samples, np.uint8).reshape(height, width)
    counts = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    level = np.arange(256)
    mean = counts @ level / grey.size
    spread = max(0.0, counts @ (level * level) / grey.size - mean * mean) ** 0.5
    step = lambda a, b: int(np.abs(a.astype(np.int16) - b).sum(dtype=np.int64)) / max(1, a.size)
    return f"{width}x{height} mean={mean:.4f} spread={spread:.4f} across={step(grey[:, 1:], grey[:, :-1]):.4f} down={step(grey[1:], grey[:-1]):.4f}"


def _payloads(batch: pa.RecordBatch, at_once: int = 512):
    """Lists of stored forms of a batch's texts and their digests, some at a time."""
    for at in range(0, batch.num_rows, at_once):
        stored = [to_pgm(payload_of(t)[1]) for t in batch.column(0).slice(at, at_once).to_pylist()]
        yield [hashlib.sha256(s).hexdigest() for s in stored], stored


def store_media(docs: DataFrame, text_col: str = "text", filter_bits: int = 27) -> DataFrame:
    """(digest, stored) for every distinct medium, written to the shared folder.

    Digests that occur more than once are known by a filter of a fixed size; only media that may be
    among them are shuffled, each once for a task, to be stored once.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def digests(stream):
        for batch in stream:
            many: dict[str, int] = {}
            for some, _ in _payloads(batch):
                for d in some:
                    many[d] = many.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(many), pa.string()), pa.array(list(many.values()), pa.int64())], names=["digest", "n"])

    low = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    often = texts.mapInArrow(digests, "digest string, n long").groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1")
    shared = spark.sparkContext.broadcast(key_filter(often.select(low.alias("k")), "k", filter_bits))

    def stored(repeated: bool):
        def run(stream):
            seen: set[str] = set()
            for batch in stream:
                for some, forms in _payloads(batch):
                    hit = in_filter(shared.value, np.array([int(d[:15], 16) for d in some], np.uint64)).tolist()
                    rows = [(d, f) for d, f, h in zip(some, forms, hit) if h == repeated and d not in seen]
                    rows = list(dict(rows).items())
                    if repeated:
                        seen.update(d for d, _ in rows[: max(0, SEEN - len(seen))])
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.binary())], names=["digest", "stored"])

        return texts.mapInArrow(run, "digest string, stored binary")

    once = stored(True).groupBy("digest").agg(F.first("stored").alias("stored"))
    return materialize(stored(False).unionByName(once), "media")


def describe_media(stored: DataFrame) -> DataFrame:
    """One row a digest with what the stored bytes say: payload length and digests, the stored form's, and features."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(stream):
        for batch in stream:
            rows = []
            for digest, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py()
                width, height, samples = from_pgm(raw)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), features(width, height, samples)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return stored.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def page_of(text: str | None) -> str:
    """A page that shows a text and, as a captioned figure behind it, its medium."""
    n, payload = payload_of(text)
    digest = hashlib.sha256(to_pgm(payload)).hexdigest()
    return f'<article><pre>{html.escape(text or "", quote=False)}</pre><figure><img src="{PREFIX}{digest}" alt="samples"><figcaption>{n} bytes as samples</figcaption></figure></article>'


def document_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, parts) for every document: its length in bytes and the parts of its page."""

    def run(stream):
        for batch in stream:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = some.column(1).to_pylist()
                parts = pa.array([parse(page_of(t)) for t in texts], pa.list_(_PART))
                sizes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), sizes, parts], names=["id", "n_bytes", "parts"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, parts {PARTS}")


def op6_interleave(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # written, so that the join deals both sides and can split the references to a common medium
    media = materialize(describe_media(store_media(docs)), "described")
    parts = F.col("parts")
    chars = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + F.coalesce(F.length(p["text"]), F.lit(0)))
    # the row's id and what it says of itself travel together, so repeated ids stay apart; its texts have no digest to be joined by
    keyed = document_sequences(docs).select(F.struct("id", "n_bytes", chars.alias("chars"), F.size(parts).alias("n_parts")).alias("id"), F.filter(parts, lambda p: p["kind"] == "media").alias("parts"))
    found = resolve(keyed, media)
    shown = F.concat_ws(" ", "medium.feature", F.format_string("part=%d/%d chars=%d caption=%s", F.col("position") + 1, "id.n_parts", "id.chars", "caption"))
    return found.select(F.col("id.id").alias("doc_id"), "id.n_bytes", "medium.payload_bytes", "medium.payload_sha256", "medium.tail_crc32", "medium.media_bytes", "medium.media_sha256", shown.alias("feature"))


def interleaved_pages(spark, sf_dir):
    """Every part of every page in its order; references are held against the media stored for the documents."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    media = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("digest", F.octet_length("stored").alias("media_bytes"))
    found = resolve(interleaved(pages), media)
    return found.select(F.col("id").alias("page_id"), "position", "kind", "text", "ref", "caption", "medium.media_bytes")
