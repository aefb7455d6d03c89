"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is good or bad. A line is described by the shares of kinds of bytes
(letters, capitals, digits, marks, symbols and so on), its length, the share of its words that are new in it, whether it stands in the
document more than once, and the same of the lines before and behind it. The field is fitted on labelled
documents: at first each line has its document's label, then lines of bad documents that look good
are counted as good, and the field is fitted again. Forward-backward marginals of all lines,
weighted by the lines' lengths, give a document's share of good text; a logistic curve fitted on the
same rows turns it into the score.

The field is fitted on whole documents, at most `most_rows` labelled rows of at most `most_bytes` and `most_lines`
in all, those with the smallest hashes of doc_id; every document is scored on all its lines. Tasks describe the lines
of these rows, and the driver, which fits the field, gets `OWN` numbers and a length for each line and no text.

A text of very many lines goes through in slices of lines with one line of overlap: forward values are kept
where slices begin, and backward values meet them from the last slice on. Beside the text this holds a slice's features and
20 bytes a line at most; a very long line holds 8 bytes for each of its words.

Null and empty texts are one empty line; labels without a document, of a null doc_id or a null
label are not used, and of repeated ones the largest counts; without any label every score is 0.5;
repeated rows get equal results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from math import exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, slices
from .toxicity import held_out, labelled_sample

LETTER, CAPITAL, DIGIT, SPACE, STOP, BAR, BANG, SYMBOL, WIDE, OTHER, BREAK = range(11)
KINDS = 11
#: Bytes, and lines, whose features are held at once.
SLICE, LINES = 1 << 20, 1 << 14
_WORD = re.compile(rb"\S+")


def _kinds() -> np.ndarray:
    table = np.full(256, OTHER, np.int64)
    for kind, chars in ((STOP, ".,;:'\"-()?"), (BAR, "|"), (BANG, "!"), (SYMBOL, "#$%&*+/<=>@[\\]^_`{}~"), (SPACE, " \t\r"), (BREAK, "\n")):
        table[np.frombuffer(chars.encode(), np.uint8)] = kind
    table[97:123], table[65:91], table[48:58], table[128:] = LETTER, CAPITAL, DIGIT, WIDE
    return table


KIND = _kinds()


def _fresh(line: bytes) -> float:
    """The share of a line's words that are new in it."""
    if len(line) <= SLICE:
        words = line.lower().split()
        return len(set(words)) / len(words) if words else 1
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(m[0].lower()) for m in _WORD.finditer(line)), np.uint64)
    return np.unique(hashes).size / hashes.size if hashes.size else 1


def _own(lines: list[bytes], again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of lines without their neighbours', their lengths)."""
    total, line = len(lines), 0
    counts = np.zeros(total * KINDS)
    fresh = np.fromiter(map(_fresh, lines), np.float64, total)
    buffer = b"\n".join(lines)
    for at in range(0, len(buffer), SLICE):
        part = KIND[np.frombuffer(buffer, np.uint8, min(SLICE, len(buffer) - at), at)]
        of = line + np.cumsum(part == BREAK) - (part == BREAK)
        low = int(of[0])
        found = np.bincount((of - low) * KINDS + part)
        counts[low * KINDS : low * KINDS + found.size] += found
        line = int(of[-1]) + int(part[-1] == BREAK)
    counts = counts.reshape(total, KINDS)
    length = counts[:, :BREAK].sum(1)
    word = counts[:, SPACE] + 1
    return np.column_stack([np.sqrt(counts[:, :BREAK] / np.maximum(length, 1)[:, None]), np.log1p(length) / 5, np.log(np.maximum(length, 1) / word) / 3, np.minimum(1, (counts[:, SYMBOL] + counts[:, BANG] + counts[:, BAR]) / word), counts[:, CAPITAL] / np.maximum(counts[:, LETTER] + counts[:, CAPITAL], 1), again, fresh, np.sqrt(1 - fresh)]), length


def _beside(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The features of lines beside their neighbours'; `first` has where documents begin and the end."""
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:], behind[:-1] = own[:-1], own[1:]
    before[first[:-1]], behind[first[1:] - 1] = 0, 0
    edge = np.zeros((len(own), 3))
    edge[first[:-1], 0], edge[first[1:] - 1, 1], edge[:, 2] = 1, 1, 1
    return np.hstack([own, before, behind, edge])


def own_features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines without their neighbours', their lengths, first line of each document and the end)."""
    lines, again, first = [], [], [0]
    for raw in raws:
        split = raw.split(b"\n")
        lines += split
        first.append(len(lines))
        if len(split) > 1 and len(set(split)) < len(split):
            seen: dict[bytes, int] = {}
            for s in split:
                seen[s] = seen.get(s, 0) + 1
            again += [seen[s] > 1 and len(s) > 0 for s in split]
        else:
            again += [False] * len(split)
    return *_own(lines, np.array(again, np.float64)), np.array(first, np.int64)


def line_features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, their lengths, first line of each document and the end)."""
    own, length, first = own_features(raws)
    return _beside(own, first), length, first


#: Features of a line without its neighbours'.
OWN = own_features([b""])[0].shape[1]


def _slices(raw: bytes):
    """The lines of a text, LINES at a time or what SLICE bytes hold."""
    at = 0
    while at <= len(raw):
        lines, size = [], 0
        while at <= len(raw) and len(lines) < LINES and size < SLICE:
            stop = raw.find(b"\n", at)
            stop = len(raw) if stop < 0 else stop
            lines.append(raw[at:stop])
            size, at = size + stop - at, stop + 1
        yield lines


def sliced_features(raw: bytes):
    """(features, lengths) of a text's lines, slice by slice; the same as `line_features` gives of the whole."""
    hashes = np.concatenate([np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)) for lines in _slices(raw)])
    hashes.sort()
    twice = hashes[1:][hashes[1:] == hashes[:-1]]
    del hashes

    def again(lines):
        found = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
        at = np.minimum(np.searchsorted(twice, found), max(0, twice.size - 1))
        return (twice[at] == found) & (np.fromiter(map(len, lines), np.int64, len(lines)) > 0) if twice.size else np.zeros(len(lines), bool)

    # a slice goes out once the line behind it is known
    before, held, held_length, start = None, None, None, True
    for lines in _slices(raw):
        own, length = _own(lines, again(lines).astype(np.float64))
        if held is not None:
            yield _with_edges(before, held, own[:1], start, False), held_length
            before, start = held[-1:], False
        held, held_length = own, length
    yield _with_edges(before, held, None, start, True), held_length


def _with_edges(before, own, behind, start: bool, end: bool) -> np.ndarray:
    """Features of a slice between the line before it and the line behind it."""
    rows = [x for x in (before, own, behind) if x is not None]
    x = _beside(np.vstack(rows), np.array([0, sum(map(len, rows))]))[0 if before is None else 1 :][: len(own)]
    x[0, -3], x[-1, -2] = float(start), float(end)
    return x


class Field:
    """Weights of a line's features for good over bad, log potentials of neighbouring labels, and the final curve."""

    def __init__(self, size: int):
        self.weights, self.pairs = np.zeros(size), np.zeros((2, 2))
        self.slope, self.offset = 1.0, 0.0

    def marginals(self, lean: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability that each line is good; `lean` is the line's own log-odds."""
        (bb, bg), (gb, gg) = np.exp(self.pairs).tolist()
        ahead, back = lean.tolist(), [0.0] * lean.size
        cap = 50.0
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            for t in range(a + 1, z):
                o = exp(max(-cap, min(cap, ahead[t - 1])))
                ahead[t] += log((o * gg + bg) / (o * gb + bb))
            for t in range(z - 2, a - 1, -1):
                o = exp(max(-cap, min(cap, back[t + 1] + lean[t + 1])))
                back[t] = log((o * gg + gb) / (o * bg + bb))
        return 1 / (1 + np.exp(-np.clip(np.array(ahead) + np.array(back), -cap, cap)))

    def share(self, good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-odds of each document's length-weighted share of good text."""
        if first.size < 2:
            return np.empty(0)
        weight = np.maximum(length, 1e-9)
        q = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return np.log(q / (1 - q))

    def long_share(self, raw: bytes) -> np.ndarray:
        """`share` of one text, slice by slice: forward values where slices begin, then backwards from the last slice."""
        (bb, bg), (gb, gg) = np.exp(self.pairs).tolist()
        leans, weights, cap = [], [], 50.0
        for x, length in sliced_features(raw):
            leans.append(x @ self.weights)
            weights.append(length.astype(np.float32))

        def forward(lean, came):
            ahead = lean.tolist()
            for t, own in enumerate(ahead):
                if came is not None:
                    o = exp(max(-cap, min(cap, came)))
                    own += log((o * gg + bg) / (o * gb + bb))
                ahead[t] = came = own
            return ahead

        came, begins = None, []
        for lean in leans:
            begins.append(came)
            came = forward(lean, came)[-1]
        good = total = later = 0.0
        for k in range(len(leans) - 1, -1, -1):
            lean, ahead = leans[k].tolist(), forward(leans[k], begins[k])
            back = [0.0] * len(lean)
            for t in range(len(lean) - 1, -1, -1):
                back[t] = later
                o = exp(max(-cap, min(cap, later + lean[t])))
                later = log((o * gg + gb) / (o * bg + bb))
            weight = np.maximum(weights[k].astype(np.float64), 1e-9)
            good += float((weight / (1 + np.exp(-np.clip(np.array(ahead) + np.array(back), -cap, cap)))).sum())
            total += float(weight.sum())
        q = np.clip(good / total, 1e-4, 1 - 1e-4)
        return np.array([np.log(q / (1 - q))])

    def scores(self, texts: list[str | None]) -> list[float]:
        """Scores of texts, those of some megabytes and some thousand lines at a time."""
        out, held, size, lines = [], [], 0, 0

        def flush():
            if held:
                x, length, first = line_features(held)
                out.append(self.share(self.marginals(x @ self.weights, first), length, first))
                held.clear()

        for text in texts:
            raw = (text or "").encode()
            many = raw.count(b"\n") + 1
            if lines + many > LINES or size + len(raw) > SLICE:
                flush()
                size = lines = 0
            if many > LINES or len(raw) > SLICE:
                out.append(self.long_share(raw))
                continue
            held.append(raw)
            size, lines = size + len(raw), lines + many
        flush()
        s = self.slope * np.concatenate([np.empty(0), *out]) + self.offset
        return (1 / (1 + np.exp(-np.clip(s, -30, 30)))).tolist()

    def fit(self, texts: list[str], y: np.ndarray, rounds: int = 120, rate: float = 0.1, shrink: float = 1e-4, passes: int = 2) -> Field:
        if not texts:
            return self
        return self.fit_lines(*own_features([(t or "").encode() for t in texts]), y, rounds, rate, shrink, passes)

    def fit_lines(self, own: np.ndarray, length: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, shrink: float = 1e-4, passes: int = 2) -> Field:
        """`fit` from what `own_features` gives of the texts."""
        if first.size < 2:
            return self
        x = _beside(own, first)
        of = np.repeat(np.arange(first.size - 1), np.diff(first))
        state = y[of].astype(np.int64)
        for turn in range(passes):
            self._climb(x, state, first, rounds, rate, shrink)
            if turn + 1 < passes:
                good = self.marginals(x @ self.weights, first)
                worst = np.minimum.reduceat(good, first[:-1])[of]
                state = np.where((y[of] == 0) & ((good < 0.5) | (good <= worst)), 0, 1)
        s = self.share(self.marginals(x @ self.weights, first), length, first)
        curve = np.array([self.slope, self.offset])
        for _ in range(50):  # Newton steps of a logistic curve
            p = 1 / (1 + np.exp(-np.clip(curve[0] * s + curve[1], -30, 30)))
            w = p * (1 - p) + 1e-6
            design = np.column_stack([s, np.ones_like(s)])
            grad = design.T @ (p - y) + 1e-2 * curve
            curve = curve - np.linalg.solve(design.T * w @ design + 1e-2 * np.eye(2), grad).clip(-1, 1)
        self.slope, self.offset = map(float, curve)
        return self

    def _climb(self, x, state, first, rounds, rate, shrink):
        """Adam on the negative log likelihood of whole label sequences.

        Lines are laid out by their place in the document, long documents first, so that the n-th
        lines of all documents that have one are neighbours and one step of a recursion is one slice.
        """
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        many = np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), side="left")
        at = np.concatenate([first[:-1][order[:k]] + t for t, k in enumerate(many)])
        cuts = np.concatenate([[0], np.cumsum(many)]).tolist()
        before = np.concatenate([np.arange(a, a + k) for a, k in zip(cuts, many[1:])]) if len(many) > 1 else np.empty(0, np.int64)
        x, state, rest = x[at], state[at], slice(int(many[0]), None)
        seen = np.bincount(state[before] * 2 + state[rest], minlength=4).reshape(2, 2)
        m = [np.zeros_like(self.weights), np.zeros((2, 2))]
        v = [np.zeros_like(self.weights), np.zeros((2, 2))]
        total = len(x)
        for step in range(1, rounds + 1):
            (bb, bg), (gb, gg) = self.pairs.tolist()
            lean = x @ self.weights
            ahead, back = lean.copy(), np.zeros(total)
            for t in range(1, len(many)):
                odds = ahead[cuts[t - 1] : cuts[t - 1] + many[t]]
                ahead[cuts[t] : cuts[t + 1]] += np.logaddexp(odds + gg, bg) - np.logaddexp(odds + gb, bb)
            for t in range(len(many) - 2, -1, -1):
                odds = lean[cuts[t + 1] : cuts[t + 2]] + back[cuts[t + 1] : cuts[t + 2]]
                back[cuts[t] : cuts[t] + many[t + 1]] = np.logaddexp(odds + gg, gb) - np.logaddexp(odds + bg, bb)
            good = 1 / (1 + np.exp(-np.clip(ahead + back, -50, 50)))
            # joint probabilities of neighbouring lines
            left, right = ahead[before], lean[rest] + back[rest]
            joint = np.stack([np.full(left.size, bb), bg + right, gb + left, gg + left + right])
            joint = np.exp(joint - np.logaddexp.reduce(joint, axis=0)).sum(1).reshape(2, 2)
            grads = [x.T @ (good - state) / total + shrink * self.weights, (joint - seen) / total + shrink * self.pairs]
            for p, g, a, b in zip((self.weights, self.pairs), grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9)


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, most_rows: int = 6_000, most_bytes: int = 64 << 20, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_lines: int = 1 << 18) -> Field:
    """A field fitted on a bounded sample of the labelled rows."""
    table = described(labelled_sample(docs, labels, label, train_rows, most_rows, most_bytes, id_col, text_col, most_lines)).toArrow().combine_chunks()
    own, length = (np.concatenate([np.empty(0), *(c.flatten().to_numpy() for c in table[name].chunks)]) for name in ("own", "length"))
    first = np.concatenate([[0], np.cumsum(table["lines"].to_numpy())])
    field = Field(line_features([b""])[0].shape[1])
    return field.fit_lines(own.reshape(-1, OWN), length, first, table["y"].to_numpy().astype(np.float64))


def described(sample: DataFrame) -> DataFrame:
    """(y, lines, own, length) for each row of `sample(text, y)`: how many lines it has, and what `own_features` gives of them."""
    columns = {"y": pa.int64(), "lines": pa.int64(), "own": pa.list_(pa.float64()), "length": pa.list_(pa.float64())}

    def rows(batch):
        for part in slices(batch, 0):
            own, length, first = own_features([t.encode() for t in part.column(0).to_pylist()])
            cuts = [slice(i, j) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
            yield {"y": part.column(1).to_numpy(), "lines": np.diff(first), "own": [own[c].ravel() for c in cuts], "length": [length[c] for c in cuts]}

    return sample.select("text", F.col("y").cast("long")).mapInArrow(batches(columns, rows), "y long, lines long, own array<double>, length array<double>")


def score_texts(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, field: Field, threshold: float, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text_col)

    def run(stream):
        for batch in (part for whole in stream for part in slices(whole, at)):
            yield batch.filter(pa.array([s >= threshold for s in shared.value.scores(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = held_out(F.col("doc_id"), 4, 2)
    field = train(docs, labels, ~out)
    scored = score_texts(docs, field)
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
