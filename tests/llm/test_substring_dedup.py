"""Removal of repeated word windows against a search over all windows."""

import collections
import hashlib
import random

import numpy as np
import pytest

from phosfold.llm import fm_index, substring_dedup
from test_llm import docs, documents, none, odd  # noqa: F401


def plain(rows, width=50):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - width + 1) if d is not None else ():
            key = tuple(w[i : i + width])
            least[key] = min(d, least.get(key, d))
    found = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - width + 1) if d is not None else ():
            if least[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        found.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return found


def digests(rows, width=50):
    return collections.Counter((d, n, g, hashlib.sha256(kept).hexdigest()) for d, n, g, kept in plain(rows, width))


def passages(seed=1, n=60, vocabulary=400):
    """Texts that share passages of about the width, in all orders of ids."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    common = [[word() for _ in range(rng.choice((49, 50, 51, 90)))] for _ in range(5)]
    rows = []
    for k in range(n):
        text = []
        for _ in range(rng.randint(1, 4)):
            text += [word() for _ in range(rng.randint(0, 60))] + rng.choice(common)
        rows.append((rng.choice((None, rng.randrange(80), -k)), rng.choice((" ", "\n", " \x0b\t")).join(text)))
    long = "y" * 700
    tail = " ".join(f"z{i}" for i in range(60))
    return rows + [(500, f"a {long} {tail}"), (501, f"b {long} {tail}"), (502, f"c {long}x {tail} \xa0 　 end"), (503, "same " * 300), (504, "same " * 51), (505, "same " * 49)] + rows[:3]


@pytest.mark.parametrize("crowd", [1024, 0, 3])
def test_removal(spark, odd, none, docs, crowd):
    for table in (odd, docs, documents(spark, passages())):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        got = substring_dedup.removal_report(table, crowd=crowd, filter_bits=20)
        want = digests(rows)
        assert collections.Counter(tuple(r) for r in got.collect()) == want
        if table is not odd:
            assert sum(n > 0 for _, _, n, _ in want) > 5
    assert substring_dedup.removal_report(none, crowd=crowd).count() == 0


def test_small_windows_pieces_and_shards(spark, monkeypatch):
    for name, value in (("GROUP", 300), ("PIECE", 40), ("AT_ONCE", 16), ("SHARD_WORDS", 500), ("LONG_WORD", 3)):
        monkeypatch.setattr(substring_dedup, name, value)
    table = documents(spark, passages(3, 50, 9))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    for width, gram in ((6, 2), (5, 5), (1, 1)):
        groups = [g for g in substring_dedup._groups([t for _, t in rows], width, gram)]
        starts = collections.Counter((int(d), int(s) + j) for g in groups for d, s, n in zip(g.doc, g.place, g.many) for j in range(n))
        assert starts == collections.Counter((k, i) for k, (_, t) in enumerate(rows) for i in range(len(t.encode().split()) - width + 1))
    ids = [k for k, (d, _) in enumerate(rows) if d is not None]
    # what tasks see of the settings above is their own module's, so the shards are tried here
    a, x, owner, content = [], [], [], []
    for g in substring_dedup._groups([rows[k][1] for k in ids], 6, 2):
        contents = g.contents()
        a += g.name.view(np.int64).tolist()
        x += [hash(c) for c in contents]
        owner += [rows[ids[d]][0] for d in g.doc.tolist()]
        content += contents
    found = substring_dedup.indexed(a, x, owner, content, 6)
    least = {}
    for o, c in zip(owner, content):
        w = c.split()
        for i in range(len(w) - 5):
            least[tuple(w[i : i + 6])] = min(o, least.get(tuple(w[i : i + 6]), o))
    want = collections.Counter((p, q, i, least[tuple(c.split()[i : i + 6])]) for p, q, c in zip(a, x, content) for i in range(len(c.split()) - 5))
    got = collections.Counter((p, q, j + k, m) for p, q, j, n, m in zip(*(found[c].tolist() for c in ("a", "x", "j", "many", "least"))) for k in range(n))
    assert got == want


def test_kept_texts(spark, docs):
    table = documents(spark, passages(5))
    want = collections.Counter((d, kept.decode() if g else t) for (d, t), (_, _, g, kept) in zip([(r.doc_id, r.text) for r in table.collect()], plain([(r.doc_id, r.text) for r in table.collect()])))
    got = substring_dedup.remove_repeats(table, filter_bits=20)
    assert got.columns == table.columns
    rows = got.collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == want and all(r.n_chars == len(r.text) for r in rows)


def test_index():
    rng = np.random.default_rng(4)
    for sigma, n in ((2, 60), (5, 500), (900, 4000)):
        seq = np.minimum(rng.geometric(0.05 if sigma > 9 else 0.4, n), sigma) - 1
        tree = fm_index.WaveletTree(seq, sigma)
        symbols, at = np.repeat(np.arange(sigma), 40), rng.integers(0, n + 1, 40 * sigma)
        assert tree.rank(symbols, at).tolist() == [int((seq[:k] == s).sum()) for s, k in zip(symbols, at)] if sigma < 9 else True
        if sigma > 9:
            some = rng.integers(0, symbols.size, 500)
            assert tree.rank(symbols[some], at[some]).tolist() == [int((seq[:k] == s).sum()) if (seq == s).any() else 0 for s, k in zip(symbols[some], at[some])]
        bits = sum(level[0].words.size * 64 for level in tree.levels)
        share = np.bincount(seq) / n
        entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
        assert bits <= n * (entropy + 1) + 64 * len(tree.levels) + n * 0.01
