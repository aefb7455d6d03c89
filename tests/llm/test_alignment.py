"""Alignment of two tokenizers against the libraries' own ids, position by position."""

import collections
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from phosfold.llm import alignment  # noqa: E402
from test_llm import SF, documents, odd, none, docs  # noqa: E402, F401


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_report(rows, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    from phosfold.llm.bpe import byte_letters

    a_model, b_model = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_model.encode_special_tokens = True
    letters = byte_letters()
    b_bytes = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    found, pairs = [], collections.Counter()
    for doc_id, text in rows:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_parts, b_parts = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        if not text or not b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
            found.append((doc_id, 0, 0, [], ""))
            continue
        ends = []
        for tokens in (a_parts, b_parts):
            at, here = 0, []
            for t in tokens:
                at += len(t)
                here.append(at)
            ends.append(here)
        where = [{e: k for k, e in enumerate(x)} for x in ends]
        shared = sorted(where[0].keys() & where[1].keys())
        groups, i, j = [], 0, 0
        for e in shared:
            x, y = where[0][e] + 1, where[1][e] + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = [(g[-1], h[-1]) for g, h in groups]
        pairs.update(links)
        text_form = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        found.append((doc_id, len(a), len(b), links, hashlib.sha256(text_form.encode()).hexdigest()))
    top = collections.Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    return collections.Counter((d, n, m, len(ls), len(ls), sum(pairs[x] == top[x[1]] for x in ls), sum(pairs[x] for x in ls), s) for d, n, m, ls, s in found)


def awkward(n=300):
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "　", "\xa0", "a", "the", " of", "ing", "'s", "12", "é", "é", "日本", "\U0001f600", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "▁", "​", "\x00", "Token", ".", ",", "!?", "\r\n", "ß"]
    return [(k, "".join(rng.choice(bits[:-9] if k % 3 else bits) for _ in range(rng.randint(1, 40)))) for k in range(n)]


@pytest.mark.parametrize("hot", [1 << 20, 60, 0])
def test_alignment(spark, odd, none, docs, paths, hot):
    for table in (odd, docs, documents(spark, awkward())):
        want = plain_report([(r.doc_id, r.text) for r in table.collect()], paths)
        got = alignment.alignment_report(table, *paths, hot_pairs=hot)
        assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert alignment.alignment_report(none, *paths, hot_pairs=hot).count() == 0


def test_long_texts_in_parts(spark, docs, paths, monkeypatch):
    text = " ".join(r.text for r in docs.orderBy("doc_id").limit(60).collect())
    rows = [(1, text), (2, text + "▁"), (3, "x" * 3000 + " " + text[:5000] + "  \n " * 40), (4, " " * 2000), (5, text[:1500])]
    want = plain_report(rows, paths)
    monkeypatch.setattr(alignment, "SLICE", 700)
    coder = alignment.Aligner(*paths, remembered=50)
    found = list(alignment.aligned([t for _, t in rows], coder))
    assert [(n, m, g, s) for n, m, g, s, _, _ in found] == [next((r[1], r[2], r[3], r[7]) for r in want if r[0] == d) for d, _ in rows]
    assert found[1][:4] == (0, 0, 0, "") and len(coder.windows) <= 50
    assert "".join(alignment.parts(text)) == " " + text and len(list(alignment.parts(text))) > 50


def test_equal_hashes_of_different_windows(paths, monkeypatch):
    coder = alignment.Aligner(*paths)
    parts = [" one two three two", " two four one"]
    a, b = [coder.a_ids(p) for p in parts], [coder.b.encode(p) for p in parts]
    want = coder.align(a, b)
    coder.fast = None
    assert [coder.a_ids(p) for p in parts] == a
    monkeypatch.setattr(alignment, "mixed", lambda h: h & 0)
    again = coder.align(a, b)
    assert again[0] == want[0] and all((x == y).all() for x, y in zip(again[1:], want[1:]))
