"""Long periodic texts in the removal of repeated bytes."""

import collections
import hashlib

import numpy as np
import pytest

from plumbline.llm import suffixes


def brute(texts, length):
    counts = collections.Counter(t[j : j + length] for t in texts for j in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for j in range(len(t) - length + 1):
            if counts[t[j : j + length]] > 1:
                gone[j] += 1
                gone[j + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def removed(spark, texts):
    df = spark.createDataFrame([(i, t.decode(), 1) for i, t in enumerate(texts)], "doc_id long, text string, pos int").repartition(3)
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(suffixes.remove_repeats(df).collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("piece", [1 << 22, 700])
def test_periodic_texts(spark, monkeypatch, piece):
    monkeypatch.setattr(suffixes, "SLICE", piece)
    rng = np.random.default_rng(piece)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    roots = [b" ", b"-=", b"=====\n", word(37), word(100), word(128), word(150), b"a" * 20 + b"b", word(60) + b"x" * 30]
    texts = [b"", b"abc", b" " * 200, b" " * 201 + b"z", word(300)]
    for root in roots:
        for n in (150, 199, 200, 230, 260, 399, 410, 470, 900, 2500):
            long = root * (n // len(root) + 2)
            cut = int(rng.integers(0, len(root)))
            texts.append(word(int(rng.integers(0, 60))) + long[cut : cut + n] + word(int(rng.integers(0, 300))))
    for _ in range(20):
        a, b = (roots[int(k)] for k in rng.integers(0, len(roots), 2))
        texts.append((a * 40)[: int(rng.integers(150, 900))] + (b * 400)[: int(rng.integers(150, 900))])
    texts = list(dict.fromkeys(texts))
    assert removed(spark, texts) == brute(texts, 200)
    alone = [t for i, t in enumerate(texts) if i % 9 == 3]  # each pattern in few places
    assert removed(spark, alone) == brute(alone, 200)


def test_very_long_texts(spark):
    """20 MB of blanks, a pattern repeated for 9 MB, and what of them stands elsewhere."""
    line = b"-*- this line is here again and again -*-\n"
    blanks = b"begin" + b" " * 20_000_000 + b"end"
    rules = b"head " + line * 220_000 + b"tail"
    texts = [blanks, rules, b"abc" + b" " * 200, b"x" + (line * 9)[11:211] + b"y", b" " * 199 + b"q", b"abc"]
    got = removed(spark, texts)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got[0] == (len(blanks), 20_000_000, 1, digest(b"beginend"))
    assert got[1] == (len(rules), len(rules) - 9, 1, digest(b"head tail"))
    assert got[2] == (203, 200, 1, digest(b"abc")) and got[3] == (202, 200, 1, digest(b"xy"))
    assert [g[1] for g in got[4:]] == [0, 0]


def test_anchors_of_a_stretch_are_few():
    data = np.frombuffer(b"begin" + b" " * 1_000_000 + b"end", np.uint8)
    at, _, periodic = suffixes.anchors(data, np.array([0, len(data)]), 200, 73)
    assert len(at) < 500 and periodic.tolist() == [[5, 1_000_005, 1]]
