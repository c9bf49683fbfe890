"""Operators that SQL can't express against plain Python: features and scores of quality, pieces of the real model."""

import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import pieces, quality, queries
from plumbline.llm.common import buffers
from tests.llm.conftest import TEXTS

SF = "/root/testdata/sf0.001"


def plain_features(text):
    data = (text or "").encode()
    n = len(data)
    share = lambda k: k / max(n, 1)
    out = [share(sum(b in members for b in data)) for members in quality.CLASSES.values()] + [share(sum(b >= 128 for b in data))]
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    m = max(len(words), 1)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / m
    counts = Counter(words)
    lines = data.split(b"\n")
    out += [
        math.log1p(n), math.log1p(len(words)), mean, math.sqrt(max(sum(s * s for s in sizes) / m - mean**2, 0)), math.log1p(max(sizes, default=0)),
        len(counts) / len(words) if words else 0, max(counts.values(), default=0) / m, math.log1p(len(lines)), len(set(lines)) / len(lines),
        None, sum(s <= 2 for s in sizes) / m, sum(65 <= w[0] <= 90 for w in words) / m, math.log1p(len(words) / len(lines)),
    ]
    out[-4] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    return out


def test_features_are_those_of_plain_python():
    texts = [t or "" for t in TEXTS] + ["The end.\nThe end.\nThe end", "\n", "a a a b b", "ÀÉ \x0b x,;: \"q\" (1) #tag 99"]
    got = quality.features(*buffers(pa.array(texts)))
    want = np.array([plain_features(t) for t in texts])
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-9


def test_scores_follow_the_weights(spark, docs):
    rng = np.random.default_rng(3)
    width = quality.N_FEATURES
    model = quality.Model(rng.normal(size=width), rng.uniform(0.5, 2, width), rng.normal(size=2 * width) / 9, 0.4, 1.7)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, text in enumerate(TEXTS):
        z = [min(max((x - a) / s, -8), 8) for x, a, s in zip(plain_features(text), model.mean, model.scale, strict=True)]
        strength = sum(w * v for w, v in zip(model.weights, [*z, *(min(v * v, 16) for v in z)], strict=True))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * (strength - model.cut) + math.log(0.3 / 0.7)))), abs=1e-9)


def test_pieces_of_the_real_model_are_the_best():
    """Another Viterbi, over characters and a dictionary, from the end of the text."""
    model = pieces.load()
    score = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True) if k in (pieces.NORMAL, pieces.USER)}
    longest = max(map(len, score))

    def best(text):
        value, step = [0.0] + [None] * len(text), [None] * (len(text) + 1)
        for n in range(1, len(text) + 1):  # the best of the last n characters
            at = len(text) - n
            options = [(score[text[at : at + k]] + value[n - k], k) for k in range(1, min(longest, n) + 1) if text[at : at + k] in score]
            if text[at] not in score:
                options.append((model.unknown_score + value[n - 1], 1))
            value[n], step[n] = max(options)
        return value[-1]

    def worth(ids):
        total, held = 0.0, 0
        for i in ids:
            if model.kinds[i] == pieces.BYTE:
                held += 1 if bytes([int(model.pieces[i][3:5], 16)])[0] & 0xC0 != 0x80 else 0
            else:
                total += model.scores[i]
        return total + held * model.unknown_score

    for text in [t for t in TEXTS if t and len(t) < 2000] + ["Étion dans çouelle 日本 \U0001f642 end\n\n  two  spaces", "internationalization of unbelievable things"]:
        ids = model.encode(text)
        assert worth(ids) == pytest.approx(best(model.normal(text)), abs=1e-6)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_periodic_runs"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{x}"' for x in sorted(out.columns))
    got = sorted((tuple(r[x] for x in sorted(out.columns)) for r in out.collect()), key=repr)
    assert got == sorted(c.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall(), key=repr)
