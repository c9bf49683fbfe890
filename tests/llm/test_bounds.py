"""Brute-force versions and bounds of the parts that SQL can't express."""

import hashlib
import io
import re
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chunks, jaccard, mixing, recompression
from plumbline.llm.common import SAMPLE, repeated
from plumbline.llm.repeats import Corpus

from .conftest import TEXTS


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_reach_the_score(percent):
    """Sets at the limit of the similarity agree on as many parts as `possible` demands of each of them."""
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 400))
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        t = s.copy()
        for _ in range(int(rng.integers(0, len(s) + 1))):  # drop or swap elements while the link holds
            u = t[rng.random(len(t)) > 0.5 / max(len(t), 1)] if rng.random() < 0.5 else np.unique(np.concatenate([t[1:], rng.integers(0, 1 << 63, 1).astype(np.uint64)]))
            if len(u) and jaccard.linked(s, u, percent):
                t = u
        x, y = jaccard.signatures(s, percent), jaccard.signatures(t, percent)
        reached = False
        for band in set(x[1]) & set(y[1]):
            of = lambda z, band=band: set(zip(z[0][z[1] == band].tolist(), z[2][z[1] == band].tolist(), strict=True))
            common = [part for _, part in of(x) & of(y)]
            score = sum(2 if common.count(p) == len(jaccard.SUBSETS) else 1 for p in set(common))
            n1 = jaccard.parts_of(int(band), percent)
            needed = [1 if not n1 else 2 * n1 - jaccard.differences(len(z) + min(int(jaccard.BANDS[band]), len(z) * 100 // percent), percent) for z in (s, t)]
            reached |= score >= max(needed)
        assert reached, (len(s), len(t))


def brute_cuts(data: bytes, least=256, most=8192, mask=0xFFC00000):
    ends, start = [], 0
    for i in range(len(data)):
        h = sum(int(chunks.GEAR[data[j]]) << (i - j) for j in range(max(0, i - 31), i + 1)) & 0xFFFFFFFF
        if i + 1 - start == most or (i + 1 - start >= least and h & mask == 0):
            start = i + 1
            ends.append(start)
    return len(ends) + (start < len(data))


def test_media_by_brute_force(spark, docs):
    texts = {i: t or "" for i, t in enumerate(TEXTS)}
    got = {r.doc_id: r for r in chunks.load(*chunks.store(docs), chunks.OUTPUTS, chunks.features).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        raw, r = text.encode(), got[i]
        data = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(data)
        values = [b - 128 for b in data]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(values, values[1:], strict=False))
        feature = f"chunks={brute_cuts(data)};peak={max(map(abs, values))};sum={sum(values)};energy={sum(v * v for v in values)};crossings={crossings}"
        form = file.getvalue()
        want = (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(form), hashlib.sha256(form).hexdigest(), feature)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want


def test_mix_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"s{int(s)}" if s else None, "w " * int(rng.integers(0, 40))) for i, s in enumerate(rng.integers(0, 5, 800))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()))
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"\w+", text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(sizes.values())
    while any(left * weight[s] > 2 * sizes[s] * sum(weight[o] for o in order if o not in target) for s in order if s not in target):
        total = sum(weight[o] for o in order if o not in target)
        over = [s for s in order if s not in target and left * weight[s] > 2 * sizes[s] * total]
        target |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
    total = sum(weight[o] for o in order if o not in target)
    target |= {s: left * weight[s] / total for s in order if s not in target}
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 40 for s in order)


def test_clashing_columns_of_the_mix(spark):
    rows = [(i, "s", "a b c", 77 + i, 9, 8) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _size long, _nth long, _copy long")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() and all(tuple(r) == rows[r.doc_id] for r in out.collect())


def test_hot_keys_are_dealt_and_whole(spark):
    """A key of many rows goes through several tasks; every row of it stays, rows of lone keys go."""
    rows = spark.range(6000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).cast("long").alias("key"), "id")
    out = repeated(rows, rows.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0), "key", ["id"], group_rows=100)
    assert out.count() == 4000 and out.filter("key <> 1").isEmpty()


def test_frequent_names_meet_by_their_windows(spark):
    """Thousands of places of one phrase, in parts of two: the same rows go as by one group."""
    phrase = "the quick brown fox jumps over the lazy dog and runs"
    texts = [f"{' '.join(f'a{i % 50}x{k}' for k in range(12))} {phrase} {' '.join(f'b{i % 40}x{k}' for k in range(12))}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {tuple(r) for r in recompression.remove_repeats(docs).collect()}
    corpus = Corpus(docs, "doc_id", "text")
    segments = corpus.around(corpus.meeting(recompression.word_anchors(20), group_rows=2), recompression.window_hashes(20), "windows binary")
    spans = corpus.spans(segments, recompression.later_windows(20), "windows binary", meet=recompression.meeting_windows(20))
    got = {tuple(r) for r in corpus.finish(spans, recompression.kept_words(20), "n_words long, n_removed long, kept_sha256 string").collect()}
    seen, removed = set(), {}
    for i, text in enumerate(texts):
        w = text.split()
        gone = set()
        for at in range(len(w) - 19):
            k = tuple(w[at : at + 20])
            if k in seen:
                gone |= set(range(at, at + 20))
            seen.add(k)
        removed[i] = len(gone)
    assert {r[0]: r[2] for r in got} == removed and got == want
