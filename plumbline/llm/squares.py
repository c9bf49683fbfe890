"""Periodic runs of words, caught as squares by catchers over completed power-of-two blocks.

A run is a stretch of words with smallest period q that no neighbouring word extends and that is at least max(6, 4 * q)
words long. For q in [m, 2m), m a power of two, such a run holds two neighbouring blocks of m words, each aligned to m,
that recur q words later. So each completed block of m words gets a catcher, which lives while the next 2m words are
appended: every appended word advances the comparison of the newest m words with the block, by hashes of dyadic length
that grow from those of half the length. Where two neighbouring catchers of one level see the same period, the words
themselves (numbered exactly, not hashed) are compared outward from the square; squares of one period merge into the run
that holds them. The catchers of a level advance together, as arrays over the words of many documents.

A square inside a known run of a period of at most m is a power of that run's root, by the theorem of Fine and Wilf, and
tells nothing new; levels go up, so smallest periods come first.

Null and empty texts and texts without words have no runs. Rows are judged one by one: repeated ids and rows give one row
each, a null id stays null. Extra columns are ignored. Texts of any length are read whole: memory grows by some 60 bytes
a word of the longest text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import U, mix, slices, whole_texts

#: A run has this many words and this many times its period at least.
LEAST, TIMES = 6, 4


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, offsets by text): stretches without the bytes 32 and 9-13."""
    parts = pc.ascii_split_whitespace(texts)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(real.to_numpy(zero_copy_only=False), out=before[1:])
    return flat.filter(real), before[offsets - offsets[0]]


def outward(words: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The maximal stretch around words[start:end], in which words a period apart are equal."""
    step = 64
    while end < len(words):
        n = min(step, len(words) - end)
        differ = words[end : end + n] != words[end - period : end - period + n]
        at = int(differ.argmax())
        if differ[at]:
            end += at
            break
        end, step = end + n, min(step * 2, 1 << 18)
    step = 64
    while start > 0:
        n = min(step, start)
        differ = (words[start - n : start] != words[start - n + period : start + period])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            start -= at
            break
        start, step = start - n, min(step * 2, 1 << 18)
    return start, end


def caught(hashes: np.ndarray, m: int) -> np.ndarray:
    """Offsets t at which words from t + m on repeat the block of m words that t lies in, and a neighbouring catcher says so too.

    hashes[i] stands for the m words from i on. The block is at t - t % m, the period is m + t % m.
    """
    blocks = np.repeat(hashes[::m], m)[: max(len(hashes) - m, 0)]
    same = blocks == hashes[m:]
    near = np.zeros(len(same), bool)
    near[m:] = same[:-m] if m else same
    near[: max(len(same) - m, 0)] |= same[m:]
    return np.flatnonzero(same & near)


def runs_of(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period. Equal numbers are equal words; longest bounds a run's length."""
    hashes, m = mix(words.astype(np.int64).view(U)), 1
    found = np.zeros((0, 3), np.int64)
    while TIMES * m <= longest:
        at = caught(hashes, m)
        starts, periods = at - at % m, m + at % m
        if len(found):
            order = np.argsort(found[:, 0], kind="stable")
            reach = np.append(-1, np.maximum.accumulate(found[order, 1]))
            known = reach[np.searchsorted(found[order, 0], starts, "right")] >= starts + periods + m
            starts, periods = starts[~known], periods[~known]
        order = np.lexsort((starts, periods))
        starts, periods = starts[order], periods[order]
        edges = np.append(np.flatnonzero(np.diff(periods, prepend=-1)), len(periods))
        new = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            q = int(periods[lo])
            while lo < hi:
                start, end = outward(words, int(starts[lo]), int(starts[lo]) + q + m, q)
                if end - start >= max(LEAST, TIMES * q):
                    new.append((start, end, q))
                lo += max(1, int(np.searchsorted(starts[lo:hi], end - q - m, "right")))
        if new:
            found = np.concatenate([found, np.array(new, np.int64)])
        left = len(hashes) - m
        if left <= 0:
            break
        hashes, m = mix(hashes[:left] * U(0x9E3779B97F4A7C15) + mix(hashes[m:] + U(m))), m * 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_by_text(numbers: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The runs of each text, counted from its first word; numbers: of its words, offsets: of the texts."""
    sizes = np.diff(offsets)
    texts = len(sizes)
    apart = offsets + np.arange(texts + 1)
    words = np.full(int(apart[-1]), 0, np.int64)
    words[np.arange(len(numbers)) + np.repeat(np.arange(texts), sizes)] = numbers
    words[apart[1:] - 1] = -1 - np.arange(texts)  # no text runs into the next
    found = runs_of(words, int(sizes.max(initial=0)))
    cut = np.searchsorted(found[:, 0], apart)
    return [found[cut[i] : cut[i + 1]] - np.array([apart[i], apart[i], 0]) for i in range(texts)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run holds beyond its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each of n places: in one document of ten a tail is made periodic (op12's contract)."""
    at = np.arange(n)
    if doc_id is None or not n:
        return at
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def periodic_runs(docs: DataFrame, tails: bool = False) -> DataFrame:
    """One row per row of docs: (doc_id, n_runs, start, length, period, exponent_milli of the longest run, runs, collapsed).

    runs: array of (start, length, period) by start, then period. collapsed: the words that stay, joined by one space.
    tails: first make the tails of some documents periodic, as op12's contract says.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    kinds = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 21):
                words, offsets = split_words(part.column(1))
                numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
                ids = part.column(0).to_pylist()
                place = np.arange(len(numbers))
                if tails:
                    for i, n in zip(range(len(ids)), np.diff(offsets).tolist(), strict=True):
                        place[offsets[i] : offsets[i + 1]] = offsets[i] + repeated_tail(ids[i], n)
                found = runs_by_text(numbers[place], offsets)
                stays = np.ones(len(numbers), bool)
                for i, runs in enumerate(found):
                    if len(runs):
                        stays[offsets[i] : offsets[i + 1]] = kept_words(int(offsets[i + 1] - offsets[i]), runs)
                before = np.append(0, np.cumsum(stays))[offsets]
                kept = pa.ListArray.from_arrays(pa.array(before, pa.int32()), words.take(pa.array(place[stays])))
                top = []
                for runs in found:
                    if len(runs):
                        length = runs[:, 1] - runs[:, 0]
                        s, e, q = runs[int(length.argmax())].tolist()  # first of the longest: smallest start, then period
                        top.append((s, e - s, q, 1000 * (e - s) // q))
                    else:
                        top.append((None,) * 4)
                spans = [[{"start": s, "length": e - s, "period": q} for s, e, q in runs.tolist()] for runs in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(r) for r in found], pa.int64()),
                        *(pa.array([t[k] for t in top], pa.int64()) for k in range(4)),
                        pa.array(spans, pa.list_(kinds)),
                        pc.binary_join(kept, " "),
                    ],
                    names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"],
                )

    return whole_texts(docs).mapInArrow(rows, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of its runs, the longest one, and digests of all runs and of the collapsed words."""
    out = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), tails=True)
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_sql() -> str:
    """All pairs of equal words of one document up to a quarter of its length apart, as islands. crc32 by its shift register."""
    crc = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
      lambda a, x: CASE WHEN x < 256 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, CASE WHEN doc_id IS NOT NULL THEN {crc} ELSE 1 END AS h FROM documents),
    a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, 3 + (h // 10) % 8 AS e FROM d),
    t AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN n = 0 THEN [] ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // e) ELSE i END]) END AS w FROM a),
    v AS MATERIALIZED (SELECT r, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t),
    p AS (SELECT x.r, x.i, y.i - x.i AS q FROM v x JOIN v y ON x.r = y.r AND x.word = y.word AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n),
    g AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM p) GROUP BY r, q, island),
    u AS MATERIALIZED (SELECT r, s, l, min(q) AS q FROM g WHERE l >= greatest(6, 4 * q) GROUP BY r, s, l),
    b AS (SELECT r, count(*) AS n_runs, arg_min([s, l, q], [-l, s, q]) AS top, string_agg(s::BIGINT || ',' || l::BIGINT || ',' || q::BIGINT || chr(10), '' ORDER BY s, q) AS line FROM u GROUP BY r),
    k AS (SELECT v.r, string_agg(v.word, ' ' ORDER BY v.i) AS kept FROM v WHERE NOT EXISTS (FROM u WHERE u.r = v.r AND v.i >= u.s + u.q AND v.i < u.s + u.l) GROUP BY v.r)
    SELECT t.doc_id, coalesce(b.n_runs, 0) AS n_runs, b.top[1]::BIGINT AS start, b.top[2]::BIGINT AS length, b.top[3]::BIGINT AS period, (1000 * b.top[2] // b.top[3])::BIGINT AS exponent_milli,
      sha256(coalesce(b.line, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
    FROM t LEFT JOIN b USING (r) LEFT JOIN k USING (r)"""
