"""Removal of repeated word windows by recompression.

Words get 64-bit names. In each round every symbol falls into one of two classes by a hash of its name and the round; a
left symbol followed by a right one becomes a named pair, and equal neighbours that found no partner become a named run.
A name is a hash of what it stands for, so tasks agree on it without asking each other: equal substrings get equal
interior symbols wherever they stand. With each symbol goes the range of words that determines it (a pair needs its two
parts alone, a run and a symbol that stays alone need their neighbours, and the partner of a neighbour of the same name);
a window holds a symbol if it holds that range.

Each window is represented by the highest symbol it holds (ties by name). Spark shuffles these symbols by name over all
documents; those that occur once are dropped, and the others meet by name, each with the hashes of the windows that it
represents and of those between them. Within a name, a window whose hash occurs earlier is a repeat. Names of many symbols
are judged in parts. Only what is first in its part goes on, and that meets by its own hash: a window comes at most once
from a part, and no task gets all places of a frequent name.

Nulls and texts of fewer than `window` words lose nothing. Documents with equal texts are folded first: the first stands
for all, later ones lose every window. Rows that repeat an id with another text are ordered by a hash of the text, null ids
come last; rows repeated wholly count as one and get equal results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import U, buffers, gram_hashes, mix, slices, union, word_hashes
from plumbline.llm.repeats import Corpus

WINDOW, ROUNDS = 20, 6
FAR = 1 << 20


def symbols(words: np.ndarray, by_doc: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(level, name, start, end) of every symbol at its creation; [start, end) determines it and is within a document."""
    n = len(words)
    doc = np.repeat(np.arange(len(by_doc) - 1), np.diff(by_doc))
    name, a, b = words.copy(), np.arange(n), np.arange(1, n + 1)
    out = [(np.zeros(n, np.uint8), name, a, b)]
    for level in range(1, rounds + 1):
        if len(name) < 2:
            break
        left = mix(name + U(level * 0x9E3779B97F4A7C15 % (1 << 64))) & U(1) == 0
        same_doc = doc[1:] == doc[:-1]
        pair = left[:-1] & ~left[1:] & same_doc
        paired = np.zeros(len(name), bool)
        paired[:-1] |= pair
        paired[1:] |= pair
        # Runs among the symbols without a partner.
        joined = ~paired[:-1] & ~paired[1:] & (name[1:] == name[:-1]) & same_doc
        head = np.ones(len(name), bool)
        head[1:] = ~(pair | joined)
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(name)))
        last = at + size - 1
        is_pair = paired[at]
        # What stays alone, and runs, are determined with both neighbours in view.
        before, after = np.maximum(at - 1, 0), np.minimum(last + 1, len(name) - 1)
        has_before, has_after = (at > 0) & (doc[before] == doc[at]), (last < len(name) - 1) & (doc[after] == doc[at])
        # A neighbour of the same name would belong to the run but for its own partner beyond, so that one counts too.
        before = np.where(has_before & (name[before] == name[at]), np.maximum(before - 1, 0), before)
        after = np.where(has_after & (name[after] == name[at]), np.minimum(after + 1, len(name) - 1), after)
        new_a = np.where(is_pair, a[at], np.where(has_before, a[before], a[at] - FAR))
        new_b = np.where(is_pair, b[last], np.where(has_after, b[after], b[last] + FAR))
        made = is_pair | (size > 1)
        pair_name = mix(name[at] * U(0xD6E8FEB86659FD93) + mix(name[last]) + U(level))
        run_name = mix(name[at] ^ mix(size.astype(U) + U(0xABCDEF)))
        name = np.where(is_pair, pair_name, np.where(size > 1, run_name, name[at]))
        a, b, doc = new_a, new_b, doc[at]
        use = made & (b - a <= window)
        if not use.any():
            continue  # later rounds may still make symbols that fit, whatever else lies in the slice
        out.append((np.full(int(use.sum()), level, np.uint8), name[use], a[use], b[use]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchors(words: np.ndarray, by_doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, end) of the symbols that represent some window."""
    return representatives(words, by_doc, window)[:3]


def representatives(words: np.ndarray, by_doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, end, offsets) of the symbols that represent some window.

    The windows that a symbol represents start lo to hi words before it; offsets is lo * window + hi. Some in between may
    have another symbol. Equal windows have equal symbols at equal places, so these alone need to meet.
    """
    n = len(words)
    level, name, a, b = symbols(words, by_doc, window)
    order = np.argsort(a, kind="stable")  # so that ties go by place
    level, name, a, b = level[order], name[order], a[order], b[order]
    key = (level.astype(U) << U(60)) | ((mix(name) >> U(36)) << U(32)) | np.arange(len(a), dtype=U)
    size = b - a
    best = np.zeros(n, U)
    for d in range(1, window + 1):
        if d > 1:
            best[:-1] = np.maximum(best[:-1], best[1:])  # ranges of d words from those of d - 1
        mine = np.flatnonzero(size == d)
        # At most one symbol of a level has a given range; the highest level counts.
        np.maximum.at(best, a[mine], key[mine])
    starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, e - window + 1) for s, e in zip(by_doc[:-1], by_doc[1:], strict=True) if e - s >= window)])
    mine = (best[starts] & U(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(mine, kind="stable")  # starts ascend within a symbol
    chosen, first, count = np.unique(mine[order], return_index=True, return_counts=True)
    lo, hi = a[chosen] - starts[order[first + count - 1]], a[chosen] - starts[order[first]]
    return mix(name[chosen] + size[chosen].astype(U) * U(0x9E3779B97F4A7C15)), a[chosen], b[chosen], lo * window + hi


def word_anchors(window: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 3, 1 << 18):
            words, by = word_hashes(*buffers(part.column(3)))
            fp, a, _, offsets = representatives(words, by, window)
            doc = np.searchsorted(by, a, "right") - 1
            k1 = part.column(1).to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(k1), pa.array((a - by[doc]).astype(np.int32)), pa.array(offsets.astype(np.int32))], names=["fp", "k1", "pos", "size"])

    return run


def each_window(size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset) of every window of the rows, from lo to hi in each, and where the windows of a row begin and end."""
    lo, hi = np.divmod(size, window)
    ends = np.append(0, np.cumsum(hi - lo + 1))
    row = np.repeat(np.arange(len(size)), hi - lo + 1)
    return row, np.arange(len(row)) - ends[row] + lo[row], ends


def blobs(hashes: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The hashes of each row in one binary value."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(hashes))])


def window_hashes(window: int):
    """The hashes of an anchor's windows, by offset."""

    def cut(texts, doc, pos, size):
        data, offsets = buffers(texts)
        words, by = word_hashes(data, offsets, family=1)
        hashes = gram_hashes(words, window, 0x9E3779B97F4A7C15) | U(1)  # 0 means none
        row, o, ends = each_window(size, window)
        return np.ones(len(doc), bool), [blobs(hashes[(by[doc] + pos)[row] - o], ends)]

    return cut


def later_windows(window: int):
    def judge(table: pa.Table):
        fp, k1, pos, size, salts = (table.column(c).combine_chunks().to_numpy() for c in ("fp", "k1", "pos", "size", "salts"))
        ids = table.column("doc_id").combine_chunks()
        none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        hashes = buffers(table.column("windows"))[0].view(U)
        row, o, ends = each_window(size, window)
        # Texts in order, null ids last.
        order = np.lexsort([k1, ids, none])
        new = np.append(False, (k1[order][1:] != k1[order][:-1]) | (ids[order][1:] != ids[order][:-1]) | (none[order][1:] != none[order][:-1]))
        nth = np.empty(len(order), np.int64)
        nth[order] = np.cumsum(new)
        place = (nth[row] << 32) + pos[row] - o
        # The first of each window within its name; others are removed, if they are at another place.
        key = hashes ^ mix(fp.view(U) + U(0x51ED270B))[row]
        live = np.flatnonzero(hashes)
        live = live[np.lexsort([place[live], key[live]])]
        head = np.append(True, key[live][1:] != key[live][:-1])[: len(live)]
        first = live[head]
        again = live[place[live] != place[first][np.cumsum(head) - 1]]
        rows, starts = row[again], pos[row[again]] - o[again]
        # Neighbouring windows of a row join here.
        far = int(pos.max(initial=0)) + 2 * window
        s, e = union(rows * far + starts, rows * far + starts + window)
        rows = s // far
        # Only parts of a name go on, and of them the windows that no earlier row of the part has.
        left = np.zeros_like(hashes)
        left[first] = hashes[first]
        stand = np.unique(row[first[salts[row[first]] > 1]])
        return rows, s - rows * far, e - rows * far, stand, {"windows": blobs(left, ends).take(pa.array(stand))}

    return judge


def meeting_windows(window: int):
    """Spans of the windows that are first in their part of a frequent name, but not over all its parts."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, o, _ = each_window(batch.column(4).to_numpy(), window)
            hashes = buffers(batch.column(5))[0].view(np.int64)
            some = np.flatnonzero(hashes)
            start = batch.column(3).to_numpy()[row] - o
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row[some])) for i in range(3)), pa.array(start[some]), pa.array(hashes[some])], names=["fp", "doc_id", "k1", "start", "hash"])

    def meet(rows: DataFrame) -> DataFrame:
        spread_ = rows.select("fp", "doc_id", "k1", "pos", "size", "windows").mapInArrow(spread, "fp long, doc_id long, k1 long, start long, hash long")
        place = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "start")  # null ids come last
        firsts = spread_.groupBy("fp", "hash").agg(F.min(place).alias("place"), F.count("*").alias("n")).filter("n > 1").select("fp", "hash", "place")
        again = spread_.join(firsts, ["fp", "hash"]).filter(place != F.col("place"))
        return again.select("doc_id", "k1", "start", (F.col("start") + window).alias("end"))

    return meet


def kept_words(window: int):
    def make(text: bytes, spans, earlier: bool, copied: bool) -> tuple[int, int, str]:
        words = text.split()  # bytes split at 9-13 and 32
        n = len(words)
        if earlier and n >= window:
            return n, n, hashlib.sha256(b"").hexdigest()
        removed = 0
        if spans is not None:
            kept, at = [], 0
            for s, e in zip(*union(*spans), strict=True):
                kept += words[at:s]
                removed += int(e - s)
                at = e
            words = kept + words[at:]
        return n, removed, hashlib.sha256(b" ".join(words)).hexdigest()

    return make


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    corpus = Corpus(docs, id_col, text_col)
    segments = corpus.around(corpus.meeting(word_anchors(window)), window_hashes(window), "windows binary")
    return corpus.finish(corpus.spans(segments, later_windows(window), "windows binary", meet=meeting_windows(window)), kept_words(window), "n_words long, n_removed long, kept_sha256 string")


def op7_recompression(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
