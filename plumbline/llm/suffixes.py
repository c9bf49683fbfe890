"""Removal of repeated byte strings by induced sorting of sampled suffixes.

A suffix array of all bytes would take many times the corpus on disk, so only suffixes that can matter are sorted. In
every string of `length` bytes the smallest hash among its `GRAM`-byte substrings marks an anchor (equal strings mark
equal places); anchors whose hash occurs once are dropped, and the suffixes at the others meet by hash, each with the
bytes before it. A shard first orders its suffixes by their bytes, with the common prefix of neighbours. Then comes the
induction: the order of the suffixes that start one byte earlier follows from pushing (preceding byte, suffix, common
prefix) in the present order into a priority queue by byte and popping it; the common prefix grows by one or falls to
the minimum in between. After o steps, neighbours with `length` bytes in common are equal strings that start o bytes
before their anchors. Suffixes that can't reach `length` any more leave the queue.

Shards are small and in memory, not external: some 20,000 suffixes of at most 327 bytes (7 MB), and there is one level of
induction. The suffixes at a frequent anchor are first sorted in parts, and what is left of them is split, where it is
still too much, by the bytes that all strings of a range of offsets share; halving the range ends with single offsets,
at which equal bytes are equal strings and nothing is left to sort.

Long periodic stretches (runs of one byte, rules, repeated lines of up to 128 bytes) repeat themselves, so they are
removed as intervals, and only the strings of their first period take part in the sorting. Texts of more than 4 MB are
taken in pieces that overlap by a string.

Nulls and texts of fewer than `length` bytes lose nothing. Documents with equal texts are folded: each loses everything.
Rows that repeat an id with another text are documents of their own; a row repeated wholly counts as a copy. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BASES, U, buffers, gram_hashes, mix, slices, table_of, union
from plumbline.llm.repeats import Corpus

LENGTH, GRAM = 200, 73
#: Bits of an anchor's key that hold its place in a slice; slices are at most SLICE bytes and a string.
PLACE, SLICE = U(27), 1 << 22


def reached(data: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The maximal stretch of data[low:high] around data[at:at + period] in which bytes a period apart are equal."""
    end, step = at + period, 1024
    while end < high:
        n = min(step, high - end)
        differ = data[end : end + n] != data[end - period : end - period + n]
        k = int(differ.argmax())
        if differ[k]:
            end += k
            break
        end, step = end + n, step * 2
    start, step = at, 1024
    while start > low:
        n = min(step, start - low)
        differ = (data[start - n : start] != data[start - n + period : start + period])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            start -= k
            break
        start, step = start - n, step * 2
    return start, end


def stretches(data: np.ndarray, bounds: np.ndarray, at: np.ndarray, h: np.ndarray, length: int) -> np.ndarray:
    """(start, end, period) of long periodic stretches inside texts: anchors of one hash a constant distance apart tell them.

    In a stretch of length + 2 * period bytes or more, every string of `length` bytes starts at two places.
    """
    gap = np.diff(at)
    if not len(gap):
        return np.zeros((0, 3), np.int64)
    same = (h[at[1:]] == h[at[:-1]]) & (gap <= length)
    new = np.append(True, (gap[1:] != gap[:-1]) | ~same[1:] | ~same[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(gap))
    found, done = [], 0
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        p = int(gap[i])
        if same[i] and p * (j - i) >= 2 * length and at[i] >= done:
            text = int(np.searchsorted(bounds, at[i], "right")) - 1
            start, end = reached(data, int(at[i]), p, int(bounds[text]), int(bounds[text + 1]))
            if end - start >= length + 2 * p:
                found.append((start, end, p))
                done = end - length
    return np.array(found, np.int64).reshape(-1, 3)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes of all grams, periodic stretches) of some texts.

    Of a periodic stretch only the strings that start in its first period or leave it at its end keep their anchors: all
    others equal one in the first period, so the cost of a stretch doesn't grow with its length.
    """
    reach = length - gram + 1  # grams in a string
    h = gram_hashes(table_of(0)[data], gram, BASES[0])
    low = ((h >> PLACE) << PLACE) | np.arange(len(h), dtype=U)
    covered = 1
    while covered < reach:
        step = min(covered, reach - covered)
        np.minimum(low[:-step], low[step:], out=low[:-step])
        covered += step
    starts = np.zeros(len(data) + 1, np.int64)
    long = np.diff(offsets) >= length
    np.add.at(starts, offsets[:-1][long], 1)
    np.add.at(starts, offsets[1:][long] - length + 1, -1)
    inside = np.cumsum(starts)[: len(low)] > 0
    places = lambda: np.unique(low[np.flatnonzero(inside)] & U((1 << int(PLACE)) - 1)).astype(np.int64)
    at = places()
    periodic = stretches(data, offsets, at, h, length)
    for start, end, period in periodic.tolist():
        inside[start + period : end - length + 1] = False
    return places() if len(periodic) else at, h, periodic


def byte_anchors(length: int, gram: int):
    """(fp, k1, pos, size) of the smallest gram of every string of `length` bytes.

    A periodic stretch is a pair of rows with a hash of their own and the stretch's length, negated, as size.
    """

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(bytes, offsets of texts, their keys, place in the text) of slices; long texts overlap by a string."""
        for part in slices(batch, 3):
            data, offsets = buffers(part.column(3))
            k1 = part.column(1).to_numpy()
            if len(data) <= SLICE or len(offsets) > 2:
                yield data, offsets, k1, 0
                continue
            for start in range(0, len(data) - length + 1, SLICE):
                piece = data[start : start + SLICE + length - 1]
                yield piece, np.array([0, len(piece)]), k1, start

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for data, offsets, k1, start in parts(batch):
            if len(data) < length:
                continue
            at, h, periodic = anchors(data, offsets, length, gram)
            doc = np.searchsorted(offsets, at, "right") - 1
            of = np.searchsorted(offsets, periodic[:, 0], "right") - 1
            pos, stretch = at - offsets[doc] + start, periodic[:, 0] - offsets[of] + start
            size = periodic[:, 1] - periodic[:, 0]
            own = mix(mix(k1[of].view(U) + stretch.view(U)) + size.view(U)).view(np.int64)
            columns = (h[at].view(np.int64), own, own), (k1[doc], k1[of], k1[of]), (pos, stretch, stretch), (np.full(len(at), gram), -size, -size)
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=True)], names=["fp", "k1", "pos", "size"])

    return run


def surroundings(length: int, gram: int):
    """The bytes around an anchor that its strings can hold, and how many of them come before it."""

    def cut(texts, doc, pos, size):
        data, offsets = buffers(texts)
        at = offsets[doc] + pos
        a, b = np.maximum(at - (length - gram), offsets[doc]), np.minimum(at + length, offsets[doc + 1])
        b = np.where(size < 0, a, b)  # a periodic stretch needs none
        raw = memoryview(data)
        ok = (pos >= 0) & (at + gram <= offsets[doc + 1])
        rows = [bytes(raw[x:y]) for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True)]
        return ok, [pa.array(rows, pa.binary()), pa.array((at - a)[ok], pa.int64())]

    return cut


class ByteQueue:
    """A priority queue by one byte for rows that are pushed in the order of their suffixes.

    Rows of a byte come out in the order in which they went in, so each byte has a first-in first-out run. Beyond `room`
    rows the runs go to a file.
    """

    def __init__(self, room: int = 8_000_000):
        self.room, self.held, self.file = room, 0, None
        self.runs: list[list] = [[] for _ in range(256)]

    def push(self, byte: np.ndarray, row: np.ndarray, common: np.ndarray) -> None:
        order = np.argsort(byte, kind="stable")
        bounds = np.searchsorted(byte[order], np.arange(257))
        row, common = row[order], common[order]
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            self.runs[c].append((row[bounds[c] : bounds[c + 1]], common[bounds[c] : bounds[c + 1]]))
        self.held += len(row)
        if self.held > self.room:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, os.SEEK_END)
        for run in self.runs:
            for i, part in enumerate(run):
                if isinstance(part[0], np.ndarray):
                    place = self.file.tell()
                    part[0].tofile(self.file)
                    part[1].tofile(self.file)
                    run[i] = (place, len(part[0]))
        self.held = 0

    def pop(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs by byte; each byte's first common prefix is 0."""
        for run in self.runs:
            first = True
            for part in run:
                if not isinstance(part[0], np.ndarray):
                    self.file.seek(part[0])
                    part = np.fromfile(self.file, np.int64, part[1]), np.fromfile(self.file, np.int64, part[1])
                if first:
                    part[1][0] = 0
                    first = False
                yield part
        if self.file:
            self.file.close()


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[l:h]) for each pair l < h."""
    out = np.empty(len(low), values.dtype)
    width = high - low
    level, table = 0, values
    while True:
        mine = np.flatnonzero((width >> level) == 1)
        if len(mine):
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << level)])
        if not len(width) or (1 << (level + 1)) > width.max():
            return out
        step = 1 << level
        table = np.minimum(table[:-step], table[step:])
        level += 1


def bytes_matrix(rows: list[bytes], width: int, on_disk: int = 1_000_000) -> np.ndarray:
    """The byte strings as rows, filled up with zeros; a file on disk holds them if there are many."""
    shape = (len(rows), width)
    if len(rows) > on_disk:
        out = np.memmap(tempfile.TemporaryFile(), np.uint8, "w+", shape=shape)
    else:
        out = np.zeros(shape, np.uint8)
    for start in range(0, len(rows), 65536):
        part = rows[start : start + 65536]
        out[start : start + len(part)] = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in part), np.uint8).reshape(-1, width)
    return out


def induced(before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For o = 0, 1, ...: (o, rows in suffix order, common prefixes with the row before), for the suffixes that start o
    bytes before the anchors. before: bytes before the anchor, last first."""
    row = np.argsort(np.ascontiguousarray(after).view(f"S{length}").ravel(), kind="stable")
    common = np.zeros(len(row), np.int64)
    for start in range(1, len(row), 65536):
        x, y = row[start - 1 : start + 65535], row[start : start + 65536]
        x = x[: len(y)]
        differ = after[x] != after[y]
        equal = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        common[start : start + len(y)] = np.minimum(equal, np.minimum(n_after[x], n_after[y]))
    for o in range(length - gram + 1):
        # Common prefixes that can't grow to the length any more separate; what stands alone leaves.
        common[common < gram + o] = 0
        alive = common > 0
        alive[:-1] |= common[1:] > 0
        row, common = row[alive], common[alive]
        if not len(row):
            return
        yield o, row, common
        if o == length - gram:
            return
        # Rows with no further byte before them leave; the prefix to their successor is the least on the way.
        has = n_before[row] > o
        rank = np.flatnonzero(has)
        if not len(rank):
            return
        byte = np.asarray(before[row[rank], o])
        block = np.cumsum(common == 0)
        order = np.argsort(byte, kind="stable")
        ranks = rank[order]
        grown = np.zeros(len(ranks), np.int64)
        x, y = ranks[:-1], ranks[1:]
        same = np.flatnonzero((byte[order][1:] == byte[order][:-1]) & (y > x) & (block[y] == block[x]))
        grown[same + 1] = range_min(common, x[same] + 1, y[same] + 1) + 1
        by_rank = np.empty(len(rank), np.int64)
        by_rank[order] = grown
        queue = ByteQueue()
        for start in range(0, len(rank), 1 << 20):
            end = start + (1 << 20)
            queue.push(byte[start:end], row[rank[start:end]], by_rank[start:end])
        parts = list(queue.pop())
        row, common = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def equal_strings(length: int, gram: int):
    reach = length - gram + 1

    def judge(table: pa.Table):
        pos, size, n_before = (table.column(c).combine_chunks().to_numpy() for c in ("pos", "size", "n_before"))
        around = table.column("around").to_pylist()
        n = len(around)
        cuts = n_before.tolist()
        n_after = np.array([len(r) - k for r, k in zip(around, cuts, strict=True)])
        before = bytes_matrix([r[:k][::-1] for r, k in zip(around, cuts, strict=True)], length - gram)
        after = bytes_matrix([r[k:] for r, k in zip(around, cuts, strict=True)], length)
        found, later = np.zeros((n, reach), bool), np.zeros(n, np.int64)
        for o, row, common in induced(before, n_before, after, n_after, length, gram):
            again = common >= length
            later[row[again]] += 1
            found[row[again], o] = True
            found[row[np.flatnonzero(again) - 1], o] = True
        # Strings of a row: those that have o bytes before the anchor and the rest behind it.
        strings = np.maximum(np.minimum(n_before, length - gram) - np.maximum(length - n_after, 0) + 1, 0)
        row, o = np.nonzero(found)
        stretch = np.flatnonzero(size < 0)
        starts, ends = np.append(pos[row] - o, pos[stretch]), np.append(pos[row] - o + length, pos[stretch] - size[stretch])
        row = np.append(row, stretch)
        far = int(ends.max(initial=0)) + 2 * length
        s, e = union(row * far + starts, row * far + ends)
        rows = s // far
        return rows, s - rows * far, e - rows * far, np.flatnonzero(later < strings), {}

    return judge


def halved(length: int, gram: int):
    """Rows by halves of their range of offsets, with a hash of the bytes that all strings of the half share.

    Strings start lo to hi bytes before the anchor, so they share lo bytes before it and length - hi from it on. Rows
    that hold no such bytes hold no such string.
    """

    def split(rows: DataFrame) -> DataFrame:
        lo, hi = F.coalesce("lo", F.lit(0)), F.coalesce("hi", F.lit(length - gram))
        mid = F.floor((lo + hi) / 2).cast("int")
        halves = F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), hi.alias("hi")))
        parts = rows.withColumn("half", F.explode(halves)).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi"), "window": F.lit(length).cast("long")}).drop("half")
        parts = parts.filter(f"n_before >= lo and length(around) - n_before >= {length} - hi")
        return parts.withColumn("key", F.expr(f"xxhash64(substring(around, cast(n_before - lo + 1 as int), {length} - hi + lo))"))

    return split


def kept_bytes(length: int):
    def make(text: bytes, spans, earlier: bool, copied: bool) -> tuple[int, int, int, str]:
        n = len(text)
        if copied and n >= length:
            return n, n, 1, hashlib.sha256(b"").hexdigest()
        if spans is None:
            return n, 0, 0, hashlib.sha256(text).hexdigest()
        starts, ends = union(*spans)
        kept, at = hashlib.sha256(), 0
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            kept.update(text[at:s])
            at = e
        kept.update(text[at:])
        return n, int((ends - starts).sum()), len(starts), kept.hexdigest()

    return make


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    corpus = Corpus(docs, id_col, text_col)
    extra = "around binary, n_before long"
    segments = corpus.around(corpus.meeting(byte_anchors(length, gram)), surroundings(length, gram), extra)
    return corpus.finish(corpus.spans(segments, equal_strings(length, gram), extra, halved(length, gram)), kept_bytes(length), "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_induced_sorting(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
