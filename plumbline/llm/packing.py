"""Packing of token sequences by a configuration linear program over the length histogram.

A configuration says how many pieces of each length share one sequence. The program covers the histogram by fractions of
configurations with as few sequences as possible. It is solved by multiplicative weights: prices of lengths start at
their share of a sequence; a knapsack dynamic program over the capacity finds, for each length, the best-priced
configuration that holds it; lengths that are behind take theirs until every length is covered by one more share of its count; prices
of lengths fall with the exponential of what covers them ahead of time. Each round's prices, divided by the best configuration's,
bound the number of sequences from below. Rounding keeps the whole part of each configuration, then solves the program
again for what is left, as long as that places much of it; the remaining pieces, fewer than there are configurations, go
to where they fit best.

The histogram has at most `capacity` lengths, whatever the number of pieces; only it and the plan (some thousand
configurations, with how often each is used) are on the driver. Pieces of one length are interchangeable, so they are
numbered by task: each knows its place among its task's pieces of its length, counts by task and length are summed up
in order, and the plan tells the sequence and offset of each number. A length that holds most pieces is spread over all
tasks.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Shelf

CAPACITY, END = 1024, 2
Config = tuple[tuple[int, int], ...]  # (length, how many), longest first


def knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best value, length taken last) for each capacity; price[l] is that of length l, 0 where it isn't on offer."""
    best, last = np.zeros(len(price)), np.zeros(len(price), np.int64)
    for w in range(1, len(price)):
        values = price[1 : w + 1] + best[w - 1 :: -1]
        at = int(values.argmax())
        best[w], last[w] = values[at], at + 1
    return best, last


def through(length: int, last: np.ndarray, price: np.ndarray) -> Config:
    """The best configuration that holds the length."""
    found, room = {length: 1}, len(last) - 1 - length
    while room > 0:
        one = int(last[room])
        if price[one] > 0:
            found[one] = found.get(one, 0) + 1
        room -= one
    return tuple(sorted(found.items(), reverse=True))


def fractional(counts: np.ndarray, rounds: int, step: float) -> tuple[dict[Config, float], float]:
    """(fractions of configurations that cover the counts, lower bound of the number of sequences) by multiplicative weights."""
    lengths = np.flatnonzero(counts)
    capacity = len(counts) - 1
    price = np.zeros(len(counts))
    price[lengths] = lengths / capacity
    total: dict[Config, float] = {}
    covered = np.zeros(len(counts))
    bound = float(-(-int(counts @ np.arange(len(counts))) // capacity))
    for t in range(1, rounds + 1):
        best, last = knapsack(price)
        bound = max(bound, float(counts @ price / best[capacity]))
        for one in lengths[::-1].tolist():
            need = counts[one] * t / rounds - covered[one]
            if need > 1e-9 * counts[one]:
                config = through(one, last, price)
                times = need / dict(config)[one]
                for length, n in config:
                    covered[length] += n * times
                total[config] = total.get(config, 0.0) + times
        ahead = covered[lengths] / counts[lengths] * rounds - t
        price[lengths] = lengths / capacity * np.exp(-step * ahead)
    return total, bound


def fitted(counts: np.ndarray, plan: dict[Config, int]) -> dict[Config, int]:
    """The plan with the counted pieces in, longest first, each where it leaves the least room; new sequences where none has room."""
    capacity = len(counts) - 1
    room: list[dict[Config, int]] = [{} for _ in range(capacity + 1)]
    for config, times in plan.items():
        room[capacity - sum(length * n for length, n in config)][config] = times
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            free = next((w for w in range(length, capacity + 1) if room[w]), None)
            if free is None:
                held = min(left, capacity // length)
                config, times = ((length, held),), left // held
                room[capacity - held * length][config] = room[capacity - held * length].get(config, 0) + times
                left -= times * held
            else:
                config, there = next(iter(room[free].items()))
                times = min(left, there)
                room[free][config] -= times
                if times == there:
                    del room[free][config]
                grown = dict(config)
                grown[length] = grown.get(length, 0) + 1
                more = tuple(sorted(grown.items(), reverse=True))
                room[free - length][more] = room[free - length].get(more, 0) + times
                left -= times
    return {config: times for group in room for config, times in group.items()}


def planned(counts: np.ndarray, rounds: int = 60, step: float = 0.001, least: float = 0.05) -> tuple[dict[Config, int], float]:
    """(how often each configuration is used, lower bound) for counts[length] pieces of each length; all pieces are placed."""
    left, plan, bound = counts.astype(np.int64), {}, 0.0
    while left.any():
        fractions, low = fractional(left, rounds, step)
        bound = bound or low
        placed = 0
        for config, x in sorted(fractions.items(), key=lambda c: (-c[1], c[0])):
            times = min(int(x), *(int(left[length]) // n for length, n in config))
            if times > 0:
                plan[config] = plan.get(config, 0) + times
                for length, n in config:
                    left[length] -= n * times
                placed += times
        if placed < least * low:
            break
    return fitted(left, plan), bound


class Encoder:
    """Token ids of texts by the vocabulary file; built once a task.

    tokenizers' own merges take 1.5 MB/s, so the same vocabulary as ranks is read by tiktoken, whose ids are equal (the
    tests compare them, and every code point has been compared). Where its pattern fails, as on very long white space,
    tokenizers encodes the text.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken

        self.path, self.slow = path, None
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = {"<|endoftext|>": len(table)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=self.special)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=set(self.special))
        except ValueError:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def default_encoder() -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be shorter, the others fill a sequence."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def pieces(docs: DataFrame, encoder=default_encoder, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, number): number counts the task's pieces of this length."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"
    names = [part.split()[0] for part in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(), np.zeros(capacity + 1, np.int64).tolist()
        task = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode.ids(text.as_buffer().to_pybytes().decode("utf-8", "replace") if text.is_valid else ""), end).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(rows, schema)


@dataclass
class Slots:
    """Where the pieces of each length go: its numbers from `first` on, `each` to a sequence from number `sequence` on."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    key: np.ndarray

    @classmethod
    def of(cls, plan: dict[Config, int]) -> Slots:
        rows, sequence, numbered = [], 0, {}
        for config, times in sorted(plan.items(), reverse=True):
            offset = 0
            for length, n in config:
                first = numbered.get(length, 0)
                rows.append((length, first, n, sequence, offset))
                numbered[length] = first + n * times
                offset += n * length
            sequence += times
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5).T
        return cls(*table, table[0] * (1 << 44) + table[1])

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these numbers among all of their length."""
        at = np.searchsorted(self.key, length * (1 << 44) + number, "right") - 1
        turn, slot = np.divmod(number - self.first[at], self.each[at])
        return self.sequence[at] + turn, self.offset[at] + slot * length


def packed(docs: DataFrame, encoder=default_encoder, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Null and empty texts are their end token alone. Rows are packed one by one, whatever their ids, null or repeated.
    Extra columns are ignored. An empty table gives no rows. Bytes that are no UTF-8 become replacement characters.
    """
    shelf = Shelf(docs.sparkSession)
    table = shelf.put(pieces(docs, encoder, capacity, end), "pieces")
    by_task = table.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    slots = Slots.of(planned(counts)[0])
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = table.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("number"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = slots.place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, at)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return numbered.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of at most 1,024 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
