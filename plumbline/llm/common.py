"""Pieces that several operators share: tables in the shared folder, word hashes, interval unions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U = np.uint64
#: Bytes 9-13 and 32 separate words.
DELIMITER = np.zeros(256, bool)
DELIMITER[[9, 10, 11, 12, 13, 32]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the setting is absent and Spark is local (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Arrow batches while a table is stored: rows hold texts and sets, and several batches are in memory at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """BATCHES hold inside; what the session had before holds again afterwards."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and rereads it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}/{name}"
    schema = df.schema
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Shelf:
    """The stored tables of one computation. Those that nothing reads any more are dropped when their readers are stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        table, path = stored(df, name)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        gone = [path for t, path in self.tables if any(t is x for x in tables)]
        self.tables = [(t, path) for t, path in self.tables if path not in gone]
        forget(self.spark, *gone)

    def keep(self, *tables: DataFrame | None) -> None:
        """Drops all others."""
        self.drop(*(t for t, _ in self.tables if not any(t is x for x in tables)))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them as long as a column has such a name (Spark doesn't tell case apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) with null texts as empty ones; other columns stay behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def table_of(seed: int, fold_case: bool = False) -> np.ndarray:
    """256 random-looking values, one for each byte; A-Z share those of a-z if fold_case."""
    t = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 2 + 1))
    if fold_case:
        t[65:91] = t[97:123]
    return t


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def tidy() -> None:
    """Gives free memory of a Python worker back to the system: workers wait for further tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose string column holds about `most` bytes each, so that arrays made from it stay small."""
    text = batch.column(column)
    o = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(o, int(o[at]) + most, "right")) - 1)
        yield batch.slice(at, min(end, len(text)) - at)
        at = end
    tidy()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, base, U), np.full(n, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
    return have


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of values[s:e] for each range, then mixed with its length."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def gram_hashes(values: np.ndarray, n: int, base: int) -> np.ndarray:
    """range_hash of every run of n values."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    out = total[n:] - total[: max(len(total) - n, 0)]
    out *= down[: len(out)]
    out += U(n * 0x9E3779B97F4A7C15 % (1 << 64))
    return mix(out)


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by document): the words of each document as byte ranges."""
    inside = ~DELIMITER[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[edge] = inside[edge]
        edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Two independent families of word hashes.
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


def word_hashes(data: np.ndarray, offsets: np.ndarray, family: int = 0, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, word offsets by document)."""
    starts, ends, by_doc = word_ranges(data, offsets)
    return range_hash(table_of(family, fold_case)[data], starts, ends, BASES[family]), by_doc


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that a set of half-open ranges covers; touching ranges join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1]


#: Bits of a bitmap at most (8 MB), so it may be broadcast whatever the input; fewer if there are few values.
BITS = 1 << 26


def bits_for(values: int, most: int | None = None) -> int:
    """Bits of a bitmap for so many values: 64 a value (a power of two), until `most` is reached."""
    most = most or BITS
    return min(most, max(64, 1 << (64 * max(values, 1) - 1).bit_length()))


def bit_words(values: DataFrame, column: str, bits: int | None = None) -> DataFrame:
    """A bitmap as rows (word, mask, bits), at most bits / 64: bit `column mod bits` of each value is set.

    A set bit means "perhaps among the values", a clear one "certainly not". Counts the values first.
    """
    bits = bits or bits_for(values.count())
    at = F.pmod(F.col(column), F.lit(bits))
    words = values.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word"))
    return words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"), F.lit(bits).cast("long").alias("bits"))


def flagged(rows: DataFrame, column: str, words: DataFrame, name: str = "perhaps") -> DataFrame:
    """rows with `name`: whether the bit of the column is set in a stored bitmap of bit_words, by a join with its rows."""
    first = words.select("bits").first()
    if first is None:
        return rows.withColumn(name, F.lit(False))
    word, mask, at = fresh(rows.columns, "_word", "_mask", "_at")
    words = words.select(F.col("word").alias(word), F.col("mask").alias(mask))
    rows = rows.withColumn(at, F.pmod(F.col(column), F.lit(first.bits)))
    told = rows.join(F.broadcast(words), F.expr(f"{at} div 64 = {word}"), "left")
    return told.withColumn(name, F.expr(f"coalesce(shiftrightunsigned({mask}, cast({at} % 64 as int)) & 1 = 1, false)")).drop(at, word, mask)


#: One document in SAMPLE tells which keys are hot; at most HOT_KEYS of them are broadcast.
SAMPLE, HOT_KEYS = 64, 10_000


def repeated(rows: DataFrame, sample: DataFrame, key: str, deal: list[str], group_rows: int = 20_000, share: int = SAMPLE) -> DataFrame:
    """The rows whose key another row has too, with `n`: how many rows have it. Rows are shuffled once, by their key.

    sample: the rows of one document in `share`. Keys that it shows to have more than group_rows rows are dealt by the
    columns `deal` too, so that no task gets all of their rows; their n is an estimate. Other keys go to one task each,
    so the list of hot keys may end anywhere.
    """
    hot = sample.groupBy(key).agg((F.count("*") * share).alias("_n")).filter(f"_n > {group_rows} and _n > {share}")
    hot = hot.orderBy(F.desc("_n"), key).limit(HOT_KEYS).select(F.col(key).alias("_key"), "_n")
    told = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    told = told.withColumn("_salt", F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64(*deal), F.ceil(F.col("_n") / group_rows))))
    counted = told.withColumn("n", F.coalesce("_n", F.count("*").over(Window.partitionBy(key, "_salt"))))
    return counted.filter("n > 1").drop("_key", "_n", "_salt")


def bitmap(values: DataFrame, column: str, bits: int | None = None) -> bytes:
    """The same bitmap in one piece, for tests inside Python tasks. values: a stored table, since it is read twice."""
    bits = bits or bits_for(values.count())
    words = bit_words(values, column, bits).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out.tobytes()


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each int64 value's bit is set; bits: np.frombuffer(bitmap(...), np.uint64)."""
    at = np.mod(values.astype(np.int64), len(bits) * 64).astype(U)
    return (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than the default, for results that are read after an operator returns: rows that hold
    texts are large. A session that has set its own number keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)
