"""What the two substring operators share: folding equal texts, finding dealt anchors, and joining spans to their texts.

Both mark, in every text, some content-determined anchors such that equal windows hold equal anchors at equal places.
Anchors are shuffled by fingerprint once and those that occur once are dropped; the rest bring along what lies around
them, meet by fingerprint, and tell which windows recur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SAMPLE, Shelf, U, bit_words, flagged, mix, repeated, text_batches, tidy, whole_texts


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, k1, k2): k1 and k2 are two hashes of the text."""
    return whole_texts(docs, id_col, text_col).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def deflated(texts: pa.Array) -> pa.Array:
    squeeze = zstandard.ZstdCompressor(3).compress
    return pa.array([squeeze(t.as_buffer()) for t in texts], pa.binary())


def packed(rows: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text) with the text compressed, before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], deflated(b.column(3))], names=["doc_id", "k1", "k2", "ztext"])

    return rows.select("doc_id", "k1", "k2", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, ztext binary")


def inflated(texts: pa.Array) -> pa.Array:
    d = zstandard.ZstdDecompressor()
    return pa.array([d.decompress(t.as_buffer()) for t in texts], pa.large_binary())


#: Bytes of texts, and hits in them, that are worked on together; a longer text is alone.
TEXTS, HITS = 1 << 20, 100_000


def by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most TEXTS bytes of unpacked text."""
    sizes = [zstandard.frame_content_size(z.as_buffer().to_pybytes()[:18]) for z in batch.column("ztext")]
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > TEXTS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


class Corpus:
    """Documents with equal texts folded: `copies` has (k1, k2, first, n) of each text that occurs more than once."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        text_batches(docs.sparkSession)
        self.rows = keyed(docs, id_col, text_col)
        groups = self.rows.select("doc_id", "k1", "k2").groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        self.shelf = Shelf(docs.sparkSession)
        self.copies = self.shelf.put(groups.filter("n > 1"), "copies")
        self.words = self.shelf.put(bit_words(self.copies, "k1"), "bits")

    def distinct(self, sample: bool = False) -> DataFrame:
        """(doc_id, k1, k2, text), one row of each text, or of one text in SAMPLE. Only texts that may have copies are shuffled."""
        rows = self.rows.filter(F.pmod("k1", F.lit(SAMPLE)) == 0) if sample else self.rows
        told = flagged(rows, "k1", self.words)
        once = told.filter("not perhaps").select("doc_id", "k1", "k2", "text")
        firsts = told.filter("perhaps").join(self.copies, ["k1", "k2"], "left").filter("first is null or doc_id <=> first")
        return once.unionByName(firsts.dropDuplicates(["k1", "k2"]).select("doc_id", "k1", "k2", "text"))

    def meeting(self, anchors: Callable, group_rows: int = 20_000) -> DataFrame:
        """(k1, hits array<struct<fp, pos, size, salts>>): the anchors that occur more than once, by text.

        anchors(batch) yields (fp, k1, pos, size) record batches of a (doc_id, k1, k2, text) batch. Ids don't tell texts
        apart: they may repeat with other texts, or be null.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from anchors(batch)

        found, sample = (self.distinct(part).mapInArrow(run, "fp long, k1 long, pos int, size int") for part in (False, True))
        salts = F.ceil(F.col("n") / group_rows).cast("int").alias("salts")
        told = repeated(found, sample, "fp", ["k1", "pos"], group_rows)
        # A document's list is at most as long as its text.
        return told.groupBy("k1").agg(F.collect_list(F.struct("fp", "pos", "size", salts)).alias("hits"))

    def around(self, hits: DataFrame, cut: Callable, extra: str) -> DataFrame:
        """cut(bytes of a text, hits) -> columns after (fp, salt, salts, doc_id, k1, pos, size), given as DDL in extra."""
        names = ["fp", "salt", "salts", "doc_id", "k1", "pos", "size", *(c.split()[0] for c in extra.split(", "))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in by_size(whole):
                    texts = inflated(batch.column("ztext"))
                    hit = batch.column("hits")
                    each = np.diff(np.asarray(hit.offsets))
                    flat = hit.flatten()
                    every = np.repeat(np.arange(batch.num_rows), each)
                    for at in range(0, len(every), HITS):
                        part, doc = flat.slice(at, HITS), every[at : at + HITS]
                        get = lambda n, part=part: part.field(n).to_numpy(zero_copy_only=False)
                        pos, size, fp, salts = get("pos").astype(np.int64), get("size").astype(np.int64), get("fp"), get("salts")
                        k1 = batch.column("k1").to_numpy()[doc]
                        keep, columns = cut(texts, doc, pos, size)
                        salt = (mix(k1.view(U) + pos.view(U)) % salts.astype(U)).astype(np.int64)
                        ids = batch.column("doc_id").take(pa.array(doc[keep]))
                        fp, salt, salts, k1, pos, size = (pa.array(x[keep]) for x in (fp, salt, salts, k1, pos, size))
                        yield pa.RecordBatch.from_arrays([fp, salt, salts, ids, k1, pos, size, *columns], names=names)
                tidy()

        return packed(self.distinct()).drop("k2").join(hits, "k1").select("doc_id", "k1", "ztext", "hits").mapInArrow(run, f"fp long, salt long, salts int, doc_id long, k1 long, pos long, size long, {extra}")

    def spans(self, segments: DataFrame, judge: Callable, extra: str, split: Callable | None = None, meet: Callable | None = None, group_rows: int = 20_000) -> DataFrame:
        """Spans (doc_id, k1, start, end) of all windows that recur.

        judge(rows of whole groups, as a table) -> (rows, starts, ends of spans; rows of parted groups that stand for
        their windows, others needn't be left out; columns of `extra` that they carry on in place of their own). Groups
        of many rows are judged in parts, by salt; then those that stand for the windows of their part meet: meet(rows)
        -> their spans, by the windows themselves. Without `meet` they are judged by group again; if they are more than
        group_rows, they are first split by what the windows have in common: split(rows with the range lo..hi of
        offsets) -> the rows with parts of the range and a key each.
        """
        names = ["fp", "salts", "doc_id", "k1", "pos", "size", *(c.split()[0] for c in extra.split(", "))]
        ddl = f"fp long, salts int, doc_id long, k1 long, pos long, size long, {extra}, start long, end long"
        by = ["fp"]

        def level(last: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for table in whole_groups(batches, by if last else ["fp", "salt"], apart=2 if last and len(by) > 1 else 0):
                    rows, starts, ends, stand, carried = judge(table)
                    at = np.concatenate([rows, stand]) if not last else rows
                    none = len(at) - len(rows)
                    arrays = [table.column(n).combine_chunks().take(pa.array(at)) for n in names]
                    if last or carried or none < len(at):  # spans carry no context along
                        wide = range(6, len(names))
                        for i in wide:
                            own = arrays[i].slice(len(rows))
                            arrays[i] = pa.concat_arrays([pa.nulls(len(rows), arrays[i].type), own if last else carried.get(names[i], own)])
                    bounds = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(none, pa.int64())]) for x in (starts, ends)]
                    yield pa.RecordBatch.from_arrays([*arrays, *bounds], names=[*names, "start", "end"])
                    tidy()

            return run

        columns = ["fp", "salt", "salts", "doc_id", "k1", "pos", "size", *names[6:]]
        first = segments.select(columns).repartition("fp", "salt").sortWithinPartitions("fp", "salt").mapInArrow(level(False), ddl)
        shelf = Shelf(segments.sparkSession)
        first = shelf.put(first.filter("start is not null or salts > 1"), "judged")
        rest = first.filter("start is null").withColumn("salt", F.lit(0).cast("long")).select(columns)
        out = ["doc_id", "k1", "start", "end"]
        found = [first.filter("start is not null").select(out)]
        if meet:
            spans = self.shelf.put(found[0].unionByName(meet(rest).select(out)), "spans")
            shelf.keep()
            return spans
        if split:
            hot = shelf.put(rest.groupBy("fp").agg(F.count("*").alias("m")).filter(F.col("m") > group_rows).select("fp"), "hot")
            if not hot.isEmpty():
                by = ["lo", "hi", "fp", "key"]
                cold = [rest.join(hot, "fp", "left_anti").withColumns({"lo": F.lit(None).cast("int"), "hi": F.lit(None).cast("int"), "key": F.lit(0).cast("long")})]
                parts = rest.join(hot, "fp", "left_semi").withColumns({"lo": F.lit(None).cast("int"), "hi": F.lit(None).cast("int")})
                while parts is not None:
                    parts = shelf.put(split(parts), "parts")
                    sizes = shelf.put(parts.groupBy(by).agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
                    met = shelf.put(parts.join(sizes, by), "met")
                    shelf.drop(parts, sizes)
                    # Rows that meet by one offset alone have the whole window in common.
                    found.append(met.filter("lo = hi").select("doc_id", "k1", (F.col("pos") - F.col("lo")).alias("start"), (F.col("pos") - F.col("lo") + F.col("window")).alias("end")))
                    cold.append(met.filter((F.col("lo") < F.col("hi")) & (F.col("m") <= group_rows)).select(*columns, "lo", "hi", "key"))
                    larger = met.filter((F.col("lo") < F.col("hi")) & (F.col("m") > group_rows))
                    parts = None if larger.isEmpty() else larger.select(*columns, "lo", "hi")
                rest = cold[0].select(*columns, "lo", "hi", "key")
                for part in cold[1:]:
                    rest = rest.unionByName(part)
        second = rest.repartition(*by).sortWithinPartitions(*by).mapInArrow(level(True), ddl)
        found.append(second.select(out))
        every = found[0]
        for part in found[1:]:
            every = every.unionByName(part)
        spans = self.shelf.put(every, "spans")
        shelf.keep()
        return spans

    def finish(self, spans: DataFrame, make: Callable, outputs: str) -> DataFrame:
        """make(text bytes, spans or None, has an earlier copy, has any copy) -> the output columns, for every row.

        Only texts with spans or copies are shuffled, with the spans of a text beside it.
        """
        per_text = spans.groupBy("doc_id", "k1").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        either = self.shelf.put(self.copies.select("k1").unionByName(spans.select("k1").distinct()), "either")
        words = self.shelf.put(bit_words(either, "k1"), "bits")
        told = flagged(self.rows, "k1", words)
        self.shelf.keep(self.copies, spans, words)
        names = ["doc_id", *(c.split()[0] for c in outputs.split(", "))]

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [make(t.as_buffer().to_pybytes(), None, False, False) for t in batch.column(1)]
                if made:
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*made, strict=True))], names=names)

        def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            inflate = zstandard.ZstdDecompressor().decompress
            for batch in batches:
                made = []
                for i, z, found, first, n in zip(*(batch.column(c) for c in ("doc_id", "ztext", "spans", "first", "n")), strict=True):
                    pairs = None
                    if found.is_valid:
                        flat = found.values
                        pairs = tuple(flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
                    copied = n.is_valid and n.as_py() > 1  # first is null if all copies have null ids
                    made.append(make(inflate(z.as_buffer()), pairs, copied and first.as_py() != i.as_py(), copied))
                if made:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*made, strict=True))], names=names)

        ddl = f"doc_id long, {outputs}"
        once = told.filter("not perhaps").select("doc_id", "text").mapInArrow(plain, ddl)
        per_text = per_text.withColumnsRenamed({"doc_id": "_id", "k1": "_k1"})
        joined = packed(told.filter("perhaps")).join(self.copies, ["k1", "k2"], "left").join(per_text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_k1")), "left")
        return once.unionByName(joined.select("doc_id", "ztext", "spans", "first", "n").mapInArrow(spanned, ddl))


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 20_000, apart: int = 0) -> Iterator[pa.Table]:
    """Tables of about `rows` rows of a sorted stream, cut only between groups, and wherever one of the first `apart`
    columns of `by` changes."""
    held: list[pa.RecordBatch] = []
    count = 0

    def changes(table: pa.Table, columns: list[str]) -> np.ndarray:
        new = np.zeros(len(table), bool)
        for c in columns:
            k = table.column(c).combine_chunks().fill_null(-1).to_numpy()
            new[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(new)

    def pieces(table: pa.Table) -> Iterator[pa.Table]:
        bounds = [0, *changes(table, by[:apart]).tolist(), len(table)]
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            yield table.slice(start, end - start)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        cut = changes(table, by)
        if len(cut):
            yield from pieces(table.slice(0, int(cut[-1])))
            table = table.slice(int(cut[-1]))
        held, count = table.combine_chunks().to_batches(), len(table)
    if held:
        yield from pieces(pa.Table.from_batches(held))
