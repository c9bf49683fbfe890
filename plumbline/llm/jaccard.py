"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document is the set of its distinct word shingles. Sizes fall into bands; in a band, sets that reach the similarity
differ in at most k elements. The shingle domain is cut into n1 parts, each into N2 = 3 sub-parts, and every subset of
N2 - K2 = 2 sub-parts of a part gives a signature: the band, the part, the subset and a hash of the shingles in it. With
n1 = k div (K2 + 1) + 1 + k div SPARE, some part differs in at most K2 = 1 elements, which lie in one sub-part, so the
subset without it agrees. Sets near the upper end of a band also sign for the next.

More than one part must agree: a part without a common signature holds at least two differences, one in which not all
signatures are common at least one, and both bounds hold for a document and any partner as well as for a document and all
others together. So a document whose parts, by the signatures that recur at all, would need more differences than its size
allows has no partner, and its signatures are dropped (`Join.possible`). That leaves a tenth of the documents or less.

Documents that share a signature are verified exactly, on whole sets, but not all pairs of a bucket: first each document
against one member of its buckets (stars), twice, then against the member nearest to the core of its family, and then all
pairs of documents that are still in different components and can link by what sets them apart from the core
(`Join.rest`). Links inside a component can't change it, and nothing is capped.

Equal texts are folded before, and a hash of the text (`node`) stands for each, since ids may repeat or be null. Nulls and
texts without words have an empty set and link with nothing. Rows that repeat an id are one node, linked as any of their
texts is. Null ids are equal to no other: such rows link by their texts alone, and their component_id is null if no row
that links reach has an id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Shelf, U, bit_words, buffers, flagged, fresh, mix, repeated, slices, word_hashes
from plumbline.llm.repeats import Corpus

WORDS = 3
#: Upper ends of the size bands, by a factor of about 1.5.
BANDS = np.array(sorted({int(1.5**j) for j in range(66)}))
#: Sub-parts of a part, differences that a part may hold, and how many differences bring one part more than needed.
N2, K2, SPARE = 3, 1, 20
SUBSETS = [list(c) for c in combinations(range(N2), N2 - K2)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer words than `words` make one shingle, none an empty set."""
    h, by = word_hashes(data, offsets, fold_case=True)
    n = len(h)
    s = np.zeros(max(n - words + 1, 0), U)
    for i in range(words):
        s = mix(s * U(0x9E3779B97F4A7C15) + h[i : i + len(s)])
    out = []
    for a, b in zip(by[:-1].tolist(), by[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        elif b > a:
            x = U(b - a)
            for w in h[a:b]:
                x = mix(np.array([x ^ U(0xD1B54A32D192ED03)]) + w)[0]
            out.append(np.array([x], U))
        else:
            out.append(np.zeros(0, U))
    return out


def differences(sizes, percent: int):
    """The most elements in which two sets with this sum of sizes differ if 100 * intersection >= percent * union."""
    return (100 - percent) * sizes // (100 + percent)


def parts_of(band: int, percent: int) -> int:
    """Parts of the domain in a band; 0 if its sets link only if they are equal."""
    k = differences(2 * int(BANDS[band]), percent)
    return k // (K2 + 1) + 1 + k // SPARE if k else 0


def signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, their bands, their parts) of one sorted set."""
    size = len(s)
    if not size:
        return np.zeros(0, U), np.zeros(0, np.int8), np.zeros(0, np.int32)
    own = int(np.searchsorted(BANDS, size))
    bands = [own] + ([own + 1] if 100 * size >= percent * (BANDS[own] + 1) else [])
    value = np.zeros(size + 1, U)
    np.cumsum(mix(s), out=value[1:])
    out, parts = [], []
    for band in bands:
        n1 = parts_of(band, percent)
        if not n1:
            out.append(mix(value[-1:] + U(band)))
            parts.append(np.zeros(1, np.int32))
            continue
        bounds = np.searchsorted(((s >> U(32)) * U(n1 * N2)) >> U(32), np.arange(n1 * N2 + 1, dtype=U))
        within = (value[bounds[1:]] - value[bounds[:-1]]).reshape(n1, N2)
        total = np.stack([within[:, c].sum(axis=1, dtype=U) for c in SUBSETS], axis=1).ravel()
        out.append(mix(total + mix(np.arange(len(total), dtype=U) * U(64) + U(band))))
        parts.append(np.repeat(np.arange(n1, dtype=np.int32), len(SUBSETS)))
    return np.concatenate(out), np.repeat(np.array(bands, np.int8), [len(x) for x in out]), np.concatenate(parts)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes of edges (a, b).

    Each round points every node at its smallest neighbour, follows the pointers to their ends and contracts the edges,
    so the rounds are logarithmic in the longest chain. Every round is written to the shared folder.
    """
    labels = None
    shelf = Shelf(edges.sparkSession)
    left = shelf.put(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = shelf.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "point")
        while True:
            further = point.select(F.col("node").alias("label"), F.col("label").alias("next"))
            moved = shelf.put(point.join(further, "label").select("node", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), "jump")
            shelf.keep(left, labels, moved)
            point = moved.select("node", "label")
            if moved.filter("moved").isEmpty():
                break
        if labels is None:
            labels = moved
        else:
            now = point.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = shelf.put(labels.join(now, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        p, q = point.select(F.col("node").alias("a"), F.col("label").alias("x")), point.select(F.col("node").alias("b"), F.col("label").alias("y"))
        left = shelf.put(left.join(p, "a").join(q, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct(), "edges")
        shelf.keep(left, labels)
    return labels.select("node", "label") if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))


class Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int):
        self.words, self.percent = words, percent
        self.corpus = Corpus(docs, id_col, text_col)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 3, 1 << 18):
                    sizes = [len(s) for s in shingle_sets(*buffers(part.column(3)), words)]
                    yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(0), pa.array(sizes, pa.int64())], names=["node", "k2", "doc_id", "n"])

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 3, 1 << 18):
                    made = [signatures(s, percent) for s in shingle_sets(*buffers(part.column(3)), words)]
                    nodes = np.repeat(part.column(1).to_numpy(), [len(m[0]) for m in made])
                    signs, bands, parts = (np.concatenate([m[i] for m in made]) for i in range(3))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(signs.view(np.int64)), pa.array(bands), pa.array(parts)], names=["node", "sign", "band", "part"])

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1, 1 << 18):
                    sets = shingle_sets(*buffers(part.column(1)), words)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

        self.shelf = shelf = self.corpus.shelf
        self.sizes = shelf.put(self.corpus.distinct().mapInArrow(count, "node long, k2 long, doc_id long, n long"), "sizes")
        signed, sample = (self.corpus.distinct(part).mapInArrow(sign, "node long, sign long, band byte, part int") for part in (False, True))
        again = repeated(signed, sample, "sign", ["node"]).select("node", "sign", "band", "part")
        #: Rows (sign, node, n, band, part) of signatures that several documents have, of documents that may have a partner.
        self.rows = shelf.put(self.possible(again.join(self.sizes.select("node", "n"), "node")).select("sign", "node", "n", "band", "part"), "rows")
        members = shelf.put(self.rows.select("node").distinct(), "members")
        wanted = flagged(self.corpus.distinct(), "k1", shelf.put(bit_words(members, "node"), "bits")).filter("perhaps")
        self.sets = shelf.put(wanted.select("k1", "text").mapInArrow(collect, "node long, set binary"), "sets")
        shelf.keep(self.corpus.copies, self.corpus.words, self.sizes, self.rows, self.sets)

    def possible(self, rows: DataFrame) -> DataFrame:
        """The rows of documents that can have a partner by these rows, which hold all signatures that others have too.

        A part without any counts as two differences, one without all as one; in all there may be as many as the
        document and the largest partner in the band allow. One shuffle by document serves the counts of its parts and
        their sum, so rows are neither stored nor joined for it.
        """
        percent = self.percent
        of_band = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("band").cast("int") + 1)
        n1 = of_band([parts_of(b, percent) for b in range(len(BANDS))])
        most = F.least(of_band([int(b) for b in BANDS]), F.floor(F.col("n") * 100 / percent))
        needed = F.when(n1 == 0, 1).otherwise(2 * n1 - F.floor((100 - percent) * (F.col("n") + most) / (100 + percent)))
        scale = lcm(*range(1, len(SUBSETS) + 1))  # a part's score is shared out to its rows in whole numbers
        c, score = fresh(rows.columns, "_c", "_score")
        share = F.when(F.col(c) == len(SUBSETS), 2 * scale).otherwise(scale) / F.col(c)
        told = rows.withColumn(c, F.count("*").over(Window.partitionBy("node", "band", "part")))
        told = told.withColumn(score, F.sum(share.cast("long")).over(Window.partitionBy("node", "band")))
        return told.filter(F.col(score) >= needed * scale).select(rows.columns)

    def similar_sizes(self, n, m) -> F.Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their whole sets."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = [linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        pairs = self.shelf.put(pairs, "pairs")
        x, y = (self.wanted(pairs.select(c)).select(F.col("node").alias(c), F.col("set").alias(s)) for c, s in (("a", "x"), ("b", "y")))
        links = self.shelf.put(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
        self.shelf.drop(pairs)
        return links

    def wanted(self, ids: DataFrame) -> DataFrame:
        """The sets of these documents and perhaps of a few others: sets are large, so the rest stays out of shuffles."""
        words = self.shelf.put(bit_words(ids.distinct(), ids.columns[0]), "bits")
        return flagged(self.sets, "node", words).filter("perhaps").select("node", "set")

    def with_labels(self, labels: DataFrame | None) -> DataFrame:
        """Rows of buckets that hold several components, with the component, of documents that may have a partner in another."""
        if labels is None:
            return self.rows.withColumn("label", F.col("node"))
        rows = self.rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rows = self.shelf.put(rows, "labelled")
        open_ = rows.groupBy("sign").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("sign")
        return self.possible(rows.join(open_, "sign", "left_semi"))

    def star(self, labels: DataFrame | None, turn: int) -> DataFrame:
        """One pair for each document: with the bucket centre of another component that it shares most signatures with.

        Centres are first the documents whose signatures most others have, for their size: of a group of near copies
        those with the fewest changes, with which the others link even if they don't link with each other.
        """
        rows = self.with_labels(labels)
        order = F.xxhash64("node", F.lit(turn))
        if not turn:
            shared = rows.join(rows.groupBy("sign").agg(F.count("*").alias("m")), "sign")
            popular = shared.groupBy("node").agg((-F.sum("m") / F.first("n")).alias("rank"))
            rows, order = rows.join(popular, "node"), F.struct("rank", "node")
        centres = rows.groupBy("sign").agg(F.min_by(F.struct("node", "n", "label"), order).alias("c"))
        pairs = rows.join(centres, "sign").filter((F.col("c.label") != F.col("label")) & self.similar_sizes(F.col("n"), F.col("c.n")))
        shared = pairs.groupBy(F.col("node").alias("a"), F.col("c.node").alias("b")).count()
        return shared.groupBy("a").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b"))

    def relabelled(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows with the components that their documents are in by now."""
        now = labels.select("node", F.col("label").alias("now"))
        return rows.join(now, "node", "left").withColumn("label", F.coalesce("now", "label")).drop("now")

    def rest(self, labels: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """Pairs of different components that can still link, of the documents whose buckets hold several: one for each
        document, and a function that gives all others by the components after the first are verified.

        Documents joined by buckets form families. A family's core is what more than half of its sets hold, and D is
        what a set and the core don't share, so two sets differ in as many elements as their Ds do. Two sets that link
        without a common element of D also link with the member that has the smallest D for its size; others have a
        common element among the rarest of their Ds. Most near copies link with that member, which leaves few components
        of a family, and of two documents that share an element one is outside the largest component there.
        """
        rows = self.shelf.put(self.with_labels(labels), "open")
        centres = rows.groupBy("sign").agg(F.min("node").alias("b"))
        families = components(rows.join(centres, "sign").select(F.col("node").alias("a"), "b").filter("a <> b").distinct())
        docs = rows.select("node", "n", "label").distinct().join(families.select("node", F.col("label").alias("family")), "node")
        docs = self.shelf.put(docs.join(self.wanted(docs.select("node")), "node").select("family", "node", "n", "label", "set"), "families")

        def exploded(keep: int, change):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for whole in batches:
                    for start in range(0, whole.num_rows, 100):
                        batch = whole.slice(start, 100)
                        sets = change(batch)
                        at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in sets]))
                        size = pa.array(np.repeat([len(x) for x in sets], [len(x) for x in sets]).astype(np.int64))
                        yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:keep]), size, pa.array(np.concatenate(sets))], names=[*batch.schema.names[:keep], "size", "element"])

            return run

        raw = lambda batch: [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(batch.schema.names.index("set"))]
        elements = docs.select("family", "set").mapInArrow(exploded(1, raw), "family long, size long, element long")
        members = docs.groupBy("family").agg(F.count("*").alias("m"))
        frequent = elements.groupBy("family", "element").agg(F.count("*").alias("c")).filter("c > 1").join(members, "family").filter("2 * c > m")
        core = frequent.groupBy("family").agg(F.collect_list("element").alias("core"))  # fewer than two sets hold

        def apart(batch: pa.RecordBatch) -> list[np.ndarray]:
            cores = batch.column(batch.schema.names.index("core"))
            none = np.zeros(0, np.int64)
            return [np.setxor1d(x, np.asarray(c.values) if c.is_valid else none) for x, c in zip(raw(batch), cores, strict=True)]

        told = docs.join(core, "family", "left").select("family", "node", "n", "label", "set", "core")
        different = self.shelf.put(told.mapInArrow(exploded(4, apart), "family long, node long, n long, label long, size long, element long"), "different")

        share = (100 - self.percent) / (100 + self.percent)  # of both sizes: so many elements may differ
        sizes = different.groupBy("family", "node", "n", "label").agg(F.first("size").alias("size"))
        every = docs.select("family", "node", "n", "label").join(sizes.select("node", "size"), "node", "left").fillna(0, ["size"])
        nearest = every.groupBy("family").agg(F.min_by(F.struct("node", "n", "label"), F.struct(F.col("size") - share * F.col("n"), F.col("node"))).alias("z"))
        to_core = every.join(nearest, "family").filter((F.col("label") != F.col("z.label")) & self.similar_sizes(F.col("n"), F.col("z.n"))).select(F.col("node").alias("a"), F.col("z.node").alias("b"))

        def others(labels: DataFrame) -> DataFrame:
            now = self.shelf.put(self.relabelled(every.select("family", "node", "label"), labels), "now")
            several = now.groupBy("family").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("family")
            open_ = different.join(several, "family", "left_semi").drop("label").join(now.select("node", "label"), "node")
            known = open_.groupBy("family", "element").agg(F.count("*").alias("c"))
            nth = F.row_number().over(Window.partitionBy("node").orderBy("c", "element"))
            longest = F.floor((F.col("size") + share * F.col("n") * (1 + 100 / self.percent)) / 2 + 1 + 1e-6)
            rare = open_.join(known, ["family", "element"]).withColumn("nth", nth).filter((F.col("nth") <= longest) & (F.col("c") > 1))
            rare = self.shelf.put(rare.select("family", "element", "node", "n", "label", "size", "nth"), "rare")
            # A pair of two components has a document outside the element's largest one.
            by_label = rare.groupBy("family", "element", "label").agg(F.count("*").alias("m"))
            largest = by_label.groupBy("family", "element").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.count("*").alias("k")).filter("k > 1")
            told = self.shelf.put(rare.join(largest.drop("k"), ["family", "element"]), "told")
            x, y = (told.select("family", "element", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "label", "size", "nth", "top"))) for k in "xy")
            allowed = share * (F.col("n_x") + F.col("n_y")) + 1e-6
            within = lambda p, q: F.col(f"nth_{p}") <= (F.col(f"size_{p}") - F.col(f"size_{q}") + allowed) / 2 + 1
            once = (F.col("label_y") == F.col("top_y")) | (F.col("node_x") < F.col("node_y"))
            apart_ = (F.col("label_x") != F.col("label_y")) & once
            x = x.filter("label_x <> top_x")
            close = x.join(y, ["family", "element"]).filter(apart_ & self.similar_sizes(F.col("n_x"), F.col("n_y")) & within("x", "y") & within("y", "x"))
            return close.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()

        return to_core, others

    def linked_texts(self, stars: int = 2) -> tuple[DataFrame, DataFrame]:
        """Links (a, b) of texts, and the components (node, label) of the texts that have any."""
        self.links: list[DataFrame] = []
        labels = None
        others = None
        for turn in range(stars + 2):
            if turn < stars:
                pairs = self.star(labels, turn)
            elif turn == stars:
                pairs, others = self.rest(labels)
            else:
                pairs = others(labels)
            found = self.verified(pairs)
            self.links.append(found)
            if others is None or turn > stars:  # until then the tables of rest() are read again
                self.shelf.keep(self.corpus.copies, self.corpus.words, self.sizes, self.rows, self.sets, *self.links)
            if turn < stars or not found.isEmpty():
                labels = components(reduce(DataFrame.unionByName, self.links))
        return reduce(DataFrame.unionByName, self.links), labels


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 90) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id, label) for every row: label is the smallest text key that links reach."""
    join = Join(docs, id_col, text_col, words, percent)
    links, labels = join.linked_texts()
    labels = join.shelf.put(labels, "labels")
    join.shelf.keep(join.sizes, labels, *join.links)
    rows = join.shelf.put(join.corpus.rows.select("doc_id", "k1", "k2"), "ids")
    several = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("k1").alias("l"), F.max("k1").alias("h")).filter("l < h")
    several = join.shelf.put(several.select("doc_id"), "several")
    apart = not several.isEmpty()
    if apart:  # the texts of an id belong together
        full = rows.join(several, "doc_id", "left_semi").join(join.sizes.filter("n > 0").select(F.col("node").alias("k1")), "k1")
        full = join.shelf.put(full.select("doc_id", "k1").distinct(), "full")
        centres = full.groupBy("doc_id").agg(F.min("k1").alias("b"))
        labels = components(links.unionByName(full.join(centres, "doc_id").select(F.col("k1").alias("a"), "b").filter("a <> b")))
    smallest = labels.join(join.sizes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    reached = labels.join(smallest, "label").select("node", "label", "component_id")
    texts = join.sizes.join(reached, "node", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    texts = join.shelf.put(texts.select(F.col("node").alias("k1"), "k2", F.col("n").alias("n_shingles"), "component_id", F.coalesce("label", "node").alias("label")), "texts")
    out = rows.join(texts, ["k1", "k2"], "left")
    none = F.col("n_shingles") == 0
    if not apart:
        return out.withColumn("component_id", F.when(none, F.col("doc_id")).otherwise(F.col("component_id")))
    others = full.join(texts, "k1").groupBy("doc_id").agg(F.min("component_id").alias("other"))
    return out.join(others, "doc_id", "left").withColumn("component_id", F.when(none, F.coalesce("other", "doc_id")).otherwise(F.col("component_id"))).drop("other")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: component_id is the smallest id that links reach."""
    return grouped(docs, id_col, text_col, words, percent).select("doc_id", "n_shingles", "component_id")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
