"""Media columns: payloads cut by a rolling gear hash, equal chunks stored once, ordered lists of digests to rebuild them.

A chunk ends where the gear hash of the last 32 bytes has its `mask` bits clear (within `least` and `most` bytes), so
equal passages cut alike wherever they stand. `store` writes two tables into the shared folder: `media` (a row per
document: its list of chunk digests, and the bytes of those chunks that no other place holds) and `chunks` (digest and
bytes, once each, of all chunks that occur more than once). A media row is a whole WAV file: the first entry of its list
is the header, kept with the row's own bytes, and the digest of the file is stored with it. `load` rebuilds each file from
what is stored, verifies that digest, and takes the payload from behind the header.

Two scans of the documents take the place of a shuffle of their texts: the first shuffles digests only. Digests that
occur more than once are told by a bitmap; a chunk whose bit is clear occurs once, all others go through the shuffle that
keeps one copy, so the result doesn't depend on the bitmap's size.

Null texts count as empty ones, empty ones are 192 blanks. A repeated (even wholly equal) row is a row of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Shelf, bitmap, marked, mix, whole_texts

GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(11)) >> np.uint64(32)).astype(np.uint32)
UNIT = 192


def gear(data: np.ndarray) -> np.ndarray:
    """Sum of GEAR[byte] << age over the last 32 bytes, at every position."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        older = h.copy()
        h[k:] += older[:-k] << np.uint32(k)
    return h


def cuts(data: np.ndarray, least: int = 256, most: int = 8192, mask: int = 0xFFC00000) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    ends, start = [], 0
    for c in np.flatnonzero((gear(data) & np.uint32(mask)) == 0).tolist():
        while c + 1 - start > most:
            start += most
            ends.append(start)
        if c + 1 - start >= least:
            start = c + 1
            ends.append(start)
    while n - start > most:
        start += most
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + b" " * (-len(raw) % UNIT or UNIT * (not raw))


def wav(samples: int) -> bytes:
    """The header of a mono WAV file of 8-bit samples at 8 kHz."""
    return b"RIFF" + struct.pack("<I", 36 + samples) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", samples)


def chunked(text: str) -> tuple[bytes, list[bytes], list[bytes]]:
    """(payload, chunks, digests) of a text; the chunks are those of the payload."""
    data = payload(text)
    ends = cuts(np.frombuffer(data, np.uint8))
    parts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return data, parts, [digest(p) for p in parts]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(media, chunks), both written to the shared folder and reread."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    texts = whole_texts(docs, id_col, text_col)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [d for t in batch.column(1).to_pylist() for d in chunked(t)[2]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([key(d) for d in found], pa.int64())], names=["digest", "key"])

    often = texts.mapInArrow(digests, "digest binary, key long").groupBy("digest", "key").count().filter("count > 1")
    often = shelf.put(often, "often")
    flags = spark.sparkContext.broadcast(bitmap(often, "key", bits))  # at most BITS / 8 bytes

    entry = pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("shared", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("recipe", pa.list_(entry)), ("own", pa.binary()), ("shared", pa.list_(pa.binary())), ("sha256", pa.string())])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_ = np.frombuffer(flags.value, np.uint64)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, parts, names = chunked(text)
                again = marked(bits_, np.array([key(d) for d in names])).tolist()
                rows[0].append(doc_id)
                rows[1].append(len(text.encode()))
                rows[2].append(len(data))
                head = wav(len(data))
                rows[3].append([{"digest": digest(head), "size": len(head), "shared": False}, *({"digest": d, "size": len(p), "shared": s} for d, p, s in zip(names, parts, again, strict=True))])
                rows[4].append(head + b"".join(p for p, s in zip(parts, again, strict=True) if not s))
                rows[5].append([p for p, s in zip(parts, again, strict=True) if s])
                rows[6].append(hashlib.sha256(head + data).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema, strict=True)], schema=schema)

    ddl = "doc_id long, n_bytes long, payload_bytes long, recipe array<struct<digest:binary,size:int,shared:boolean>>, own binary, shared array<binary>, sha256 string"
    media = texts.mapInArrow(packs, ddl)
    # The chunks that may occur elsewhere: one copy of each.
    pieces = media.select(F.explode(F.arrays_zip(F.filter("recipe", lambda x: x["shared"]).alias("r"), F.col("shared").alias("b"))).alias("x"))
    chunks = shelf.put(pieces.select(F.col("x.r.digest").alias("digest"), F.col("x.b").alias("bytes")).groupBy("digest").agg(F.first("bytes").alias("bytes")), "chunks")
    media = shelf.put(media.drop("shared"), "media")
    shelf.keep(media, chunks)
    return media, chunks


def load(media: DataFrame, chunks: DataFrame, outputs: str, make) -> DataFrame:
    """Rebuilds each stored file, checks its SHA-256, and returns make(file, number of chunks), the columns `outputs`.

    Only documents that share a chunk with others take part in a join.
    """
    media = media.withColumn("row", F.xxhash64("doc_id", "sha256"))
    shared = media.filter(F.exists("recipe", lambda x: x["shared"]))
    wanted = shared.select("row", F.explode(F.array_distinct(F.transform(F.filter("recipe", lambda x: x["shared"]), lambda x: x["digest"]))).alias("digest")).distinct()
    found = wanted.join(chunks, "digest").groupBy("row").agg(F.collect_list(F.struct("digest", "bytes")).alias("found"))  # a document's own chunks
    columns = ["doc_id", "n_bytes", "payload_bytes", "recipe", "own", "sha256", "found"]
    alone = media.filter(~F.exists("recipe", lambda x: x["shared"])).withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    rows = alone.select(columns).unionByName(shared.join(found, "row").select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x in batch.to_pylist():
                bytes_of = {f["digest"]: f["bytes"] for f in x["found"] or ()}
                parts, at = [], 0
                for r in x["recipe"]:
                    if r["shared"]:
                        parts.append(bytes_of[r["digest"]])
                    else:
                        parts.append(x["own"][at : at + r["size"]])
                        at += r["size"]
                data = b"".join(parts)
                if hashlib.sha256(data).hexdigest() != x["sha256"]:
                    raise ValueError(f"document {x['doc_id']}: the stored chunks don't give its file")
                made.append((x["doc_id"], x["n_bytes"], *make(data, len(x["recipe"]) - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=names)

    names = ["doc_id", "n_bytes", *(c.split()[0] for c in outputs.split(", "))]
    return rows.mapInArrow(run, f"doc_id long, n_bytes long, {outputs}")


def samples(media: bytes) -> bytes:
    """The samples of a WAV file of wav()."""
    n = len(media) - len(wav(0))
    if media[: len(wav(0))] != wav(n):
        raise ValueError("the header doesn't fit the file")
    return media[len(wav(0)) :]


def features(media: bytes, n_chunks: int) -> tuple:
    """Digest columns and signal features of a file that was read back."""
    data = samples(media)
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    feature = f"chunks={n_chunks};peak={int(np.abs(x).max())};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


OUTPUTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op10_media_chunks(spark, sf_dir: str) -> DataFrame:
    return load(*store(spark.read.parquet(f"{sf_dir}/documents.parquet")), OUTPUTS, features)
