"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

`load` reads the pieces, scores and normaliser flags of a SentencePiece model file. Scores of a unigram model are used as
they are; a model of the merge kind has ranks instead of log scores, and its pieces get Zipf log probabilities of their
ranks. Texts take the model's dummy prefix, blanks become the whitespace marker, and each run between places that no
piece crosses is segmented by itself: the best path of the whole text is then the chain of the best paths of the runs.
Characters that no piece covers become byte pieces. Decoding joins pieces and bytes and turns markers into blanks.

Null and empty texts have no tokens. A marker character in a text decodes to a blank, as in any SentencePiece model.
Only identity normalisers are taken; a model with a character map is refused. Repeated rows get a row each.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, whole_texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class DoubleArray:
    """A trie of byte strings in two arrays: the child of s by byte b is t = base[s] + b + 1 if check[t] == s; value[s]
    is the entry that ends in s, or -1."""

    def __init__(self, entries: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, number in entries.items():
            node = 0
            for b in word:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = number
        size = 2 * len(children) + 512
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free, stack, tried = 1, [(0, 0)], {}
        while stack:
            node, at = stack.pop()
            self.value[at] = ends[node]
            kids = sorted(children[node])
            if not kids:
                continue
            while self.check[free] >= 0:
                free += 1
            # Nodes with as many children go on where the last of them found room.
            offset = free - kids[0] - 1
            if len(kids) > 1:
                offset = max(offset, tried.get(min(len(kids), 8), offset))
            while True:
                need = offset + kids[-1] + 2
                if need > len(self.check):
                    more = need - len(self.check) + 4096
                    self.base += [0] * more
                    self.check += [-1] * more
                    self.value += [-1] * more
                if all(self.check[offset + b + 1] < 0 for b in kids):
                    break
                offset += 1
            self.base[at] = tried[min(len(kids), 8)] = offset
            for b in kids:
                self.check[offset + b + 1] = at
            stack += [(children[node][b], offset + b + 1) for b in kids]
        # Room for any byte behind the last base, and before the first, which may be negative: those slots stay free.
        self.check += [-1] * 260
        self.base += [0] * 260
        self.value += [-1] * 260


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    squeeze: bool = False
    trie: DoubleArray = field(init=False)

    def __post_init__(self):
        self.words = {p.encode(): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER) and p}
        self.trie = DoubleArray(self.words)
        self.bytes_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.unknown_score = min(self.scores[i] for i in self.words.values()) - 10
        # Runs: no piece goes on from another character to a marker, nor joins a line end with anything else.
        crossing = any(MARK in p.lstrip(MARK) for p in map(bytes.decode, self.words))
        lines = any("\n" in p and p != "\n" for p in map(bytes.decode, self.words))
        self.runs = None if crossing else f"{MARK}*[^{MARK}]+|{MARK}+" if lines else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNUSED) else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def viterbi(self, run: str) -> tuple[int, ...]:
        """The best-scoring pieces of a run."""
        data = run.encode()
        n = len(data)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            first = data[i]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here, node, single = best[i], 0, False
            for j in range(i, n):
                t = base[node] + data[j] + 1
                if check[t] != node:
                    break
                node = t
                piece = value[t]
                if piece >= 0:
                    s = here + scores[piece]
                    if s > best[j + 1]:
                        best[j + 1], back[j + 1] = s, (i, piece)
                    if j + 1 - i == width:
                        single = True
            if not single and here + self.unknown_score > best[i + width]:
                best[i + width], back[i + width] = here + self.unknown_score, (i, -1)
            i += width
        out: list[int] = []
        while n:
            start, piece = back[n]
            if piece >= 0:
                out.append(piece)
            elif self.bytes_of:
                out += [self.bytes_of[b] for b in reversed(data[start:n])]
            else:
                out.append(self.unknown)
            n = start
        return tuple(reversed(out))

    def encode(self, text: str, room: int = 1 << 17) -> list[int]:
        """room: twice so many runs are remembered at most; those that recur outlive the others."""
        text = self.normal(text)
        if self.runs is None:
            return list(self.viterbi(text))
        ids: list[int] = []
        cache = self.cache
        for run in re.findall(self.runs, text):
            got = cache.get(run)
            if got is None:
                got = self.older.get(run) or self.viterbi(run)
                if len(run) < 64:
                    if len(cache) >= room:
                        self.older, self.cache = cache, {}
                        cache = self.cache
                    cache[run] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def load(path: str = MODEL) -> Model:
    """The model of a SentencePiece file (a driver-side path; its size, not the data's, bounds what tasks receive)."""
    pieces, scores, kinds, unigram, flags, charsmap = [], [], [], True, {3: 1, 4: 1}, b""
    with open(path, "rb") as f:
        message = f.read()
    for number, value in wire(message):
        if number == 1:
            entry = dict(wire(value))
            pieces.append(entry.get(1, b"").decode())
            scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
            kinds.append(entry.get(3, NORMAL))
        elif number == 2:
            unigram = dict(wire(value)).get(3, 1) == 1
        elif number == 3:
            spec = dict(wire(value))
            charsmap = spec.get(2, b"")
            flags |= {k: v for k, v in spec.items() if k in flags}
    if charsmap:
        raise ValueError("a model with a character map is not supported")
    if not unigram:
        rank = {i: r for r, i in enumerate(sorted((i for i, k in enumerate(kinds) if k == NORMAL), key=lambda i: (-scores[i], i)), 1)}
        total = math.log(sum(1 / r for r in rank.values()))
        scores = [-math.log(rank[i]) - total if i in rank else 0.0 for i in range(len(pieces))]
    return Model(pieces, scores, kinds, bool(flags[3]), bool(flags[4]))


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row; a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 18):
                ids = [model.encode(t) for t in part.column(1).to_pylist()]
                decoded = [model.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return whole_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs, load())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
