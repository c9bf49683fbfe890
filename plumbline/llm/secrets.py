"""Secret scan: one combined automaton for all rules, made by subset construction and minimisation.

Each rule is a small regular expression over bytes (classes, groups, alternatives, ``? * +`` and ``{m,}``). The
reversed rules are joined into one NFA with a self-loop at its start, made deterministic by subset construction and
minimised by partition refinement into a flat transition array over byte classes. One pass over the bytes, from the
last to the first, then marks every position at which a match of each rule begins; from the leftmost mark on, that
rule's own forward automaton finds the longest match, and the search goes on behind it. That is the leftmost,
non-overlapping order of a greedy regular expression search for these rules.

Nulls count as empty texts; an empty text has no spans. Texts are scanned whole, whatever their length. Repeated rows
and repeated ids each give their own row; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import tidy, whole_texts


@dataclass(frozen=True)
class Rule:
    """kind, pattern, and the least length of a match, or of the assigned value if of_value; a match that is too
    short is dropped after it was consumed."""

    kind: str
    pattern: str
    least: int = 0
    of_value: bool = False


#: The three base kinds, then further ones. A run that is matched whole is long enough or it is not, so "{32,}" and
#: "{12,}" give what "+" and a later test of the length give.
RULES = (
    Rule("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


# --- regular expression -> tree -------------------------------------------------------------------------------


def parse(pattern: str):
    """A tree of ("set", frozenset of bytes), ("cat", [...]), ("alt", [...]) and ("rep", tree, least, most or None)."""
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def alternatives():
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence():
        items = []
        while at < len(pattern) and pattern[at] not in "|)":
            items.append(repeated())
        return ("cat", items)

    def repeated():
        nonlocal at
        node = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, _, high = pattern[at:end].partition(",")
                node = ("rep", node, int(low), int(high) if high else (int(low) if "," not in pattern[at:end] else None))
                at = end + 1
            else:
                node = ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return node

    def atom():
        nonlocal at
        if pattern[at] == "(":
            at += 3 if pattern.startswith("(?:", at) else 1
            node = alternatives()
            at += 1
            return node
        if pattern[at] == "[":
            at += 1
            negated = pattern[at] == "^"
            at += negated
            members: set[int] = set()
            while pattern[at] != "]":
                low = high = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = char()
                members |= set(range(low, high + 1))
            at += 1
            return ("set", frozenset(set(range(256)) - members if negated else members))
        return ("set", frozenset([char()]))

    return alternatives()


def reverse(tree):
    """The tree of the reversed words."""
    if tree[0] == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


# --- tree -> NFA -> minimal DFA -------------------------------------------------------------------------------


@dataclass
class Automaton:
    """Transition array over byte classes: next state = table[state * width + classes[byte]]; states come multiplied
    by width, those from `accepting` on have a mask of rules in masks."""

    classes: bytes
    width: int
    table: list[int]
    start: int
    accepting: int
    masks: dict[int, int]
    dead: int


def compile_dfa(trees: list, unanchored: bool) -> Automaton:
    """One minimal DFA for all trees; bit i of a state's mask says that a word of tree i ends there."""
    moves: list[list[tuple[frozenset, int]]] = []
    jumps: list[list[int]] = []

    def state() -> int:
        moves.append([])
        jumps.append([])
        return len(moves) - 1

    def build(tree, source: int) -> int:
        if tree[0] == "set":
            target = state()
            moves[source].append((tree[1], target))
            return target
        if tree[0] == "cat":
            for x in tree[1]:
                source = build(x, source)
            return source
        if tree[0] == "alt":
            target = state()
            for x in tree[1]:
                jumps[build(x, source)].append(target)
            return target
        _, inner, least, most = tree
        for _ in range(least):
            source = build(inner, source)
        if most is None:
            hub = state()
            jumps[source].append(hub)
            jumps[build(inner, hub)].append(hub)
            return hub
        target = state()
        jumps[source].append(target)
        for _ in range(most - least):
            source = build(inner, source)
            jumps[source].append(target)
        return target

    root = state()
    final: dict[int, int] = {}
    for i, tree in enumerate(trees):
        entry = state()
        jumps[root].append(entry)
        end = build(tree, entry)
        final[end] = final.get(end, 0) | 1 << i
    if unanchored:
        moves[root].append((frozenset(range(256)), root))

    # Bytes that no set tells apart form one class.
    sets = {s for m in moves for s, _ in m}
    by_signature: dict[tuple, list[int]] = {}
    for b in range(256):
        by_signature.setdefault(tuple(b in s for s in sets), []).append(b)
    members = list(by_signature.values())
    classes = bytearray(256)
    for k, group in enumerate(members):
        for b in group:
            classes[b] = k
    width = len(members)

    def closure(states) -> frozenset:
        stack, seen = list(states), set(states)
        while stack:
            for t in jumps[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return frozenset(s for s in seen if moves[s] or s in final)

    by_class = [[[t for s, t in m if g[0] in s] for g in members] for m in moves]
    ids = {closure([root]): 0}
    order, rows = [next(iter(ids))], []
    for subset in order:  # the list grows while it is walked
        row = []
        for k in range(width):
            target = closure({t for s in subset for t in by_class[s][k]})
            if target not in ids:
                ids[target] = len(order)
                order.append(target)
            row.append(ids[target])
        rows.append(row)
    masks = [0] * len(order)
    for i, subset in enumerate(order):
        for s in subset:
            masks[i] |= final.get(s, 0)

    # Partition refinement: states stay together as long as their masks and the blocks of their targets agree.
    block = np.unique(np.array(masks), return_inverse=True)[1]
    targets = np.array(rows)
    while True:
        refined = np.unique(np.column_stack([block, block[targets]]), axis=0, return_inverse=True)[1].ravel()
        if refined.max() == block.max():
            break
        block = refined
    keep = {int(b): i for i, b in reversed(list(enumerate(block)))}
    ranked = sorted(keep, key=lambda b: (masks[keep[b]] != 0, keep[b]))
    number = {b: i for i, b in enumerate(ranked)}
    table = [number[int(block[t])] * width for b in ranked for t in rows[keep[b]]]
    accepting = sum(masks[keep[b]] == 0 for b in ranked) * width
    dead = next((i * width for i, b in enumerate(ranked) if not masks[keep[b]] and all(t == i * width for t in table[i * width : (i + 1) * width])), -1)
    return Automaton(bytes(classes), width, table, number[int(block[0])] * width, accepting, {number[b] * width: masks[keep[b]] for b in ranked if masks[keep[b]]}, dead)


class Scanner:
    """All rules compiled; find(data) gives the kept spans by rule as byte ranges."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(r.pattern) for r in rules]
        self.back = compile_dfa([reverse(t) for t in trees], unanchored=True)
        self.forward = [compile_dfa([t], unanchored=False) for t in trees]

    def starts(self, data: bytes) -> list[list[int]]:
        """By rule, the positions where a match begins, last first: the one pass over all bytes."""
        a = self.back
        table, accepting, masks, s, found = a.table, a.accepting, a.masks, a.start, []
        i = len(data)
        for c in data.translate(a.classes)[::-1]:
            i -= 1
            s = table[s + c]
            if s >= accepting:
                found.append((i, s))
        by_rule: list[list[int]] = [[] for _ in self.rules]
        for i, s in found:
            mask = masks[s]
            for k in range(len(by_rule)):
                if mask >> k & 1:
                    by_rule[k].append(i)
        return by_rule

    def longest(self, k: int, data: bytes, start: int) -> int:
        a = self.forward[k]
        table, classes, s, end = a.table, a.classes, a.start, start
        for i in range(start, len(data)):
            s = table[s + classes[data[i]]]
            if s >= a.accepting:
                end = i + 1
            elif s == a.dead:
                break
        return end

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) by start, then by the order of the rules."""
        spans = []
        for k, marks in enumerate(self.starts(data)):
            rule, at = self.rules[k], 0
            for start in reversed(marks):
                if start < at:
                    continue
                at = self.longest(k, data, start)
                if (self._value(data[start:at]) if rule.of_value else at - start) >= rule.least:
                    spans.append((start, k, at))
        return sorted(spans)

    @staticmethod
    def _value(match: bytes) -> int:
        """Length of what follows the operator, blanks and an opening quote."""
        operator = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
        value = match[operator + 1 :].lstrip(b" ")
        return len(value) - value.startswith((b'"', b"'"))


@lru_cache
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def code_points(data: bytes, text_is_ascii: bool, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points instead of bytes."""
    if text_is_ascii or not spans:
        return spans
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=before[1:])
    return [(int(before[s]), k, int(before[e])) for s, k, e in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep_text: bool = False) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for each row; a map without a shuffle.

    keep_text adds the redacted text: every span, overlapping ones joined, becomes "[secret]". start and end are code
    points of the original text, end exclusive.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))] + ([("redacted", pa.string())] if keep_text else []))

    scanner = compiled(rules)  # on the driver; its size depends on the rules alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for text in batch.column(1).to_pylist():
                data = text.encode()
                spans = code_points(data, text.isascii(), scanner.find(data))
                found.append([{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans])
                if keep_text:
                    texts.append(redact(text, spans))
            columns = [batch.column(0), pa.array(found, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if keep_text else []), schema=schema)

    ddl = "doc_id long, spans array<struct<kind:string,start:int,end:int>>" + (", redacted string" if keep_text else "")
    return whole_texts(docs, id_col, text_col).mapInArrow(run, ddl)


def redact(text: str, spans: list[tuple[int, int, int]], by: str = "[secret]") -> str:
    """text with each covered run replaced."""
    parts, at, end = [], 0, -1
    for s, _, e in spans:
        if s > end:
            if end >= 0:
                parts += [by]
            parts.append(text[max(at, 0) : s])
        at = end = max(end, e)
    return "".join(parts) + (by if end >= 0 else "") + text[max(at, 0) :]


def redacted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in text_col replaced; nulls stay null, all other columns as they are."""
    scanner, at = compiled(rules), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                data = (text or "").encode()
                found = scanner.find(data)
                texts.append(redact(text, code_points(data, text.isascii(), found)) if found else text)
            tidy()
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def joined(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns of scan() over all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
