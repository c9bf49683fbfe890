"""Change orders on a plate: revision A of a specification, the order's text, and reading it back."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import let, short_number
from plumbline.sources import specs as source

# Fields that an order may change, their labels and tolerances in mm; header and footer of an order;
# shares by which revision A departs, how often it is drawn; calls of the model and how they are read.
LABELS = {
    "length": "overall length (X)",
    "width": "overall width (Y)",
    "thickness": "plate thickness (Z)",
    "hole_diameter": "hole diameter",
    "edge_margin": "edge margin (hole centre to nearest edges)",
}
TOLERANCES = {"length": 0.5, "width": 0.5, "thickness": 0.5, "hole_diameter": 0.2, "edge_margin": 0.5}
HEADER = "ENGINEERING CHANGE ORDER, rev A -> rev B:"
FOOTER = "Every other characteristic stays exactly as in rev A"
SHARES, LEAST, TRIES, AGREE = (0.1, 0.15, 0.2, 0.25), 0.5, 200, 1e-6
NUMBER = r"(\d+(?:\.\d+)?)"
CALLS = {
    "box": rf"\.box\(\s*{NUMBER}\s*,\s*{NUMBER}\s*,\s*{NUMBER}\s*\)",
    "rect": rf"\.rect\(\s*{NUMBER}\s*,\s*{NUMBER}\s*,\s*forConstruction=True\s*\)",
    "hole": rf"\.hole\(\s*{NUMBER}\s*\)",
}
FIELDS = tuple(LABELS)


def drawn(key: str, values: dict[str, float], tries: int = TRIES) -> Iterator[dict[str, float]]:
    """The departures that Python's generator draws for a key, one after the other; the order of draws fixes them."""
    rng = random.Random(zlib.crc32(key.encode()))
    for _ in range(tries):
        out = dict(values)
        for name in rng.sample(FIELDS, rng.choice((1, 2))):
            sign = rng.choice((-1, 1))
            out[name] = max(LEAST, round((values[name] + sign * rng.choice(SHARES) * values[name]) * 2) / 2)
        yield out


def revision_a(specs: DataFrame) -> DataFrame:
    """specs with a_<field>: the first drawn departure that is feasible and visible beyond the tolerances.

    The generator runs once a row and gives all its tries as rows; which of them serve is told by the same expressions as
    for specs. A spec without such a try stops the query.
    """
    names = ["id", "try", *(f"a_{f}" for f in FIELDS)]

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [(r["id"], n, *(t[f] for f in FIELDS)) for r in rows for n, t in enumerate(drawn(f"edit:{r['id']}", r))]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=names)

    ddl = "id string, try long, " + ", ".join(f"a_{f} double" for f in FIELDS)
    every = specs.select("id", *FIELDS).mapInArrow(tries, ddl)
    serves = every.select("id", "try", *(F.col(f"a_{f}").alias(f) for f in FIELDS)).filter(source.feasible()).select("id", "try", *(F.col(f).alias(f"a_{f}") for f in FIELDS))
    serves = serves.join(specs.select("id", *FIELDS), "id").filter(source.moved(TOLERANCES))
    first = serves.groupBy("id").agg(F.min_by(F.struct(*(f"a_{f}" for f in FIELDS)), "try").alias("a"))
    found = specs.join(first, "id", "left")
    sure = F.when(F.col("a").isNotNull(), F.col("a.a_length")).otherwise(F.raise_error(F.concat(F.lit("no feasible revision A of "), F.col("id"))).cast("double"))
    return found.withColumns({f"a_{f}": F.col(f"a.a_{f}") for f in FIELDS} | {"a_length": sure}).drop("a")


def order_lines(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """A line for each field that moves, in the order of the fields."""
    one = lambda f: F.concat(F.lit(f"  - change {LABELS[f]} from "), short_number(old[f]), F.lit(" mm to "), short_number(new[f]), F.lit(" mm"))
    return F.array_join(F.array_compact(F.array(*(F.when(old[f] != new[f], one(f)) for f in FIELDS))), "\n")


def read_order(text: Column) -> Column:
    """struct(L, W, T, PX, PY, D, failure) of what an order asks for; a failure leaves the numbers null.

    The model's box, rectangle and hole must each be called once; both margins that follow must agree. Lines are applied
    in their order, each only if its old value is the present one; the first that can't be is the failure.
    """

    def of_model(m: Column) -> Column:
        start = F.create_map(*(x for f, v in zip(FIELDS, (m["length"], m["width"], m["thickness"], m["hole"], m["mx"]), strict=True) for x in (F.lit(LABELS[f]), v)))
        folded = F.aggregate(m["lines"], F.struct(start.alias("v"), F.lit(None).cast("string").alias("why")), apply)
        return let(folded, lambda state: outcome(m, state))

    def apply(state: Column, line: Column) -> Column:
        read = F.struct(*(F.regexp_extract(line, form, n).alias(c) for n, c in ((1, "label"), (2, "old"), (3, "new"))))

        def one(r: Column) -> Column:
            label, old, new = r["label"], r["old"].try_cast("double"), r["new"].try_cast("double")
            now = F.try_element_at(state["v"], label)
            why = F.when(label == "", F.concat(F.lit("unrecognised change line '"), F.trim(line), F.lit("'"))).when(
                F.abs(now - old) > AGREE, F.concat(label, F.lit(" is "), short_number(now), F.lit(" mm before this change, not "), short_number(old), F.lit(" mm"))
            )
            return let(why, lambda w: F.struct(F.transform_values(state["v"], lambda k, x: F.when((k == label) & w.isNull(), new).otherwise(x)).alias("v"), w.alias("why")))

        return F.when(state["why"].isNotNull(), state).otherwise(let(read, one))

    def outcome(m: Column, state: Column) -> Column:
        calls = [F.when(m[f"n_{name}"] != 1, F.concat(F.lit(f"expected one .{name}() call in rev A, found "), m[f"n_{name}"].cast("string"))) for name in CALLS]
        apart = F.concat(F.lit("rev A edge margin differs between X ("), short_number(m["mx"]), F.lit(") and Y ("), short_number(m["my"]), F.lit(")"))
        failure = F.coalesce(
            F.when(~m["coded"], F.lit("no rev A code block")), *calls, F.when(F.abs(m["mx"] - m["my"]) > AGREE, apart), F.when(~m["ended"], F.lit("the change order has no end")),
            F.when(F.size(m["lines"]) == 0, F.lit("the change order lists no change")), state["why"],
        )
        v = {f: F.element_at(state["v"], F.lit(LABELS[f])) for f in FIELDS}
        numbers = {"L": v["length"], "W": v["width"], "T": v["thickness"], "PX": v["length"] - 2 * v["edge_margin"], "PY": v["width"] - 2 * v["edge_margin"], "D": v["hole_diameter"]}
        return let(failure, lambda why: F.struct(*(F.when(why.isNull(), x).alias(n) for n, x in numbers.items()), why.alias("failure")))

    def of_text(t: Column) -> Column:
        after = F.substring_index(t, HEADER, -1)
        lines = F.filter(F.split(F.substring_index(after, FOOTER, 1), "\n"), lambda x: ~x.rlike(r"^\s*$"))

        def of_code(code: Column) -> Column:
            get = lambda call, n: F.regexp_extract(code, CALLS[call], n).try_cast("double")
            hits = [F.size(F.regexp_extract_all(code, F.lit(p), F.lit(0))).alias(f"n_{name}") for name, p in CALLS.items()]
            length, width = get("box", 1), get("box", 2)
            return F.struct(
                (code != "").alias("coded"), *hits, length.alias("length"), width.alias("width"), get("box", 3).alias("thickness"), get("hole", 1).alias("hole"),
                ((length - get("rect", 1)) / 2).alias("mx"), ((width - get("rect", 2)) / 2).alias("my"), lines.alias("lines"), F.contains(after, F.lit(FOOTER)).alias("ended"),
            )

        return let(let(F.regexp_extract(t, r"(?s)```python\n(.*?)```", 1), of_code), of_model)

    form = r"^  - change (" + "|".join(re.sub(r"([()])", r"\\\1", label) for label in LABELS.values()) + rf") from {NUMBER} mm to {NUMBER} mm$"
    return let(text, of_text)


def is_order(text: Column) -> Column:
    """Other prompts are for the table reader (`prompts.from_labels`)."""
    return F.contains(text, F.lit(HEADER))
