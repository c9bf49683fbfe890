"""Queries: extraction, normalisation, labels by ordered rules, loops, conversations, JSON presence."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import changes, prompts, text
from plumbline.plans.registry import register, table


@register(
    """SELECT doc_id, CASE WHEN text LIKE '%```%' THEN 'fenced' WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 'phone' WHEN regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') THEN 'mail'
    WHEN length(text) < 200 THEN 'short' ELSE 'other' END AS label FROM documents"""
)
def first_match_label(spark, d):
    t = F.col("text")
    rules = [("fenced", t.contains("```")), ("phone", t.rlike("[0-9]{3}-[0-9]{4}")), ("mail", t.rlike("[a-z0-9.]+@[a-z0-9.]+")), ("short", F.char_length(t) < 200)]
    return table(spark, d, "documents").select("doc_id", text.first_match(rules, "other").alias("label"))


@register()
def fenced_extract(spark, d):
    """Every document; SQL can't express dedent, tests hold it against textwrap.dedent."""
    return table(spark, d, "documents").select("doc_id", F.sha2(text.code_of(F.col("text")), 256).alias("code"))


@register()
def fenced_extract_all(spark, d):
    """Every turn of every conversation."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(text.code_of(F.col("text")), 256).alias("code"))


NORMALISED = r"""SELECT doc_id, left(regexp_replace(text, '[\p{C}\p{Z}]', ' ', 'g'), 300) AS cleaned,
    left(regexp_replace(text, '^[\p{L}\p{M}\p{N}_]*(Error|Exception): ?', ''), 80) AS core FROM documents"""


@register(NORMALISED)
def normalise_error(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_error(F.col("text")).alias("cleaned"), text.error_core(F.col("text")).alias("core"))


@register(NORMALISED.replace("doc_id", "conv_id, turn").replace("documents", "conversations"))
def normalise_error_all(spark, d):
    """Every turn of every conversation."""
    return table(spark, d, "conversations").select("conv_id", "turn", text.clean_error(F.col("text")).alias("cleaned"), text.error_core(F.col("text")).alias("core"))


@register("SELECT event_id, CAST(nullif(regexp_extract(props, '\"k\"[^0-9\\-]{0,3}(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS number FROM events")
def number_extract(spark, d):
    return table(spark, d, "events").select("event_id", text.number_after(F.col("props"), '"k"').alias("number"))


@register("SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.missing') AS has_missing, coalesce(CAST(props->>'$.k' AS BIGINT), -1) AS k FROM events")
def json_presence_defaults(spark, d):
    rows = table(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    has = lambda name: F.coalesce(F.array_contains(F.json_object_keys("props"), name), F.lit(False))
    return rows.select("event_id", has("k").alias("has_k"), has("missing").alias("has_missing"), F.coalesce(F.try_variant_get("v", "$.k", "long"), F.lit(-1)).alias("k"))


@register("SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS flat FROM conversations GROUP BY conv_id")
def conversation_flatten(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    flat = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return rows.select("conv_id", F.size("t").cast("long").alias("turns"), F.sha2(flat, 256).alias("flat"))


@register(
    """WITH d AS (SELECT doc_id, right(text, 1500) AS t FROM documents),
    x AS (SELECT *, right(regexp_replace(t, '\\s+$', ''), 24) AS probe, list_filter(list_transform(string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) >= 6) AS lines FROM d),
    y AS (SELECT *, coalesce(list_max(map_values(list_histogram(lines))), 0) AS most FROM x)
    SELECT doc_id, length(t) >= 200 AND (length(regexp_replace(t, '\\s', '', 'g')) <= 0.2::DOUBLE * length(t) OR most >= 6 OR
    (length(regexp_replace(probe, '\\s', '', 'g')) >= 12 AND (length(t) - length(replace(t, probe, ''))) / nullif(length(probe), 0) >= 6)) AS looping FROM y"""
)
def degenerate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.degenerate(F.col("text")).alias("looping"))


@register()
def stable_pick(spark, d):
    return table(spark, d, "documents").select("doc_id", text.stable_pick(F.col("doc_id").cast("string"), 3).cast("int").alias("pick"))


@register(
    """SELECT lang, count(DISTINCT md5(text)) AS exact, count(DISTINCT md5(regexp_replace(text, '[0-9]+', 'N', 'g'))) AS numbers_normalised,
    round(avg(n_chars), 4) AS mean_chars, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY ALL"""
)
def structure_diversity(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count_distinct(F.md5(t)).alias("exact"),
        F.count_distinct(F.md5(F.regexp_replace(t, "[0-9]+", "N"))).alias("numbers_normalised"),
        F.round(F.avg("n_chars"), 4).alias("mean_chars"),
        F.min("n_chars").alias("low"),
        F.max("n_chars").alias("high"),
    )


@register("SELECT page_id, list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)).len() AS links FROM pages")
def link_scan(spark, d):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("links"))


@register(
    """SELECT conv_id, sha256(coalesce(string_agg(text, chr(10) ORDER BY turn, role, text) FILTER (WHERE turn % 4 <> 3), '')) AS flat FROM conversations GROUP BY conv_id"""
)
def completion_flatten(spark, d):
    """Conversations as completions in JSON, with strings, content blocks and messages without text, flattened."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", (F.col("turn") % 4).alias("form"))
    said = F.to_json(F.struct("role", F.col("text").alias("content")))
    blocks = F.to_json(F.struct("role", F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")))
    none = F.to_json(F.struct("role", F.lit(7).alias("content")))
    message = F.when(F.col("form") == 1, blocks).when(F.col("form") == 3, none).otherwise(said)
    made = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", message.alias("m")))).alias("t"))
    completion = F.concat(F.lit("["), F.array_join(F.transform("t", lambda x: x["m"]), ","), F.lit("]"))
    return made.select("conv_id", F.sha2(prompts.completion_text(F.parse_json(completion)), 256).alias("flat"))


@register(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity + 60 AS a, l_quantity + 40 AS b, l_discount * 100 + 2 AS m, l_tax * 100 AS t, l_linenumber AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN n <> 5 THEN a + n END AS new_length, CASE WHEN n <> 5 THEN round(a + n - 2 * CASE WHEN n = 3 THEN m + 1 ELSE m END, 6) END AS new_pitch,
      CASE WHEN n = 5 THEN 'plate thickness (Z) is 4 mm before this change, not 9 mm' END AS failure FROM l"""
)
def change_order_fold(spark, d):
    """A change order for every line item: a new length, for some a new margin, for some a change that doesn't apply."""
    c, n = F.col, F.col("l_linenumber")
    a, b, m = c("l_quantity") + 60, c("l_quantity") + 40, F.round(c("l_discount") * 100 + 2, 6)
    short = text.short_number
    model = F.concat(F.lit("```python\n.box("), short(a), F.lit(", "), short(b), F.lit(", 4).rect("), short(a - 2 * m), F.lit(", "), short(b - 2 * m), F.lit(f", forConstruction=True).hole(5)\n```\n{changes.HEADER}\n"))
    line = lambda f, old, new: F.concat(F.lit(f"  - change {changes.LABELS[f]} from "), old, F.lit(" mm to "), new, F.lit(" mm\n"))
    more = F.when(n == 3, line("edge_margin", short(m), short(m + 1))).when(n == 5, line("thickness", F.lit("9"), F.lit("5"))).otherwise("")
    order = F.concat(model, line("length", short(a), short(a + n)), more, F.lit(changes.FOOTER))
    read = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", changes.read_order(order).alias("r"))
    return read.select("l_orderkey", "l_linenumber", c("r.L").alias("new_length"), F.round("r.PX", 6).alias("new_pitch"), c("r.failure").alias("failure"))
