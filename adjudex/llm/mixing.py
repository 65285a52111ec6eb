"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ONE_TASK, free_name, prefix_sums, saved, table, word_count

#: Within a source, documents of like size (the first eight bits of it) are dealt by hash into so many strands; a strand is what
#: one task sorts. Classes and strands bound the table of offsets whatever the number of documents.
STRANDS = 256


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def source_targets(totals: DataFrame, weights: tuple[int, ...], most: int, one_task: int = ONE_TASK) -> DataFrame:
    """From one row per source (`source`, `source_size`) to its `target`.

    Sources by code point, null last, weigh `weights`, repeating, and share the sum of all sizes. A target stops at `most` times
    its source's size; the excess is shared again by weight until none is above. That fixed point is a water level: sources
    filled first are those with the least room per unit of weight. Up to `one_task` sources are put in order by one task, more by
    ranges; the targets are the same. Empty table: empty.
    """
    figures = totals.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    spread = figures[0] > one_task
    cap = F.col("source_size").cast("double") * most
    filled = prefix_sums(totals, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long")}, spread)
    filled = filled.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", cap)
    filled = filled.withColumn("room", F.col("cap") / F.col("weight"))
    filled = saved(prefix_sums(filled, [F.col("room"), F.col("place")], {"order": F.lit(1).cast("long"), "cap_before": F.col("cap"), "weight_before": F.col("weight")}, spread), "filled")
    all_weight = filled.agg(F.sum("weight")).first()[0] or 0.0
    level = (F.lit(float(figures[1] or 0)) - F.col("cap_before")) / (F.lit(all_weight) - F.col("weight_before"))
    open_ = filled.withColumn("level", level).filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("order", "level")).alias("open")).first()["open"]
    target = F.col("cap") if open_ is None else F.when(F.col("order") < open_["order"], F.col("cap")).otherwise(F.lit(open_["level"]) * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """Every row of `docs` with `size`, `source_size`, `target` and `copies`, the times that the mix takes it.

    Each document of a source expects target / source_size copies. Documents stand within their source by size class, then by a
    hash of the id, so that the sample holds each size class's share; prefix sums of the expected copies plus one keyed offset per
    source give a copy for each integer crossed. Rank times rate is that prefix sum, so counts per strand are all that has to be
    carried between tasks: first over the classes of a source, then over the strands of a class, both of bounded number.
    Reruns agree. Needs columns doc_id, text, source; others pass through, and those named like the new ones are replaced.

    Null or empty text: size 0. A source without words has target 0 and gives no copies. Null source: a source of its own, last.
    Null doc_id: hashed as an empty text. Rows alike in doc_id and text are interchangeable and sampled one by one.
    Empty table: empty.
    """
    new = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c.lower() not in new]
    n = {c: free_name(docs, f"mix_{c}") for c in ("key", "size", "hash", "class", "strand", "rank", "before", "source_size", "target", "id", "text")}
    col = lambda c: F.col(n[c])
    source = F.col("source").cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], word_count(F.col("text")).alias(n["size"]), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias(n["key"]),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(n["id"]), F.xxhash64("text").alias(n["text"]))
    bits = F.length(F.bin(col("size")))
    rows = rows.withColumns({n["hash"]: _unit(F.concat(F.lit(f"{seed}:"), col("id"))), n["class"]: bits * 256 + F.expr(f"shiftright({n['size']}, greatest(length(bin({n['size']})) - 8, 0))")})
    rows = rows.withColumn(n["strand"], F.floor(col("hash") * STRANDS).cast("int"))

    place = [n["key"], n["class"], n["strand"]]
    strands = saved(rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.sum(n["size"]).alias("sum")), "strands")
    classes = strands.groupBy(n["key"], n["class"]).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    totals = classes.groupBy(n["key"]).agg(F.sum("sum").alias("source_size")).withColumn("source", F.when(col("key") != "n", F.substring(col("key"), 2, 1 << 30)))
    targets = source_targets(totals, weights, most)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias(n["key"]), F.col("source_size").alias(n["source_size"]), F.col("target").alias(n["target"]))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_class = classes.select(n["key"], n["class"], earlier(Window.partitionBy(n["key"]).orderBy(n["class"])).alias("class_before"))
    of_strand = strands.select(*place, earlier(Window.partitionBy(n["key"], n["class"]).orderBy(n["strand"])).alias("strand_before"))
    offsets = of_strand.join(of_class, [n["key"], n["class"]]).join(targets, n["key"]).withColumn(n["before"], F.col("class_before") + F.col("strand_before")).drop("class_before", "strand_before")

    rate = F.when(col("source_size") > 0, col("target") / col("source_size")).otherwise(0.0)
    rank = (col("before") + col("rank")).cast("double")
    start = _unit(F.concat(F.lit(f"{seed}:offset:"), col("key")))
    crossed = F.floor(rank * rate + start) - F.floor((rank - 1) * rate + start)
    inside = Window.partitionBy(*place).orderBy(n["hash"], n["id"], n["text"])
    out = rows.withColumn(n["rank"], F.row_number().over(inside)).join(offsets, place)
    return out.select(*[F.col(f"`{c}`") for c in kept], col("size").alias("size"), col("source_size").alias("source_size"), col("target").alias("target"), crossed.cast("long").alias("copies"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: the named columns of each row as many times as its `copies`. Null or no copies: not at all. Empty table: empty."""
    copy = free_name(mixed, "copy")
    return mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
h AS (SELECT *, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
  length(bin(size)) * 256 + (size >> greatest(length(bin(size)) - 8, 0)) AS c FROM d),
s AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM h GROUP BY k),
p AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
w AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS i,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before,
  sum(source_size) OVER ()::DOUBLE AS all_size, sum(weight) OVER () AS all_weight FROM w),
l AS (SELECT *, (all_size - cap_before) / (all_weight - weight_before) AS level FROM o),
f AS (SELECT min(i) AS first FROM l WHERE level * weight <= cap),
v AS (SELECT k, source_size, CASE WHEN first IS NULL OR i < first THEN cap ELSE (SELECT level FROM l JOIN f ON i = first) * weight END AS target FROM l CROSS JOIN f),
r AS (SELECT h.*, source_size, target, row_number() OVER (PARTITION BY h.k ORDER BY c, u, doc_id::VARCHAR)::DOUBLE AS rank,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('mix:offset:' || h.k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM h JOIN v ON h.k = v.k)
SELECT doc_id, size, source_size, target, ((floor(rank * rate + start) - floor((rank - 1) * rate + start)) * size)::BIGINT AS taken FROM r
"""
