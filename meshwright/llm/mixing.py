"""Mixing sources to target weights, with DataFrame functions alone.

Method: capped water-filling. Sources share the whole by weight; a source
stops at ``max_epochs`` times its size and what it can't take is reshared by
weight among the others. A document is then taken ``floor(target / size of its
source)`` times, and once more if it comes early enough in a seeded order.

Closed form of the resharing: with sources ordered by cap over weight, the
level is (total - caps before j) / (weights from j on) at the first j whose cap
isn't below its share.

Plan: one scan makes sums per source and hash range (combined before the
shuffle, a few rows each); the hash range in which a source's rest ends is
looked at row by row; the last scan decides each document by comparing its
place in the order with its source's threshold. Texts are never shuffled and a
source's rows never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.plans.recovery import written

from .columns import Columns

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
NEW = ("size", "source_size", "target", "copies")
#: The order key has 60 bits; its top bits number the hash range, 4096 to a source.
KEY_BITS, RANGE_BITS = 60, 12


def name_of(doc_id: Column, text: Column) -> Column:
    """A document's name: its id, or without one the MD5 of its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")))))


def order_key(name: Column, seed: int) -> Column:
    """Pseudo-random but reproducible place of a document, the same in any engine with MD5."""
    text = F.concat(F.lit(f"{seed}:"), name)
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size), one row each: target, as a double.

    Sources are ranked by code point, null last, and weigh ``weights`` in turn. The table holds a row per source, so
    the ranking is one small task. Sizes of 0 give targets of 0; an empty table gives no rows.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    w = sources.withColumn("_rank", rank).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("_cap", F.col("source_size") * max_epochs).withColumn("_total", F.sum("source_size").over(everything))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("_level", (F.col("_total") - before) / rest)
    fits = F.col("_level") * F.col("_w") <= F.col("_cap")
    w = w.withColumn("_place", F.row_number().over(fill))
    level = F.min(F.when(fits, F.struct("_place", "_level"))).over(everything)["_level"]
    return w.withColumn("_final", level).select("source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_final") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` plus size, source_size, target and copies, the times that the mix takes the row.

    Size is the number of words; a null text has 0. A source's sum of size * copies differs from its target by half a
    document at most. A null source is a source of its own, ranked last. Rows with equal doc_id and size get the same
    copies (ties are taken together); rows without an id go by their texts. Whole texts are counted. An empty table
    gives no rows. If ``docs`` has columns by the four new names, they are replaced; all others stay, whatever their
    names.
    """
    given = Columns(docs, NEW)
    source, text = given["source"].cast("string"), given["text"].cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    own = name_of(given["doc_id"], text)
    wide = given.rows.select(*given.kept(), name.alias("_s"), order_key(own, seed).alias("_key"), own.alias("_id"), size.alias("size"))
    narrow = wide.select("_s", "_key", "_id", F.col("size").alias("_size"))
    shift = KEY_BITS - RANGE_BITS
    ranges = narrow.groupBy("_s", F.shiftright("_key", shift).alias("_range")).agg(F.sum("_size").alias("_sum"))
    sources = ranges.groupBy("_s").agg(F.sum("_sum").alias("source_size"))
    named = sources.select(F.when(F.col("_s") != "n", F.substring("_s", 2, 1 << 30)).alias("source"), "source_size")
    t = targets(named, weights, max_epochs).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_s"), "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = t.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    upto = F.sum("_sum").over(Window.partitionBy("_s").orderBy("_range"))
    ends = ranges.join(t, "_s").withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_rest"))
    ends = ends.groupBy("_s").agg(F.min(F.struct("_range", (F.col("_upto") - F.col("_sum")).alias("before"))).alias("_e"))
    t = t.join(ends, "_s", "left").select("_s", "source_size", "target", "_whole", "_rest", F.col("_e._range").alias("_range"), F.col("_e.before").alias("_before"))
    # written, the table's size is known: a small one is broadcast by the planner, a large one joined by a shuffle
    t = written(t, "source-targets")
    edge = narrow.join(t.select("_s", "_range", "_before", "_rest"), "_s").filter(F.shiftright("_key", shift) == F.col("_range"))
    order = Window.partitionBy("_s").orderBy(F.struct("_key", "_id", "_size")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct("_key", "_id", "_size")
    inside = edge.withColumn("_upto", F.col("_before") + F.sum("_size").over(order)).filter(2 * F.col("_upto") - F.col("_size") <= 2 * F.col("_rest"))
    last = inside.groupBy("_s").agg(F.max(place).alias("_last"))
    start = F.struct(F.shiftleft("_range", shift).alias("_key"), F.lit("").alias("_id"), F.lit(-1).cast("long").alias("_size"))
    t = written(t.join(last, "_s", "left").select("_s", "source_size", "target", "_whole", F.coalesce("_last", start).alias("_last")), "source-ends")
    out = wide.join(t, "_s", "left")
    once_more = F.struct("_key", "_id", F.col("size").alias("_size")) <= F.col("_last")
    copies = (F.col("_whole") + once_more.cast("long")).alias("copies")
    return given.named(out.withColumn("copies", copies), *NEW)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns, whatever their names.

    Null texts, null sources, repeated rows and empty tables are as in ``mix``; rows of no words are taken as often as
    the others of their source.
    """
    given = Columns(docs)
    # mix sees the columns under their positions but for the three it needs, so that nothing is replaced
    used = {given.at(c): c for c in ("doc_id", "text", "source")}
    counted = mix(given.rows.withColumnsRenamed(used), **how)
    again = counted.withColumnsRenamed({c: at for at, c in used.items()})
    times = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return given.named(again.select(*given.kept(), F.explode(times).alias("time")))
