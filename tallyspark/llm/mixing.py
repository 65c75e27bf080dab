"""Mixing sources to target weights by weighted fair queueing.

Everything here is DataFrame functions; no Python runs on the executors.

Each source is a queue of its documents in shuffled order, which starts anew when it has been served
(up to ``MAX_COPIES`` times). A document's virtual finish time is the words of its source up to its
end, divided by the source's target; sorted by finish times all queues advance together, each at the
rate of its target, and the mix is what comes before the budget is used. A document longer than a
small part of its source's target is served in packets of whole words, so that no long document
keeps a source from its target; the budget's last packet is cut.

Sums over ranges are two sums: of rows within a range of equal size, and of the ranges before. The
ranges are intervals of a hash (within a source) and of virtual time (of the mix), so that they don't
depend on samples, on the number of tasks or on lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.plans.session import materialize
from tallyspark.plans.tables import table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: How often a document is taken at most.
MAX_COPIES = 3
#: A packet has at most this part of its source's target, and needs no fewer words than ``LEAST_PACKET``.
PACKET_SHARE = 1 / 1024
LEAST_PACKET = 64
#: Rows of a range, about.
RANGE_ROWS = 20_000
#: Ranges up to this count are broadcast (under 100 bytes each), else joined by shuffle.
BROADCAST_ROWS = 100_000
SPACES = "[ \\t-\\r]+"


def n_words(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The totals (key, source_size) with each source's weight and target; one row a source, ordered by key in one task.

    Targets share the sum of all sizes by weight, but none is above ``max_copies`` times its source's
    size; the rest is shared by the others. In the order of size over weight the sources that stop are
    the first ones, and the others' share of a weight is the greatest that any place gives.
    """
    every = W.orderBy("key")
    ranked = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(every) - 1) % len(weights) + 1))
    by_room = W.orderBy(F.col("source_size") / F.col("weight"), "key")
    stopped = F.coalesce(F.sum("source_size").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * max_copies
    level = (F.sum("source_size").over(W.partitionBy()) - stopped) / F.sum("weight").over(by_room.rowsBetween(W.currentRow, W.unboundedFollowing))
    shared = ranked.withColumn("level", level).withColumn("level", F.max("level").over(W.partitionBy()))
    return shared.withColumn("target", F.least(F.col("source_size") * F.lit(float(max_copies)), F.col("weight") * F.col("level"))).drop("level")


def _before(rows: DataFrame, amount: str, by: str, within: list[str]) -> DataFrame:
    """``within`` and the sum of ``amount`` of all smaller ranges ``by``."""
    sums = rows.groupBy(*within, by).agg(F.sum(amount).alias("range_sum"))
    place = W.partitionBy(*within).orderBy(by)
    return sums.select(*within, by, (F.sum("range_sum").over(place) - F.col("range_sum")).alias("range_start"))


def _ranges(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def queues(docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, key, part and start, the words of its source before it.

    The order within a source is that of md5 of seed and doc_id (of the text where there is no id),
    so that it is the same in every run; rows that share all of these are alike.
    """
    name = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))  # null goes last
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.coalesce("text", F.lit(""))))))
    sized = materialize(docs.select("doc_id", "source", size.alias("size"), name.alias("key"), shuffled.alias("h")), "mix-sizes")
    n_ranges = max(1, sized.count() // RANGE_ROWS)
    sized = sized.withColumn("part", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * n_ranges, 32))
    sources = materialize(targets(sized.groupBy("key").agg(F.sum("size").alias("source_size")), weights, max_copies), "mix-sources")
    starts = materialize(_before(sized, "size", "part", ["key"]).join(sources, "key"), "mix-starts")
    placed = sized.join(_ranges(starts), ["key", "part"])
    inner = W.partitionBy("key", "part").orderBy("h", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.col("range_start") + F.sum("size").over(inner) - F.col("size")
    return placed.select("doc_id", "source", "size", "source_size", "target", "key", "part", start.alias("start"), F.lit(n_ranges).alias("n_ranges"))


def sequence(queued: DataFrame, budget: int | None = None) -> DataFrame:
    """The mix, one row per packet that is taken, whole or in part.

    key, doc_id, copy (from 0), skip (words of the document before the packet), finish (virtual
    time), at (words of the mix before the packet), taken (its words in the mix). ``budget``: words of
    the mix; by default the sum of all sizes, which the targets share.
    """
    packet = F.greatest(F.lit(LEAST_PACKET), F.floor(F.col("target") * PACKET_SHARE)).cast("long")
    full = queued.where("size > 0").withColumn("packet", packet)
    # what starts at the target or later finishes after all that the budget has room for
    copies = F.ceil((F.col("target") - F.col("start")) / F.col("source_size")).cast("int")
    each = full.where(copies > 0).select("*", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / F.col("packet")).cast("int"))).alias("piece"))
    skip = F.col("piece") * F.col("packet")
    words = F.least(F.col("packet"), F.col("size") - skip)
    served = F.col("copy") * F.col("source_size") + F.col("start") + skip
    timed = each.select("key", "doc_id", "copy", skip.alias("skip"), words.alias("words"), (served + words).alias("served"), ((served + words) / F.col("target")).alias("finish"), "n_ranges", (served < F.col("target")).alias("needed"))
    timed = timed.where("needed").withColumn("slot", F.least(F.floor(F.col("finish") * F.col("n_ranges")), F.col("n_ranges")).cast("long")).drop("needed", "n_ranges")
    earlier = materialize(_before(timed, "words", "slot", []), "mix-slots")
    mixed = timed.join(_ranges(earlier), "slot")
    inner = W.partitionBy("slot").orderBy("finish", "key", "served").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = F.col("range_start") + F.sum("words").over(inner) - F.col("words")
    total = F.lit(budget).cast("long") if budget is not None else None
    if total is None:
        sums = queued.groupBy("key").agg(F.max("source_size").alias("s")).agg(F.coalesce(F.sum("s"), F.lit(0))).first()
        total = F.lit(sums[0]).cast("long")
    cut = mixed.withColumn("at", at).withColumn("taken", F.least(F.col("words"), total - F.col("at")))
    return cut.where("taken > 0").select("key", "doc_id", "copy", "skip", "finish", "at", "taken")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each document.

    The mix takes the first words of each queue, so that their number for each source, counted in the
    mix, gives what it takes of each document. Null and empty texts have size 0 and nothing is taken
    of them; sources without words have target 0; null is a source of its own, the last. Repeated
    rows are documents of their own; rows without an id are ordered by their texts. Other columns are
    ignored, whatever their names. An empty table gives no row.
    """
    queued = materialize(queues(docs, n_words(F.col("text")), weights, max_copies, seed), "mix-queues")
    served = sequence(queued).groupBy("key").agg(F.sum("taken").alias("of_source"))
    by_range = materialize(queued.select("key", "part").distinct().join(served, "key", "left"), "mix-served")
    left = F.coalesce("of_source", F.lit(0)) - F.col("start")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), left - c * F.col("source_size"))) for c in range(1, max_copies)), F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return queued.join(_ranges(by_range), ["key", "part"]).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce('0' || source, '1') AS key, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), ':' || coalesce(text, ''))) AS h,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS DOUBLE) AS weight FROM d GROUP BY key),
l AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / sum(weight) OVER (ORDER BY source_size / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT key, source_size, least(source_size * 3.0::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
q AS (SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY key ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d JOIN t USING (key)),
c AS (SELECT *, greatest(64, CAST(floor(target / 1024) AS BIGINT)) AS packet, unnest([0, 1, 2]) AS copy FROM q WHERE size > 0),
p AS (SELECT *, unnest(range(0, size, packet)) AS skip FROM c),
e AS (SELECT key, least(packet, size - skip) AS words, copy * source_size + start + skip AS served, target FROM p),
f AS (SELECT key, words, served, (served + words) / target AS finish FROM e WHERE served < target),
a AS (SELECT *, sum(words) OVER (ORDER BY finish, key, served ROWS UNBOUNDED PRECEDING) - words AS place FROM f),
w AS (SELECT key, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - place))) AS w FROM a GROUP BY key)
SELECT doc_id, source, size, source_size, target, CAST(greatest(0, least(size, coalesce(w, 0) - start)) + greatest(0, least(size, coalesce(w, 0) - start - source_size))
  + greatest(0, least(size, coalesce(w, 0) - start - 2 * source_size)) AS BIGINT) AS taken FROM q LEFT JOIN w USING (key)
"""
