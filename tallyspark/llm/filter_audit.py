"""Interaction of filters over all their orders, from the masks of what each document fails.

A document's mask says which of the five filters it fails; what an order of the filters removes at
which step depends on the masks alone. Each part and label gives 32 parity sums: the sum over its
documents of -1 to the number of failed filters within a subset, for each of the 32 subsets. These
are the Walsh-Hadamard transform of the numbers of documents by mask, in whole numbers, and the
transform, applied once more and divided by 32, gives these numbers back exactly. From the 32 cells
of a part follow all steps of all 120 orders. In 120/k of the orders a filter is the first among the k
that a document fails, so that the sum over all orders of what it removes is a sum over cells.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.plans.session import materialize
from tallyspark.plans.tables import table

FILTERS = "ABCDE"
N_MASKS = 1 << len(FILTERS)
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
SPACES = "[ \\t-\\r]+"


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: part, mask (bit k: fails the filter of letter k), good, toxic.

    That a text is the first of its copies is told by (id, digest) of each text's least id, and those
    meet documents by both, so that no text's copies come together. Rows without an id are no copies
    of others nor others of theirs; rows that share id and text don't count as copies of each other.
    A document is good or toxic if any of its labels says so.
    """
    text = F.coalesce("text", F.lit(""))
    ws = F.array_remove(F.split("t", SPACES), "")
    letters = F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("t"), F.sha2(text, 256).alias("digest"))
    counted = read.select("doc_id", "part", "digest", ws.alias("ws"), (100 * letters > 5 * F.length("t")).alias("C"), F.col("t").rlike("[#$%&*|]").alias("D"))
    n, distinct = F.size("ws"), F.size(F.array_distinct("ws"))
    fails = counted.select("doc_id", "part", "digest", (n < 50).alias("A"), (100 * distinct < 65 * n).alias("B"), "C", "D")
    told = materialize(fails, "audit-fails")
    firsts = told.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    both = told.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copy = (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E")
    flags = both.select("part", "A", "B", "C", "D", copy, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    mask = sum(F.when(F.col(f), 1 << k).otherwise(0) for k, f in enumerate(FILTERS))
    return flags.select("part", mask.alias("mask"), "good", "toxic")


def _sign(subset: int) -> Column:
    """1 or -1 of a row's mask: the parity of the bits that both have."""
    return F.lit(1) - F.lit(2) * F.bit_count(F.col("mask").bitwiseAND(subset)).bitwiseAND(1)


def _signs(m: int) -> Column:
    """The signs of mask ``m`` for all subsets."""
    return F.array(*[F.lit((-1) ** (m & s).bit_count()) for s in range(N_MASKS)])


def parity_sums(masked: DataFrame) -> DataFrame:
    """part, good, toxic and sums: for each of the 32 subsets of filters the documents' signs, summed."""
    sums = [F.sum(_sign(s)).alias(f"s{s}") for s in range(N_MASKS)]
    return masked.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(N_MASKS)]).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """part and three arrays of 32 numbers of documents, by mask: all, good and toxic ones."""
    signed = [F.aggregate(F.zip_with("sums", _signs(m), lambda v, sign: v * sign), F.lit(0).cast("long"), lambda a, v: a + v) for m in range(N_MASKS)]
    inverted = sums.select("part", "good", "toxic", F.array(*[F.shiftright(c, len(FILTERS)) for c in signed]).alias("n"))
    one = [F.col("n")[m] for m in range(N_MASKS)]
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    parts = inverted.groupBy("part").agg(*[F.sum(F.when(on, c).otherwise(0)).alias(f"{k}{m}") for k, on in kinds.items() for m, c in enumerate(one)])
    return parts.select("part", *[F.array(*[f"{k}{m}" for m in range(N_MASKS)]).alias(k) for k in kinds])


def steps(counts: DataFrame) -> DataFrame:
    """The 600 steps of each part's 120 orders, evaluated over its 32 cells."""
    orders = counts.select("part", "n", "good", "toxic", F.explode(F.array(*[F.lit(o) for o in ORDERS])).alias("filter_order"))
    each = orders.select("*", F.explode(F.array(*[F.lit(k + 1) for k in range(len(FILTERS))])).alias("step"))
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), F.instr(F.lit(FILTERS), F.substr("filter_order", F.col("step"), F.lit(1))))
    earlier = sum(F.when(F.instr("filter_order", f) < F.col("step"), 1 << k).otherwise(0) for k, f in enumerate(FILTERS))
    at = each.select("*", bit.alias("bit"), earlier.alias("before"))

    def over(values: str, when) -> Column:
        weighed = F.transform(values, lambda v, m: v * when(m))
        return F.aggregate(weighed, F.lit(0).cast("long"), lambda a, v: a + v)

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    one = lambda c: c.cast("long")
    removed = lambda m: one(fails(m) & ~gone(m))
    share = lambda m: F.when(fails(m), F.floor(F.lit(len(ORDERS)) / F.bit_count(m))).otherwise(0).cast("long")
    return at.select(
        "part", "filter_order", "step",
        over("n", lambda m: one(~fails(m) & ~gone(m))).alias("kept"),
        over("n", removed).alias("removed"),
        over("n", lambda m: one(fails(m) & gone(m))).alias("redundant"),
        over("n", lambda m: one(m == F.col("bit"))).alias("unique_fails"),
        over("good", removed).alias("good_lost"),
        over("toxic", removed).alias("toxic_lost"),
        over("n", share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    A null source belongs to the part of the empty one, null texts are empty and fail A only (and E,
    as copies). Other columns of the tables are ignored, whatever their names. Labels without a
    document count nowhere. No documents give no parts and no rows.
    """
    return steps(cells(parity_sums(masks(docs, labels))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS ws FROM documents),
m AS (SELECT t, min(doc_id) AS least_id FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws),
  'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > least_id, false)} AS x
  FROM d JOIN m USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, concat(if(x.A, 'A', ''), if(x.B, 'B', ''), if(x.C, 'C', ''), if(x.D, 'D', ''), if(x.E, 'E', '')) AS fails FROM f),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS ngood, count(*) FILTER (toxic) AS ntoxic FROM c GROUP BY part, fails),
y AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS y),
o AS (SELECT a.y || b.y || c.y || d.y || e.y AS filter_order FROM y a, y b, y c, y d, y e WHERE len(list_distinct([a.y, b.y, c.y, d.y, e.y])) = 5),
s AS (SELECT filter_order, step, filter_order[step : step] AS y, substring(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
z AS (SELECT part, filter_order, step, y, n, ngood, ntoxic, fails, contains(fails, y) AS fails_it, before <> '' AND regexp_matches(fails, '[' || before || '0]') AS gone FROM s, g),
r AS (SELECT part, filter_order, step, y, CAST(sum(n) FILTER (NOT fails_it AND NOT gone) AS BIGINT) AS kept, CAST(sum(n) FILTER (fails_it AND NOT gone) AS BIGINT) AS removed,
  CAST(sum(n) FILTER (fails_it AND gone) AS BIGINT) AS redundant, CAST(sum(n) FILTER (fails = y) AS BIGINT) AS unique_fails,
  CAST(sum(ngood) FILTER (fails_it AND NOT gone) AS BIGINT) AS good_lost, CAST(sum(ntoxic) FILTER (fails_it AND NOT gone) AS BIGINT) AS toxic_lost FROM z GROUP BY part, filter_order, step, y)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
  coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, y) AS BIGINT) AS shapley FROM r
"""
