"""Benchmark decontamination: size-partitioned MinHash containment search, then an exact check.

Everything here is DataFrame functions; no Python runs on the executors.

Short test items are searched inside long documents. Comparing whole signatures cannot work for
sets of such different size, so the item's MinHash minima (the ``k`` least shingle hashes) are
looked up among *all* shingles of each document. Items are partitioned by their number of
shingles ``n`` into classes of powers of two, which set ``k``; texts too short to hold the least item
are left out beforehand, and a document too short for an item doesn't meet it. An item contained to
the threshold ``t`` misses at most ``floor((1-t) n)`` shingles, so with ``k = floor((1-t) n) + need``
minima at least ``need`` must be found: the search loses nothing. Candidates are then verified on the
shingle texts themselves: a document's set is built once, cut to the shingles of its candidates, and
intersected with each of them inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.plans.session import materialize
from tallyspark.plans.tables import table

SHINGLE = 5
THRESHOLD = 0.8
#: Hits that a candidate must show at least, beyond the shingles it may miss.
NEED = 4
#: Items and candidates up to these counts are broadcast (40 bytes a row at most); more are shuffled.
BROADCAST_ROWS = 400_000
SEPARATORS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _hash(ws: Column, at: Column, width: int) -> Column:
    """The hash of the ``width`` words from ``at`` on; places up to a whole shingle count as null."""
    rest = [F.lit(None).cast("string")] * (SHINGLE - width)
    return F.xxhash64(*[F.get(ws, at + k) for k in range(width)], *rest)


def _shingle_texts(ws: Column, n: Column) -> Column:
    """Distinct shingles of ``n`` words as texts; none if there are fewer words."""
    last = F.size(ws) - n
    return F.when(
        (last >= 0) & (n > 0),
        F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(ws, i + 1, n), " "))),
    ).otherwise(F.array().cast("array<string>"))


def items_of(bench: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, need: int = NEED) -> DataFrame:
    """One row per item text: its shingles, its size class, ``k`` and the hits a candidate needs.

    Items without a word are left out: nothing contains them. Items of fewer words than a shingle
    are one shingle of all their words.
    """
    ws = bench.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    sets = ws.select(
        "item_id",
        F.least(F.size("ws"), F.lit(shingle)).alias("width"),
        F.col("ws"),
    ).withColumn("parts", _shingle_texts(F.col("ws"), F.col("width")))
    n = F.size("parts")
    upper = F.pow(F.lit(2), F.ceil(F.log2(n.cast("double")))).cast("int")
    missed = F.floor(F.lit(1 - threshold + 1e-9) * upper).cast("int")
    return (
        sets.select("item_id", "width", "parts", n.alias("n"), upper.alias("size_class"), missed.alias("missed"))
        .distinct()
        .withColumn("k", F.least(F.col("n"), F.col("missed") + need))
        .withColumn("min_hits", F.greatest(F.lit(1), F.col("k") - F.floor(F.lit(1 - threshold + 1e-9) * F.col("n")).cast("int")))
        .withColumn("least_n", F.ceil(F.lit(threshold - 1e-9) * F.col("n")).cast("int"))
        .withColumn("item_key", F.xxhash64("item_id", F.array_join("parts", "\n")))
    )


def _minima(items: DataFrame) -> DataFrame:
    """The item's ``k`` least shingle hashes, one row each."""
    hashes = F.array_sort(F.array_distinct(F.transform("parts", _hash_of_text)))
    return items.select("item_key", "width", "k", "min_hits", "least_n", F.explode(F.slice(hashes, 1, F.col("k"))).alias("h"))


def _hash_of_text(part: Column) -> Column:
    """The hash of a shingle from its text; equals that of its words."""
    return _hash(F.split(part, " "), F.lit(0), SHINGLE)


def contained_items(
    docs: DataFrame, bench: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, need: int = NEED
) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds at least ``threshold`` of the item's shingles.

    Returns doc_id, item_id, item_shingles, shared, containment; one row per pair, the best where
    rows repeat an id. Null or empty texts, on either side, give no row. Other columns of the two
    tables are ignored, whatever their names. Empty tables give an empty result.
    """
    if shingle != SHINGLE:
        raise ValueError(f"shingles have {SHINGLE} words")
    spark = docs.sparkSession
    items = materialize(items_of(bench, shingle, threshold, need), "decontam-items")
    minima = materialize(_minima(items), "decontam-minima")
    small = minima.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda d: d)
    text_key = F.xxhash64("text").alias("text_key")
    split = docs.select("doc_id", text_key, words(F.col("text")).alias("ws"))
    found = None
    for width, least in sorted(minima.groupBy("width").agg(F.min("least_n")).collect()):  # at most as many as a shingle has words
        own = minima.where(F.col("width") == width).drop("width")
        at = split.where(F.size("ws") >= width - 1 + max(1, least)).select("doc_id", "text_key", "ws", F.posexplode("ws").alias("pos", "w"))
        grams = at.where(F.col("pos") <= F.size("ws") - width).select(
            "doc_id",
            "text_key",
            (F.size("ws") - (width - 1)).alias("room"),
            _hash(F.col("ws"), F.col("pos"), width).alias("h"),
        )
        hits = grams.join(hint(own), "h").where("room >= least_n").select("doc_id", "text_key", "item_key", "min_hits", "h")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, item_shingles int, shared int, containment double")
    candidates = materialize(
        found.groupBy("doc_id", "text_key", "item_key", "min_hits", "h").agg(F.lit(1).alias("one"))
        .groupBy("doc_id", "text_key", "item_key", "min_hits").agg(F.count("*").alias("hits"))
        .where("hits >= min_hits").select("doc_id", "text_key", "item_key"),
        "decontam-candidates",
    )
    few = candidates.count() <= BROADCAST_ROWS
    sets = items.select("item_key", F.struct("item_id", "n", "parts").alias("item"), "width")
    sets = F.broadcast(sets) if items.count() * 64 <= BROADCAST_ROWS else sets
    keyed = (
        candidates.join(sets, "item_key")
        .groupBy(F.col("doc_id").alias("c_doc"), F.col("text_key").alias("c_key"), "width")
        .agg(F.collect_set("item").alias("items"))
    )
    ids = candidates.select(F.col("doc_id").alias("c_doc"), F.col("text_key").alias("c_key")).distinct()

    def same(texts: DataFrame, other: DataFrame) -> Column:
        return texts.doc_id.eqNullSafe(other.c_doc) & (texts.text_key == other.c_key)

    texts = docs.select("doc_id", text_key, "text")
    texts = texts.join(F.broadcast(ids) if few else ids, same(texts, ids), "left_semi")
    joined = texts.join(keyed, same(texts, keyed))
    # Variables of lambdas hold the words and the cut set, so that these are made once for a row.
    cut = F.transform(
        F.array(words(F.col("text"))), lambda ws: F.array_intersect(_shingle_texts(ws, F.col("width")), F.flatten(F.col("items.parts")))
    )
    shared = F.transform(
        cut,
        lambda own: F.transform(
            "items",
            lambda i: F.struct(i.item_id.alias("item_id"), i.n.alias("item_shingles"), F.size(F.array_intersect(own, i.parts)).alias("shared")),
        ),
    )
    checked = (
        joined.select("doc_id", F.inline(F.get(shared, F.lit(0))))
        .withColumn("containment", F.col("shared") / F.col("item_shingles"))
        .where(F.col("containment") >= threshold - 1e-9)
    )
    best = F.max(F.struct("containment", "shared", "item_shingles"))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.item_shingles", "b.shared", "b.containment"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark),
bs AS (SELECT DISTINCT item_id, len(ws[1:5]) AS k, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(ws[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k WHERE len(ws) >= k)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_shingles, CAST(shared AS INTEGER) AS shared, CAST(shared AS DOUBLE) / n AS containment
FROM p JOIN n USING (item_id) WHERE CAST(shared AS DOUBLE) / n >= 0.8 - 1e-9
"""
