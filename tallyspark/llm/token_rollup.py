"""Token counts: rollups kept by signed deltas, with idempotent batch commits.

Layout below ``path``, on any Hadoop store::

    ledger/<attempt>/bucket=<b>         doc_id, tokenizer, seq, source, lang, n_tokens   what a batch set; null n_tokens: deleted
    deltas/<attempt>                    source, lang, tokenizer, d_docs, d_tokens        what it changed in the totals
    commits/<seq>                       the batch's name and its attempt; made only if it isn't there
    compact/<attempt>/state/bucket=<b>  the ledger's last rows by key up to a commit, with its totals and batches
    compacted/<seq>                     the attempt whose compact state of that commit is complete

Every attempt writes under a name of its own, and a batch counts once a commit points to one: files
of attempts that were lost are never read, and no attempt writes where another one reads. Committing
a batch again changes nothing. Of two writers that take one number, one makes the commit and the
other begins again on what that has left. Batches may have any name. A commit reads the buckets that
its keys fall into, from the last compact state and the few batches after it; totals are those of the
compact state and the deltas since.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.store import tasks_for
from tallyspark.plans.session import claim, exists, store_of, workspace
from tallyspark.plans.tables import table

LEDGER = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, seq bigint"
DELTAS = "source string, lang string, tokenizer string, d_docs bigint, d_tokens bigint"
KEY = ("doc_id", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
#: Parts of the ledger by hash of the key, and commits after which it is compacted.
BUCKETS, COMPACT = 64, 16

#: Tokenizer versions of the query: the pattern that a token matches.
TOKENIZERS = {"words-1": r"[^ \t\n\r\f\x0B]+", "alnum-1": r"[\p{L}\p{N}]+"}


def token_count(text: Column, pattern: str) -> Column:
    """Tokens that match ``pattern``; null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def counted(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """One upsert per document and tokenizer version."""
    each = F.array(*[F.struct(F.lit(k).alias("tokenizer"), token_count(F.col("text"), p).alias("n_tokens")) for k, p in tokenizers.items()])
    return docs.select("doc_id", "source", "lang", F.explode(each).alias("t")).select("doc_id", "source", "lang", "t.*")


class Mark(NamedTuple):
    """A commit, or a compact state: its number, the batch and the attempt that its files are named by."""

    seq: int
    batch: str | None
    files: str


class TokenRollup:
    """Totals by source, language and tokenizer version.

    Changes have doc_id, tokenizer, source, lang, n_tokens; a null n_tokens deletes the row of
    that document and tokenizer. Rows of one batch that share a key are tied by ``ordinal`` if there
    is such a column; then, or without it, the greatest (n_tokens, source, lang) counts, nulls least.
    Null doc_id, source or lang are keys like others. Deleting what isn't there changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT):
        self.spark, self.path, self.every = spark, path, compact

    def _names(self, folder: str) -> list[int]:
        """Numbers of the marks in a folder, by one listing."""
        p, fs = store_of(self.spark, f"{self.path}/{folder}")
        if not fs.exists(p):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit())

    def _claimed(self, folder: str, mark: Mark) -> bool:
        """Whether this writer made the mark of that number; false where there is one already."""
        return claim(self.spark, f"{self.path}/{folder}/{mark.seq:012d}", json.dumps(mark._asdict()).encode())

    def _read(self, folder: str, seq: int) -> Mark:
        p, fs = store_of(self.spark, f"{self.path}/{folder}/{seq:012d}")
        stream = fs.open(p)
        try:
            return Mark(**json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()

    def _committed(self) -> tuple[Mark | None, dict[int, Mark]]:
        """(the last compact state or none, commits after it by number): few, since every ``compact`` commits make a state."""
        last = max(self._names("compacted"), default=0)
        recent = {seq: self._read("commits", seq) for seq in self._names("commits") if seq > last}
        return self._read("compacted", last) if last else None, recent

    def _is_done(self, batch: str, base: Mark | None, recent: dict[int, Mark]) -> bool:
        if any(batch == m.batch for m in recent.values()):
            return True
        return base is not None and not self.spark.read.parquet(f"{self.path}/compact/{base.files}/batches").where(F.col("batch") == batch).isEmpty()

    def _ledger(self, base: Mark | None, marks: list[Mark], buckets: list[int] | None = None) -> DataFrame:
        """Ledger rows of the compact state and of commits, of some buckets; older rows of a key among them."""
        places = [f"{self.path}/compact/{base.files}/state"] if base else []
        places += [f"{self.path}/ledger/{m.files}" for m in marks]
        out = self.spark.createDataFrame([], LEDGER)
        for place in places:
            if exists(self.spark, place):
                rows = self.spark.read.schema(LEDGER + ", bucket int").parquet(place)
                out = out.unionByName((rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket"))
        return out

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies the batch unless it has been committed; says whether it did. An empty batch is a commit like others."""
        while True:
            base, recent = self._committed()
            if self._is_done(batch, base, recent):
                return False
            mark = Mark(1 + max([base.seq if base else 0, *recent]), batch, uuid.uuid4().hex)
            self._write(mark, changes, base, recent)
            if self._claimed("commits", mark):
                break
        if mark.seq - (base.seq if base else 0) >= self.every:
            self.compact()
        return True

    def _write(self, mark: Mark, changes: DataFrame, base: Mark | None, recent: dict[int, Mark]) -> None:
        """The ledger rows and deltas of a batch as the commit of that number."""
        seq = mark.seq
        order = [F.col("ordinal").desc_nulls_last()] if "ordinal" in changes.columns else []
        order += [F.col(c).desc_nulls_last() for c in ("n_tokens", "source", "lang")]
        new = (
            changes.withColumn("rank", F.row_number().over(W.partitionBy(*KEY).orderBy(*order)))
            .where("rank = 1")
            .select(*KEY, "source", "lang", F.col("n_tokens").cast("long"), F.lit(seq).cast("long").alias("seq"), _bucket().alias("bucket"))
        )
        place = f"{self.path}/ledger/{mark.files}"
        _by_bucket(new, tasks_for(changes)).write.partitionBy("bucket").parquet(place)
        new = self._ledger(None, [mark])
        touched = self._buckets(place)
        old = self._ledger(base, list(recent.values()), touched)
        both = new.unionByName(old.join(new.select(*KEY), _same(old, new), "left_semi") if base or recent else old)
        value = F.struct("seq", "source", "lang", "n_tokens")
        before = F.max(F.when(F.col("seq") < seq, value))
        steps = both.groupBy(*KEY).agg(before.alias("o"), F.max(F.when(F.col("seq") == seq, value)).alias("n"))
        signed = steps.select("tokenizer", F.inline(F.array(_signed("o", -1), _signed("n", 1))))
        deltas = (
            signed.where("d_tokens IS NOT NULL")
            .groupBy("source", "lang", "tokenizer")
            .agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
            .where("d_docs <> 0 OR d_tokens <> 0")
        )
        deltas.write.parquet(f"{self.path}/deltas/{mark.files}")

    def _buckets(self, place: str) -> list[int]:
        """The buckets that a batch has, by one listing."""
        p, fs = store_of(self.spark, place)
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]

    def compact(self) -> None:
        """Writes the state up to the last commit; readers take it once its mark is there. Of two writers one sets the mark."""
        base, recent = self._committed()
        if not recent:
            return
        mark = Mark(max(recent), None, uuid.uuid4().hex)
        path = f"{self.path}/compact/{mark.files}"
        value = F.max(F.struct("seq", "source", "lang", "n_tokens")).alias("v")
        whole = self._ledger(base, list(recent.values()))
        state = whole.groupBy(*KEY).agg(value).select(*KEY, "v.*").where("n_tokens IS NOT NULL")
        _by_bucket(state.withColumn("bucket", _bucket()), tasks_for(whole)).write.partitionBy("bucket").parquet(f"{path}/state")
        self._totals(base, recent).write.parquet(f"{path}/totals")
        names = self.spark.createDataFrame([(m.seq, m.batch) for m in recent.values()], "seq bigint, batch string")
        if base:
            names = self.spark.read.parquet(f"{self.path}/compact/{base.files}/batches").unionByName(names)
        names.write.parquet(f"{path}/batches")
        self._claimed("compacted", mark)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of what is in; groups that have come to nothing are left out."""
        return self._totals(*self._committed())

    def _totals(self, base: Mark | None, recent: dict[int, Mark]) -> DataFrame:
        out = self.spark.createDataFrame([], TOTALS)
        if base:
            out = out.unionByName(self.spark.read.schema(TOTALS).parquet(f"{self.path}/compact/{base.files}/totals"))
        if recent:
            deltas = self.spark.read.schema(DELTAS).parquet(*[f"{self.path}/deltas/{m.files}" for m in recent.values()])
            out = out.unionByName(deltas.select("source", "lang", "tokenizer", F.col("d_docs").alias("n_docs"), F.col("d_tokens").alias("n_tokens")))
        sums = out.groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")


def _by_bucket(rows: DataFrame, tasks: int) -> DataFrame:
    """Each bucket's rows together, so that it has few files: one, or as many as ``tasks`` give it."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, tasks // BUCKETS)))
    return rows.repartition("bucket", part)


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")


def _signed(side: str, sign: int) -> Column:
    n = F.col(f"{side}.n_tokens")
    return F.struct(
        F.col(f"{side}.source").alias("source"),
        F.col(f"{side}.lang").alias("lang"),
        F.when(n.isNotNull(), F.lit(sign).cast("long")).alias("d_docs"),
        (n * sign).alias("d_tokens"),
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & a.tokenizer.eqNullSafe(b.tokenizer)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, withdraws toxic ones, revises those of low quality, and commits again.

    Revision: ``words-1`` of documents labelled quality 0 is counted anew with the other pattern.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = TokenRollup(spark, workspace(spark, "token-rollup"))
    load = counted(docs, TOKENIZERS)
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    none = F.lit(None)
    versions = F.explode(F.array(*map(F.lit, TOKENIZERS))).alias("tokenizer")
    withdraw = toxic.select("doc_id", versions, none.cast("string").alias("source"), none.cast("string").alias("lang"), none.cast("long").alias("n_tokens"))
    low = labels.groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q")).where("q = 0 AND coalesce(t, 0) <> 1")
    revise = counted(docs.join(low, "doc_id", "left_semi"), {"words-1": TOKENIZERS["alnum-1"]})
    for batch, changes in (("load", load), ("withdraw", withdraw), ("revise", revise), ("withdraw", withdraw), ("load", load)):
        rollup.commit(batch, changes)
    return rollup.totals()


SQL = r"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT source, lang, l.quality AS quality,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+')) AS BIGINT) AS words,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+')) AS BIGINT) AS alnum
  FROM documents LEFT JOIN l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1),
t AS (
  SELECT source, lang, 'words-1' AS tokenizer, CASE WHEN quality = 0 THEN alnum ELSE words END AS n FROM d
  UNION ALL SELECT source, lang, 'alnum-1', alnum FROM d)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM t GROUP BY source, lang, tokenizer
"""
