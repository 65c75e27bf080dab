"""The queue as a stream and as a store of many writers, jobs as state machines, quiet periods.

A reply is refused or accepted by what has become of its parent, whose own fate hangs on its parent:
no fixed chain of keyed states can pass that on within a batch. So each micro-batch is folded by the
operators of :mod:`tallyspark.operators.queue` over the messages that earlier batches left, of which
it reads the buckets of the ids that it names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyspark.functions import variant
from tallyspark.operators import queue
from tallyspark.plans.session import claim, materialize, ship_code, store_of

OUTCOME = "seq bigint, op string, id string, actor string, outcome string"
EVENT = "seq bigint, at double, event string, message_id string, actor string"
STATE = queue.MESSAGE + ", stamp bigint"
#: Rows of a bucket beyond which it is split, and parts of a bucket that are put together when it is written next.
SPLIT_ROWS, MAX_PARTS = 100_000, 4
#: Tries of one batch against other writers.
MAX_TRIES = 50


def _bits(message_id: Column) -> Column:
    return F.lpad(F.conv(F.hex(F.xxhash64(message_id)), 16, 2), 64, "0")


class Contended(RuntimeError):
    """Other writers came first, each time."""


class QueueStore:
    """Messages, outcomes and events of all batches below ``path``, on any Hadoop store; several writers may share it.

    A commit is a file ``commits/<version>.json`` that exactly one writer can make. It names the store's
    whole state: for each bucket its folders, so that readers look at the last commit only and never see
    half of a batch; files that no commit names count for nothing. A bucket holds the ids whose hash
    begins with its bits. A writer reads the buckets of the ids that its commands name, folds, writes
    what has changed, and commits; if another one has changed one of these buckets meanwhile, it
    begins again, so that all outcomes are those of some order of the batches.

    Of a bucket with ``max_parts`` folders the whole state is written instead of the changes, and a
    bucket of more than ``split_rows`` messages is split: a batch reads a bounded number of rows for
    each id that it names, however long the store has been written to.

    Making a commit needs a store that refuses to replace a file by renaming: local ones and HDFS do.
    """

    def __init__(self, spark: SparkSession, path: str, parties: tuple[str, str], split_rows: int = SPLIT_ROWS, max_parts: int = MAX_PARTS):
        self.spark, self.path, self.parties = spark, path.rstrip("/"), parties
        self.split_rows, self.max_parts = split_rows, max_parts

    # commits

    def snapshot(self) -> dict:
        """The last commit: version, next (a seq that is free), applied (last batch by writer), buckets (folders and the version that changed them last)."""
        folder, fs = store_of(self.spark, f"{self.path}/commits")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        versions = [int(n[:-5]) for n in names if n.endswith(".json")]
        if not versions:
            return {"version": -1, "next": 0, "applied": {}, "buckets": {"b": {"parts": [], "touched": -1}}}
        stream = fs.open(store_of(self.spark, self._commit(max(versions)))[0])
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw)

    def _commit(self, version: int) -> str:
        return f"{self.path}/commits/{version:012d}.json"

    def _claimed(self, made: dict) -> bool:
        """Whether this commit is now the one of its version."""
        return claim(self.spark, self._commit(made["version"]), json.dumps(made, sort_keys=True).encode())

    def _committed(self, kind: str, schema: str) -> DataFrame:
        """The rows of a kind that committed attempts have written."""
        if self.snapshot()["version"] < 0:
            return self.spark.createDataFrame([], schema)
        own = self.spark.read.schema("attempt string").json(f"{self.path}/commits").where("attempt IS NOT NULL")
        rows = self.spark.read.schema(schema + ", attempt string").parquet(f"{self.path}/{kind}")
        return rows.join(own, "attempt", "left_semi").drop("attempt")

    # state

    def _bucketed(self, rows: DataFrame, buckets: list[str]) -> DataFrame:
        """``rows`` with the bucket of each id."""
        depths = sorted({len(b) for b in buckets})
        prefix = [F.concat(F.lit("b"), F.substring(_bits(F.col("id")), 1, d - 1)) for d in depths]
        if len(buckets) == 1:
            return rows.withColumn("bucket", F.lit(buckets[0]))
        keys = self.spark.createDataFrame([(b,) for b in buckets], "bucket string")  # as many as the commit names
        return rows.withColumn("bucket", F.explode(F.array(*prefix))).join(F.broadcast(keys), "bucket")

    def _state(self, snapshot: dict, buckets: list[str]) -> DataFrame:
        parts = [f"{self.path}/{p}" for b in buckets for p in snapshot["buckets"][b]["parts"]]
        if not parts:
            return self.spark.createDataFrame([], queue.MESSAGE)
        columns = [x.split()[0] for x in queue.MESSAGE.split(", ")][1:]
        rows = self.spark.read.schema(STATE).parquet(*parts)
        return rows.groupBy("id").agg(F.max_by(F.struct(*columns), "stamp").alias("m")).select("id", "m.*")

    def messages(self) -> DataFrame:
        """All messages that the committed batches have left."""
        snapshot = self.snapshot()
        return self._state(snapshot, list(snapshot["buckets"]))

    def outcomes(self) -> DataFrame:
        """seq, op, id, actor, outcome of every command."""
        return self._committed("outcomes", OUTCOME)

    def events(self, after: int = -1) -> DataFrame:
        """The log from a position on (not itself): posted, received and acknowledged once for each message; seqs grow from commit to commit."""
        return self._committed("events", EVENT).where(F.col("seq") > after)

    def follow(self, handle: Callable[[DataFrame, int], None], checkpoint: str, commits: int = 1000, **trigger) -> StreamingQuery:
        """Gives ``handle`` the events of commits as they are made, with a number that is the same if it is run again.

        The checkpoint keeps which commits have been read, at most ``commits`` of them at a time.
        """
        folder, fs = store_of(self.spark, f"{self.path}/commits")
        fs.mkdirs(folder)

        def read(rows: DataFrame, batch: int) -> None:
            paths = [f"{self.path}/events/attempt={r.attempt}" for r in rows.select("attempt").collect()]  # ``commits`` at most
            if paths:
                handle(self.spark.read.schema(EVENT).parquet(*paths), batch)

        stream = self.spark.readStream.schema("version bigint, attempt string").option("maxFilesPerTrigger", commits).json(f"{self.path}/commits")
        writer = stream.writeStream.foreachBatch(read).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    # writing

    def apply(self, commands: DataFrame, batch: int, writer: str = "stream") -> int | None:
        """Folds the commands of one batch of a writer, by their own seqs; a batch that has been applied is left alone.

        Returns the version of the commit, None where there was nothing to do.
        """
        return self._folded(materialize(commands, "queue-batch"), batch, writer, False)

    def submit(self, commands: DataFrame, batch: int, writer: str) -> int | None:
        """Like :meth:`apply`, for writers that don't share a numbering: the commit gives the commands seqs after all earlier ones, in their order."""
        return self._folded(materialize(commands, "queue-batch"), batch, writer, True)

    def _folded(self, commands: DataFrame, batch: int, writer: str, numbered: bool) -> int | None:
        if commands.isEmpty():
            return None
        for _ in range(MAX_TRIES):
            snapshot = self.snapshot()
            if snapshot["applied"].get(writer, -1) >= batch:
                return None
            own = commands.withColumn("seq", F.col("seq") + snapshot["next"]) if numbered else commands
            attempt, touched, rows = self._attempt(own, snapshot)
            version = self._publish(snapshot, attempt, touched, rows, own.agg(F.max("seq")).first()[0], batch, writer, numbered)
            if version is not None:
                return version
        raise Contended(f"{writer} {batch}")

    def _attempt(self, commands: DataFrame, snapshot: dict) -> tuple[str, list[str], dict]:
        """Writes what the commands change under a name of its own: (name, buckets read, rows of new buckets that replace or extend others)."""
        attempt = uuid.uuid4().hex
        named = commands.select(F.explode(F.array("id", "reply_to")).alias("id")).where("id IS NOT NULL").distinct()
        named = materialize(self._bucketed(named, list(snapshot["buckets"])), "queue-named")
        touched = sorted(r.bucket for r in named.select("bucket").distinct().collect())  # names of the commit's buckets
        known = self._state(snapshot, touched)
        before = materialize(known.join(named.select("id"), "id", "left_semi"), "queue-before")
        decided = materialize(queue.posts(commands, self.parties, before), "queue-decided")
        queue.outcomes(commands, self.parties, before, decided).write.parquet(f"{self.path}/outcomes/attempt={attempt}")
        after = materialize(queue.messages(commands, self.parties, decided, before), "queue-after")
        old = before.select("id", F.col("received_at").alias("o_received"), F.col("ack_at").alias("o_ack"), F.lit(True).alias("known"))
        both = after.join(old, "id", "left")
        new = F.col("known").isNull()
        received, acked = F.col("received_at").isNotNull() & F.col("o_received").isNull(), F.col("ack_at").isNotNull() & F.col("o_ack").isNull()
        changed = both.where(new | received | acked)
        self._log(changed, new, received, acked, snapshot["version"] + 1).write.parquet(f"{self.path}/events/attempt={attempt}")
        changed = materialize(self._bucketed(changed.select(*after.columns), list(snapshot["buckets"])), "queue-changed")
        full = [b for b in touched if len(snapshot["buckets"][b]["parts"]) >= self.max_parts]
        rows = changed
        if full:
            kept = self._bucketed(self._state(snapshot, full).join(changed.select("id"), "id", "left_anti"), full)
            rows = materialize(changed.unionByName(kept.select(*changed.columns)), "queue-rows")
        sizes = {r.bucket: r["count"] for r in rows.groupBy("bucket").count().collect()}  # as many as the commit has buckets
        deeper = {b: max(0, (-(-sizes[b] // self.split_rows) - 1).bit_length()) for b in full if b in sizes}
        split = {b: d for b, d in deeper.items() if d}
        place = F.col("bucket")
        for d in sorted(set(split.values())):
            inside = F.col("bucket").isin([b for b in split if split[b] == d])
            place = F.when(inside, F.concat("bucket", F.substr(_bits(F.col("id")), F.length("bucket"), F.lit(d)))).otherwise(place)
        stamped = rows.withColumn("bucket", place).withColumn("stamp", F.lit(snapshot["version"] + 1).cast("long"))
        stamped.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/state/{attempt}")
        made = {}
        for b in touched:
            if b in split:
                made[b] = {"replace": [b + format(k, f"0{split[b]}b") for k in range(1 << split[b])]}
            elif b in sizes:
                made[b] = {"replace": [b]} if b in full else {"extend": True}
        return attempt, touched, made

    def _log(self, changed: DataFrame, new: Column, received: Column, acked: Column, version: int) -> DataFrame:
        """The events of a batch; those of later commits have greater seqs."""
        kinds = F.array(
            F.when(new, F.struct(F.lit("posted").alias("event"), F.col("created_at").alias("at"), F.col("sender").alias("actor"))),
            F.when(received, F.struct(F.lit("received").alias("event"), F.col("received_at").alias("at"), F.col("recipient").alias("actor"))),
            F.when(acked, F.struct(F.lit("acknowledged").alias("event"), F.col("ack_at").alias("at"), F.col("recipient").alias("actor"))),
        )
        rows = changed.select(F.col("id").alias("message_id"), F.inline(F.array_compact(kinds)))
        return rows.select((F.lit(version).cast("long") * (1 << 36) + F.monotonically_increasing_id() % (1 << 36)).alias("seq"), "at", "event", "message_id", "actor")

    def _publish(self, snapshot: dict, attempt: str, touched: list[str], made: dict, last: int, batch: int, writer: str, numbered: bool) -> int | None:
        """The version under which the attempt counts; None where another commit stands against it."""
        written, fs = store_of(self.spark, f"{self.path}/state/{attempt}")
        there = {f.getPath().getName().removeprefix("bucket=") for f in fs.listStatus(written)}
        latest = snapshot
        while True:
            moved = latest["version"] != snapshot["version"]
            if moved and (numbered or any(latest["buckets"].get(b, {"touched": latest["version"]})["touched"] > snapshot["version"] for b in touched)):
                return None
            if latest["applied"].get(writer, -1) >= batch:
                return None
            version, buckets = latest["version"] + 1, dict(latest["buckets"])
            for b, change in made.items():
                own = lambda k: [f"state/{attempt}/bucket={k}"] if k in there else []
                if "extend" in change:
                    buckets[b] = {"parts": buckets[b]["parts"] + own(b), "touched": version}
                else:
                    del buckets[b]
                    buckets |= {k: {"parts": own(k), "touched": version} for k in change["replace"]}
            new = {"version": version, "attempt": attempt, "next": max(latest["next"], last + 1), "applied": latest["applied"] | {writer: batch}, "buckets": buckets}
            if self._claimed(new):
                return version
            latest = self.snapshot()

    def start(self, commands: DataFrame, **trigger) -> StreamingQuery:
        """Follows a stream of commands; the checkpoint lies beside the store."""
        writer = commands.writeStream.foreachBatch(lambda rows, batch: self.apply(rows, batch)).option("checkpointLocation", f"{self.path}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()


def use_state_store(spark) -> None:
    """State on local disks with a changelog in the checkpoint, as large state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


JOB = "task_id string, seq bigint, state string, images array<string>, error string"


class JobProcessor(StatefulProcessor):
    """An asynchronous job: submitted, processing, then completed, failed or timed out. Transient errors change nothing."""

    def __init__(self, deadline_ms: int):
        self.deadline_ms = deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        known = self.job.get()[0] if self.job.exists() else None
        if known is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.deadline_ms)
            known = "submitted"
        for r in pd.concat(rows).sort_values("seq", kind="stable").itertuples(index=False):
            if known in ("completed", "failed", "timed out"):
                continue
            known = r.state if r.state in ("processing", "completed", "failed") else known
            if known in ("completed", "failed"):
                images = list(r.images) if r.images is not None else []
                out.append((key[0], int(r.seq), known, images, r.error))
        self.job.update((known,))
        yield pd.DataFrame(out, columns=["task_id", "seq", "state", "images", "error"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_ = self.job.exists() and self.job.get()[0] not in ("completed", "failed", "timed out")
        if open_:
            self.job.update(("timed out",))
        yield pd.DataFrame([(key[0], -1, "timed out", [], "deadline")] if open_ else [], columns=["task_id", "seq", "state", "images", "error"])

    def close(self) -> None:
        pass


def job_states(responses: DataFrame) -> DataFrame:
    """task_id, seq, state, images, error of polled responses (seq, body) in any of their forms.

    Data may be a list or an object; the task's id is task_id or id; an image's address is a text or a list.
    """
    v, one = F.col("v"), F.col("one")
    data = variant.at(v, "data")
    job = F.when(variant.kind(data) == "ARRAY", F.try_variant_get(data, "$[0]", "variant")).when(variant.kind(data) == "OBJECT", data).otherwise(v)
    url = lambda x: F.when(variant.kind(variant.at(x, "url")) == "ARRAY", F.try_variant_get(x, "$.url[0]", "string")).otherwise(variant.at(x, "url", "string"))
    parsed = responses.select("seq", variant.parsed(F.col("body")).alias("v")).select("seq", job.alias("one"))  # each is used several times
    row = F.struct(
        F.coalesce(variant.at(one, "task_id", "string"), variant.at(one, "id", "string")).alias("task_id"),
        F.col("seq").alias("seq"),
        variant.at(one, "status", "string").alias("state"),
        F.filter(F.transform(variant.items(variant.at(one, "result.images")), url), lambda u: u.isNotNull()).alias("images"),
        variant.at(one, "error.message", "string").alias("error"),
    )
    return parsed.select(F.inline(F.array(row))).where("task_id IS NOT NULL")  # as a generator the row is made once, before the filter


def jobs(states: DataFrame, deadline_s: int = 300) -> DataFrame:
    """A row for each job when it ends. ``states`` is a stream as :func:`job_states` gives it."""
    ship_code(states.sparkSession)
    return states.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=JobProcessor(deadline_s * 1000), outputStructType=JOB, outputMode="Append", timeMode="ProcessingTime"
    )


def job_results(states: DataFrame) -> DataFrame:
    """The last word of each job in a batch of states: the first final state, else the latest one."""
    final = F.col("state").isin("completed", "failed")
    value = F.struct("seq", "state", "images", "error")
    both = states.groupBy("task_id").agg(F.min(F.when(final, value)).alias("f"), F.max(value).alias("l"))
    return both.select("task_id", F.coalesce("f", "l").alias("x")).select("task_id", "x.*")


def cli_events(lines: DataFrame) -> DataFrame:
    """seq, type, event, problem of a JSON-lines event stream (seq, value); unknown types pass, a line that is no JSON is named."""
    v = variant.parsed(F.col("value"))
    problem = F.when(v.isNull(), "no JSON, perhaps cut off").when(variant.kind(v) != "OBJECT", "not an object")
    return lines.where("value IS NOT NULL AND trim(value) <> ''").select("seq", variant.at(v, "type", "string").alias("type"), v.alias("event"), problem.alias("problem"))


def quiet_periods(changes: DataFrame, gap: str = "5 seconds", watermark: str = "1 minute") -> DataFrame:
    """path, changed_from, quiet_at, n: bursts of changes (path, ts) that a pause of ``gap`` ends. Works on streams and tables."""
    rows = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", watermark) if rows.isStreaming else rows
    return rows.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("changed_from"), F.col("w.end").alias("quiet_at"), "n")
