"""A durable message queue of two parties as a fold over commands.

commands: seq, op (post, receive, ack), id, actor, peer, kind, body, reply_to, ts. The fold gives the
table of messages and the log of events that running the commands in order of seq would leave.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import report
from tallyspark.plans.session import materialize

ID_PATTERN = r"^[a-zA-Z0-9_.-]{1,120}$"
CONTENT = ("actor", "peer", "kind", "body", "reply_to")


def rejection(parties: tuple[str, str]) -> Column:
    """Why a post is refused by itself; null if it isn't."""
    crossing = (F.col("actor") != F.col("peer")) & F.col("actor").isin(*parties) & F.col("peer").isin(*parties)
    return (
        F.when(~F.coalesce(crossing, F.lit(False)), "parties")
        .when(text.is_blank(F.col("body")), "blank body")
        .when(~F.coalesce(F.col("id").rlike(ID_PATTERN), F.lit(False)), "invalid id")
    )


def posts(commands: DataFrame, parties: tuple[str, str], before: DataFrame | None = None) -> DataFrame:
    """Every post with outcome created, repeat, conflict or the reason of its refusal.

    The first valid post of an id creates it; a later one with equal content repeats it, any other
    is a conflict. A reply must answer a message that was created before, in the other direction. A
    refused reply creates nothing, so that parents are decided before children. ``before`` are
    messages that earlier commands have left.

    Chains of replies are decided by pointer doubling, in rounds that grow with the logarithm of the
    longest chain: those whose first posts all fit by where they lead, the others by what they would
    be for each outcome of the message that they lead to. Only ids whose posts answer several
    undecided messages wait for these, and where ids answer each other in a circle, rounds follow
    link by link.

    Messages of ``before`` precede all commands, whatever their seqs.
    """
    asked = commands.where("op = 'post'").withColumn("why", rejection(parties))
    own = asked.withColumn("settled", F.lit(False))
    if before is not None:
        kept = before.select(F.lit(-1).cast("long").alias("seq"), F.lit("post").alias("op"), "id", F.col("sender").alias("actor"), F.col("recipient").alias("peer"), "kind", "body", "reply_to", F.col("created_at").alias("ts"))
        own = own.unionByName(kept.withColumn("why", F.lit(None).cast("string")).withColumn("settled", F.lit(True)), allowMissingColumns=True)
    valid = materialize(own.where("why IS NULL").select("seq", "id", "actor", "peer", "kind", "body", "reply_to", (F.col("settled") | _plain()).alias("plain")), "queue-valid")
    created = materialize(_unbroken(valid), "queue-created")
    others = materialize(valid.join(created.select("id"), "id", "left_anti"), "queue-contested")
    if not others.isEmpty():
        created = _contested(created, others)
    first = created.select(F.col("id").alias("f_id"), F.col("seq").alias("f_seq"), F.struct(*CONTENT).alias("first"))
    joined = asked.join(first, asked.id == F.col("f_id"), "left")
    same = F.struct(*CONTENT).eqNullSafe(F.col("first"))
    outcome = (
        F.when(F.col("why").isNotNull(), F.col("why"))
        .when(F.col("f_seq") == F.col("seq"), "created")
        .when((F.col("f_seq") < F.col("seq")) & same, "repeat")
        .when(F.col("f_seq") < F.col("seq"), "conflict")
        .otherwise("no such parent")
    )
    return joined.select(*commands.columns, outcome.alias("outcome"))


#: A round that decides a smaller part of the ids than one in so many gives way to rounds link by link.
LEAST_PART = 10
NONE = -2  # the value of an id that no post creates


def _contested(sure: DataFrame, others: DataFrame) -> DataFrame:
    """``sure`` and the posts that create ids of which the first post may be refused.

    An id's value is the seq of the post that creates it. Posts that answer nothing or a decided
    message are certain to count or not. If all others of an id answer one undecided message, its value
    is a table: a row for each value that the other one may have. Tables along a chain are composed, each
    round over twice as many links, until they start at an id that is decided, which gives all values.
    """
    columns = sure.columns
    left = others
    while True:
        round_ = _round(sure, left)
        if round_ is None:
            break
        told, n_ids = round_
        sure = materialize(sure.unionByName(left.join(told.where(F.col("value") != NONE), "id").where("seq = value").select(*columns)), "queue-created")
        left = materialize(left.join(told.select("id"), "id", "left_anti"), "queue-contested")
        if told.count() * LEAST_PART < n_ids:
            break
    if left.isEmpty():
        return sure
    return _by_rounds(sure, left.where("plain"), left.where("NOT plain"))


def _round(sure: DataFrame, left: DataFrame) -> tuple[DataFrame, int] | None:
    """id and value of the ids that can be decided now, and the number of ids that ``left`` has; None without ids."""
    ids = left.select("id").distinct()
    n_ids = ids.count()
    if not n_ids:
        return None
    parents = sure.select(F.col("id").alias("p_id"), F.col("actor").alias("p_actor"), F.col("peer").alias("p_peer"), F.col("seq").alias("p_seq"))
    open_ = ids.select(F.col("id").alias("up"))
    judged = left.select("id", "seq", "actor", "peer", "reply_to", "plain").join(parents, F.col("reply_to") == F.col("p_id"), "left").join(open_, F.col("reply_to") == F.col("up"), "left")
    counts = F.when(F.col("plain"), True).when(F.col("up").isNotNull(), False).otherwise(F.coalesce(_answers(), F.lit(False)))
    judged = judged.withColumn("sure", counts).where(F.col("sure") | (~F.col("plain") & F.col("up").isNotNull()))
    judged = judged.withColumn("least", F.min(F.when(F.col("sure"), F.col("seq"))).over(W.partitionBy("id")))
    kept = materialize(judged.where(F.coalesce(F.col("seq") <= F.col("least"), F.lit(True))).select("id", "seq", "actor", "peer", "least", F.when(~F.col("sure"), F.col("up")).alias("up")), "queue-kept")
    per = kept.groupBy("id").agg(F.first("least").alias("least"), F.min("up").alias("up"), F.max("up").alias("last_up"))
    per = materialize(ids.join(per, "id", "left"), "queue-ids")
    told = per.where("up IS NULL").select("id", F.coalesce("least", F.lit(NONE)).alias("value"))
    linked = per.where("up = last_up")
    options = kept.select(F.col("id").alias("up"), F.col("seq").alias("p_seq"), F.col("actor").alias("p_actor"), F.col("peer").alias("p_peer"))
    options = options.unionByName(ids.select(F.col("id").alias("up"), F.lit(NONE).cast("long").alias("p_seq")), allowMissingColumns=True)
    asked = kept.where("up IS NOT NULL").join(linked.select("id"), "id", "left_semi").join(options, "up")
    fits = F.when(F.col("p_actor").isNotNull() & F.coalesce(_answers(), F.lit(False)), F.col("seq"))
    rows = asked.groupBy("id", "up", F.col("p_seq").alias("given")).agg(F.coalesce(F.least(F.min(fits), F.first("least")), F.lit(NONE)).alias("value"))
    tables = materialize(rows, "queue-tables")
    for _ in range(n_ids.bit_length()):
        ends = tables.select("id").distinct()
        further = tables.join(ends.select(F.col("id").alias("up")), "up", "left_semi")
        if further.isEmpty():
            break
        above = tables.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("given").alias("from"), F.col("value").alias("given"))
        composed = further.join(above, ["up", "given"]).select("id", F.col("top").alias("up"), F.col("from").alias("given"), "value")
        tables = materialize(tables.join(ends.select(F.col("id").alias("up")), "up", "left_anti").select("id", "up", "given", "value").unionByName(composed), "queue-tables")
    reached = told.select(F.col("id").alias("up"), F.col("value").alias("given"))
    return materialize(told.unionByName(tables.join(reached, ["up", "given"]).select("id", "value")), "queue-told"), n_ids


def _by_rounds(sure: DataFrame, plain: DataFrame, open_: DataFrame) -> DataFrame:
    """``sure`` and the created ones of the other ids, from posts that answer nothing and replies; a round for each link until nothing changes."""
    now = materialize(sure.unionByName(_first(plain)), "queue-created")
    while True:
        parents = now.select(F.col("id").alias("p_id"), F.col("actor").alias("p_actor"), F.col("peer").alias("p_peer"), F.col("seq").alias("p_seq"))
        fits = open_.join(parents, open_.reply_to == F.col("p_id")).where(_answers()).select(*open_.columns)
        after = materialize(sure.unionByName(_first(plain.unionByName(fits))), "queue-created")
        if after.count() == now.count() and after.select("id", "seq").exceptAll(now.select("id", "seq")).isEmpty():
            return after
        now = after


def _plain() -> Column:
    """Whether a post answers nothing; an empty reference is none."""
    return F.coalesce(F.col("reply_to"), F.lit("")) == ""


def _answers() -> Column:
    return (F.col("p_actor") == F.col("peer")) & (F.col("p_peer") == F.col("actor")) & (F.col("p_seq") < F.col("seq"))


def _unbroken(valid: DataFrame) -> DataFrame:
    """The first posts of ids from which all links up to a post that answers nothing fit; these are created whatever else there is.

    Each round lets a post point twice as far up; a link that doesn't fit ends it.
    """
    first = _first(valid)
    parents = first.select(F.col("id").alias("p_id"), F.col("actor").alias("p_actor"), F.col("peer").alias("p_peer"), F.col("seq").alias("p_seq"))
    linked = first.join(parents, (first.reply_to == F.col("p_id")) & ~F.col("plain"), "left")
    state = F.when(F.col("plain"), 1).when(F.coalesce(_answers(), F.lit(False)), 0).otherwise(2)  # reached, on the way, broken
    now = materialize(linked.select("id", F.col("reply_to").alias("up"), state.alias("state")), "queue-links")
    while not now.where("state = 0").isEmpty():
        above = now.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("state").alias("found"))
        moved = now.where("state = 0").join(above, "up").select("id", F.col("further").alias("up"), F.col("found").alias("state"))
        now = materialize(now.where("state <> 0").unionByName(moved), "queue-links")
    return first.join(now.where("state = 1").select("id"), "id", "left_semi").select(*valid.columns)


def _first(rows: DataFrame) -> DataFrame:
    """The first row of each id."""
    rest = [c for c in rows.columns if c != "id"]
    least = rows.groupBy("id").agg(F.min_by(F.struct(*rest), "seq").alias("x"))
    return least.select("id", "x.*").select(*rows.columns)


MESSAGE = "id string, seq bigint, sender string, recipient string, kind string, body string, reply_to string, created_at double, received_at double, ack_at double"


def messages(commands: DataFrame, parties: tuple[str, str], decided: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """id, seq, sender, recipient, kind, body, reply_to, created_at, received_at, ack_at.

    A receive or ack command names an id; it counts if its actor is the recipient and the message
    was there. The first ack counts, and also receives what wasn't received before. ``before`` are
    messages that earlier commands have left; they come back with what the new commands add.
    """
    made = (posts(commands, parties, before) if decided is None else decided).where("outcome = 'created'")
    m = made.select("id", "seq", F.col("actor").alias("sender"), F.col("peer").alias("recipient"), "kind", "body", "reply_to", F.col("ts").alias("created_at"))
    if before is not None:
        m = m.unionByName(before.select(*m.columns))
    own = _acts(commands, m, before)
    times = own.groupBy("id").agg(
        F.min_by("a_ts", F.when(F.col("op") == "ack", F.col("a_seq"))).alias("n_ack_at"),
        F.min_by("a_ts", "a_seq").alias("n_received_at"),
    )
    found = m.join(times, "id", "left")
    if before is None:
        return found.select(*m.columns, F.col("n_received_at").alias("received_at"), F.col("n_ack_at").alias("ack_at"))
    found = found.join(before.select("id", "received_at", "ack_at"), "id", "left")
    return found.select(*m.columns, F.coalesce("received_at", "n_received_at").alias("received_at"), F.coalesce("ack_at", "n_ack_at").alias("ack_at"))


def _acts(commands: DataFrame, made: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """id, a_seq, op, a_actor, a_ts of the receipts and acks that count; messages of ``before`` precede them all."""
    if before is not None:
        made = made.join(before.select("id"), "id", "left_anti").unionByName(before.select("id", F.lit(-1).cast("long").alias("seq"), "recipient"), allowMissingColumns=True)
    acts = commands.where("op IN ('receive', 'ack')").select(F.col("id").alias("a_id"), F.col("seq").alias("a_seq"), "op", F.col("actor").alias("a_actor"), F.col("ts").alias("a_ts"))
    m = made.select("id", "seq", "recipient")
    return m.join(acts, (F.col("id") == F.col("a_id")) & (F.col("recipient") == F.col("a_actor")) & (F.col("a_seq") > F.col("seq"))).select("id", "a_seq", "op", "a_actor", "a_ts")


def outcomes(commands: DataFrame, parties: tuple[str, str], before: DataFrame | None = None, decided: DataFrame | None = None) -> DataFrame:
    """seq, op, id, actor, outcome of every command.

    Posts as :func:`posts` has them. A receipt is received, read again, or acknowledged before; an
    ack acknowledged or again; both are refused where the message isn't there or isn't the actor's.
    """
    decided = posts(commands, parties, before) if decided is None else decided
    stored = messages(commands, parties, decided, before).select("id", "seq", "recipient")
    counted = _acts(commands, stored, before)
    if before is not None:  # what earlier commands did comes first
        old = lambda op, at: before.where(f"{at} IS NOT NULL").select("id", F.lit(-1).cast("long").alias("a_seq"), F.lit(op).alias("op"), F.col("recipient").alias("a_actor"), F.col(at).alias("a_ts"))
        counted = counted.unionByName(old("receive", "received_at")).unionByName(old("ack", "ack_at"))
    earlier = W.partitionBy("id").orderBy("a_seq").rangeBetween(W.unboundedPreceding, -1)
    acked, seen = F.count_if(F.col("op") == "ack").over(earlier) > 0, F.count("*").over(earlier) > 0
    outcome = (
        F.when((F.col("op") == "ack") & acked, "again").when(F.col("op") == "ack", "acknowledged")
        .when(acked, "acknowledged before").when(seen, "read again").otherwise("received")
    )
    told = counted.withColumn("outcome", outcome).where("a_seq >= 0").select(F.col("a_seq").alias("seq"), "outcome")
    acts = commands.where("op IN ('receive', 'ack')").join(told, "seq", "left")
    columns = ["seq", "op", "id", "actor", "outcome"]
    return decided.select(*columns).unionByName(acts.withColumn("outcome", F.coalesce("outcome", F.lit("refused"))).select(*columns))


def events(commands: DataFrame, parties: tuple[str, str]) -> DataFrame:
    """at, event, message_id, actor: posted, received and acknowledged once for each message."""
    kinds = F.array(
        F.struct(F.lit("posted").alias("event"), F.col("created_at").alias("at"), F.col("sender").alias("actor")),
        F.struct(F.lit("received").alias("event"), F.col("received_at").alias("at"), F.col("recipient").alias("actor")),
        F.struct(F.lit("acknowledged").alias("event"), F.col("ack_at").alias("at"), F.col("recipient").alias("actor")),
    )
    made = messages(commands, parties)
    return made.select(F.col("id").alias("message_id"), F.inline(kinds)).where("at IS NOT NULL").select("at", "event", "message_id", "actor")


def refused_acks(commands: DataFrame, parties: tuple[str, str]) -> DataFrame:
    """Findings on acks whose message isn't there or whose actor isn't its recipient."""
    m = messages(commands, parties).select(F.col("id").alias("m_id"), "recipient", F.col("seq").alias("m_seq"))
    acks = commands.where("op = 'ack'").join(m, F.col("id") == F.col("m_id"), "left")
    allowed = F.coalesce((F.col("recipient") == F.col("actor")) & (F.col("m_seq") < F.col("seq")), F.lit(False))
    return report.findings(acks.where(~allowed), "ack refused", F.col("id"), F.col("actor"))


def pending(stored: DataFrame, recipient: str, limit: int = 10) -> DataFrame:
    """The first messages by seq that the recipient hasn't acknowledged."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is between 1 and 100")
    return stored.where((F.col("recipient") == recipient) & F.col("ack_at").isNull()).orderBy("seq").limit(limit)


#: Seconds between two looks of a wait.
STEP = 0.25


def wait(stored: Callable[[], DataFrame], recipient: str, seconds: float, limit: int = 10) -> list[Row]:
    """The first open messages as soon as there are any, looked for again until ``seconds`` have passed; none then.

    ``stored`` gives the table of messages as it is now. ``limit`` is 100 at most, so that few rows come to the driver.
    """
    if not 0 <= seconds <= 60:
        raise ValueError("a wait is between 0 and 60 seconds")
    until = time.monotonic() + seconds
    while True:
        found = pending(stored(), recipient, limit).collect()
        left = until - time.monotonic()
        if found or left <= 0:
            return found
        time.sleep(min(STEP, left))


def unacknowledged(stored: DataFrame) -> DataFrame:
    """recipient, pending: open messages of each party."""
    return stored.where("ack_at IS NULL").groupBy("recipient").agg(F.count("*").alias("pending"))


def after(stored: DataFrame, seq: int) -> DataFrame:
    """What follows a position, in order."""
    return stored.where(F.col("seq") > seq).orderBy("seq")


def by_id(stored: DataFrame, message_id: str) -> DataFrame:
    return stored.where(F.col("id") == message_id)


def idempotent(rows: DataFrame, key: str, order: str, content: list[str]) -> DataFrame:
    """key, first, repeats, conflicts: of rows that share a key the first one counts; equal ones repeat it, others conflict."""
    value = F.struct(*content)
    first = rows.groupBy(key).agg(F.min(F.struct(F.col(order), value.alias("v"))).alias("f"))
    both = rows.select(key, order, value.alias("v")).join(first, key)
    own = both.groupBy(key).agg(
        F.min(order).alias("first"),
        F.count_if((F.col(order) > F.col("f")[order]) & F.col("v").eqNullSafe(F.col("f.v"))).alias("repeats"),
        F.count_if((F.col(order) > F.col("f")[order]) & ~F.col("v").eqNullSafe(F.col("f.v"))).alias("conflicts"),
    )
    return own


def parent_failures(rows: DataFrame, key: list[str], parent: str, child: str, direction: str) -> DataFrame:
    """Rows whose parent (same key, ``parent`` of the row equal to ``child`` of the parent) is missing or has the same direction."""
    p = rows.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(child).alias("__at"), F.col(direction).alias("__direction"), F.lit(True).alias("__there"))
    on = F.col(parent) == F.col("__at")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = rows.where(F.col(parent).isNotNull()).join(p, on, "left")
    bad = F.col("__there").isNull() | F.col("__direction").eqNullSafe(F.col(direction))
    return joined.where(bad).select(*rows.columns)
