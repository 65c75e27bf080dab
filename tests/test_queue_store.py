"""The queue's store: several writers, batches that are run again, what a batch reads."""

import threading

import fixtures
import pytest
from test_operators import PlainQueue, random_commands

from tallyspark.plans.session import store_of, workspace
from tallyspark.streaming import queue as stream

PARTIES = fixtures.PARTIES


def store(spark, **sizes):
    return stream.QueueStore(spark, f"{workspace(spark, 'store')}/q", PARTIES, **sizes)


def frame(spark, rows):
    return spark.createDataFrame(rows, fixtures.COMMAND)


def post(seq, id_, body="x", actor="a", peer="b", reply=None):
    return (seq, "post", id_, actor, peer, "task", body, reply, float(seq))


@pytest.mark.parametrize("second", ["x", "other"])
def test_two_writers_of_one_id(spark, monkeypatch, second):
    """The slower one finds its bucket changed, begins again and reports what the first has made of the id."""
    s = store(spark)
    s.submit(frame(spark, [post(0, "m0")]), 0, "one")
    real, tries = s._publish, []

    def late(snapshot, *rest):
        if not tries:  # between the fold and the commit of writer two
            s2 = stream.QueueStore(spark, s.path, PARTIES)
            s2.submit(frame(spark, [post(0, "m1"), post(1, "m2", actor="b", peer="a", reply="m0")]), 1, "one")
        tries.append(1)
        return real(snapshot, *rest)

    monkeypatch.setattr(s, "_publish", late)
    s.submit(frame(spark, [post(0, "m1", second), post(1, "m3", actor="b", peer="a", reply="m1")]), 0, "two")
    assert len(tries) == 2
    told = {r.seq: (r.id, r.outcome) for r in s.outcomes().collect()}
    assert told == {0: ("m0", "created"), 1: ("m1", "created"), 2: ("m2", "created"), 3: ("m1", "repeat" if second == "x" else "conflict"), 4: ("m3", "created")}
    assert sorted((r.id, r.seq) for r in s.messages().collect()) == [("m0", 0), ("m1", 1), ("m2", 2), ("m3", 4)]
    assert s.submit(frame(spark, [post(0, "m9")]), 0, "two") is None  # a batch that has been applied
    assert {r.message_id for r in s.events(after=0).where("event = 'posted'").collect()} <= {"m0", "m1", "m2", "m3"}


def test_writers_at_once_equal_some_order(spark):
    """Threads that post, answer and acknowledge the same few ids: the outcomes are those of the commands in order of their seqs."""
    s = store(spark, split_rows=8, max_parts=2)
    failed = []

    def write(name):
        try:
            mine = stream.QueueStore(spark, s.path, PARTIES, split_rows=8, max_parts=2)
            for batch in range(2):
                rows = random_commands(40, 12, f"{name}{batch}")
                mine.submit(frame(spark, rows), batch, name)
        except Exception as why:
            failed.append(why)

    threads = [threading.Thread(target=write, args=(n,)) for n in ("x", "y", "z")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    told = {r.seq: r.outcome for r in s.outcomes().collect()}
    assert len(told) == 6 * 40
    by_version, plain = {}, PlainQueue(PARTIES)
    for n in ("x", "y", "z"):
        for batch in range(2):
            by_version[n, batch] = random_commands(40, 12, f"{n}{batch}")
    # commands keep their order within a batch, and batches don't overlap: find each batch's first seq
    ids = {r.seq: (r.op, r.id, r.actor) for r in s.outcomes().collect()}
    want = {}
    left, at = dict(by_version), min(told)
    while left:
        key = next(k for k, rows in left.items() if all(ids.get(at - rows[0][0] + r[0]) == (r[1], r[2], r[3]) for r in rows))
        rows = left.pop(key)
        shift = at - rows[0][0]
        for r in rows:
            want[shift + r[0]] = plain.run(*r)
        later = [q for q in told if q > shift + rows[-1][0]]
        at = min(later) if later else at
    assert told == want
    assert len(s.snapshot()["buckets"]) > 1  # split


def read_bytes(spark, s, rows):
    """Bytes of the state files that a batch of these rows opens."""
    snapshot = s.snapshot()
    named = s._bucketed(frame(spark, rows).select("id").distinct(), list(snapshot["buckets"]))
    total = 0
    for b in {r.bucket for r in named.collect()}:
        for part in snapshot["buckets"][b]["parts"]:
            p, fs = store_of(spark, f"{s.path}/{part}")
            total += fs.getContentSummary(p).getLength()
    return total


def test_a_batch_reads_no_more_than_its_ids_need(spark):
    """Later batches of the same size read no more, however many came before; parts of a bucket stay few."""
    s = store(spark, split_rows=16, max_parts=2)
    read, n = {}, 8
    for batch in range(n):
        rows = [post(k, f"m{batch}-{k}") for k in range(40)]
        read[batch] = read_bytes(spark, s, [post(0, f"m{batch}-0")])
        s.submit(frame(spark, rows), batch, "w")
    assert s.messages().count() == 40 * n
    assert read[n - 1] <= 2 * max(read[2], read[3])
    parts = [len(b["parts"]) for b in s.snapshot()["buckets"].values()]
    assert max(parts) <= 2 and len(parts) >= 16


def test_half_written_attempts_do_not_count(spark, monkeypatch):
    s = store(spark)
    monkeypatch.setattr(s, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        s.apply(frame(spark, [post(0, "m0")]), 0)
    monkeypatch.undo()
    assert s.messages().isEmpty() and s.outcomes().isEmpty() and s.events().isEmpty()
    s.apply(frame(spark, [post(0, "m0")]), 0)
    assert [(r.seq, r.outcome) for r in s.outcomes().collect()] == [(0, "created")]
    assert [(r.event, r.message_id) for r in s.events().collect()] == [("posted", "m0")]
