"""Operators against brute force, exact round trips and damaged input."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest_rows import docs_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import decontam, flac, htmltext, langid, lattice, pieces, simjoin, textvec, token_files, token_rollup, warc
from tallyspark.plans.session import workspace

MODEL = public_tokenizers.path(pieces.MODEL)


# Similarity join


def shingle_set(text, n=5):
    w = [x.lower() for x in re.split(r"[ \t\n\r\f\x0b]+", text or "") if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_join(rows, threshold=0.8):
    """(doc_id, class_id, n_links) of each row."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], least[find(i)], links[i]) for i in range(len(rows))]


def near_copies(n, seed):
    r = random.Random(seed)
    base = prose(seed, 150).split()
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_join_equals_brute_force(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(simjoin, "BLOCK", 7)  # so that a group is cut into blocks
    monkeypatch.setattr(simjoin, "SPREAD", 1)
    monkeypatch.setattr(simjoin, "HOT_ROWS", 3)  # and classes over salts
    texts = near_copies(60, 5) + near_copies(4, 6) + [prose(k, 80) for k in range(100, 110)] + [prose(100, 80)] * 5 + ["a b c", "A  B\tc", "", None]
    rows = list(enumerate(texts))
    got = simjoin.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(brute_join(rows))
    odd = [r[:2] for r in docs_rows()]
    got = simjoin.join(odd_docs).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=key) == sorted(brute_join(odd), key=key)


def test_recall_of_planted_pairs(spark):
    """Pairs at and above the threshold, most of them close to it."""
    r = random.Random(11)
    rows, planted = [], 0
    for k in range(400):
        words = prose(1000 + k, 120).split()
        other = list(words)
        for place in r.sample(range(len(words)), r.randint(1, 3)):
            other[place] = f"w{r.randrange(10**6)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        planted += len(a & b) >= 0.8 * len(a | b)
    found = sum(x.n_links for x in simjoin.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) // 2
    print(f"recall {found / planted:.4f} of {planted} planted pairs")
    assert planted > 250 and found / planted >= 0.99


def test_hot_classes_are_dealt_over_salts(spark):
    rows = spark.range(4000).selectExpr("id AS unit", "0 AS side", "0 AS band", "cast(cast(if(id % 10 = 0, id, 7) AS string) AS binary) AS key")
    side = rows.select("key").distinct().withColumn("size", simjoin.F.lit(1))
    met = simjoin._with_classes(rows, side)
    assert met.count() == 4000 and met.columns == ["key", "unit", "side", "band", "size"]
    parts = -(-3600 // simjoin.HOT_ROWS)
    salts = rows.where("unit % 10 <> 0").select(simjoin.F.pmod(simjoin.F.xxhash64("unit", "side", "band"), simjoin.F.lit(parts)).alias("s"))
    sizes = [x["count"] for x in salts.groupBy("s").count().collect()]
    assert len(sizes) == parts and max(sizes) < 2 * simjoin.HOT_ROWS


def test_pairs_of_units(monkeypatch):
    """Small and large units give each pair once: all of a block, or those across two blocks."""
    monkeypatch.setattr(simjoin, "PAIRS", 50)
    r = random.Random(3)
    unit, side = [], []
    for k, m in enumerate([1, 2, 5, 5, 9, 300, 1, 270, 40]):
        unit += [k] * m
        side += [2] * m if k % 2 else [r.randint(0, 1) for _ in range(m)]
    found = [p for a, b in simjoin._pairs(np.array(unit), np.array(side)) for p in zip(a.tolist(), b.tolist(), strict=True)]
    n = len(unit)
    wanted = {(i, j) for i in range(n) for j in range(i + 1, n) if unit[i] == unit[j] and (side[i] == 2 or side[i] != side[j])}
    assert len(found) == len(wanted) and {tuple(sorted(p)) for p in found} == wanted


def test_rows_of_one_large_bucket(spark):
    """Rows that a bucket of S classes sends grow with S to the power of 1.5, a unit's with its root."""
    for n in (1_000, 20_000):
        buckets = spark.range(n).selectExpr("1L AS bucket", "0 AS band", "cast(cast(id AS string) AS binary) AS key")
        units = simjoin._units(buckets).groupBy("unit").count().collect()
        block = max(simjoin.BLOCK, simjoin.SPREAD * n**0.5)
        assert sum(u["count"] for u in units) <= n * (n / block + 1)
        assert max(u["count"] for u in units) <= 3 * block


def test_pruning_keeps_what_is_likely():
    least = simjoin.least_matches(0.8)
    assert list(least) == [25, 50, 75, 100, 125, 150]
    for n, m in least.items():  # a pair at the threshold drops out with about the tolerance
        below = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert below < 10 * simjoin.TOLERANCE


def test_signatures_estimate_similarity():
    texts = near_copies(2, 9)
    data, offsets = textvec.utf8(pa.array(texts))
    values, _ = simjoin.signatures(data, offsets)
    a, b = map(shingle_set, texts)
    assert abs((values[0] == values[1]).mean() - len(a & b) / len(a | b)) < 0.15


def test_overlaps():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 500, 200).astype(np.uint64)) for _ in range(9)]
    a, b = np.triu_indices(9, 1)
    assert simjoin.overlaps(sets, a, b).tolist() == [len(set(sets[i]) & set(sets[j])) for i, j in zip(a, b, strict=True)]


def test_components_of_long_chains(spark):
    edges = [(bytes([i + 1]), bytes([i])) for i in range(40)] + [(b"z1", b"z2"), (b"z3", b"z3")]
    got = {bytes(r.key): bytes(r.root) for r in simjoin.components(spark.createDataFrame(edges, "key binary, root binary")).collect()}
    assert got == {bytes([i]): b"\x00" for i in range(41)} | {b"z1": b"z1", b"z2": b"z1"}


# Decontamination


def test_decontamination_equals_brute_force(spark):
    items = [(k, prose(200 + k, n)) for k, n in enumerate((5, 6, 15, 40, 57, 3, 1))] + [(90, None), (91, " ?! ")]
    words = {k: t.split() for k, t in items if t}
    rows = []
    for k, w in words.items():
        cut = w[: -max(1, len(w) // 8)] if len(w) > 9 else w
        rows += [(len(rows), prose(300 + k, 400) + " " + " ".join(cut) + " " + prose(400 + k, 300)), (len(rows) + 1, " ".join(w).upper()), (len(rows) + 2, " ".join(w[: len(w) // 2]))]
    rows += [(len(rows), None), (len(rows) + 1, ""), (None, " ".join(words[3]))]
    norm = lambda t: [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]

    def sets(t, n):
        w = norm(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for doc, text in rows:
        for item, part in items:
            n = min(5, len(norm(part)))
            q = sets(part, n) if n else set()
            shared = len(q & sets(text, n)) if n else 0
            if q and shared >= 0.8 * len(q) - 1e-9:
                want.add((doc, item, len(q), shared))
    got = decontam.contained_items(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got} == want and len(got) == len(want)


def test_decontamination_equals_its_sql_on_short_items(spark, tmp_path):
    import duckdb

    long = prose(5, 200)
    docs = [(1, long), (2, "one two three"), (3, "x " + long + " one two"), (4, None), (5, "two three"), (6, "one two three four five")]
    items = [(1, "one two"), (2, "Two, three!"), (3, " ".join(long.split()[20:80])), (4, "one"), (5, "one two three four five"), (6, None), (7, "four one")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contained_items(d, b).collect()
    con = duckdb.connect()
    for name, frame in (("documents", d), ("benchmark", b)):
        frame.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = con.execute(decontam.SQL).fetchall()
    assert Counter(map(tuple, got)) == Counter(want) and {(r.doc_id, r.item_id) for r in got} >= {(2, 1), (2, 2), (2, 4), (5, 2), (3, 1), (6, 5), (1, 3)}


def test_decontamination_of_many_items_in_one_document(spark):
    """A document that holds hundreds of items: each is found, and its shingles are made once, not for each item."""
    text = prose(9, 3000)
    w = text.split()
    items = spark.createDataFrame([(k, " ".join(w[9 * k : 9 * k + 20])) for k in range(300)], "item_id bigint, text string")
    found = decontam.contained_items(spark.createDataFrame([(1, text), (2, prose(10, 50))], "doc_id bigint, text string"), items)
    assert sorted((r.doc_id, r.item_id, r.containment) for r in found.collect()) == [(1, k, 1.0) for k in range(300)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower() and plan.count("sequence(") == 1


def test_decontamination_runs_no_python(spark, tables):
    from tallyspark.llm.decontam import query

    plan = query(spark, tables["odd"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination_beyond_the_broadcast_bound(spark, odd_docs, tables, monkeypatch):
    bench = spark.read.parquet(f"{tables['odd']}/benchmark.parquet")
    small = decontam.contained_items(odd_docs, bench).collect()
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert Counter(decontam.contained_items(odd_docs, bench).collect()) == Counter(small) and small


# Subword lattices


def all_segmentations(word, weights):
    """Summed and best weight of all ways to cut the word into pieces."""
    total, best = [1.0] + [0.0] * len(word), [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            p = weights.get(word[i:j], 0.0)
            total[j] += total[i] * p
            best[j] = max(best[j], best[i] * p)
    return total[-1], best[-1]


@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=20))
@settings(max_examples=25, deadline=None)
def test_lattice_equals_enumeration(words):
    texts = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca", b"cab"]
    p = np.linspace(0.05, 0.2, len(texts))
    weights = dict(zip(texts, p, strict=True))
    own = lattice.Lattice(texts, np.log(p))
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    for rows, group in own.groups(data, ends - [len(w) for w in raw], ends):
        sums, (_, scores) = own.marginal(group), own.best(group)
        for k, i in enumerate(rows):
            total, best = all_segmentations(raw[i], weights)
            assert np.isclose(sums[k], math.log(total)) and np.isclose(scores[k], math.log(best))


@given(st.lists(st.text("abcé", min_size=1, max_size=12), min_size=1, max_size=6), st.booleans())
@settings(max_examples=40, deadline=None)
def test_few_long_words_go_arc_by_arc(words, bytes_too):
    texts = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca", "é".encode()]
    p = np.linspace(0.05, 0.2, len(texts) + (256 if bytes_too else 0)).astype(np.float32).astype(float)
    own = lattice.Lattice(texts, np.log(p), bytes_too)
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    few, long = lattice.FEW, lattice.LONG
    for _, group in own.groups(data, ends - [len(w) for w in raw], ends):
        want = own.best(group), own.marginal(group) if bytes_too else 0.0
        lattice.FEW, lattice.LONG = 100, 0
        try:
            got = own.best(group), own.marginal(group) if bytes_too else 0.0
        finally:
            lattice.FEW, lattice.LONG = few, long
        assert np.allclose(got[0][1], want[0][1]) and np.allclose(got[1], want[1])
        assert bytes_too or np.array_equal(got[0][0], want[0][0])


def test_expected_counts_equal_enumeration():
    texts = [b"a", b"b", b"ab", b"ba"]
    p = np.array([0.2, 0.1, 0.15, 0.05])
    own = lattice.Lattice(texts, np.log(np.concatenate([p, np.full(256, 0.001)])), bytes_too=True)
    word = np.frombuffer(b"abab", np.uint8)[None]
    out = np.zeros(4 + 256)
    ll = own.expected_counts(word, np.array([3.0]), out)
    full = dict(zip(texts, p, strict=True))
    arcs = [(i, t, q) for t, q in full.items() for i in range(4) if b"abab"[i : i + len(t)] == t] + [(i, bytes([b"abab"[i]]) + b"*", 0.001) for i in range(4)]
    total, used = 0.0, Counter()
    for path in (c for n in range(1, 5) for c in itertools.combinations(sorted(arcs), n)):
        at = 0
        for i, t, _ in path:
            if i != at:
                break
            at += len(t.rstrip(b"*"))
        else:
            if at == 4:
                w = math.prod(q for *_, q in path)
                total += w
                for _, t, _ in path:
                    used[t] += w
    assert np.isclose(ll, 3 * math.log(total))
    for k, t in enumerate(texts):
        assert np.isclose(out[k], 3 * used[t] / total)
    assert np.isclose(out[4 + ord("a")], 3 * used[b"a*"] / total)


def test_pieces_are_those_of_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    vocabulary = lattice.vocabulary(MODEL)
    proto = pb.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    weight = vocabulary.zipf()
    for i, s in zip(vocabulary.ids, weight, strict=True):
        proto.pieces[i].score = s
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    by_id = dict(zip(vocabulary.ids.tolist(), weight, strict=True))
    least = weight.min() - lattice.UNKNOWN_PENALTY
    texts = [w for k in range(5) for w in prose(k, 300).split()] + ["日本語 naïve 😀", "a  b   c", "\n\ttab", "x" * 70, "ÀÉÎ ß", "&&& $$$"]
    data, offsets = textvec.utf8(pa.array(texts))
    ids, counts = pieces.codec(MODEL).encode(data, offsets)
    ends = np.cumsum(counts)
    same = 0
    for t, e, n in zip(texts, ends, counts, strict=True):
        own, theirs = ids[e - n : e].tolist(), library.encode(t)
        same += own == theirs
        score = lambda x: sum(by_id.get(i, least) for i in x)
        assert own == theirs or abs(score(own) - score(theirs)) < 1e-3, t  # ties are cut otherwise
    assert same > 0.98 * len(texts)


@given(st.lists(st.text(max_size=40), max_size=12))
@settings(max_examples=60, deadline=None)
def test_pieces_round_trip(texts):
    data, offsets = textvec.utf8(pa.array(texts, pa.string()))
    ids, counts = pieces.codec(MODEL).encode(data, offsets)
    back, sizes = pieces.codec(MODEL).decode(ids, counts)
    ends = np.cumsum(sizes)
    got = [back.tobytes()[e - s : e].decode() for e, s in zip(ends, sizes, strict=True)]
    assert got == [t.replace("▁", " ") for t in texts]


def test_piece_tables(spark, odd_docs):
    encoded = pieces.encode(odd_docs, MODEL)
    back = pieces.decode(encoded, MODEL, keep=["doc_id", "score"]).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, (t or "").replace("▁", " ")) for i, t, *_ in docs_rows())
    assert all(r.score == "clash" for r in back)
    with pytest.raises(Exception, match="vocabulary"):
        pieces.decode(spark.createDataFrame([(1, [10**6])], "doc_id int, ids array<int>"), MODEL).collect()


# Hashes of text


@given(st.lists(st.text(" \tabcdeé", max_size=60), max_size=10))
@settings(max_examples=60, deadline=None)
def test_shingles_are_word_windows(texts):
    data, offsets = textvec.utf8(pa.array(texts, pa.string()))
    h, rows = textvec.shingles(data, offsets)
    seen: dict = {}
    own = defaultdict(list)
    for x, r in zip(h.tolist(), rows.tolist(), strict=True):
        own[r].append(x)
    for r, t in enumerate(texts):
        w = [x for x in re.split(r"[ \t]+", t) if x]
        windows = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        assert len(windows) == len(own[r])
        for window, x in zip(windows, own[r], strict=True):
            assert seen.setdefault(window, x) == x
    assert len(set(seen.values())) == len(seen)


# FLAC


@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5))
@settings(max_examples=25, deadline=None)
def test_flac_round_trip(texts):
    payloads = [flac.payload_of(np.frombuffer(t, np.uint8)) for t in texts]
    streams = flac.encode([flac.LEVEL[p] for p in payloads], flac.LEVEL_BLOCK)
    for x, p, s in zip(flac.decode(streams), payloads, streams, strict=True):
        m = flac.metadata(s)
        assert m.levels and np.array_equal(flac.bytes_of(x, True), p)
        plain = flac._plain(s, m, m.audio, len(s))[:, 0]  # the decoder that goes bit by bit agrees
        assert np.array_equal(plain.astype(np.int8), x)


def test_flac_subframes_and_seeking():
    t = np.arange(576 * 4)
    waves = [np.full(576, 9), (t * 3) % 251, 128 + 90 * np.sin(t / 9), np.random.default_rng(0).integers(0, 256, 1152), np.where(t == 700, 255, 0)]
    payloads = [w.astype(np.uint8) for w in waves] + [flac.payload_of(np.frombuffer(prose(4, 900).encode(), np.uint8))]
    streams = flac.encode([(p ^ 0x80).view(np.int8) for p in payloads])
    assert all(np.array_equal(flac.bytes_of(x, False), p) for x, p in zip(flac.decode(streams), payloads, strict=True))
    places = [0, 575, 576, 1000, 100, 4000]
    for x, p, at in zip(flac.seek_all(streams, places, 300), payloads, places, strict=True):
        assert np.array_equal(flac.bytes_of(x, False), p[at : at + 300])
    kinds = set()
    for s in streams:
        m = flac.metadata(s)
        kinds |= {s[m.audio + int(o) + 6] >> 1 for o in m.points["offset"]}
        assert flac.seek(s, 500, 200).tolist() == (flac.decode([s])[0][500:700]).tolist()
    assert {0, 1} < kinds and any(8 <= k <= 12 for k in kinds) and any(k >= 32 for k in kinds)
    s = bytearray(streams[2])
    s[-9] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        flac.decode([bytes(s)])
    with pytest.raises(ValueError):
        flac.decode([streams[2][:-40]])


def test_flac_levels_are_one_to_one():
    every = np.arange(256, dtype=np.uint8)
    assert len(set(flac.LEVEL.tolist())) == 256 and np.array_equal(flac.BYTE[flac.LEVEL.view(np.uint8)], every)
    assert flac.LEVEL[ord(" ")] == 0 and np.array_equal(flac.bytes_of(flac.LEVEL[every].astype(np.int32), True), every)


#: Streams put together by hand from the format's description: (bytes, samples).
BY_HAND = [
    # One frame of four samples, fixed predictor of order 1: warm-up 10; Rice parameter 0; residuals 1, 0, -1 as 2, 0, 1.
    ("subframe 8-bit fixed order 1", 10, "0001001 0", "00001010", "00 0000 0000", "001 1 01", [10, 11, 11, 10]),
    # The same samples as a constant and as verbatim ones.
    ("constant", 7, "0000000 0", "00000111", "", "", [7, 7, 7, 7]),
    ("verbatim", 3, "0000001 0", "00000011 11111111 00000000 01111111", "", "", [3, -1, 0, 127]),
    # Linear predictor of order 1, coefficient 2 of 3 bits, shift 1: as fixed order 1.
    ("linear", 10, "0100000 0", "00001010 0010 00001 010", "00 0000 0000", "001 1 01", [10, 11, 11, 10]),
]


@pytest.mark.parametrize("parts", BY_HAND, ids=lambda p: p[0])
def test_flac_streams_by_hand(parts):
    """Frames that no encoder of this library has written."""
    import hashlib

    _, _, head, warm, coding, residuals, samples = parts
    bits = "0" + head.split()[0][1:] + head.split()[1]
    bits = bits + warm.replace(" ", "") + coding.replace(" ", "") + residuals.replace(" ", "")
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    start = b"\xff\xf8\x60\x02\x00\x03"  # block size in 8 bits less one, rate of STREAMINFO, mono, 8 bits, frame 0

    def crc(data, poly, width):
        x = 0
        for byte in data:
            x ^= byte << width - 8
            for _ in range(8):
                x = (x << 1 ^ (poly if x >> width - 1 else 0)) & (1 << width) - 1
        return x.to_bytes(width // 8, "big")

    frame = start + crc(start, 0x07, 8) + body
    frame += crc(frame, 0x8005, 16)
    pcm = np.array(samples, np.int8)
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 4).to_bytes(8, "big") + hashlib.md5(pcm.tobytes()).digest()
    stream = b"fLaC\x80\x00\x00\x22" + info + frame
    assert flac.decode([stream])[0].tolist() == samples
    assert flac.seek(stream, 1, 2).tolist() == samples[1:3]
    with pytest.raises(ValueError, match="checksum"):
        flac.decode([stream[:-1] + bytes([stream[-1] ^ 1])])


def test_flac_tables(spark, odd_docs):
    path = workspace(spark, "flac-test")
    media = flac.stored(flac.encode_column(odd_docs.where("doc_id < 11")), path)
    blocks = flac.pcm_blocks(media, samples=1000).collect()
    by_doc = defaultdict(dict)
    for b in blocks:
        by_doc[b.doc_id][b.sample_offset] = bytes(b.pcm)
        assert b.n_samples == len(b.pcm) and len(b.tail) == 32
    for doc_id, text, *_ in docs_rows():
        if doc_id is not None and doc_id < 11:
            raw = b"".join(v for _, v in sorted(by_doc[doc_id].items()))
            own = (text or "").encode()
            assert raw == own + b"\xff" * (len(raw) - len(own)) and len(raw) % 576 == 0 and list(by_doc[doc_id]) == list(range(0, len(raw), 1000))


def test_flac_written_blocks_are_read_by_ranges(spark, odd_docs):
    path = workspace(spark, "flac-pcm-test")
    docs = odd_docs.where("doc_id < 11").dropDuplicates(["doc_id"])
    blocks = flac.write_pcm(flac.encode_column(docs), path, samples=1000)
    payload = {r.doc_id: flac.payload_of(np.frombuffer((r.text or "").encode(), np.uint8)).tobytes() for r in docs.collect()}
    assert all(bytes(r.pcm) == payload[r.doc_id][r.sample_offset :][: r.n_samples] and r.block == r.sample_offset // 1000 for r in blocks.collect())
    longest = max(payload, key=lambda k: len(payload[k]))
    assert len(payload[longest]) > 3000
    ends = [(k, len(v) - 5, 100) for k, v in payload.items()]
    none = [(longest, None, 5), (longest, 5, None), (None, 0, 5), (-77, 0, 5), (longest, 10, 0), (longest, 10, -3), (longest, 2**62, 2**62)]
    wanted = [*ends, (longest, 990, 2020), (longest, -10, 30), (longest, 1000, 1000), (longest, 999, 2), (longest, 0, 2**63 - 1), *none]
    rows = flac.pcm_ranges(blocks, spark.createDataFrame([(*w, "clash") for w in wanted], "doc_id bigint, start bigint, length bigint, pcm string"), 1000).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id, r.start, r.length].append((r.sample_offset, bytes(r.pcm)))
    for k, start, length in wanted:
        own = sorted(parts.pop((k, start, length), []))
        want = b"" if (k, start, length) in none else payload[k][max(0, start) : start + length]
        assert b"".join(x for _, x in own) == want and (not own or own[0][0] == max(0, start))
        assert len(own) == len({(at // 1000) for at, _ in own})
    assert not parts
    assert flac.pcm_ranges(blocks, spark.createDataFrame([], "doc_id bigint, start bigint, length bigint")).count() == 0


def test_digests_need_whole_streams_in_order(spark, odd_docs, monkeypatch):
    media = flac.encode_column(odd_docs.where("doc_id = 5").limit(1).union(odd_docs.where("doc_id = 5").limit(1)))
    whole = flac.pcm_blocks
    assert len({tuple(r) for r in flac.digests(media).collect()}) == 1
    monkeypatch.setattr(flac, "pcm_blocks", lambda *a, **k: whole(*a, samples=576, **k).where("sample_offset + n_samples < samples OR sample_offset = 0"))
    with pytest.raises(Exception, match="doesn't follow|no end"):
        flac.digests(flac.encode_column(odd_docs)).collect()


def test_features_do_not_depend_on_blocks():
    pcm = np.random.default_rng(3).integers(0, 256, 5000).astype(np.uint8)
    whole, parts = flac.Feature(), flac.Feature()
    whole.add(pcm)
    for part in np.array_split(pcm, 13):
        parts.add(part)
    x = pcm.astype(int) - 128
    assert str(whole) == str(parts) == f"samples=5000;sum={x.sum()};energy={(x * x).sum()};crossings={((x[1:] < 0) != (x[:-1] < 0)).sum()};step={abs(np.diff(x)).max()}"


# Token files


def write_shard(base, ids, length=64):
    with open(f"{base}.arrows", "wb") as f:
        writer = token_files.SequenceWriter(f, length, ids.dtype)
        for part in np.array_split(ids, 7):
            writer.add(part)
        writer.close()
    with open(f"{base}.batches", "wb") as f:
        writer.write_places(f)
    return writer


def test_sequences_are_views(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_ROWS", 16)
    ids = np.arange(5000, dtype=np.uint16)
    writer = write_shard(tmp_path / "x", ids)
    read = token_files.SequenceFile(f"file://{tmp_path}/x")
    assert len(read) == writer.sequences == 79 and len(writer.batches) == 5
    for i in range(len(read)):
        own, mask = read.sequence(i)
        batch = read.batch(i // 16)
        assert own[mask.to_numpy(zero_copy_only=False)].tolist() == ids[i * 64 : (i + 1) * 64].tolist()
        for view, column in ((pa.array(own), batch.column(0)), (mask, batch.column(1))):  # of the batch's own memory
            assert view.buffers()[1].address == column.values.buffers()[1].address + (0 if view is mask else 2 * 64 * (i % 16))
    assert read.tokens(100, 4000).tolist() == ids[100:4100].tolist() and read.tokens(10, 0).tolist() == []
    whole = pa.ipc.open_stream(f"{tmp_path}/x.arrows").read_all()  # any Arrow reader reads the stream
    assert whole.num_rows == 79 and whole.column(0).combine_chunks().flatten().to_pylist()[:5000] == ids.tolist()


def test_remote_sequences_read_their_batch_only(tmp_path, monkeypatch):
    from pyarrow import fs as pafs

    from tallyspark.llm import store

    monkeypatch.setattr(token_files, "BATCH_ROWS", 4)
    monkeypatch.setattr(token_files, "HELD_BATCHES", 2)
    ids = np.arange(9000, dtype=np.uint16)
    write_shard(tmp_path / "x", ids)
    remote = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    monkeypatch.setitem(store.STORES, "fake", lambda uri: (remote, uri.removeprefix("fake://")))
    read = token_files.SequenceFile("fake://x")
    assert not read.local and read.sequence(70)[0].tolist() == ids[70 * 64 : 71 * 64].tolist() and len(read.held) == 1
    assert all(read.sequence(i)[0][0] == i * 64 for i in (0, 9, 33, 100, 2)) and len(read.held) == 2


def test_long_texts_are_cut_at_words():
    text = (prose(5, 4000) + " \n ") * 3
    raw = text.encode()
    data, offsets = textvec.utf8(pa.array(["a b", text, None, "x" * 5000]))
    whole = textvec.span_hashes(data, *textvec.word_spans(data, offsets)[:2])
    parts, seen = [], b""
    for row, end, part, cuts, last in textvec.word_chunks(data, offsets, 1000):
        starts, ends, _ = textvec.word_spans(part, cuts)
        parts.append(textvec.span_hashes(part, starts, ends))
        seen += part.tobytes()
        assert last or end == row + 1 == 2
    assert np.array_equal(np.concatenate(parts), whole) and seen == data.tobytes() and raw in seen
    encoder = token_files.encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids, counts = encoder.encode(data, offsets, 2)
    few, few_counts = None, None
    size, token_files.ENCODE_BYTES = token_files.ENCODE_BYTES, 1000
    try:
        few, few_counts = encoder.encode(data, offsets, 2)
    finally:
        token_files.ENCODE_BYTES = size
    assert np.array_equal(ids, few) and np.array_equal(counts, few_counts)


def test_hashes_of_long_spans(monkeypatch):
    data = np.frombuffer(prose(6, 3000).encode(), np.uint8)
    starts, ends = np.array([0, 700, 900]), np.array([600, 800, len(data)])
    want = textvec.span_hashes(data, starts, ends)
    monkeypatch.setattr(textvec, "CHUNK_BYTES", 128)
    assert np.array_equal(textvec.span_hashes(data, starts, ends), want)


# WARC


def test_warc_lookup_and_order(spark):
    rows = [(k, f"http://h{k % 7}.example.org/{k % 50}", f"<p>{k % 13}</p>" * (200 if k % 3 else 1)) for k in range(300)]
    rows += [(1000 + k, "http://hot.org/", "x") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = workspace(spark, "warc-test")
    manifest = warc.write(warc.captures(pages), path, block_lines=8, file_bytes=2000).orderBy("shard")
    listed = manifest.collect()
    shards = [(m.path, m.first_key, m.first_page, m.last_key, m.last_page) for m in listed]
    assert all(a[3:] <= b[1:3] for a, b in itertools.pairwise(shards)) and sum(m.records for m in listed) == len(rows)
    archive = warc.Archive(shards)
    for url in ("http://h3.example.org/10", "http://hot.org/", "http://nowhere.org/"):
        key = {"http://h3.example.org/10": "org,example,h3)/10", "http://hot.org/": "org,hot)/", "http://nowhere.org/": "org,nowhere)/"}[url]
        got = {warc._page(h["WARC-Record-ID"]) for h, _ in warc.lookup(archive, key)}
        assert got == {p for p, u, _ in rows if u == url}
    hot = [s for s in shards if s[1] <= "org,hot)/" <= s[3]]
    assert len(hot) > 1  # one address is spread over shards
    wanted = spark.createDataFrame([("org,hot)/", 1007), ("org,hot)/", 1007), ("org,hot)/", 5), ("org,example,h3)/10", 10), ("org,nowhere)/", 10)], "key string, page_id bigint")
    found = {(r.page_id, r.url): r.payload and bytes(r.payload) for r in warc.read(manifest, wanted, payloads=True).collect()}
    assert found == {(1007, "http://hot.org/"): b"x", (10, "http://h3.example.org/10"): None}


def test_warc_reads_little_for_a_lookup(spark, monkeypatch):
    """One capture costs one directory, one block and one record, however many there are."""
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://a.org/', id) AS url", "'x' AS html")
    manifest = warc.write(warc.captures(pages), workspace(spark, "warc-few"), block_lines=16, shards=3).orderBy("shard").collect()
    read = Counter()
    for name in ("_directory", "_block", "_record"):
        monkeypatch.setattr(warc, name, lambda *x, name=name, f=getattr(warc, name): (read.update([name]), f(*x))[1])
    archive = warc.Archive([(m.path, m.first_key, m.first_page, m.last_key, m.last_page) for m in manifest])
    assert [warc._page(h["WARC-Record-ID"]) for h, _ in warc.lookup(archive, "org,a)/1234")] == [1234]
    assert read["_directory"] <= 2 and read["_block"] <= 3 and read["_record"] == 1
    broken = warc.record(1, "u", b"abc", "0" * 40, "response", None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(broken)


def test_stores_are_found_by_scheme(monkeypatch, tmp_path):
    from pyarrow import fs as pafs

    from tallyspark.llm import store

    fake = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    monkeypatch.setitem(store.STORES, "fake", lambda uri: (fake, uri.removeprefix("fake://")))
    with store.written("fake://bucket/a/x", 3) as out:
        out.write(b"abc")
    assert (tmp_path / "bucket/a/x").read_bytes() == b"abc" and store.opened("fake://bucket/a/x").read() == b"abc"
    with pytest.raises(RuntimeError), store.written("fake://bucket/a/y", 1):
        raise RuntimeError
    assert [p.name for p in (tmp_path / "bucket/a").iterdir()] == ["x"]
    for uri in ("file:/tmp/a b", "/tmp/a b", "file:///tmp/a b"):
        assert store.located(uri)[1] == "/tmp/a b"
    assert store.located("dbfs:/x/y")[1] == "/dbfs/x/y"


def test_tasks_follow_bytes(spark, tmp_path, monkeypatch):
    from tallyspark.llm import store

    spark.range(1000).selectExpr("repeat(cast(id AS string), 100) AS text").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").where("text <> ''")
    size = store.input_bytes(df)
    assert size == sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert store.tasks_for(df) == 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(store, "TASK_BYTES", size // 100)
    assert store.tasks_for(df) in (100, 101)
    assert store.input_bytes(spark.sparkContext.parallelize([(1,)]).toDF(["a"])) is None


def test_warc_digests_beyond_the_broadcast_bound(spark, tables, monkeypatch):
    pages = spark.read.parquet(f"{tables['odd']}/pages.parquet")
    small = Counter(warc.captures(pages).collect())
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert Counter(warc.captures(pages).collect()) == small


# HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='ad'>x<article><p>kept</p></article></div>", "kept"),
        ("<main><h1>T</h1><p>a&lt;b &#233;</p><aside>no</aside><p>c\n\n d<br>e</p></main>", "T\na<b é\nc d e"),
        ("<article><p>one</p><form>no</form><p>two</article><section class='comments'><article><p>a comment</p></article></section>", "one\ntwo"),
        ("<header>site</header><div id='content'><h2>H</h2><p>" + "words and more words " * 20 + "</p><p>short</p></div><div class='sidebar'>no</div><footer>f</footer>", "H\n" + ("words and more words " * 20).strip() + "\nshort"),
        ("<script>var a='</p>';</script><style>p{}</style><p>text</p>", "text"),
        ("<nav><a href=x>only links</a></nav>", ""),
        ("<![foo[x]]><p>after", "after"),
        ("no tags at all", "no tags at all"),
        ("<article><header><h1>Head</h1></header><p>p</p><footer>by</footer></article>", "Head\np"),
    ],
)
def test_main_text(html, text):
    assert htmltext.extract(html) == text


# Language identification


def test_filter_counts_are_corrected():
    r = np.random.default_rng(1)
    grams = {k: np.unique(r.integers(0, 2**32, 4000, dtype=np.uint64).astype(np.uint32)) for k in ("a", "b")}
    own = langid.LanguageFilter.build(grams, slot_bits=12)
    for bit, k in enumerate(("a", "b")):
        assert ((own.masks(grams[k])[0] >> bit) & 1).all()  # nothing inserted is missed
    foreign = r.integers(0, 2**32, 20_000, dtype=np.uint64).astype(np.uint32)
    rate = ((own.masks(foreign) & 1) == 1).mean()
    assert abs(rate - own.fill[0] ** own.hashes) < 0.03


def test_language_of_many_labels(spark):
    """More languages than a number has bits, and labels that nothing can be learned from."""
    words = {f"l{k:02d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}q" for x in "abcdefgh"] for k in range(75)}
    rows = [(1000 * i + j, " ".join(w * 4), k) for i, (k, w) in enumerate(words.items()) for j in range(9)]
    rows += [(10**6 + j, f"stray {j}", f"junk{j}") for j in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(docs)
    assert model.slots.shape[0] == 2 and model.languages == sorted(words)
    own = [r for r in langid.predict(docs, model).collect() if r.doc_id < 10**6]
    assert all(r.lang == r.lang_pred and r.score > 0.5 and r.fit > 0.9 for r in own)
    foreign = spark.createDataFrame([(1, "Привет мир " * 50, None), (2, None, None)], docs.schema)
    told = {r.doc_id: r for r in langid.predict(foreign, model).collect()}
    assert told[1].fit < 0.1 and told[2].lang_pred == langid.UNKNOWN


def test_filters_grow_with_their_sets():
    r = np.random.default_rng(2)
    for n in (1000, 400_000):
        own = langid.LanguageFilter.build({"a": np.unique(r.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32))})
        assert own.fill[0] ** own.hashes < langid.FALSE


def plain_grams(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\r\f\x0b" else b for b in text.encode())
    return Counter(raw[i : i + n] for n in langid.LENGTHS for i in range(len(raw) - n + 1))


def test_language_query_equals_a_plain_version(spark):
    """Sets in place of the Bloom filter: equal languages but for near ties, scores up to the correction's error."""
    import zlib

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fold = {k: zlib.crc32(str(k).encode()) % 3 for k in rows}
    counts = defaultdict(Counter)
    for k, r in rows.items():
        if fold[k] != 1 and r.text is not None and r.lang is not None:
            counts[r.lang].update(plain_grams(r.text))
    total = {(lang, n): sum(c for g, c in own.items() if len(g) == n) for lang, own in counts.items() for n in langid.LENGTHS}
    share = {lang: {g: c / total[lang, len(g)] for g, c in own.items() if c >= langid.MIN_COUNT} for lang, own in counts.items()}
    top = Counter()
    for own in share.values():
        for g, p in own.items():
            top[g] = max(top[g], p)
    sets = {lang: {g for g, p in own.items() if p >= langid.RATIO * top[g]} for lang, own in share.items()}
    for r in langid.query(spark, sf).collect():
        text = rows[r.doc_id].text or ""
        assert r.held_out == (fold[r.doc_id] == 1)
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == (langid.UNKNOWN, 0)
            continue
        grams = plain_grams(text)
        hits = sorted(((sum(c for g, c in grams.items() if g in own), lang) for lang, own in sets.items()), reverse=True)
        (best, lang), (second, _) = hits[:2]
        if best > 20:
            assert abs(r.score - best / (best + second)) < 0.03
        if best - second > 5:
            assert r.lang_pred == lang


def test_long_texts_are_read_in_parts(monkeypatch):
    grams = np.unique(langid.gram_codes(*textvec.utf8(pa.array([prose(8, 50)])), 3)[0])
    own = langid.LanguageFilter.build({"a": grams})
    column = textvec.utf8(pa.array(["ab", prose(8, 400), "", prose(9, 10)]))
    want = own.hits(*column)
    monkeypatch.setattr(langid, "CHUNK_BYTES", 64)
    monkeypatch.setattr(langid, "chunks", lambda data, offsets: textvec.chunks(data, offsets, 64))
    got = own.hits(*column)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = langid.predict(docs, langid.learn(docs), keep=["doc_id", "lang"])
    rows = told.where(langid.held_out(told.doc_id)).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 100


# Token counts


def test_rollups_read_what_a_batch_touches(spark):
    """Small commits after a large one: each reads its buckets, and compaction keeps what lies before them short."""
    path = workspace(spark, "rollup-many")
    rollup = token_rollup.TokenRollup(spark, path, compact=4)
    schema = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint"
    load = spark.range(3000).selectExpr("id AS doc_id", "'t' AS tokenizer", "'a' AS source", "'en' AS lang", "id AS n_tokens")
    assert rollup.commit("load", load)
    total, read = 3000 * 2999 // 2, []
    for k in range(1, 12):
        base, recent = rollup._committed()
        buckets = [r.b for r in spark.createDataFrame([(7, "t")], "doc_id bigint, tokenizer string").select(token_rollup._bucket().alias("b")).collect()]
        rows = rollup._ledger(base, list(recent.values()), buckets)
        read.append(rows.count())
        assert rows.count() < 3000 / 10 and len(recent) <= 4
        assert rollup.commit(f"b{k}", spark.createDataFrame([(7, "t", "a", "en", 100 * k)], schema))
        assert not rollup.commit(f"b{k}", spark.createDataFrame([(7, "t", "a", "en", 1)], schema)) and not rollup.commit("load", load)
    (r,) = rollup.totals().collect()
    assert (r.n_docs, r.n_tokens) == (3000, total - 7 + 1100) and read[-1] <= read[0] + 4
    assert rollup.commit("none", spark.createDataFrame([], schema)) and rollup.totals().first().n_tokens == total - 7 + 1100


def test_two_writers_of_one_number(spark):
    path = workspace(spark, "rollup-two")
    schema = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint"
    rows = spark.createDataFrame([(1, "t", "a", "en", 5)], schema)
    one, other = token_rollup.TokenRollup(spark, path), token_rollup.TokenRollup(spark, path)
    seen, real = other._committed(), other._committed
    assert one.commit("one", rows)
    looks = iter([lambda: seen])
    other._committed = lambda: next(looks, real)()  # its first look is from before that commit
    assert other.commit("other", rows.withColumn("n_tokens", token_rollup.F.lit(8)))
    (r,) = one.totals().collect()
    assert (r.n_docs, r.n_tokens) == (1, 8)
    looks = iter([lambda: seen])
    assert not other.commit("one", rows) and one.totals().first().n_tokens == 8  # the same batch from two writers


def test_batches_of_any_name(spark):
    path = workspace(spark, "rollup-names")
    schema = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint"
    rollup = token_rollup.TokenRollup(spark, path, compact=3)
    names = ["a", "a/b", "a/bucket=1", "..", "x=y %20", "\u00e9\n", ""]
    for k, name in enumerate(names):
        assert rollup.commit(name, spark.createDataFrame([(k, "t", "a", "en", 10**k)], schema))
    assert not any(rollup.commit(name, spark.createDataFrame([(0, "t", "a", "en", 5)], schema)) for name in names)
    (r,) = rollup.totals().collect()
    assert (r.n_docs, r.n_tokens) == (len(names), 1111111)


def test_rollup_is_idempotent_and_recovers(spark, monkeypatch):
    path = workspace(spark, "rollup-test")
    rollup = token_rollup.TokenRollup(spark, path)
    schema = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, ordinal int"
    first = spark.createDataFrame([(1, "t", "a", "en", 5, 1), (1, "t", "a", "en", 6, 2), (2, "t", "a", None, 7, 1), (None, "t", None, "en", 1, 1)], schema)
    assert rollup.commit("one", first) and not rollup.commit("one", first)
    state = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert state() == {("a", "en"): (1, 6), ("a", None): (1, 7), (None, "en"): (1, 1)}
    second = spark.createDataFrame([(1, "t", "b", "en", 10, 1), (2, "t", None, None, None, 1), (9, "t", None, None, None, 1)], schema)
    # A batch that is lost before its commit leaves no trace in the totals, and can be written again.
    with monkeypatch.context() as m:
        m.setattr(token_rollup, "claim", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            rollup.commit("two", second)
    assert state() == {("a", "en"): (1, 6), ("a", None): (1, 7), (None, "en"): (1, 1)}
    assert rollup.commit("two", second) and not rollup.commit("two", second)
    assert state() == {("b", "en"): (1, 10), (None, "en"): (1, 1)}
