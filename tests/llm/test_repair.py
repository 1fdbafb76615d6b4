"""Conversation repair, whitening and SimHash against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from habitscope.llm import conversations, simhash
from habitscope.llm.common import table
from habitscope.llm.queries import QUERIES
from habitscope.llm.whitening import whiten
from tests.llm.test_groups import smallest_reachable

CONVERSATION = "conv_id long, turn long, role string, text string, _c int, n int, key int, head int, letter int"


def cheapest(items):
    """(cost, audit, repaired rows) of rows (role, text, fault): all edits by plain recursion over rows and states."""
    memo = {}

    def go(i, state):
        if (i, state) in memo:
            return memo[i, state]
        memo[i, state] = (10**9, "", ())  # an insertion never comes back to the same place
        grammar = {"": "su", "s": "u", "u": "a", "a": "u"}
        options = [(0, "", ())] if i == len(items) and state in ("", "a") else []

        def add(cost, edit, row, at, after):
            rest = go(at, after)
            options.append((cost + rest[0], edit + rest[1], row + rest[2]))

        if i < len(items):
            role, text, fault = items[i]
            add(3, "D", (), i + 1, state)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and role[0] in grammar[state]:
                    add(more, "K", ((role, text),), i + 1, role[0])
                for new in ("user", "assistant"):
                    if new[0] in grammar[state]:
                        add(2 + more, "R", ((new, text),), i + 1, new[0])
        for new in ("user", "assistant"):
            if new[0] in grammar[state] and len(inserted) < 4:
                inserted.append(new)
                add(2, "I", ((new, ""),), i, new[0])
                inserted.pop()
        found = min(options, default=(10**9, "", ()))
        if inserted:
            del memo[i, state]
        else:
            memo[i, state] = found
        return found

    inserted = []
    return go(0, "")


def repaired(rows):
    """The result of the operator's query, row by row in Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " "))
        for _, turn, role, text in mine:
            name = lambda v: " " if v is None else str(v)
            way = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
            role, text = name(role), name(text)
            if way:
                text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
                kept += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, items, faults = set(), [], []
        for _, role, text in kept:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
            seen.add((role, text))
            items.append((role, text, fault))
            faults.append(fault)
        turns = {t for t, _, _ in kept if t is not None}
        cost, audit, fixed = cheapest(items)
        initials = [r[:1] for r, _, _ in items]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(),
        )
    return out


def random_conversations():
    chance = random.Random(5)
    rows = []
    for conv in range(150):
        for turn in range(chance.randrange(1, 9)):
            role = chance.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = chance.choice(["Yes.", "No", "Well!", "", " \n", None, "Again.", "Zwölf Boxer?", "x" * 70000 + "."])
            rows.append((conv, chance.choice([turn, turn, turn, turn + 2, None]), role, text))
    for turn in range(1500):  # several pieces
        rows.append((1000, turn, chance.choice(["user", "assistant"]), f"{turn % 700}."))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)]
    rows += [rows[3]] * 40 + [rows[10]] * 3
    return rows


def results(frame):
    return {r.conv_id: tuple(r)[1:9] for r in frame.collect()}


def test_repair_matches_brute_force(spark):
    import sys

    sys.setrecursionlimit(20000)
    rows = random_conversations()
    frame = spark.createDataFrame([(*r, *[None] * 5) for r in rows], CONVERSATION)
    got = conversations.repair(conversations.damage(frame))
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = repaired(rows)
    found = results(got)
    assert {k: v for k, v in found.items() if want.get(k) != v} == {} and set(found) == set(want)
    assert results(conversations.repair(conversations.damage(frame.repartition(7)))) == want
    assert conversations.repair(conversations.damage(frame.limit(0))).count() == 0


def test_repair_query(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op11_conversation_repair"](spark, folder)) == repaired(rows)


def test_a_lost_conversation_has_an_empty_row(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = conversations.repair(conversations.damage(spark.createDataFrame([(lost, 0, "user", "Hi.", *[None] * 5)], CONVERSATION)))
    assert results(got) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_shared_suffixes_are_built_once():
    graph = conversations.SuffixGraph()
    ends = "EIEIEIEI" * 20
    given = sorted((a + b + ends for a in "AEIM" for b in "AEIM"), key=lambda s: s[::-1])
    for signature in given:
        assert graph.audit(signature) == conversations.SuffixGraph().audit(signature)
    assert graph.built == len(ends) + 4 + 16


def whitened_by_hand(vectors, components=4):
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors], dtype=object)
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
    cov = centred.T @ centred / n
    values, units = np.linalg.eigh(cov)
    values, units = values[::-1][:components], units[:, ::-1][:, :components]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    rows = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    return n, deviation, rows @ units / np.sqrt(values), values / np.trace(cov)


@pytest.mark.parametrize("blocks", [(4096, 1024), (7, 5)])
def test_whitening_matches_numpy(spark, blocks):
    draw = np.random.default_rng(3)
    some = (draw.normal(size=(200, 12)) * np.linspace(3, 1, 12) + 0.25).astype(np.float32)
    vectors = [*map(list, some.tolist()), *[some[0].tolist()] * 60, some[1].tolist()]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, h int, x string")
    got = whiten(frame, 4, *blocks).collect()
    n, deviation, white, explained = whitened_by_hand(vectors)
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n} == {200}
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(4):
        mine = np.array([by[i, k + 1].whitened for i in range(len(vectors))])
        sign = np.sign(mine @ white[:, k])
        np.testing.assert_allclose(sign * mine, white[:, k], rtol=0, atol=1e-9)
        assert abs(by[0, k + 1].explained / explained[k] - 1) < 1e-9
    assert all(by[i, 1].deviation == deviation[i] for i in range(len(vectors)))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [[1.0, 0.0], None, [nan, 1.0], [inf, 1.0], [None, 1.0], [], [0.5], [1.0, 0.0], [0.0, 2.0], [-0.001, 0.3], [1e300, 0.0]]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = whiten(frame(data[:-1])).collect()
    assert {r.vec_id for r in got} == {0, 5, 6, 7, 8, 9} and {r.component for r in got} == {1, 2} and {r.n for r in got} == {5}
    assert [r.vec_id for r in whiten(frame(data)).where("deviation is null and component = 1").orderBy("vec_id").collect()]
    assert whiten(frame([[1.0, 2.0], [1.0, 2.0]])).count() == 0
    assert whiten(frame([[], None])).count() == whiten(frame(data).limit(0)).count() == 0
    line = whiten(frame([[float(i), 2.0 * i] for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_whitening_query(spark, folder):
    vectors = table(spark, folder, "embeddings").orderBy("vec_id").collect()
    got = QUERIES["op12_embedding_whitening"](spark, folder).orderBy("vec_id", "component").collect()
    n, deviation, white, explained = whitened_by_hand([r.embedding for r in vectors])
    assert [r.vec_id for r in got[::4]] == [r.vec_id for r in vectors] and [r.deviation for r in got[::4]] == deviation
    mine = np.array([r.whitened for r in got]).reshape(-1, 4)
    np.testing.assert_allclose(np.abs(mine), np.abs(white), atol=1e-7)
    np.testing.assert_allclose([r.explained for r in got[:4]], explained, rtol=1e-9)
    assert got[0].n == n and got[0].identity_error < 1e-9


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = smallest_reachable(prints, links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op13_simhash_groups"](spark, folder).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_hash_is_that_of_spark(spark):
    texts = ["a b c", "naïve café x", "", "x" * 100]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h")).collect()]
    assert [h % 2**64 for h in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def crowded_points(count, seed=1):
    """Clusters around centres, chains of near values, and lone values."""
    draw = random.Random(seed)
    out = {0, 1, 2**64 - 1}
    while len(out) < count:
        at = draw.getrandbits(64)
        out.add(at)
        for _ in range(draw.choice([0, 0, 3, 40])):
            step = at
            for b in draw.sample(range(64), draw.randrange(1, 5)):
                step ^= 1 << b
            out.add(step)
            if draw.random() < 0.4:
                at = step
    return np.array(sorted(out)[:count], np.uint64)


@pytest.mark.parametrize("shard", [60, 5000])
def test_links_connect_what_all_pairs_connect(spark, shard):
    points = crowded_points(1500)
    apart = np.bitwise_count(points[:, None] ^ points[None, :])
    x, y = np.nonzero(apart <= 3)
    ids = points.view(np.int64).tolist()
    want = smallest_reachable(ids, [(ids[a], ids[b]) for a, b in zip(x, y, strict=True) if a < b])
    frame = spark.createDataFrame([(i,) for i in ids], "fp long")
    got = [(r.a, r.b) for r in simhash.links(frame, 3, shard, 50).collect()]
    assert smallest_reachable(ids, got) == want


def test_every_near_pair_meets_in_a_shard(spark):
    points = crowded_points(800, 2)
    ids = points.view(np.int64)
    rows = simhash.shards(spark.createDataFrame([(i,) for i in ids.tolist()], "fp long"), 3, 40).collect()
    members, visits = {}, {}
    for r in rows:
        (members if r.member else visits).setdefault(r.fp, set()).add(r.node)
    assert all(len(members[i]) == 1 for i in ids.tolist()) and len(members) == len(ids)
    assert len(set().union(*members.values())) > 10
    x, y = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    for a, b in zip(ids[x].tolist(), ids[y].tolist(), strict=True):
        here, there = members[a], members[b]
        assert here == there or here & visits.get(b, set()) or there & visits.get(a, set())


def test_a_dense_group_gives_one_row_for_each_fingerprint(spark):
    for size in (500, 2000):
        near = [a ^ b for a, b in itertools.product([0, *(1 << i for i in range(50))], repeat=2)]
        ids = sorted(set(near))[:size]
        assert simhash.links(spark.createDataFrame([(i,) for i in ids], "fp long")).count() == len(ids) - 1


def test_simhash_of_odd_texts(spark):
    long = "Word and word " * 60000
    data = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, long), (7, long.upper()), (None, "one"), (None, "two apart"), (8, "a b c d"), (8, "e f g h i")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, fp int, component int")
    got = sorted(map(tuple, simhash.simhash_groups(docs).collect()), key=str)
    want = [(i, plain_fingerprint(t)) for i, t in data]
    assert sorted((i, fp % 2**64) for i, fp, _ in got if i) == sorted((i, p) for i, p in want if i)
    component = {(i, fp): c for i, fp, c in got}
    assert {component[i, 0] for i in (1, 2, 3)} == {1}
    one = next(fp for i, fp, _ in got if i == 4)
    assert component[5, one] == component[None, one] == 4 and {c for i, _, c in got if i in (6, 7)} == {6}
    assert [c for i, fp, c in got if i is None and fp != one] == [None]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
