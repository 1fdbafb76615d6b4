"""Duplicates, components and mixing against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitscope.llm import chunk_dedup, mixing, near_dups
from habitscope.llm.components import components


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "zigzag", "none"])
def test_components(spark, kind):
    chance = random.Random(kind)
    links = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(150, i) for i in range(300) if i != 150],
        "random": [(chance.randrange(400), chance.randrange(400)) for _ in range(260)],
        "zigzag": [(i, 400 - i) for i in range(100)] + [(400 - i, i + 1) for i in range(100)],
        "none": [],
    }[kind]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == smallest_reachable({x for p in real for x in p}, real)


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset((width, *words[i : i + width]) for i in range(len(words) - width + 1))


def near_texts():
    """A large group of near copies, chains of edits, exact copies, and texts that share a passage only."""
    chance = random.Random(7)
    word = lambda: "".join(chance.choice("abcdefghij") for _ in range(chance.randint(2, 7)))
    base = [word() for _ in range(150)]
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(150):
        own = list(base)
        for _ in range(chance.randint(0, 4)):
            own[chance.randrange(len(own))] = word()
        out.append(" ".join(own))
    chain = [word() for _ in range(120)]
    for _ in range(40):
        chain[chance.randrange(len(chain))] = word()
        out.append(" ".join(chain))
    for _ in range(150):
        out.append(" ".join([word() for _ in range(chance.randint(5, 60))] + passage))
    out += [out[3], out[3].upper(), "a b", "A  b", "b a", None, ""]
    chance.shuffle(out)
    return out


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_groups(spark, width, percent):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [shingles(t, width) for t in texts]
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    want = smallest_reachable(range(len(texts)), links)
    got = {r.doc_id: r for r in near_dups.near_groups(docs, width, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_signatures_within_the_distance_share_a_key(spark):
    """The pigeonhole guarantee: any 15 changed values leave a common key."""
    chance = random.Random(9)
    rows = []
    for i in range(200):
        one = [chance.randrange(65536) for _ in range(near_dups.VALUES)]
        two = list(one)
        for place in chance.sample(range(near_dups.VALUES), 15):
            two[place] = (two[place] + 1) % 65536
        rows.append((i, one, two))
    frame = spark.createDataFrame(rows, "i int, one array<int>, two array<int>")
    keys = frame.select(near_dups.masked_keys(F.col("one")).alias("a"), near_dups.masked_keys(F.col("two")).alias("b"))
    assert keys.where(F.arrays_overlap("a", "b")).count() == 200


def test_chunks_give_the_text(spark):
    texts = ["", "a", "x" * 5000, *[t for t in near_texts() if t], "é🙂 " * 3000, "the end of a big line\n" * 400]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    joined = frame.select("text", chunk_dedup.chunks(F.col("text"), 512).alias("c"))
    assert joined.where(F.array_join("c", "") != F.col("text")).count() == 0
    assert joined.where(F.size("c") > 3).count() > 5


@pytest.mark.parametrize("bits", [2, 64])
def test_clashing_hashes_are_told_apart(spark, bits):
    """With two bits nearly all chunks clash."""
    texts = [t or "" for t in near_texts()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in chunk_dedup.exact_groups(docs, bits).collect()}
    for i, text in enumerate(texts):
        same = [j for j, t in enumerate(texts) if t == text]
        assert got[i] == (max(same), len(same), i == max(same))


def test_targets_and_quotas(spark):
    sizes = [("a", 100), ("b", 4000), ("c", 10), ("d", 0), (None, 7000), ("e", 90)]
    targets = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", "e", None], [1, 2, 3, 1, 2, 3], strict=True))
    caps = {s: 3 * n for s, n in sizes}
    capped: set = set()
    while True:
        left = 11200 - sum(caps[s] for s in capped)
        total = sum(w for s, w in weights.items() if s not in capped)
        over = {s for s, w in weights.items() if s not in capped and left * w / total > caps[s]}
        if not over:
            break
        capped |= over
    want = {s: float(caps[s]) if s in capped else left * w / total for s, w in weights.items()}
    assert targets == pytest.approx(want)

    chance = random.Random(5)
    parties = [("g", i, float(chance.randint(0, 500)), seats) for seats in (0,) for i in range(3)]
    parties = [(f"g{n}", i, float(chance.choice([0, 1, 7, chance.randint(0, 900)])), n) for n in (0, 1, 5, 33, 400) for i in range(9)]
    frame = spark.createDataFrame(parties, "g string, party int, share double, seats long")
    got = {(r.g, r.party): r.quota for r in mixing.apportioned(frame, ["g"], ["party"], "share", "seats").collect()}
    for group in {p[0] for p in parties}:
        own = [p for p in parties if p[0] == group]
        quotients = sorted(((-share / (2 * s - 1), i, s) for _, i, share, n in own if share for s in range(1, n + 1)))
        won = [i for _, i, _ in quotients[: own[0][3]]]
        assert {i: got[(group, i)] for _, i, _, _ in own} == {i: won.count(i) for _, i, _, _ in own}


def test_mix_is_near_its_targets(spark):
    chance = random.Random(2)
    rows = [(i, " ".join(["w"] * chance.randint(0, 80)), chance.choice(["a", "a", "a", "b", "c", None])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, shard_rows=100)
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 16 * 2 for r in sums)
    assert got.where("taken > 3 * size").count() == 0
    again = mixing.mix(docs.repartition(7), shard_rows=100)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_parities_differ_in_no_more_bits_than_sets():
    draw = random.Random(9)
    for size in (0, 1, 30, 5000):
        base = [draw.getrandbits(63) for _ in range(size)]
        for change in (0, 1, 7, 200):
            other = base[change:] + [draw.getrandbits(63) for _ in range(change)]
            a, b = (near_dups._parity(np.array(sorted(set(s)), np.int64)) for s in (base, other))
            differing = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
            apart = len(set(base) ^ set(other))
            assert differing <= apart and differing % 2 == apart % 2
