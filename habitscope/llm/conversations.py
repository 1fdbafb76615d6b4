"""Repair of conversation structure over a word graph that all conversations share.

A conversation's rows become one signature: a letter for each row, from the role's initial and the row's fault. The
distinct signatures of all conversations, in the order of their reversals, build an acyclic automaton whose nodes are
suffixes: what a signature has in common with its neighbour, from the end, is not built again. At each node the
cheapest cost to go and the best first edit are known for each of the four states of the grammar s?(ua)+ or nothing.
Nodes with the same suffix share them, and a step from a node depends only on its relative costs, so steps are looked
up. The audit of a signature is read off from its first node; conversations get it by a join.

Rows are dealt by ranges of (conversation, turn), so a conversation of any size is cut into several pieces; only the
digest of its repaired text, which no two tasks could share, reads the pieces in one stream.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitscope.llm.common import BATCH_ROWS, written

# Letters of a signature: four roles (system, user, assistant, other) times four faults.
ROLES, FAULTS = "suax", ("", "blank", "duplicate", "truncated")
LETTERS = "ABCDEFGHIJKLMNOP"
# Grammar states: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTS = (START, ASSISTANT)
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NEXT_ROLE = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
_NEVER = 1 << 60
PIECE_ROWS, PIECE_BYTES = 512, 1 << 16


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the damaged rows of a test corpus by the checksum of ``conv_id:turn``.

    Of 20 remainders, 0 drops a row (no copy of it), 1 empties its text, 2 removes its sentence marks, 3 repeats it and
    4 gives it the role user. Null roles and texts are one space, and so are null ids and turns in the checksum.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(way == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.when(way == 0, 0).when(way == 3, 2).otherwise(1).alias("copies"),
    )


def _place(turn: str = "turn") -> list[Column]:
    """Order of the rows of a conversation: turn, nulls first."""
    return [F.col(turn).isNotNull(), F.col(turn)]


def faulted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, key, n, again, letter: equal rows of a conversation as one, with their number.

    ``letter`` is that of the first of the n; ``again`` is the letter of the others.
    """
    equal = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    equal = written(equal.withColumn("key", F.sha2(F.col("text").cast("binary"), 256)), "conversation-rows")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # The first of rows with one role and text. Only texts that several turns of a conversation have are looked up.
    place = F.struct(*[c.alias(f"p{i}") for i, c in enumerate(_place())])
    first = F.min(place).alias("first")
    repeated = (
        equal.where(~blank & (F.col("n") > 0)).groupBy("conv_id", "role", "key").agg(first, F.count("*").alias("turns")).where("turns > 1")
    )
    repeated = written(repeated.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("key").alias("_k"), "first"), "repeated-texts")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("key") == F.col("_k"))
    later = F.col("first").isNotNull() & (place != F.col("first"))
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, 1).when(later, 2).when(~ended, 3).otherwise(0)
    role = F.instr(F.lit(ROLES[:3]), F.substring("role", 1, 1))
    role = F.when((F.col("role") == "") | (role == 0), 3).otherwise(role - 1)
    letter = lambda f: F.substring(F.lit(LETTERS), role * 4 + f + 1, F.lit(1))
    return equal.join(repeated, same, "left").select(
        "conv_id", "turn", "role", "text", "key", "n", letter(fault).alias("letter"),
        letter(F.when(blank, 1).otherwise(2)).alias("again"),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted rows of one conversation, packed; at most PIECE_ROWS rows and about PIECE_BYTES of text."""
    held, piece, size = [], 0, 0

    def packed(rows, piece):
        ids, roles, texts, counts, letters = zip(*rows, strict=True)
        signature = "".join(first + again * (n - 1) if n else "" for (first, again), n in zip(letters, counts, strict=True))
        return {"conv_id": ids[0], "piece": piece, "roles": roles, "texts": texts, "counts": counts, "signature": signature}

    def table(rows):
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    out, schema = [], None
    for batch in batches:
        if schema is None:
            schema = pa.schema(
                [
                    ("conv_id", batch.schema.field("conv_id").type),
                    ("piece", pa.int64()),
                    ("roles", pa.list_(pa.string())),
                    ("texts", pa.list_(pa.string())),
                    ("counts", pa.list_(pa.int64())),
                    ("signature", pa.string()),
                ]
            )
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text", "n", "letter", "again")]
        for conv, role, text, n, letter, again in zip(*columns, strict=True):
            if held and (conv != held[0][0] or len(held) >= PIECE_ROWS or size >= PIECE_BYTES):
                out.append(packed(held, piece))
                held, size, piece = [], 0, piece + 1
                if len(out) >= 100:
                    yield table(out)
                    out = []
            held.append((conv, role, text, n, (letter, again)))
            size += len(text)
    if held:
        out.append(packed(held, piece))
    if out:
        yield table(out)


# What is known of a node is few things in many nodes: relative costs and best edits by state, each held once.
_PROFILES: list[tuple[tuple[int, ...], str]] = []
_NUMBERS: dict[tuple[tuple[int, ...], str], int] = {}
_KNOWN: dict[tuple[str, int], tuple[int, int]] = {}


def _settled(edits: list[dict[str, int]]) -> tuple[int, int]:
    """A profile's number, and the cost taken off: the cheapest edit of each state, with insertions, which stay at the
    node. Ties go to the least in ASCII; each edit leads to one state."""
    best = [min(e.values(), default=_NEVER) for e in edits]
    for _ in range(4):
        best = [min(best[s], INSERT + best[STEPS[s][NEXT_ROLE[s]]]) for s in range(4)]
    chosen = ""
    for s, mine in enumerate(edits):
        mine = {**mine, "I": INSERT + best[STEPS[s][NEXT_ROLE[s]]]}
        chosen += min((cost, edit) for edit, cost in mine.items())[1]
    least = min(best)
    profile = (tuple(b - least for b in best), chosen)
    if profile not in _NUMBERS:
        _NUMBERS[profile] = len(_PROFILES)
        _PROFILES.append(profile)
    return _NUMBERS[profile], least


def _step(letter: str, after: int) -> tuple[int, int]:
    """The same of a node that ``letter`` leads from to a node of profile ``after``."""
    known = _KNOWN.get((letter, after))
    if known is None:
        number = LETTERS.index(letter)
        role, fault = ROLES[number // 4], FAULTS[number % 4]
        more = TRUNCATED if fault == "truncated" else 0
        costs, edits = _PROFILES[after][0], []
        for state in range(4):
            mine = {"D": DELETE + costs[state]}
            if fault not in ("blank", "duplicate"):
                if role in STEPS[state]:
                    mine["K"] = more + costs[STEPS[state][role]]
                mine["R"] = REROLE + more + costs[STEPS[state][NEXT_ROLE[state]]]
            edits.append(mine)
        known = _KNOWN[letter, after] = _settled(edits)
    return known


class SuffixGraph:
    """Nodes of the suffixes of signatures that come in the order of their reversals; one path is held at a time."""

    def __init__(self):
        number, total = _settled([{".": 0} if s in ACCEPTS else {} for s in range(4)])
        self.before, self.profiles, self.totals, self.built = "", array("i", [number]), array("q", [total]), 0

    def audit(self, signature: str) -> tuple[int, str]:
        """Least cost and its audit: initials of the edits in order, the ASCII-least of the cheapest."""
        shared, most = 0, min(len(signature), len(self.before))
        while shared < most and signature[-1 - shared] == self.before[-1 - shared]:
            shared += 1
        del self.profiles[shared + 1 :], self.totals[shared + 1 :]
        for letter in reversed(signature[: len(signature) - shared]):
            number, less = _step(letter, self.profiles[-1])
            self.profiles.append(number)
            self.totals.append(self.totals[-1] + less)
            self.built += 1
        self.before = signature
        out, state, at = bytearray(), START, len(signature)
        cost = self.totals[at] + _PROFILES[self.profiles[at]][0][START]
        while (edit := _PROFILES[self.profiles[at]][1][state]) != ".":
            out += edit.encode()
            if edit == "K":
                state = STEPS[state][ROLES[LETTERS.index(signature[len(signature) - at]) // 4]]
            elif edit != "D":
                state = STEPS[state][NEXT_ROLE[state]]
            at -= edit != "I"
        return cost, out.decode()


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    graph = SuffixGraph()
    for batch in batches:
        signatures = batch.column(batch.schema.get_field_index("signature")).to_pylist()
        found = [graph.audit(s) for s in signatures]
        yield pa.RecordBatch.from_arrays(
            [pa.array(signatures), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
            names=["signature", "cost", "audit"],
        )


def audits(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit of distinct ``signatures``: those with a common end meet in one task, one by one."""
    turned = signatures.withColumn("turned", F.reverse("signature"))
    ordered = turned.repartitionByRange("turned").sortWithinPartitions("turned").select("signature")
    return ordered.mapInArrow(_audits, "signature string, cost long, audit string")


def _repaired(kind: str):
    """Digest of each conversation's repaired rows; a head row with the audit comes before its pieces."""
    names = ["conv_id", "head", "audit", "roles", "texts", "counts"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, conv, state = [], [], None, None

        def take(state, edit, role=None, text=None):
            grammar, digest, begun, at = state["grammar"], state["digest"], state["begun"], state["at"]
            if edit != "D":
                if edit == "K":
                    step = role[:1]
                else:
                    step = NEXT_ROLE[grammar]
                    role = NAMES[step]
                    text = text if edit == "R" else ""
                digest.update((f"\n{role}:{text}" if begun else f"{role}:{text}").encode())
                state["grammar"], state["begun"] = STEPS[grammar][step], True
            state["at"] = at + 1

        def inserts(state):
            while state["audit"][state["at"] : state["at"] + 1] == "I":
                take(state, "I")

        def close():
            inserts(state)
            ids.append(conv)
            digests.append(state["digest"].hexdigest())

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
            for id_, head, audit, roles, texts, counts in zip(
                *[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True
            ):
                if head:
                    if state is not None:
                        close()
                    conv, state = id_, {"audit": audit, "at": 0, "grammar": START, "begun": False, "digest": hashlib.sha256()}
                    continue
                for role, text, n in zip(roles, texts, counts, strict=True):
                    for _ in range(n):
                        inserts(state)
                        take(state, state["audit"][state["at"]], role, text)
            if len(ids) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(digests)], schema=schema)
                ids, digests = [], []
        if state is not None:
            close()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(digests)], schema=schema)

    return rows


def _distinct_turns(rows: DataFrame) -> DataFrame:
    """_c, gaps: missing turns between the first and the last turn of each conversation that has one."""
    turns = rows.where("copies > 0 and turn is not null").select(F.col("conv_id").alias("_c"), "turn").distinct()
    return turns.groupBy("_c").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conv_id.

    ``rows`` has conv_id, turn, role, text and copies, how often a row is there; 0 names a conversation whose row is
    lost. Rows of a conversation are taken by turn, nulls first; rows of one turn by role and digest of the text, so
    equal rows are neighbours. Null roles and texts are one space; a null conv_id is a conversation of its own. Of
    faults, blank goes before duplicate (role and text seen before) and that before truncated. A role that begins with
    none of s, u and a, or is empty, can only be changed or deleted. An empty table gives no rows; other columns are
    not read. A task holds one signature and its audit, a letter for each row of a conversation, and no texts but those
    of a few pieces.
    """
    session = rows.sparkSession
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", "turn", space("role"), space("text"), "copies")
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", *_place(), "role", "key"]
    dealt = faulted(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"conv_id {kind}, piece long, roles array<string>, texts array<string>, counts array<long>, signature string"
    # Partitions are ranges in order, so (range, piece) is the order of a conversation's pieces.
    pieces = written(dealt.mapInArrow(_pieces, schema).withColumn("range", F.spark_partition_id()), "conversation-pieces")

    parts = F.array_sort(F.collect_list(F.struct("range", "piece", "signature")))
    whole = pieces.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["signature"]), "").alias("signature"))
    whole = written(whole, "signatures")
    known = audits(whole.select("signature").distinct())
    count = lambda fault: F.length(
        F.regexp_replace("signature", f"[^{''.join(LETTERS[i * 4 + FAULTS.index(fault)] for i in range(4))}]", "")
    ).cast("long")
    # Initials of all rows: pairs are adjacent places of the signature, legal ones su, ua and au.
    initials = F.translate("signature", LETTERS, "".join(r * 4 for r in ROLES))
    legal = F.lit(0)
    for pair in ("su", "ua", "au"):
        legal = legal + F.regexp_count(initials, F.lit(f"{pair[0]}(?={pair[1]})"))
    illegal = F.greatest(F.length("signature") - 1 - legal, F.lit(0)).cast("long")
    # Written, so that the join of a signature that very many conversations share can be split.
    known = written(
        known.select(
            "signature", "cost", "audit", count("blank").alias("blank"), count("duplicate").alias("duplicate"),
            count("truncated").alias("truncated"), illegal.alias("illegal"),
        ),
        "signature-audits",
    )
    named = written(whole.join(known, "signature").drop("signature"), "conversation-audits")

    empty = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = named.select(
        "conv_id", F.lit(True).alias("head"), F.lit(0).alias("range"), F.lit(0).cast("long").alias("piece"), "audit",
        empty("roles", "array<string>"), empty("texts", "array<string>"), empty("counts", "array<long>"),
    )
    bodies = pieces.select(
        "conv_id", F.lit(False).alias("head"), "range", "piece", empty("audit", "string"), "roles", "texts", "counts"
    )
    streamed = heads.union(bodies).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), "range", "piece")
    digests = streamed.drop("range", "piece").mapInArrow(_repaired(kind), f"conv_id {kind}, repaired_sha256 string")
    digests = digests.withColumnRenamed("conv_id", "_d")
    out = named.join(digests, F.col("conv_id").eqNullSafe(F.col("_d")))
    out = out.join(_distinct_turns(rows), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return out.select(
        "conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        "cost", "audit", "repaired_sha256",
    )
