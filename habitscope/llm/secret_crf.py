"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags every token as the begin of a secret, inside of one, or outside. Its features are the token's shape,
the tokens around it and measures of the whole file; the best tags come from the Viterbi algorithm. It is trained
here: on a sample of documents, whose tokens inside a pattern match are secrets. Documents with a match and those
without are sampled apart, so that rare secrets are learned from in a table of any size.

Decoding is exact but mostly skipped: where the score of a token speaks against a secret by more than all that a
change of neighbouring tags could win, the best path is outside there, and the path falls apart into the short
stretches in between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitscope.llm.common import byte_table, column_bytes, runs, slices, texts, written

KINDS = ("assign", "access", "hex", "crf")
# The patterns of the base kinds. All their characters are ASCII, so bytes can be searched.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
IS_HEX = byte_table(b"0123456789abcdef")

SPACE, LOWER, UPPER, DIGIT, SYMBOL, OTHER = range(6)
_CLASS = np.full(256, SYMBOL, np.uint8)
_CLASS[0x80:] = OTHER
_CLASS[:0x21] = SPACE
_CLASS[0x7F] = SPACE
_CLASS[ord("a") : ord("z") + 1] = LOWER
_CLASS[ord("A") : ord("Z") + 1] = UPPER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_IS_WORD = np.isin(np.arange(6), (LOWER, UPPER, DIGIT, OTHER))[_CLASS]
_FOLD = bytes(range(256)).lower()
_SYMBOLS = np.zeros(256, np.int64)  # 1 equals sign, 2 colon, 3 quote, 4 other
_SYMBOLS[_CLASS == SYMBOL] = 4
_SYMBOLS[ord("=")], _SYMBOLS[ord(":")] = 1, 2
_SYMBOLS[[ord('"'), ord("'")]] = 3
# Two counts for each byte in one number, 32 bits apart.
_DIGIT_UPPER = (_CLASS == DIGIT).astype(np.int64) + ((_CLASS == UPPER).astype(np.int64) << 32)
_PLAIN_OTHER = (~np.isin(np.arange(256), list(b"0123456789abcdefABCDEF"))).astype(np.int64) + (
    (_CLASS == OTHER).astype(np.int64) << 32
)
_LENGTHS = np.array([4, 8, 12, 16, 20, 32, 48])

# Feature blocks: how many values each has. A token's shape is one joint code; training shares weights over its parts.
PARTS = {"length": 8, "digits": 4, "case": 4, "hexadecimal": 2, "changes": 4}
AROUND, FILES = 9, 16
OUTSIDE, BEGIN, INSIDE = range(3)


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    shape: np.ndarray  # joint code of the parts of words, or the symbol after all of them
    around: np.ndarray  # what neighbours see of it, from 1; 0 stands for no token
    before: np.ndarray  # around codes of the three tokens before, and of the next one
    file: np.ndarray


SHAPES = 8 * 4 * 4 * 2 * 4


def places(view: bytes, words) -> np.ndarray:
    """Where any of the words begins."""
    found = []
    for word in words:
        at = view.find(word)
        while at >= 0:
            found.append(at)
            at = view.find(word, at + 1)
    return np.array(sorted(found), np.int64)


def tokenise(data: np.ndarray, bounds: np.ndarray, keywords: np.ndarray) -> Tokens:
    """Tokens of a batch: runs of letters and digits, and single symbols."""
    word = _IS_WORD[data]
    starts, ends = runs(word, bounds)
    signs = np.flatnonzero(_CLASS[data] == SYMBOL)
    order = np.argsort(np.concatenate([starts, signs]), kind="stable")
    starts, ends = np.concatenate([starts, signs])[order], np.concatenate([ends, signs + 1])[order]
    n = len(starts)
    row = np.searchsorted(bounds, starts, side="right") - 1

    def counted(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[ends] - total[starts]

    pair = counted(_DIGIT_UPPER[data])
    digits, upper = pair & 0xFFFFFFFF, pair >> 32
    pair = counted(_PLAIN_OTHER[data])
    plain, other = pair & 0xFFFFFFFF, pair >> 32
    turn = np.zeros(len(data), np.int8)
    if len(data):
        numeric = _CLASS[data] == DIGIT
        turn[1:] = (numeric[1:] != numeric[:-1]) & word[1:] & word[:-1]
    turn[starts] = 0
    changes = counted(turn)
    size = ends - starts
    lower = size - digits - upper - other
    symbol = _SYMBOLS[data[starts]] if n else np.empty(0, np.int64)
    code = np.searchsorted(_LENGTHS, size, side="right")
    code = code * 4 + np.where(digits == 0, 0, np.where(4 * digits < size, 1, np.where(3 * digits < 2 * size, 2, 3)))
    code = code * 4 + (lower > 0) * 2 + (upper > 0)
    code = code * 2 + (plain == 0)
    code = code * 4 + np.searchsorted([1, 3, 6], changes, side="right")
    shape = np.where(symbol > 0, SHAPES + symbol, code)
    around = np.where(symbol > 0, 2 + symbol, np.where(digits > 0, 7, np.where(other > 0, 8, 1)))
    if len(keywords):
        holder = np.searchsorted(starts, keywords, side="right") - 1
        around[holder[(holder >= 0)]] = 2
    before = np.zeros((4, n), np.int64)
    for i, step in enumerate((1, 2, 3)):
        before[i, step:] = np.where(row[step:] == row[:-step], around[:-step], 0) if n > step else 0
    if n > 1:
        before[3, :-1] = np.where(row[1:] == row[:-1], around[1:], 0)
    rows = len(bounds) - 1
    total = np.maximum(np.bincount(row, minlength=rows), 1)
    mixed = np.bincount(row, weights=(symbol == 0) & (digits > 0), minlength=rows) / total
    signs_share = np.bincount(row, weights=symbol > 0, minlength=rows) / total
    file = np.searchsorted([0.002, 0.02, 0.2], mixed, side="right") * 4 + np.searchsorted([0.1, 0.2, 0.4], signs_share, side="right")
    return Tokens(starts, ends, shape, around, before, file[row])


def base_spans(view: bytes, data: np.ndarray, bounds: np.ndarray, keywords: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, start, kind, end, start of the secret itself) of all base matches of a batch, in bytes of it."""
    found = []
    starts, ends = runs(IS_HEX[data], bounds)
    long = ends - starts >= HEX_LEAST
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        found.append((int(np.searchsorted(bounds, a, side="right")) - 1, a, 2, b, a))

    def rows_at(at: np.ndarray) -> list[int]:
        return np.unique(np.searchsorted(bounds, at, side="right") - 1).tolist()

    for row in rows_at(places(view, (b"AKIA",))):
        begin, end = int(bounds[row]), int(bounds[row + 1])
        for match in ACCESS.finditer(view, begin, end):
            if match.end() - match.start() >= ACCESS_LEAST:
                found.append((row, match.start(), 1, match.end(), match.start()))
    for row in rows_at(keywords):
        begin, end = int(bounds[row]), int(bounds[row + 1])
        if view.find(b"=", begin, end) < 0 and view.find(b":", begin, end) < 0:
            continue
        for match in ASSIGN.finditer(view, begin, end):
            if match.end(2) - match.start(2) >= ASSIGN_LEAST:
                found.append((row, match.start(), 0, match.end(), match.start(2)))
    return sorted(found)


@dataclass
class Model:
    """Scores of begin and inside over outside, from five tables, and of following tags."""

    shape: np.ndarray  # (SHAPES + 5) x 2
    before: np.ndarray  # 4 x AROUND x 2
    file: np.ndarray  # FILES x 2
    follow: np.ndarray  # 3 x 3, from a tag to the next; inside never follows outside

    def scores(self, tokens: Tokens) -> np.ndarray:
        out = np.empty((2, len(tokens.starts)))
        for k in range(2):
            out[k] = self.shape[tokens.shape, k] + self.file[tokens.file, k]
            for i in range(4):
                out[k] += self.before[i, tokens.before[i], k]
        return out

    def margin(self, scores: np.ndarray) -> float:
        """What making one token a secret can win at most through other tags than its own.

        The path without it has outside there; where inside came next, that becomes begin.
        """
        t = self.follow
        easy = max(t[a, y] + t[y, c] - t[a, OUTSIDE] - t[OUTSIDE, c] for a in range(3) for y in (1, 2) for c in (0, 1))
        hard = max(
            t[a, y] + t[y, INSIDE] + t[INSIDE, c] - t[a, OUTSIDE] - t[OUTSIDE, BEGIN] - t[BEGIN, c]
            for a in range(3)
            for y in (1, 2)
            for c in range(3)
        )
        return max(easy, hard + float((scores[1] - scores[0]).max(initial=0.0)))


def viterbi(scores: np.ndarray, first: np.ndarray, last: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Best tags of many stretches at once; before and after each stands an outside tag."""
    tags = np.zeros(scores.shape[1], np.int8)
    order = np.argsort(first - last, kind="stable")  # longest first
    first, last = first[order], last[order]
    length = last - first
    if not len(length):
        return tags
    best = np.tile(follow[OUTSIDE], (len(first), 1))
    best[:, 1] += scores[0, first]
    best[:, 2] += scores[1, first]
    back = []
    for step in range(1, int(length[0])):
        live = int(np.searchsorted(-length, -step, side="left"))
        ways = best[:live, :, None] + follow[None]
        back.append(ways.argmax(axis=1).astype(np.int8))
        best[:live] = ways.max(axis=1)
        best[:live, 1] += scores[0, first[:live] + step]
        best[:live, 2] += scores[1, first[:live] + step]
    tag = (best + follow[:, OUTSIDE]).argmax(axis=1)
    tags[last - 1] = tag
    for step in range(int(length[0]) - 1, 0, -1):
        live = len(back[step - 1])
        tag[:live] = back[step - 1][np.arange(live), tag[:live]]
        tags[first[:live] + step - 1] = tag[:live]
    return tags


def tagged_spans(tokens: Tokens, bounds: np.ndarray, model: Model) -> list[tuple[int, int, int]]:
    """(row, start, end) of the stretches that the best tags call a secret."""
    if not len(tokens.starts):
        return []
    scores = model.scores(tokens)
    open_tokens = np.maximum(scores[0], scores[1]) >= -model.margin(scores)
    row = np.searchsorted(bounds, tokens.starts, side="right") - 1
    first, last = runs(open_tokens, np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]]))
    tags = viterbi(scores, first, last, model.follow)
    begins = np.flatnonzero(tags == BEGIN)
    found = []
    for at in begins.tolist():
        end = at + 1
        while end < len(tags) and tags[end] == INSIDE and row[end] == row[at]:
            end += 1
        found.append((int(row[at]), int(tokens.starts[at]), int(tokens.ends[end - 1])))
    return found


def _found(model: Model | None, names: list[str]):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, bounds = column_bytes(batch, "text")
            view = data.tobytes()
            keywords = places(view.translate(_FOLD), KEYWORDS)
            base = base_spans(view, data, bounds, keywords)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            for row, start, which, end, _ in base:
                spans[row].append((start, which, end))
            if model is not None:
                for row, start, end in tagged_spans(tokenise(data, bounds, keywords), bounds, model):
                    if all(end <= a or b <= start for a, which, b in spans[row] if which != 3):
                        spans[row].append((start, 3, end))
            out = []
            for i, own in enumerate(spans):
                if not own:
                    out.append([])
                    continue
                # Code points before each byte.
                points = np.cumsum((data[bounds[i] : bounds[i + 1]] & 0xC0) != 0x80)
                at = lambda byte, i=i, points=points: int(points[byte - bounds[i] - 1]) if byte > bounds[i] else 0
                out.append([{"kind": KINDS[w], "start": at(a), "end": at(b)} for a, w, b in sorted(own)])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, kind)], names=[*names, "spans"])

    return rows


def find_secrets(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive), one row for each row of ``docs``.

    Spans of the base kinds are all there; a span of the field is added where it meets none of them. They are
    sorted by start, then kind. Null and empty texts have none; without a model there are only base spans. Repeated
    rows get equal answers; an empty table gives no rows; other columns are not read. Whole texts are read in one
    pass without a shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    return texts(docs).mapInArrow(_found(model, ["doc_id"]), schema)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


# ------------------------------------------------------------------------------------------------ training

_STRETCH = 128


def _place(seed: int) -> Column:
    """A seeded hash of a row; rows that repeat doc_id and text have one place."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _matched(batch: pa.RecordBatch) -> np.ndarray:
    """For each row: whether a base match there has a token to tag, as all have but those inside a longer word."""
    data, bounds = column_bytes(batch, "text")
    view = data.tobytes()
    out = np.zeros(batch.num_rows, bool)
    for row, _, _, _, secret in base_spans(view, data, bounds, places(view.translate(_FOLD), KEYWORDS)):
        out[row] |= secret == bounds[row] or not _IS_WORD[data[secret - 1]]
    return out


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        place = batch.column(batch.schema.get_field_index("place"))
        yield pa.RecordBatch.from_arrays([place, pa.array(_matched(batch))], names=["place", "matched"])


def _examples(one_in: int, most: dict[bool, int]):
    """Token codes and tags of the sampled texts in stretches; all with a secret, and one in so many of the others.

    A text is sampled up to the place in ``most``, by whether it has a match.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            matched = _matched(batch)
            place = batch.column(batch.schema.get_field_index("place")).to_numpy()
            taken = place <= np.where(matched, most[True], most[False])
            if not taken.any():
                continue
            batch, matched, place = batch.filter(pa.array(taken)), matched[taken], place[taken]
            data, bounds = column_bytes(batch, "text")
            view = data.tobytes()
            keywords = places(view.translate(_FOLD), KEYWORDS)
            tokens = tokenise(data, bounds, keywords)
            tags = np.zeros(len(tokens.starts), np.int64)
            for _, _, _, end, secret in base_spans(view, data, bounds, keywords):
                a = int(np.searchsorted(tokens.starts, secret))
                b = int(np.searchsorted(tokens.starts, end))
                if a < b:
                    tags[a:b] = np.where(tags[a:b] == OUTSIDE, INSIDE, tags[a:b])
                    tags[a] = BEGIN
            row = np.searchsorted(bounds, tokens.starts, side="right") - 1
            codes = np.stack([tokens.shape, *tokens.before, tokens.file, tags]) if len(tags) else np.empty((7, 0), np.int64)
            out, owner, at_token, secret = [], [], [], []
            edges = np.flatnonzero(np.diff(row)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(tags)], strict=True):
                at = begin
                while at < end:
                    stop = min(end, at + _STRETCH)
                    while stop < end and tags[stop] == INSIDE and stop - at < 2 * _STRETCH:
                        stop += 1
                    own = codes[:, at:stop]
                    if own[6].any() or int((own[0] * np.arange(1, own.shape[1] + 1)).sum()) % one_in == 0:
                        out.append(own.astype(np.int32).ravel())
                        owner.append(int(row[at]))
                        at_token.append(at - begin)
                        secret.append(bool(own[6].any()))
                    at = stop
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place[owner], pa.int64()),
                    pa.array(matched[owner], pa.bool_()),
                    pa.array(at_token, pa.int32()),
                    pa.array(secret, pa.bool_()),
                    pa.array(out, pa.list_(pa.int32())),
                ],
                names=["place", "matched", "at", "secret", "codes"],
            )

    return rows


def _shape_parts() -> tuple[np.ndarray, int]:
    """For each joint shape: the features it shares with others (its parts, and two pairs of them)."""
    code = np.arange(SHAPES)
    values = {}
    for name, size in reversed(PARTS.items()):
        values[name], code = code % size, code // size
    sizes = [*PARTS.values(), 32, 32]
    columns = [*(values[n] for n in PARTS), values["length"] * 4 + values["changes"], values["length"] * 4 + values["digits"]]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    table = np.stack([c + o for c, o in zip(columns, offsets, strict=False)], axis=1)
    signs = np.full((5, table.shape[1]), offsets[-1])
    signs[1:] += np.arange(1, 5)[:, None]
    return np.concatenate([table, signs]), int(offsets[-1] + 5)


def fit(
    docs: DataFrame, sample: int = 4000, one_in: int = 32, rounds: int = 60, seed: int = 1, least_share: float = 0.01
) -> Model | None:
    """A field trained on ``sample`` documents, the first by a seeded hash; None only where the whole table has no match.

    All documents are tagged with the base patterns first. A quarter of the sample, or as many as there are, has a
    match, however rare those are among all; a table of up to ``sample`` rows is used in full. Documents with and
    without a match weigh in training as much as in the table, but those with one at least ``least_share`` of all.
    Rows that repeat doc_id and text count once. Of the sample, all stretches of some 128 tokens with a secret go to
    the driver as codes, and one in ``one_in`` of the others; at most ``sample`` of each, by a hash.
    """
    placed = texts(docs).withColumn("place", _place(seed))
    seen = written(placed.select("place", "text").mapInArrow(_tagged, "place long, matched boolean"), "base-tags").distinct()
    count = {r["matched"]: r["n"] for r in seen.groupBy("matched").agg(F.count("*").alias("n")).collect()}
    with_match, without = count.get(True, 0), count.get(False, 0)
    if not with_match:
        return None
    size = {True: min(with_match, max(sample // 4, sample - without, 1))}
    size[False] = min(without, max(sample - size[True], 0))
    most = {}
    for matched, number in size.items():
        first = seen.where(F.col("matched") == matched).orderBy("place").limit(number)
        last = first.agg(F.max("place").alias("place")).first()["place"]
        most[matched] = -(1 << 63) if last is None else last
    stretches = (
        placed.select("place", "text")
        .where(F.col("place") <= max(most.values()))
        .mapInArrow(_examples(one_in, most), "place long, matched boolean, at int, secret boolean, codes array<int>")
        .dropDuplicates(["place", "at"])
    )
    listed = written(stretches, "secret-stretches")
    got = []
    for secret in (True, False):
        rows = listed.where(F.col("secret") == secret).orderBy(F.xxhash64("codes", "place"), "place", "at").limit(sample)
        got += [(np.asarray(r.codes, np.int64).reshape(7, -1), r.matched) for r in rows.toPandas().itertuples()]
    share = max(with_match / (with_match + without), least_share) if without else 1.0
    weight = {True: share / size[True], False: (1 - share) / max(size[False], 1)}
    got.sort(key=lambda g: (g[0].shape[1], g[0].tobytes(), g[1]))
    got += [(hidden(c), m) for c, m in got if c[6].any()]
    return train([c for c, _ in got], rounds, weights=np.array([weight[m] for _, m in got]))


def hidden(stretch: np.ndarray) -> np.ndarray:
    """The stretch with plain words around its secrets, so that the field can't rely on what a pattern asks for."""
    out = stretch.copy()
    out[1:5, out[6] != OUTSIDE] = 1
    return out


def train(
    stretches: list[np.ndarray], rounds: int = 60, pace: float = 0.15, shrink: float = 1e-4, weights: np.ndarray | None = None
) -> Model:
    """Maximum likelihood by gradient steps (Adam) with a small penalty. A stretch: seven rows of codes, tags last.

    Only the ratios of ``weights``, how much each stretch counts, matter.
    """
    n, longest = len(stretches), max(c.shape[1] for c in stretches)
    padded = np.zeros((7, n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, c in enumerate(stretches):
        padded[:, i, : c.shape[1]] = c
        mask[i, : c.shape[1]] = True
    parts, size = _shape_parts()
    offsets = size + np.arange(5) * AROUND
    columns = [parts[padded[0], j] for j in range(parts.shape[1])]
    columns += [padded[1 + i] + offsets[i] for i in range(4)] + [padded[5] + offsets[4]]
    total = int(offsets[4] + FILES)
    gold = padded[6]
    before = np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], axis=1)
    after_last = gold[np.arange(n), mask.sum(axis=1) - 1]
    counts = np.ones(n) if weights is None else weights / weights.mean()
    each = counts[:, None] * mask
    follow_gold = np.bincount((before * 3 + gold)[mask], weights=each[mask], minlength=9).reshape(3, 3)
    follow_gold[:, 0] += np.bincount(after_last, weights=counts, minlength=3)
    weights, follow = np.zeros((total, 2)), np.zeros((3, 3))
    barred = np.zeros((3, 3))
    barred[OUTSIDE, INSIDE] = -1e9
    state = [np.zeros((total, 2)), np.zeros((total, 2)), np.zeros((3, 3)), np.zeros((3, 3))]
    lengths = mask.sum(axis=1)
    steps = np.arange(n)

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for turn in range(1, rounds + 1):
        emitted = np.zeros((n, longest, 3))
        for c in columns:
            emitted[:, :, 1:] += weights[c]
        t = follow + barred
        ahead, behind = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        ahead[:, 0] = t[OUTSIDE] + emitted[:, 0]
        for i in range(1, longest):
            ahead[:, i] = log_sum(ahead[:, i - 1, :, None] + t[None], 1) + emitted[:, i]
        for i in range(longest - 1, -1, -1):
            if i + 1 < longest:
                onward = log_sum(t[None] + (emitted[:, i + 1] + behind[:, i + 1])[:, None], 2)
                behind[:, i] = np.where((i + 1 < lengths)[:, None], onward, t[:, OUTSIDE])
            else:
                behind[:, i] = t[:, OUTSIDE]
        normal = log_sum(ahead[steps, lengths - 1] + t[:, OUTSIDE], 1)
        chance = np.exp(ahead + behind - normal[:, None, None]) * each[:, :, None]
        pull = np.stack([(gold == k) * each - chance[:, :, k] for k in (1, 2)], axis=2)
        slope = np.zeros((total, 2))
        for c in columns:
            for k in range(2):
                slope[:, k] += np.bincount(c.ravel(), weights=pull[:, :, k].ravel(), minlength=total)
        expected = np.zeros((3, 3))
        if longest > 1:
            joint = ahead[:, :-1, :, None] + t + (emitted[:, 1:] + behind[:, 1:])[:, :, None] - normal[:, None, None, None]
            expected += (np.exp(joint) * each[:, 1:, None, None]).sum(axis=(0, 1))
        expected[OUTSIDE] += chance[:, 0].sum(axis=0)
        expected[:, OUTSIDE] += chance[steps, lengths - 1].sum(axis=0)
        slopes = [slope / n - shrink * weights, (follow_gold - expected) / n - shrink * follow]
        for k, (value, g) in enumerate(zip((weights, follow), slopes, strict=True)):
            first, second = state[2 * k], state[2 * k + 1]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            value += pace * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    shape = weights[parts].sum(axis=1)
    around = np.stack([weights[offsets[i] : offsets[i] + AROUND] for i in range(4)])
    return Model(shape, around, weights[offsets[4] : offsets[4] + FILES], follow + barred)
