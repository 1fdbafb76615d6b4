"""Byte-level BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over 16 bytes cuts every text at places that depend on the nearby bytes only, so passages that
documents share give the same chunks wherever they stand. Chunks that occur more than once are encoded once, in one
of the documents that hold them, and their ids travel to the others. What is not shared is encoded in its own
document. A chunk edge may cut a word, so joins are repaired: the text between the last sure token bound of the
left chunk and the first one of the right chunk is encoded again, and where the ids at hand do not agree with that
bound, or a chunk has none, the stretch grows into the next chunk, until both sides agree exactly.

A sure bound is a place between a visible ASCII character and a space: no token crosses it in any context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitscope.llm import tokenizer
from habitscope.llm.common import column_bytes, mixed, slices, text_keys, texts, written

WINDOW = 16
APART = 64
KEY = ["k1", "k2"]
HASH = ["h1", "h2"]
# Values of single bytes in the rolling hash, from a rule.
_GEAR = (mixed(np.arange(1000, 1256)) >> np.uint64(32)).astype(np.uint32)
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def cut_places(data: np.ndarray, bits: int) -> np.ndarray:
    """Places before which a chunk may end: the hash of the 16 bytes before has ``bits`` leading zeros.

    A place less than APART bytes after another one does not count, so that a run of one character is not cut
    everywhere; nor does one inside a character.
    """
    if len(data) <= WINDOW:
        return np.empty(0, np.int64)
    rolled = _GEAR[data]
    for step in (1, 2, 4, 8):
        wider = rolled.copy()
        wider[step:] += rolled[:-step] << np.uint32(step)
        rolled = wider
    places = np.flatnonzero((rolled[WINDOW - 1 : -1] >> np.uint32(32 - bits)) == 0) + WINDOW
    if len(places):
        places = places[np.diff(places, prepend=-APART) >= APART]
        places = places[(data[places] & 0xC0) != 0x80]
    return places


class Pieces:
    """Chunks and special strings of one text, by byte offsets."""

    def __init__(self, view: bytes, tokens: tokenizer.Tokenizer, bits: int):
        self.view = view
        self.parts: list[tuple[list[int], int | None]] = []
        if not any(s.encode() in view for s in tokens.special):
            ranges = [(0, len(view), None)] if view else []
        else:
            ranges, at = [], 0
            for text, special in tokens.segments(view.decode()):
                size = len(text.encode())
                ranges.append((at, at + size, special))
                at += size
        for begin, end, special in ranges:
            inner = [] if special is not None else cut_places(np.frombuffer(view, np.uint8)[begin:end], bits).tolist()
            self.parts.append(([begin, *(begin + c for c in inner), end], special))

    def chunks(self) -> list[tuple[int, int]]:
        """Bounds of the chunks in order; special strings are none."""
        return [pair for cuts, special in self.parts if special is None for pair in zip(cuts[:-1], cuts[1:], strict=True)]


def _chunk_rows(paths: tuple[str, str], bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        tokens = tokenizer.load(paths)
        for batch in slices(batches, "text"):
            data, bounds = column_bytes(batch, "text")
            row, number, digests = [], [], []
            for i in range(batch.num_rows):
                view = data[bounds[i] : bounds[i + 1]].tobytes()
                for seq, (begin, end) in enumerate(Pieces(view, tokens, bits).chunks()):
                    row.append(i)
                    number.append(seq)
                    digests.append(xxhash.xxh3_128_digest(view[begin:end]))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            keys = [batch.column(batch.schema.get_field_index(k)).take(pa.array(row, pa.int64())) for k in KEY]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(number, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                names=[*KEY, "seq", *HASH],
            )

    return rows


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches, "text"):
        data, bounds = column_bytes(batch, "text")
        packed = [squeeze.compress(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in (*KEY, "doc_id")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(packed, pa.binary())], names=[*KEY, "doc_id", "packed"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    import zstandard

    stretch = zstandard.ZstdDecompressor()
    for value in batch.column(batch.schema.get_field_index("packed")):
        yield stretch.decompress(value.as_buffer())


def _encode_owned(paths: tuple[str, str], bits: int):
    """Ids of the chunks that other texts wait for, each from the text that owns it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        tokens = tokenizer.load(paths)
        for batch in batches:
            digests, found = [], []
            owned = batch.column(batch.schema.get_field_index("owned")).to_pylist()
            for view, numbers in zip(_unpacked(batch), owned, strict=True):
                chunks = Pieces(view, tokens, bits).chunks()
                for seq in numbers:
                    begin, end = chunks[seq]
                    digests.append(xxhash.xxh3_128_digest(view[begin:end]))
                    ids = tokens.encode_plain(view[begin:end].decode())
                    found.append(np.array(ids, np.uint32).astype("<u4").tobytes())
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(found, pa.binary())],
                names=[*HASH, "chunk_ids"],
            )

    return rows


def joined(view: bytes, cuts: list[int], ready: dict[int, np.ndarray], tokens: tokenizer.Tokenizer) -> np.ndarray:
    """Ids of one plain stretch. ``ready``: ids of some of its chunks, by position.

    Neighbouring chunks without ready ids are one stretch of text. The ids of a stretch count from its first sure
    bound to its last; what lies between is encoded anew.
    """

    def encode(begin: int, end: int) -> np.ndarray:
        return np.array(tokens.encode_plain(view[begin:end].decode()), np.int64)

    spans: list[tuple[int, int, np.ndarray | None]] = []
    for i, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        ids = ready.get(i)
        if ids is not None and b"".join(map(tokens.pieces.__getitem__, ids.tolist())) != view[begin:end]:
            ids = None
        if ids is None and spans and spans[-1][2] is None:
            spans[-1] = (spans[-1][0], end, None)
        else:
            spans.append((begin, end, ids))
    if all(ids is None for _, _, ids in spans):
        return encode(cuts[0], cuts[-1])
    out: list[np.ndarray] = []
    open_from = cuts[0]  # everything before it is final
    for i, (begin, end, ids) in enumerate(spans):
        if ids is None:
            ids = encode(begin, end)
        ends = np.cumsum(tokens.lengths[ids]) + begin
        data = np.frombuffer(view, np.uint8)[begin:end]
        sure = np.flatnonzero(_VISIBLE[data[:-1]] & (data[1:] == 0x20)) + begin + 1
        sure = sure[np.isin(sure, ends)]
        first = begin if i == 0 else int(sure[0]) if len(sure) else None
        last = end if i == len(spans) - 1 else int(sure[-1]) if len(sure) else None
        if first is None or last is None:
            if last is not None and i == len(spans) - 1:
                out.append(encode(open_from, end))
            continue
        if first > open_from:
            out.append(encode(open_from, first))
        lower = int(np.searchsorted(ends, first, side="right"))
        out.append(ids[lower : int(np.searchsorted(ends, last, side="right"))])
        open_from = last
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _assemble(paths: tuple[str, str], bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer.load(paths)
        for batch in batches:
            found, counts = [], []
            shared = batch.column(batch.schema.get_field_index("shared")).to_pylist()
            for view, given in zip(_unpacked(batch), shared, strict=True):
                if not given:
                    ids = np.array(tokens.encode(view.decode()), np.uint32)
                else:
                    ready = {x["seq"]: np.frombuffer(x["chunk_ids"], "<u4").astype(np.int64) for x in given}
                    out, at = [], 0
                    for cuts, special in Pieces(view, tokens, bits).parts:
                        if special is not None:
                            out.append(np.array([special], np.int64))
                            continue
                        n = len(cuts) - 1
                        out.append(joined(view, cuts, {s - at: v for s, v in ready.items() if at <= s < at + n}, tokens))
                        at += n
                    ids = np.concatenate(out)
                counts.append(len(ids))
                found.append(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(counts, pa.int64()), pa.array(found, pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )

    return rows


def shared_chunks(rows: DataFrame, paths: tuple[str, str], bits: int) -> DataFrame:
    """k1, k2, seq, h1, h2, owns: one row for each chunk of each text that occurs more than once, however often the
    text itself is repeated under one key; ``owns`` marks the place where the chunk is encoded."""
    places = rows.select(*KEY, "text").mapInArrow(_chunk_rows(paths, bits), "k1 long, k2 long, seq int, h1 long, h2 long")
    shared = (
        places.groupBy(*HASH)
        .agg(F.count("*").alias("uses"), F.min(F.struct(*KEY, "seq")).alias("owner"))
        .where("uses > 1")
        .select(*HASH, "owner")
    )
    owns = (F.struct(*KEY, "seq") == F.col("owner")).alias("owns")
    return written(places.join(shared, HASH).select(*KEY, "seq", *HASH, owns).dropDuplicates([*KEY, "seq"]), "shared-chunks")


def encode(docs: DataFrame, paths: tuple[str, str] | None = None, bits: int = 10) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit numbers) of every row's whole text.

    Chunks are 2^``bits`` bytes long on average. Null and empty texts have no ids. Rows that repeat a doc_id keep a
    row each; a null doc_id stays null; an empty table gives no rows; other columns of ``docs`` are not read. A very
    long text is one row in one task, as its ids are one value.

    Moved: chunk digests (about 40 bytes for each chunk), every text once in packed form, to the ids that its
    chunks get from others, and those ids. A chunk that a third of all texts share is one row of the owners and many
    rows of a join with a written table, which adaptive execution splits. Rows that repeat doc_id and text have one
    entry for each of their chunks together, however many they are.
    """
    paths = paths or tokenizer.default_paths()
    rows = texts(docs).select("doc_id", "text", *text_keys())
    kind = docs.schema["doc_id"].dataType.simpleString()
    uses = shared_chunks(rows, paths, bits)
    packed = rows.select(*KEY, "doc_id", "text").mapInArrow(_pack, f"k1 long not null, k2 long not null, doc_id {kind}, packed binary")
    owned = uses.where("owns").groupBy(*KEY).agg(F.collect_set("seq").alias("owned"))
    # Both joins read the same columns of ``packed`` under one key, so its shuffle is written once and read twice.
    encoded = packed.join(owned, KEY).select("doc_id", "packed", "owned").mapInArrow(_encode_owned(paths, bits), "h1 long, h2 long, chunk_ids binary")
    encoded = written(encoded.dropDuplicates(HASH), "encoded-chunks")
    given = (
        uses.select(*KEY, "seq", *HASH)
        .join(encoded, HASH)
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct("seq", "chunk_ids")).alias("shared"))
    )
    whole = packed.join(given, KEY, "left").select("doc_id", "packed", "shared")
    return whole.mapInArrow(_assemble(paths, bits), f"doc_id {kind}, n_tokens long, ids binary")


def _decode(paths: tuple[str, str], names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer.load(paths)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            found = [None if not v.is_valid else tokens.decode(np.frombuffer(v.as_buffer(), "<u4").tolist()) for v in ids]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string())], names=[*names, "decoded"])

    return rows


def decode(encoded: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``: the text of their ids, special tokens included."""
    names = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*names).schema.add("decoded", "string")
    return encoded.select(*names).mapInArrow(_decode(paths or tokenizer.default_paths(), names), schema)
