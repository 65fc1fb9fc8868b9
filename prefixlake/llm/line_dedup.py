"""Line deduplication behind two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased. One pass hashes the
distinct keys of each document. The hash space is cut into slots, and one task streams the
hashes of a slot through two Bloom filters: the first remembers what was seen once, the second
what was seen again in another document. Only lines whose hash is in the second filter are
suspected; their digests alone are shuffled, already counted by task, and counted exactly.

The second filters are broadcast: together they take 8 bits for each hash and at most
``FILTER_BYTES``. Beyond that they fill up and more lines are suspected, which changes no result.
The repeated keys are broadcast while they are at most ``BROADCAST_KEYS``; beyond that each
document's suspected lines are joined to them and back by row.

Defined results: a null or empty text is one empty line; an empty key never repeats; every row
counts as a document, rows repeated with one doc_id too; an empty table gives an empty result.
Texts are never cut, however long. A document that loses all lines has the empty text. With
``keep_first`` the occurrence with the smallest (doc_id, line) stays, null ids last; rows repeated
with that id all keep it. Extra columns pass through; one with the name of a result is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixlake.llm.common import stored

BLANK = b" \t\n\x0b\x0c\r"
SLOTS = 1024
#: Most bytes of all second filters together, and bits of a filter for each hash below that.
FILTER_BYTES = 1 << 26
FILTER_BITS = 8
#: Most repeated keys to broadcast (32 bytes each), and most hashes or keys a task holds back.
BROADCAST_KEYS = 1 << 18
HELD = 200_000
_U = np.uint64
_RESULT = ["n_lines", "n_dropped", "kept"]
_FIELDS = [T.StructField(n, t) for n, t in zip(_RESULT, (T.LongType(), T.LongType(), T.StringType()), strict=True)]


def keys_of(text: str | None) -> list[bytes]:
    """The key of each line."""
    return [line.strip(BLANK).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _by_slot(hashes: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    """One row per slot: how many hashes, those of one document, those of several."""
    slot = (hashes >> _U(54)).astype(np.int32)  # hashes are sorted, so slots are too
    cut = np.searchsorted(slot, np.arange(SLOTS + 1))
    some = np.flatnonzero(np.diff(cut))
    once, more = [], []
    for s in some:
        h, f = hashes[cut[s] : cut[s + 1]], flags[cut[s] : cut[s + 1]]
        once.append(h[~f].tobytes())
        more.append(h[f].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.diff(cut)[some], pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["slot", "n", "once", "more"])


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        hashes, times = np.unique(np.concatenate(held), return_counts=True)
        return _by_slot(hashes, times > 1)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            keys = set(keys_of(text))
            keys.discard(b"")
            # two keys of one document with one hash would look like two documents: suspected at worst
            held.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys)))
            size += len(keys)
        if size > HELD:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each hash in its slot's filter (``bits`` is a power of two)."""
    return hashes & _U(bits - 1), (hashes >> _U(27)) & _U(bits - 1)


class Filters:
    """What was seen once and what was seen again, of one slot."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)

    def add(self, once: np.ndarray, more: np.ndarray) -> None:
        """Distinct hashes of further documents; ``more`` are in several of them."""
        for hashes, again in ((once, None), (more, True)):
            a, b = _places(hashes, self.bits)
            seen = self.once[a] & self.once[b] if again is None else np.ones(len(a), dtype=bool)
            self.twice[a[seen]] = self.twice[b[seen]] = True
            self.once[a] = self.once[b] = True


def _filter_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, filters = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([np.packbits(filters.twice).tobytes()], pa.binary())], names=["slot", "twice"])

        for batch in batches:
            for s, once, more in zip(*(batch.column(c).to_pylist() for c in ("slot", "once", "more")), strict=True):
                if s != slot:
                    if filters:
                        yield done()
                    slot, filters = s, Filters(bits)
                filters.add(np.frombuffer(once, dtype=np.uint64), np.frombuffer(more, dtype=np.uint64))
        if filters:
            yield done()

    return run


def _suspects(packed: np.ndarray, bits: int, keys: list[bytes]) -> list[int]:
    """Places of the keys whose hash is in the second filters."""
    at = [i for i, k in enumerate(keys) if k]
    if not at:
        return []
    h = np.fromiter((xxhash.xxh3_64_intdigest(keys[i]) for i in at), dtype=np.uint64, count=len(at))
    row = (h >> _U(54)) * _U(bits)
    hit = np.ones(len(h), dtype=bool)
    for place in _places(h, bits):
        place = place + row
        hit &= (packed[place >> _U(3)] >> (_U(7) - (place & _U(7))).astype(np.uint8)) & 1 == 1
    return [at[i] for i in np.flatnonzero(hit)]


def second_filter(texts: DataFrame) -> tuple[bytes, int]:
    """All slots' second filters side by side, and the bits of each; ``texts`` has one column."""
    hashes = stored(texts.mapInArrow(_hash_batches, "slot int, n long, once binary, more binary"))
    total = hashes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = 64
    while bits * SLOTS < total * FILTER_BITS and bits * SLOTS < FILTER_BYTES * 8:
        bits *= 2
    rows = hashes.repartition("slot").sortWithinPartitions("slot").mapInArrow(_filter_batches(bits), "slot int, twice binary").collect()
    packed = np.zeros((SLOTS, bits // 8), dtype=np.uint8)  # at most FILTER_BYTES
    for r in rows:
        packed[r["slot"]] = np.frombuffer(r["twice"], dtype=np.uint8)
    return packed.tobytes(), bits


def repeated_keys(docs: DataFrame, text: str, id_column: str, min_docs: int, shared, bits: int) -> DataFrame:
    """(digest, first_id, first_line) of every key in at least ``min_docs`` documents, counted exactly."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(shared.value, dtype=np.uint8)
        held: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            n, ids, lines = zip(*held.values(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(lines, pa.int64())], names=["digest", "n", "doc", "line"])

        def order(doc, line: int) -> tuple:
            return (doc is None, doc or 0, line)

        for batch in batches:
            for value, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = keys_of(value)
                met = set()
                for i in _suspects(packed, bits, keys):
                    if (d := hashlib.sha256(keys[i]).digest()) in met:
                        continue
                    met.add(d)
                    old = held.setdefault(d, [0, doc, i])
                    old[0] += 1
                    if order(doc, i) < order(old[1], old[2]):
                        old[1:] = [doc, i]
                if len(held) > HELD:
                    yield flush()
                    held = {}
        if held:
            yield flush()

    counted = docs.select(F.col(text), F.col(id_column).cast("long").alias("doc")).mapInArrow(count, "digest binary, n long, doc long, line long")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "line"))
    merged = counted.groupBy("digest").agg(F.sum("n").alias("n"), first.alias("first"))
    return merged.filter(F.col("n") >= min_docs).select("digest", F.col("first.doc").alias("first_id"), F.col("first.line").alias("first_line"))


def _stays(value: str | None, gone: list[bool]) -> str:
    return "\n".join(line for line, g in zip((value or "").split("\n"), gone, strict=True) if not g)


def dedup_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", min_docs: int = 2, keep_first: bool = True) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept: the text without lines whose key is in at least ``min_docs`` documents."""
    if min_docs < 2:
        raise ValueError("a line repeats from two documents on")
    base = docs.drop(*_RESULT)
    packed, bits = second_filter(base.select(text))
    shared = base.sparkSession.sparkContext.broadcast(packed)
    repeated = stored(repeated_keys(base, text, id_column, min_docs, shared, bits))
    if repeated.count() > BROADCAST_KEYS:
        return _joined(base, text, id_column, keep_first, repeated, shared, bits)
    rows = repeated.collect()
    firsts = base.sparkSession.sparkContext.broadcast({bytes(r["digest"]): (r["first_id"], r["first_line"]) for r in rows})
    schema = T.StructType([*base.schema.fields, *_FIELDS])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, known = np.frombuffer(shared.value, dtype=np.uint8), firsts.value
        for batch in batches:
            out = []
            for value, doc in zip(batch.column(text).to_pylist(), batch.column(id_column).to_pylist(), strict=True):
                keys = keys_of(value)
                gone = [False] * len(keys)
                for i in _suspects(packed, bits, keys):
                    first = known.get(hashlib.sha256(keys[i]).digest())
                    gone[i] = first is not None and not (keep_first and first == (doc, i))
                n = sum(gone)
                out.append((len(keys), n, _stays(value, gone) if n else value or ""))
            lines, dropped, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=[*batch.schema.names, *_RESULT])

    return base.mapInArrow(drop, schema)


def _joined(base: DataFrame, text: str, id_column: str, keep_first: bool, repeated: DataFrame, shared, bits: int) -> DataFrame:
    """The same without a broadcast of the repeated keys: suspected lines meet them by join, and go back to their rows."""
    numbered = stored(base.withColumn("__row", F.monotonically_increasing_id()))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            out = []
            for value, doc, row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                keys = keys_of(value)
                out += [(hashlib.sha256(keys[i]).digest(), doc, row, i) for i in _suspects(packed, bits, keys)]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["digest", "doc", "__row", "line"])

    lines = numbered.select(F.col(text), F.col(id_column).cast("long").alias("doc"), "__row").mapInArrow(suspect, "digest binary, doc long, __row long, line long")
    is_first = F.col("doc").eqNullSafe(F.col("first_id")) & (F.col("line") == F.col("first_line"))
    gone = lines.join(repeated, "digest").filter(~is_first if keep_first else F.lit(True)).groupBy("__row").agg(F.collect_list("line").alias("__gone"))  # at most the lines of one text
    schema, columns = T.StructType([*base.schema.fields, *_FIELDS]), base.columns

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for value, places in zip(batch.column(text).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                flags = [False] * ((value or "").count("\n") + 1)
                for i in places or ():
                    flags[i] = True
                n_lines.append(len(flags))
                n_dropped.append(sum(flags))
                kept.append(_stays(value, flags))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=[*columns, *_RESULT])

    return numbered.join(gone, "__row", "left").select(*columns, "__gone").mapInArrow(drop, schema)
