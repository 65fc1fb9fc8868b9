"""Aligning the tokens of two tokenizers by interval coalescing.

Tokenizer A reads a space and the text, tokenizer B the text (it adds the space itself), so both
cover the same bytes. All A and B tokens of a batch stand on one axis of byte offsets: they are
lexsorted by start, ``maximum.accumulate`` gives the furthest end so far, and a group breaks where
a start reaches it. Tokens of both kinds whose ranges overlap are expanded into links, inside groups.

Neither tokenizer's tokens cross a lone space in front of a visible character, so both ids of a
space-marked chunk are looked up in a table of the chunks a worker has met; the table is started
anew when it is full, which changes no result. What a chunk's tokens are does not depend on its
neighbours; groups, links and counts are worked out over whole documents.

A pair of ids counts the documents that hold it linked, over the whole corpus. The counts are
broadcast while there are at most ``BROADCAST_PAIRS`` pairs; beyond that the documents' pairs are
joined to them and summed by document.

Defined results: null and empty texts, and texts whose A or B tokens do not spell the space and the
text byte by byte, have no tokens: zeros and an empty digest. Texts are never cut; very long ones
are worked off in slices that end between two chunks. Every row counts as a document, repeated
rows too; ties for an A id's highest count all count as best; an empty table gives an empty result.
Extra columns pass through; one with the name of a result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixlake.llm.common import stored

TOKENIZER_A, RANKS_A, TOKENIZER_B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Most chunks and characters a worker's table holds.
TABLE_ENTRIES = 400_000
TABLE_CHARS = 8_000_000
#: Chunks that are worked off together.
SLICE = 200_000
#: Most pairs whose counts are broadcast (13 bytes each).
BROADCAST_PAIRS = 4_000_000
MARK = "▁"
_LONE_SPACE = re.compile(r"(?<! ) (?=\S)")
_OTHER_SPACE = re.compile(r" (?!\S)")
#: Both implementations of tokenizer A agree on what is a letter or digit in these.
_PLAIN = re.compile(r"[\x00-ɏ]*")
_NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def token_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks_of_text(text: str) -> list[str]:
    """Chunks of a space and the text, each without its leading space."""
    if not text.startswith(" ") and not _OTHER_SPACE.search(text):
        return text.split(" ")
    marked = " " + text
    at = [m.start() for m in _LONE_SPACE.finditer(marked)]
    at = at if at and at[0] == 0 else [0, *at]
    return [marked[a + 1 : b] for a, b in zip(at, [*at[1:], len(marked)], strict=True)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum())), sizes


class Tokens:
    """Both tokenizers, and a table of the chunks met: where each chunk's ids stand, and whether they spell it."""

    def __init__(self, a_file: str, ranks_file: str, b_file: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.a_fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(a_file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = byte_letters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.b.serialized_model_proto())
        spec = proto.normalizer_spec
        crossing = any(p.type in (1, 4) and re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)
        if crossing or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("pieces can cross white space marks: chunks are not independent")
        self.b_bytes = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.wide = len(self.b_bytes)  # a pair (a, b) is written as a * wide + b
        if len(self.a_bytes) * self.wide > 1 << 31:
            raise ValueError("a pair does not fit into 32 bits")
        self.written = [f"{i}{s}" for i in range(max(len(self.a_bytes), self.wide)) for s in ",|;"]
        self.a_size, self.b_size = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.chars = 0
        self.ids = [np.zeros(0, dtype=np.int64)] * 2
        self.first, self.many = [np.zeros(0, dtype=np.int64)] * 2, [np.zeros(0, dtype=np.int64)] * 2
        self.spelt = np.zeros(0, dtype=bool)

    def _encode_a(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk with its space in front. Plain ones are read in one go and cut where a chunk ends."""
        plain = [bool(c) and not c[0].isspace() and _PLAIN.fullmatch(c) is not None for c in chunks]
        easy = [" " + c for c, p in zip(chunks, plain, strict=True) if p]
        ids = self.a_fast.encode_ordinary("".join(easy))
        ends = np.cumsum(self.a_size[ids]) if ids else np.zeros(0, dtype=np.int64)
        cuts = np.searchsorted(ends, np.cumsum([len(c.encode()) for c in easy])) + 1 if easy else []
        cut = iter(zip([0, *cuts[:-1]], cuts, strict=True)) if easy else iter(())
        hard = iter(e.ids for e in self.a.encode_batch_fast([" " + c for c, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False))
        return [ids[slice(*next(cut))] if p else next(hard) for p in plain]

    def learn(self, chunks: list[str]) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self.row]
        if self.chars and (len(self.row) + len(new) > TABLE_ENTRIES or self.chars + sum(map(len, new)) > TABLE_CHARS):
            self.clear()
            new = list(dict.fromkeys(chunks))
        if not new:
            return
        self.chars += sum(map(len, new))
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        spelt = np.ones(len(new), dtype=bool)
        sizes = np.array([len(c.encode("utf-8", "surrogatepass")) + 1 for c in new])
        odd = np.array([MARK in c or "\x00" in c for c in new])
        for k, (lists, table, size) in enumerate(((self._encode_a(new), self.a_bytes, self.a_size), (self.b.encode(new, num_threads=1), self.b_bytes, self.b_size))):
            ids, many = _flat(lists)
            after = np.cumsum(many)
            covered = np.diff(np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], after])])
            for i in np.flatnonzero((covered != sizes) | odd):
                spelt[i] = b"".join(table[t] for t in lists[i]) == b" " + new[i].encode("utf-8", "surrogatepass")
            self.first[k] = np.concatenate([self.first[k], len(self.ids[k]) + after - many])
            self.many[k] = np.concatenate([self.many[k], many])
            self.ids[k] = np.concatenate([self.ids[k], ids])
        self.spelt = np.concatenate([self.spelt, spelt])

    def look_up(self, chunks: list[str]) -> np.ndarray:
        self.learn(chunks)
        return np.fromiter(map(self.row.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def spell(self, chunks: list[str]) -> bool:
        """Whether both tokenizers' tokens spell all the chunks."""
        rows = self.look_up(chunks)
        return bool(self.spelt[rows].all())

    def tokens(self, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokenizer ``k`` over all chunks, and how many each chunk has."""
        many = self.many[k][rows]
        return self.ids[k][spans(self.first[k][rows], many)], many


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: bytes that print stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def spans(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] of them), first[1], ..."""
    at = np.cumsum(many) - many
    return np.repeat(first - at, many) + np.arange(int(many.sum()))


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (A's, then B's, by number) sorted by start, the group of each, and which of them are B's."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((np.arange(len(start)) >= len(a_start), start))
    furthest = np.maximum.accumulate(end[order])
    breaks = np.ones(len(start), dtype=bool)
    breaks[1:] = start[order][1:] >= furthest[:-1]
    return order, np.cumsum(breaks) - 1, order >= len(a_start)


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (A token, B token) whose ranges overlap; both kinds tile the axis, so an A token's partners stand in a row."""
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    return np.repeat(np.arange(len(a_start)), high - low), spans(low, high - low)


@lru_cache(maxsize=1)
def _tokens(*files: str) -> Tokens:
    """The table of this Python process."""
    return Tokens(*files)


class Align:
    """Documents of a batch: totals, a digest and the text of groups, and linked pairs with how often."""

    def __init__(self, tokens: Tokens, n: int, groups: bool):
        self.tokens, self.sums = tokens, np.zeros((4, n), dtype=np.int64)
        self.digest = [hashlib.sha256() for _ in range(n)]
        self.texts: list[list[str]] | None = [[] for _ in range(n)] if groups else None
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.begun = np.zeros(n, dtype=bool)

    def add(self, docs: np.ndarray, rows: np.ndarray) -> None:
        """Chunks (table rows) of the documents ``docs``, in order; whole chunks end groups."""
        table, n = self.tokens, len(self.begun)
        (a, a_many), (b, b_many) = table.tokens(0, rows), table.tokens(1, rows)
        a_doc, b_doc = np.repeat(docs, a_many), np.repeat(docs, b_many)
        a_end, b_end = np.cumsum(table.a_size[a]), np.cumsum(table.b_size[b])
        a_start, b_start = a_end - table.a_size[a], b_end - table.b_size[b]
        order, group, is_b = coalesce(a_start, a_end, b_start, b_end)
        ids, doc = np.concatenate([a, b])[order], np.concatenate([a_doc, b_doc])[order]
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        left, right = overlaps(a_start, a_end, b_start, b_end)
        for k, where in enumerate((a_doc, b_doc, doc[heads], a_doc[left])):
            self.sums[k] += np.bincount(where, minlength=n)
        keys, times = np.unique((a_doc[left] << 32) | (a[left] * table.wide + b[right]), return_counts=True)
        self.links.append((keys, times))
        # a group's A ids, then its B ids, each kind by start
        by = np.argsort(group * 2 + is_b, kind="stable")
        side, ids, group, doc = is_b[by], ids[by], group[by], doc[by]
        separator = np.full(len(ids), 2)
        separator[:-1] = np.where(group[1:] != group[:-1], 2, (side[1:] != side[:-1]).astype(int))
        words, code = table.written, (ids * 3 + separator).tolist()
        cuts = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist()]
        for d, lo, hi in zip(doc[cuts].tolist(), cuts, [*cuts[1:], len(doc)], strict=True):
            text = "".join(map(words.__getitem__, code[lo:hi]))[:-1]
            text = ";" + text if self.begun[d] else text
            self.begun[d] = True
            self.digest[d].update(text.encode())
            if self.texts is not None:
                self.texts[d].append(text)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each document's pairs begin, the pairs (sorted in a document) and how often each is linked."""
        keys = np.concatenate([k for k, _ in self.links]) if self.links else np.zeros(0, dtype=np.int64)
        times = np.concatenate([t for _, t in self.links]) if self.links else np.zeros(0, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, times = keys[first], np.add.reduceat(times, first) if len(first) else times
        return np.searchsorted(keys >> 32, np.arange(len(self.begun) + 1)), keys & 0xFFFFFFFF, times


def align_batch(tokens: Tokens, texts: list[str | None], groups: bool) -> Align:
    out = Align(tokens, len(texts), groups)
    held: list[str] = []
    of: list[np.ndarray] = []

    def flush() -> None:
        if not held:
            return
        rows, docs = tokens.look_up(held), np.concatenate(of)
        good = ~np.isin(docs, docs[~tokens.spelt[rows]])
        if good.any():
            out.add(docs[good], rows[good])
        held.clear()
        of.clear()

    for d, text in enumerate(texts):
        chunks = chunks_of_text(text) if text else []
        slices = [chunks[i : i + SLICE] for i in range(0, len(chunks), SLICE)]
        # a text that is not spelt has no tokens at all: known before the first of its slices is worked off
        if len(slices) > 1 and not all(map(tokens.spell, slices)):
            continue
        for part in slices:
            if len(held) + len(part) > SLICE:
                flush()
            held.extend(part)
            of.append(np.full(len(part), d))
    flush()
    return out


def align_documents(docs: DataFrame, text: str = "text", groups: bool = True, files: tuple[str, str, str] | None = None) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with ``groups`` also the groups as text."""
    base = docs.drop(*_NAMES, "groups")
    files = files or (token_file(TOKENIZER_A), token_file(RANKS_A), token_file(TOKENIZER_B))
    aligned = stored(_aligned(base, text, groups, files))
    wide = _tokens(*files).wide
    held = aligned.select(F.explode("__pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / wide)))  # at most B's vocabulary in a group
    counts = stored(held.withColumn("best", F.col("n") == highest))
    scored = _shared(aligned, counts) if counts.count() <= BROADCAST_PAIRS else _joined(aligned, counts)
    return scored.select(*base.columns, *_NAMES, *(["groups"] if groups else []))


def _aligned(base: DataFrame, text: str, groups: bool, files: tuple[str, str, str]) -> DataFrame:
    """Everything a document tells by itself, and its distinct pairs with how often each is linked."""
    longs = ["n_a", "n_b", "n_groups", "n_links"]
    more = [*[T.StructField(n, T.LongType()) for n in longs], T.StructField("groups_sha256", T.StringType()), *([T.StructField("groups", T.StringType())] if groups else [])]
    lists = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("__pairs", "__times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(*files)
        for batch in batches:
            out = align_batch(tokens, batch.column(text).to_pylist(), groups)
            first, pairs, times = out.pairs()
            digests = [h.hexdigest() if b else "" for h, b in zip(out.digest, out.begun.tolist(), strict=True)]
            columns = [*(pa.array(x) for x in out.sums), pa.array(digests, pa.string())]
            if out.texts is not None:
                columns.append(pa.array(["".join(t) for t in out.texts], pa.string()))
            columns += [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[f.name for f in (*more, *lists)]])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *more, *lists]))


def _shared(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Score each document's pairs by a broadcast table of at most ``BROADCAST_PAIRS`` counts."""
    table = counts.orderBy("pair").toArrow()
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))
    slim = aligned.drop("__pairs", "__times")
    columns = slim.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            pairs, times = batch.column("__pairs"), batch.column("__times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(known, pairs.flatten().to_numpy())
            offsets = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in ((best[at] * times, n[at] * times) if len(at) else (times, times))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *[pa.array(x, pa.int64()) for x in sums]], names=[*columns, "n_best", "count_sum"])

    return aligned.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]))


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join of the documents' pairs to their counts; the side of the counts has one row a pair."""
    rows = aligned.withColumn("__row", F.monotonically_increasing_id())
    single = rows.select("__row", F.explode(F.arrays_zip("__pairs", "__times")).alias("x")).select("__row", F.col("x.__pairs").alias("pair"), F.col("x.__times").cast("long").alias("times"))
    times = F.col("times")
    sums = single.join(counts, "pair").groupBy("__row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))
    return rows.join(sums, "__row", "left").fillna({"n_best": 0, "count_sum": 0}).drop("__row")
