"""SentencePiece encoding and decoding by a table of distinct marked words.

The model marks white space, and none of its pieces has a mark behind another character, so a
text falls into chunks (a run of marks and what follows it) that are segmented independently.
A task keeps a table of the distinct chunks it has met: each is segmented once by the library,
and a document is put together by looking its chunks up in order. The table is started anew
when it is full, which changes no result.

Defined results: null counts as empty; an empty text has the end id alone and decodes to the
empty text; texts are never cut. Extra columns pass through; a column with the name of a result
is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prefixlake.llm.common import chunks_of

MODEL = "piece_bpe_32k.model"
#: Most chunks and characters a task's table holds.
TABLE_ENTRIES = 600_000
TABLE_CHARS = 12_000_000
#: Characters looked up together.
SPAN = 1_000_000
MARK = "▁"
_CHUNK = re.compile(r" *[^ ]+| +$")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTable:
    """Ids (as written numbers) and decoded text of each distinct chunk."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.pieces.serialized_model_proto())
        spec = proto.normalizer_spec
        crossing = any(p.type in (1, 4) and re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)
        if crossing or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model's pieces can cross white space marks, or it rewrites texts: chunks are not independent")
        self.end = str(self.pieces.eos_id())
        self.written = [str(i) for i in range(len(proto.pieces))]
        self.plain = [p.piece.replace(MARK, " ") if p.type == 1 else None for p in proto.pieces]
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}  # only where it differs from the chunk
        self.chars = 0

    def learn(self, chunks: set[str]) -> None:
        """Segment chunks that are not in the table; a chunk stands here without its first mark."""
        new = [c for c in chunks if c not in self.ids]
        if self.chars and (len(self.ids) + len(new) > TABLE_ENTRIES or self.chars + sum(map(len, new)) > TABLE_CHARS):
            self.ids = {c: self.ids[c] for c in chunks if c in self.ids}
            self.text = {c: self.text[c] for c in chunks if c in self.text}
            self.chars = sum(map(len, self.ids))
        if "" in new:  # a lone mark: the library would take it for an empty text
            new.remove("")
            self.ids[""] = str(self.pieces.piece_to_id(MARK))
        if not new:
            return
        self.chars += sum(map(len, new))
        written, plain = self.written.__getitem__, self.plain.__getitem__
        for chunk, ids in zip(new, self.pieces.encode(new, num_threads=1), strict=True):
            self.ids[chunk] = " ".join(map(written, ids))
            try:
                text = "".join(map(plain, ids))[1:]
            except TypeError:  # bytes, or what the library shows in its own way
                text = self.pieces.decode(ids)
            if text != chunk:
                self.text[chunk] = text

    @staticmethod
    def split(text: str) -> list[str]:
        """Chunks of a text, each without its first mark."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " not in text and not text.startswith(" "):
            return text.split(" ")
        return [c[1:] for c in _CHUNK.findall(" " + text)]

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Per text: ids written as numbers with one space between, the end id last; the decoded text."""
        lists = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*lists))
        find, differ, end = self.ids.__getitem__, self.text.get, f" {self.end}"
        for chunks in lists:
            yield (" ".join(map(find, chunks)) + end, " ".join(map(differ, chunks, chunks))) if chunks else (self.end, "")


@lru_cache(maxsize=1)
def _table(path: str) -> ChunkTable:
    """The table of this Python process; tasks that run in it one after the other share it."""
    return ChunkTable(path)


def encode_documents(docs: DataFrame, text: str = "text", model_file: str | None = None, tokens: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256; with ``tokens`` also token_ids and decoded."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids", "decoded"] if tokens else [])]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType()), T.StringType()]
    base = docs.drop(*names)
    path = model_file or model_path()
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=False)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in batches:
            out: list[tuple] = []
            texts = [t or "" for t in batch.column(text).to_pylist()]
            spans = chunks_of(texts, [len(t) for t in texts], SPAN)
            for ids, decoded in (pair for a, b in spans for pair in table.encode(texts[a:b])):
                row = (ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                out.append((*row, [int(i) for i in ids.split()], decoded) if tokens else row)
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(list(c), k) for c, k in zip(columns, types, strict=False)]], names=[*batch.schema.names, *names])

    return base.mapInArrow(run, schema)
