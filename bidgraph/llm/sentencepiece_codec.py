"""SentencePiece encoding and decoding through a table of distinct chunks.

When no piece of the model has a whitespace marker after another character, segmentation never
looks across the place where a run of markers begins.  A text is then the row of its marked words,
each distinct marked word is segmented and decoded once per table, and the ids and texts are
joined back by position.  Line feeds, which no longer piece holds, end a chunk as well.  The table
belongs to a task and is bounded: distinct words grow with the corpus, so a table of all of them
could not be sent to the tasks, and one row per word of the corpus would be far more than the
texts.  A model that doesn't meet the condition is run on whole texts.

Defined cases: a null text counts as empty and gives the begin and end ids alone; a table that is full
starts anew; rows that repeat are encoded each; other columns of the
input are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
TABLE_CHUNKS = 250_000  # distinct chunks that a task's table holds besides those of the text at hand
GROUP_CHARS = 1_000_000  # characters of texts that are handled together

_RESULT = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def chunk_pattern(proto) -> re.Pattern | None:
    """How texts split into chunks that segment on their own; None if this model's don't."""
    spec, trainer = proto.normalizer_spec, proto.trainer_spec
    plain = not spec.precompiled_charsmap and not spec.normalization_rule_tsv and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    kind = type(proto.pieces.add())
    proto.pieces.pop()
    special = [p for p in proto.pieces if p.type == kind.USER_DEFINED]
    words = [p.piece for p in proto.pieces if p.type == kind.NORMAL]
    crossing = any(re.search(f"[^{MARK}]{MARK}", w) for w in words)
    if not plain or special or crossing or trainer.treat_whitespace_as_suffix or not (trainer.byte_fallback and trainer.model_type == 2):
        return None
    return re.compile(" *[^ ]+| +" if any("\n" in w for w in words) else "\n| +[^ \n]*|[^ \n]+")


class ChunkTable(dict):
    """chunk -> (ids as little-endian bytes, decoded text)."""

    def __init__(self, plain: sentencepiece.SentencePieceProcessor):
        super().__init__()
        self.plain = plain

    def add(self, chunks: set[str]) -> None:
        """Segment and decode each chunk that the table lacks, once."""
        new = list(chunks.difference(self))
        if len(self) + len(new) > TABLE_CHUNKS:
            self.clear()
            new = list(chunks)
        if new:
            found = self.plain.encode(new, num_threads=1)
            for chunk, ids, text in zip(new, found, self.plain.decode(found, num_threads=1)):
                self[chunk] = _packed(ids), chunk if text == chunk else text


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encodes as the library does with begin and end ids, and decodes as its decode(ids)."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunks, self.prefix = chunk_pattern(proto), proto.normalizer_spec.add_dummy_prefix
        if self.chunks is not None:
            proto.normalizer_spec.add_dummy_prefix = False
            self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.begin, self.end = (_packed([k]) for k in (self.whole.bos_id(), self.whole.eos_id()))

    def new_table(self) -> ChunkTable | None:
        return None if self.chunks is None else ChunkTable(self.plain)

    def run(self, texts: list[str | None], table: ChunkTable | None = None) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each text; the chunks of all of them enter the table together."""
        if self.chunks is None:
            found = [self.whole.encode(t or "", add_bos=True, add_eos=True) for t in texts]
            return [(_packed(ids), self.whole.decode(ids)) for ids in found]
        marked = [(t or "").replace(MARK, " ") for t in texts]
        parts = [self.chunks.findall(f" {t}" if self.prefix and t else t) for t in marked]
        table = self.new_table() if table is None else table
        table.add(set().union(*parts))
        get, out = table.__getitem__, []
        for chunks in parts:
            entries = list(map(get, chunks))
            decoded = "".join([e[1] for e in entries])
            out.append((b"".join([self.begin, *[e[0] for e in entries], self.end]), decoded[1:] if self.prefix else decoded))
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        with open(path, "rb") as model:
            _CODECS[path] = Codec(model.read())
    return _CODECS[path]


def _groups(texts: pd.Series) -> Iterator[list[str | None]]:
    """Runs of texts of about GROUP_CHARS characters."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_decode(text: Column, model: str) -> Column:
    """(ids, decoded): all ids of a whole text as packed little-endian 32-bit integers, and the text that they decode to."""

    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        table = own.new_table()  # freed with the task, as workers serve later stages too
        for texts in batches:
            for group in _groups(texts):
                yield pd.DataFrame(own.run(group, table), columns=["ids", "decoded"])

    return run(text)


def id_array(ids: Column) -> Column:
    """Packed ids as an array of integers."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def unpack(packed: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else np.frombuffer(p, "<u4").astype("i4") for p in packed], dtype=object)

    return unpack(ids)
