"""Encoding and decoding with a SentencePiece model through a table of distinct chunks.

The model marks every space, and none of its pieces holds a mark behind another character. So a text falls into chunks,
each a stretch of marks and the characters up to the next mark, that no piece crosses and that are segmented alike
wherever they stand. A task cuts its texts into chunks, segments each distinct chunk once, and joins the ids back by
position. What it has segmented it keeps for its later batches, up to ``TABLE_CHARS`` characters; beyond them the table
starts anew, which costs time and changes no result. Models whose pieces do cross marks are refused.
"""

from __future__ import annotations

import re
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.text import map_text, prepare

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
TABLE_CHARS = 16 << 20


def default_model() -> str:
    """Place of the model file in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(model: bytes):
    """The processor of a model; refuses those for which chunks cannot stand alone."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("pieces of this model cross marked spaces")
    # spaces must be kept as they are, and one mark must be set before the text
    probe = " \t a  b　ﬁ "
    if processor.decode(processor.encode(probe)) != probe or processor.encode("a") != [processor.piece_to_id(MARK + "a")]:
        raise ValueError("this model changes texts before it segments them")
    return processor


class ChunkTable:
    """Ids of distinct chunks, each segmented once."""

    def __init__(self, model: bytes):
        self.processor = load(model)
        self.ids: dict[str, list[int]] = {}
        self.chars = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # a space and a written mark are the same to the model; an empty text gets no mark
        cut = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.chars > TABLE_CHARS:
            self.ids, self.chars = {}, 0
        fresh = [c for c in set(chain.from_iterable(cut)) if c not in self.ids]
        # the model sets the first mark itself, but for an empty text
        coded = self.processor.encode([c[1:] for c in fresh], num_threads=1)
        for chunk, ids in zip(fresh, coded, strict=True):
            self.ids[chunk] = ids if len(chunk) > 1 else [self.processor.piece_to_id(MARK)]
            self.chars += len(chunk)
        find = self.ids.__getitem__
        return [np.fromiter(chain.from_iterable(map(find, c)), np.int32) for c in cut]


def encode(docs: DataFrame, keep: list[Column], text: Column, model: bytes) -> DataFrame:
    """``keep`` and ``ids array<int>``: the ids of the whole text, without begin or end ids.

    A null or empty text has no ids. Rows are encoded where they lie: repeated rows give repeated results, null ids stay,
    nothing is shuffled; a text without spaces is one chunk. Only ``keep`` is carried, so other columns cannot clash.
    """

    def start():
        table = ChunkTable(model)
        return lambda texts: [table.encode(texts)]

    return map_text(docs, keep, text, {"ids": "array<int>"}, start)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in the column ``into``; null or empty ids give an empty text."""
    source = prepare(encoded)
    source = source.select(*[c for c in source.columns if c != into])
    schema = T.StructType([*source.schema.fields, T.StructField(into, T.StringType())])
    at, names = source.columns.index(ids), schema.fieldNames()

    def run(batches):
        processor = load(model)
        for batch in batches:
            if batch.num_rows:
                rows = [v.values.to_numpy().tolist() if v.is_valid else [] for v in batch.column(at)]
                texts = pa.array([processor.decode(r) if r else "" for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=names)

    return source.mapInArrow(run, schema)


def read_model(path: str | None = None) -> bytes:
    """The model file, at most a few MB, as tasks get it."""
    return Path(path or default_model()).read_bytes()


def digests(decoded: DataFrame) -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text, per document."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
