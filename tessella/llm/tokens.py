"""Ids of a public byte-level BPE vocabulary, by a sentencepiece model written directly from that vocabulary.

The vocabulary file lists each token's bytes and rank. A sentencepiece BPE model joins the pair whose joined piece has the
best score; with each byte written as one visible character and the score of a piece set to its negative rank, that is the
same rule as byte-level BPE on ranks. The model is serialised here as protocol buffer fields: the pieces, the trainer's
kind (BPE) and an identity normaliser, with nothing added, removed or escaped. Texts are cut into pre-tokens first; each
pre-token is encoded for itself. Decoding maps ids back to bytes and joins them.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered by each worker before it starts anew, counted in pre-tokens of `MEAN` characters.
MEMORY, MEAN = 400_000, 8


def vocabulary_path(name: str = NAME, folder: str | None = None) -> str:
    """Where a vocabulary file lies: in `folder`, else in TOKENIZER_DIR, else in the installed package of public tokenizers."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


def _visible() -> str:
    """A visible character for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


VISIBLE = _visible()
_TABLE = {b: c for b, c in enumerate(VISIBLE)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """The tokens' bytes by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised model: piece 0 is the unknown piece, piece i + 1 has rank i."""
    pieces = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, token in enumerate(tokens):
        shown = token.decode("latin-1").translate(_TABLE)
        pieces.append(_field(1, _field(1, shown) + _field(2, -float(rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}
        self.held = 0

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 4-byte integers; none for an empty or null text."""
        known = self.known
        if self.held > MEMORY:
            known.clear()
            self.held = 0
        parts = [self.cut(t) if t else [] for t in texts]
        if new := [*set().union(*parts).difference(known)]:
            shown = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TABLE) for p in new]
            self.held += sum(map(len, shown)) // MEAN
            known.update(zip(new, ((np.array(ids, dtype=np.int32) - 1).tobytes() for ids in self.model.encode(shown, num_threads=1))))
        return [b"".join(map(known.__getitem__, ps)) for ps in parts]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; no ids for an empty or null text."""
        return [np.frombuffer(x, dtype=np.int32).tolist() for x in self.packed(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of these ids."""
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "surrogatepass")


@functools.cache
def codec(path: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path)


#: Texts taken at once, so that a batch of very long texts stays small in memory.
STEP = 500


def encoded(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, only_count: bool = False) -> DataFrame:
    """One row for each row: (id, ids), or (id, n_tokens) with `only_count`.

    Null and empty texts give an empty list (0 tokens); blank texts have the ids of their blanks. Repeated rows are
    repeated, a null id is kept. Other columns are ignored whatever their names. Special tokens' strings are ordinary text.
    The vocabulary is read once by each worker from `path`, which must exist on every executor.
    """
    path = path or vocabulary_path()
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                packed = bpe.packed(part.column(1).to_pylist())
                sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
                if only_count:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int32))], names=[id_column, "n_tokens"])
                    continue
                flat = np.frombuffer(b"".join(packed), dtype=np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_column, "ids"])

    out = f"`{id_column}` {kind}, " + ("n_tokens int" if only_count else "ids array<int>")
    return rows.select(F.col(id_column), F.col(text_column)).mapInArrow(run, out)


def decoded(rows: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) of each row of ids; a null list gives a null text, an empty list an empty text."""
    path = path or vocabulary_path()
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return rows.select(F.col(id_column), F.col(ids_column)).mapInArrow(run, f"`{id_column}` {kind}, text string")
