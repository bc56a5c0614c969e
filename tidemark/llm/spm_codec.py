"""Encoding of whole texts with a public byte-level BPE vocabulary.

No tokenizer is trained.  A sentencepiece BPE model is serialised straight from
the ranked vocabulary: every token is a piece of byte-mapped characters (one
printable character per byte), its score is the negative rank, the normaliser is
the identity.  Sentencepiece merges the adjacent pair whose joined piece has the
best score, leftmost first, which is the rank order of byte-level BPE, and piece
i is token i.  Texts are cut into pre-tokens by the vocabulary's pattern and each
distinct pre-token is encoded once per worker.  Decoding maps ids to pieces and
pieces back to bytes.

Defined results: a null or empty text has an empty list of ids; any other text,
of whatever length, is encoded whole, without special tokens (their spelling in a
text is ordinary text).  Rows are kept as they are, repeated ones included.  An
empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = os.environ.get("TIDEMARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# The pattern by which this vocabulary's texts are cut into pre-tokens.
PRE_TOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pre-tokens a worker remembers before it starts anew; bounds memory, not results.
REMEMBERED = 400_000
#: Below this code point classes are spelled out for the faster engine; texts beyond use the Unicode engine.
SPELLED_OUT = 0x3000


def byte_letters() -> list[str]:
    """One printable character for each byte: itself where it is a visible Latin-1 character, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or length-delimited bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model whose piece ids are the ranks; the unknown piece comes last and is never met."""
    letters = byte_letters()
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must count from 0 without holes")
    normal, unknown, bpe = 1, 2, 2
    pieces = []
    for rank, token in enumerate(order):
        text = "".join(letters[b] for b in token).encode()
        pieces.append(_field(1, _field(1, text) + _field(2, float(-rank)) + _field(3, normal)))
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    none = (1 << 64) - 1  # -1: the model has no such piece
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(order)) + b"".join(_field(n, none) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def _spelled(test) -> str:
    """The characters below SPELLED_OUT that pass ``test`` as the inside of a character class."""
    runs: list[list[int]] = []
    for point in range(SPELLED_OUT):
        if test(chr(point)):
            if runs and runs[-1][1] == point - 1:
                runs[-1][1] = point
            else:
                runs.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@cache
def _splitters():
    import regex

    full = regex.compile(PRE_TOKEN_PATTERN)
    space = regex.compile(r"\s")
    classes = {
        r"\p{L}": _spelled(lambda ch: unicodedata.category(ch)[0] == "L"), r"\p{N}": _spelled(lambda ch: unicodedata.category(ch)[0] == "N"),
        r"\s": _spelled(lambda ch: space.match(ch) is not None),
    }
    spelled = PRE_TOKEN_PATTERN.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(classes.values()) + "]")
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        spelled = spelled.replace(name, f"[{classes[name]}]")
    spelled = spelled.replace(r"\S", f"[^{classes[chr(92) + 's']}]")
    return re.compile(spelled).findall, full.findall, re.compile(f"[\\U{SPELLED_OUT:08x}-\\U0010ffff]").search


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text; joined they are the text."""
    fast, full, beyond = _splitters()
    return full(text) if beyond(text) else fast(text)


class Codec:
    """Encodes and decodes texts with a serialised model."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        self.table = dict(enumerate(letters))
        self.back = {ord(letter): b for b, letter in enumerate(letters)}
        self.known: dict[str, list[int]] = {}

    def _learn(self, tokens: list[str]) -> None:
        """Encodes distinct pre-tokens in one call; the joint is no byte letter, so it splits them again."""
        joint = "\uffff"
        mapped = joint.join([t.encode().decode("latin-1") for t in tokens]).translate(self.table).split(joint)
        self.known.update(zip(tokens, self.processor.encode(mapped, num_threads=1), strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        cut = [pre_tokens(text) if text else [] for text in texts]
        fresh = set().union(*cut).difference(self.known)
        if fresh:
            self._learn(list(fresh))
        ids = self.known.__getitem__
        return [list(chain.from_iterable(map(ids, tokens))) for tokens in cut]

    def decode(self, ids: Iterable[int]) -> str:
        pieces = "".join(self.processor.id_to_piece(list(ids)))
        return bytes(map(self.back.__getitem__, map(ord, pieces))).decode()


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col`` and ``ids``, the token ids of each row's whole text; no shuffle."""
    model = serialise(read_ranks(vocabulary))  # some 1 MB, as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            rows = codec.encode_batch(batch.column(1).to_pylist())
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(rows), np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[id_col, "ids"])

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, ids array<int>")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col`` and ``text``; a null list gives an empty text."""
    model = serialise(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            texts = [codec.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, text string")
