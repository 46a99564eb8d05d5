"""Byte-level BPE through a SentencePiece model written from a rank file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import spm
from brindle.session import ship

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose ids a worker keeps; the table is emptied when full.
KEPT = 400_000
#: Matches of the pattern that are looked up at once; bounds memory for very long texts.
STEP = 1 << 20


class Codec:
    """Encodes and decodes by one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = spm.read_ranks(path)
        self.model = spm.load(spm.bpe_model(ranks))
        letters = spm.byte_letters()
        self.letters = dict(enumerate(letters))
        self.bytes = {c: b for b, c in enumerate(letters)}
        # the inverse mapping, read back from the model's own pieces
        self.decoded = [bytes(self.bytes[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, bytes] = {}

    def _miss(self, token: str) -> bytes:
        ids = self.model.encode(token.encode().decode("latin-1").translate(self.letters))
        out = np.array(ids, "<u4").tobytes()
        if len(token) <= 64:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[token] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, parts, out = self.kept.get, [], []
        for m in self._tokens(text):
            parts.append(get(m) or self._miss(m))
            if len(parts) >= STEP:
                out.append(b"".join(parts))
                parts.clear()
        out.append(b"".join(parts))
        return b"".join(out)

    def _tokens(self, text: str):
        if len(text) < STEP:
            return self.pattern.findall(text)
        return (m[0] for m in self.pattern.finditer(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids (binary).

    Each match of the pattern is encoded by itself, without special tokens; ids are then decoded
    by the inverse mapping and both are digested. Null and empty texts have no tokens. Ids keep
    their nulls and repeats; an empty table gives no rows. ids holds little-endian unsigned 32-bit
    integers. vocabulary is a rank file's name in the folder of public tokenizers, or its path;
    each worker reads it once and needs no data from the driver.
    """
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), pattern)
        for b in batches:
            n, ids_hex, text_hex, all_ids = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(all_ids, pa.binary())] * with_ids, names=names)

    ship(docs.sparkSession)
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
