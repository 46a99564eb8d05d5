"""Token counts of a unigram tokenizer without its pieces: a Viterbi pass that carries a count."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from brindle.llm import spm
from brindle.session import ship

VOCABULARY = "piece_bpe_32k.model"
KEPT = 400_000
#: What SentencePiece takes off the lowest score for an unknown character.
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")


class Counter:
    """Counts pieces stretch by stretch.

    Texts are cut where no piece can reach across: before each run of word marks, and around
    characters that are in no piece of two or more. The best path of a text is the best paths of
    its stretches in turn, so each stretch is counted once and kept.
    """

    def __init__(self, model: bytes):
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spm.check_plain(proto)
        kind = pb.ModelProto.SentencePiece
        scores = {p.piece: p.score for p in proto.pieces if p.type == kind.NORMAL}
        if any(spm.SPACE in p.lstrip(spm.SPACE) for p in scores):
            raise ValueError("a piece reaches across words")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.fallback = proto.trainer_spec.byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        joined = {c for p in scores if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\x0b\x0c" if c not in joined)
        self.stretch = re.compile(f"[{alone}]|{spm.SPACE}*[^{spm.SPACE}{alone}]+|{spm.SPACE}+" if alone else f"{spm.SPACE}*[^{spm.SPACE}]+|{spm.SPACE}+")
        self.kept: dict[str, int] = {}

    def viterbi(self, s: str) -> int:
        """The number of pieces on the best path.

        At each end the automaton gives matches from the longest on, which is the order of their
        starts; a later one wins only with a better score, as in the tokenizer. A character that
        is no piece is unknown: as many pieces as it has bytes under byte fallback, else one for
        each run of them, which the tokenizer joins.
        """
        n = len(s)
        best, count, unknown = [NEVER] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0], at = 0.0, 0

        def unmatched(end: int) -> None:
            """Reach end by an unknown character, from a place that is known by now."""
            score = best[end - 1] + self.unknown
            if score > best[end]:
                extra = len(s[end - 1].encode()) if self.fallback else 0 if unknown[end - 1] else 1
                best[end], count[end], unknown[end] = score, count[end - 1] + extra, True

        single = False
        for last, (size, score) in self.automaton.iter(s):
            end = last + 1
            while at < end:
                if at and not single:
                    unmatched(at)
                at, single = at + 1, False
            single |= size == 1
            score += best[end - size]
            if score > best[end]:
                best[end], count[end], unknown[end] = score, count[end - size] + 1, False
        while at <= n:
            if at and not single:
                unmatched(at)
            at, single = at + 1, False
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = (spm.SPACE if self.prefix else "") + text.replace(" ", spm.SPACE)
        total, get = 0, self.kept.get
        for m in self.stretch.finditer(marked) if len(marked) > 1 << 20 else self.stretch.findall(marked):
            s = m if isinstance(m, str) else m[0]
            k = get(s)
            if k is None:
                k = self.viterbi(s)
                if len(s) <= 64:
                    if len(self.kept) >= KEPT:
                        self.kept.clear()
                    self.kept[s] = k
            total += k
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(spm.unigram_model(path))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: id, n_tokens under the unigram model of a vocabulary file.

    Null and empty texts have no tokens. Whole texts are counted. Ids keep their nulls and
    repeats; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.count(t or "") for t in b.column(1).to_pylist()], pa.int64())], names=["id", "n_tokens"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_tokens long")
