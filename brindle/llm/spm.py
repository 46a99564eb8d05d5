"""SentencePiece models written from public vocabulary files."""

from __future__ import annotations

import base64
import math

import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

SPACE = "▁"
UNKNOWN = "⁇unknown⁇"


def byte_letters() -> list[str]:
    """One printable letter for each byte: itself where it prints, else the next code point from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = [""] * 256, 256
    for b in range(256):
        if b in prints:
            letters[b] = chr(b)
        else:
            letters[b], free = chr(free), free + 1
    return letters


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def bpe_model(ranks: list[bytes]) -> bytes:
    """A serialised BPE model whose piece ids are the ranks.

    Pieces are byte strings in byte_letters(), scored by the negative rank, so the best-scored
    merge is the one of the lowest rank. Nothing is normalised. The unknown piece, which the
    format asks for, comes last and is never met, as each byte is a piece.
    """
    letters = byte_letters()
    model = pb.ModelProto()
    for rank, token in enumerate(ranks):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece=UNKNOWN, score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t, n = model.trainer_spec, model.normalizer_spec
    t.model_type, t.vocab_size, t.byte_fallback = pb.TrainerSpec.BPE, len(model.pieces), False
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = len(ranks), -1, -1, -1
    n.name, n.precompiled_charsmap = "identity", b""
    n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = False, False, False
    return model.SerializeToString()


def check_plain(model: pb.ModelProto) -> None:
    """Raise unless texts reach the pieces as they are, but for spaces that become marks."""
    n = model.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model's normaliser rewrites texts")
    if any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces):
        raise ValueError("the model has pieces defined by users")


def unigram_model(path: str) -> bytes:
    """The pieces of a model file as a unigram model with byte fallback.

    A piece at place r of the vocabulary has the log probability -ln(r + 2), in steps of 1/256, so
    sums over a stretch of text are exact in single precision. Byte, control and unknown pieces
    and the normaliser stay as they are. Models that rewrite texts or have pieces of their users aren't taken.
    """
    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    check_plain(model)
    place = 0
    for p in model.pieces:
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score, place = -round(math.log(place + 2) * 256) / 256, place + 1
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.trainer_spec.byte_fallback = True
    return model.SerializeToString()


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)
