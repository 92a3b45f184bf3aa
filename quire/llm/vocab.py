"""Byte-level BPE vocabularies: rank files, and the sentencepiece model made from them."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Fixed value: where the byte-level alphabet puts bytes that don't print, from this code point on.
SHIFTED_FROM = 256


@lru_cache(maxsize=4)
def ranks(path: str) -> tuple[bytes, ...]:
    """The tokens of a rank file in order of rank (one ``base64 rank`` per line, ranks gapless from 0)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return tuple(out)


@lru_cache(maxsize=1)
def byte_alphabet() -> tuple[str, ...]:
    """One printable character for each byte: itself where latin-1 prints it, else the next free one from 256 on."""
    keeps = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, free = [], SHIFTED_FROM
    for b in range(256):
        out.append(chr(b if b in keeps else free))
        free += b not in keeps
    return tuple(out)


def mapped(token: bytes) -> str:
    """A byte string over the byte alphabet."""
    return token.decode("latin-1").translate(_TO_ALPHABET)


_TO_ALPHABET = dict(enumerate(byte_alphabet()))


@lru_cache(maxsize=4)
def sentencepiece_model(path: str) -> bytes:
    """A serialised sentencepiece BPE model with the vocabulary of a rank file.

    Each token is a piece over the byte alphabet, scored by its negative rank, so that the merge
    with the best score is the merge of lowest rank; piece ids are ranks.  Normalisation is the
    identity: no dummy prefix, no escaping or removal of white space.  One unknown piece, which no
    text can reach because every byte has a piece, comes after the last rank.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    tokens = ranks(path)
    m = proto.ModelProto()
    for rank, token in enumerate(tokens):
        m.pieces.add(piece=mapped(token), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    m.pieces.add(piece="<unk>", score=-float(len(tokens)), type=proto.ModelProto.SentencePiece.UNKNOWN)
    t = m.trainer_spec
    t.model_type = proto.TrainerSpec.BPE
    t.vocab_size = len(m.pieces)
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = len(tokens), -1, -1, -1
    n = m.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return m.SerializeToString()
