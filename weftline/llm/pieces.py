"""A public SentencePiece vocabulary as sorted substring hashes, and texts as code points."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece

from weftline.llm import bytetext as B

SPACE = 0x2581  # stands for a blank in pieces
RANK_SHIFT = 100


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Pieces:
    """Pieces in the order of their hashes; ``ids`` are the model's, ``byte_ids`` those of its 256 byte pieces."""

    hashes: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray
    texts: tuple[str, ...]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes among the sorted pieces, -1 where no piece has the hash."""
        at = np.searchsorted(self.hashes, hashes).astype(np.int32)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, np.int32(-1))


@lru_cache(maxsize=1)
def _spread() -> np.ndarray:
    return B.mix(np.arange(0x110000, dtype=np.uint64))


def code_sums(data: np.ndarray) -> np.ndarray:
    """``bytetext.sums`` over code points."""
    return B.sums(_spread()[data])


def log_probabilities(scores: np.ndarray) -> np.ndarray:
    """The scores of a unigram model as they are; those of a BPE model are merge ranks (0, -1, -2, ...), of which
    the Zipf-Mandelbrot law makes log probabilities: p is in proportion to 1 / (rank + RANK_SHIFT). Pieces without a rank
    (1e9) count as beyond the last.
    """
    if not (scores == np.floor(scores)).all():
        return scores
    rank = np.minimum(-scores, len(scores))
    p = 1 / (rank + RANK_SHIFT)
    return np.log(p / p.sum())


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = tuple(model.id_to_piece(i) for i in range(model.get_piece_size()))
    plain = [i for i in range(len(texts)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    data, at = codes([texts[i] for i in plain])
    hashes = B.spans(code_sums(data), at[:-1], at[1:])
    order = np.argsort(hashes)
    ids = np.array(plain, np.int32)[order]
    scores = log_probabilities(np.array([model.get_score(int(i)) for i in ids]))
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    return Pieces(hashes[order], ids, scores, int(np.diff(at).max()), byte_ids, texts)


def forget() -> None:
    """Drops what a process keeps of vocabularies: for drivers, which need them in passing only."""
    load.cache_clear()
    _spread.cache_clear()
    B.give_back()


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts behind one another and the n + 1 places where each begins."""
    at = np.r_[0, np.cumsum([len(x) for x in texts], dtype=np.int64)] if texts else np.zeros(1, np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), at


def column_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``codes`` of an Arrow column; null counts as empty."""
    data, offsets = B.raw(column)
    begins = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), begins[offsets]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def matrix(data: np.ndarray, start: np.ndarray, length: int, lead: int | None = None) -> np.ndarray:
    """Equal-length words as rows of code points, behind the code point ``lead`` if one is given."""
    body = data[start[:, None] + np.arange(length)]
    return body if lead is None else np.concatenate([np.full((len(start), 1), lead, body.dtype), body], axis=1)


def substrings(pieces: Pieces, rows: np.ndarray) -> list[np.ndarray]:
    """For each length k from 1: the piece at [i, i + k) of every row, as a matrix over i; -1 for none."""
    n, length = rows.shape
    power, inverse = B._powers(length + 1)
    prefix = np.zeros((n, length + 1), np.uint64)
    np.cumsum(_spread()[rows] * power[:length], axis=1, out=prefix[:, 1:])
    return [pieces.find(B.mix((prefix[:, k:] - prefix[:, :-k]) * inverse[: length - k + 1] + np.uint64(k * int(B._MUL) % (1 << 64)))) for k in range(1, min(pieces.longest, length) + 1)]
