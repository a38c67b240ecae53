"""A unigram view of a public SentencePiece vocabulary, shared by token counts and segmentation sampling.

The vocabulary file holds merge ranks, not probabilities. A piece's score here is the logarithm of Zipf's law at its
rank, -log(rank + 2.7) less the logarithm of the sum, so that early merges are likely. A character without a piece of
its own is written as its UTF-8 bytes and scores ten below the least piece, as the library's unigram model has it.

Texts get one space in front and spaces stand for themselves; the mark U+2581 in a text is not a space and goes to bytes,
so decoding restores every text. No piece has a space after another character, and none holds a line break: a text can
be cut before each run of spaces and around each line break without changing any segmentation.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

SHIFT = 2.7
UNKNOWN_BELOW = 10.0
PRE_TOKEN = re.compile(r"\n| *[^ \n]+| +")
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Pieces:
    """Scores and ids of the pieces by text, the ids of bytes, and the score of an unknown character."""

    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    unknown: float
    tails: dict[str, float | None] = field(repr=False, default_factory=dict)
    #: what a worker has made of the vocabulary
    tools: tuple | None = field(repr=False, default=None)

    @staticmethod
    def load(path: str = DEFAULT_MODEL, tails: bool = True) -> Pieces:
        """The vocabulary of a model file, with the ends of its pieces if they are asked for."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found, byte_ids = [], [0] * 256
        for i in range(model.vocab_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(text[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                found.append((-model.get_score(i), i, text.replace("▁", " ")))
        return Pieces.ranked([(text, i) for _, i, text in sorted(found)], byte_ids, tails)

    @staticmethod
    def ranked(pieces: list[tuple[str, int]], byte_ids: list[int], tails: bool = True) -> Pieces:
        """Pieces (text, id), most likely first."""
        for text, _ in pieces:
            if " " in text.lstrip(" ") or "\n" in text:
                raise ValueError(f"a piece with an inner space or a line break: {text!r}")
        total = math.log(sum(1 / (r + SHIFT) for r in range(1, len(pieces) + 1)))
        scores = {text: -math.log(r + SHIFT) - total for r, (text, _) in enumerate(pieces, 1)}
        out = Pieces(scores, dict(pieces), byte_ids, min(scores.values()) - UNKNOWN_BELOW)
        for text, score in scores.items() if tails else ():
            for k in range(1, len(text)):
                out.tails.setdefault(text[k:], None)
            out.tails[text] = score
        return out


def pre_tokens(text: str) -> list[str]:
    """The independent parts of a text; they join to the text with one space in front. An empty text has none."""
    return PRE_TOKEN.findall(" " + text) if text else []
