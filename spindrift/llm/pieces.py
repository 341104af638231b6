"""A unigram vocabulary from the file of a public piece tokenizer, and its matcher."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import ahocorasick

SPACE = "▁"
#: What an unknown character scores below the lowest piece, as in the public unigram tokenizers.
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces of the file with log probabilities by Zipf's law over their order in the file.

    The file ranks pieces by merges; rank r (from 1) has probability 1 / (r * H). Byte and control pieces
    have the probability of the last rank.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        alphabet = set("".join(self.pieces))
        #: A character of no piece, to stand for a literal U+2581 of a text.
        self.stand_in = next(chr(c) for c in range(0xE000, 0xF900) if chr(c) not in alphabet)
        total = math.log(sum(1 / r for r in range(1, len(self.normal) + 1)))
        self.lowest = -math.log(len(self.normal)) - total
        self.scores = [self.lowest] * n
        for rank, i in enumerate(self.normal, 1):
            self.scores[i] = -math.log(rank) - total

    def matcher(self, ids: list[int] | None = None, value: Callable[[int], object] | None = None) -> ahocorasick.Automaton:
        """Matches of pieces: (length, id, score), or a value of one's own, by the place of their last character."""
        found = ahocorasick.Automaton()
        for i in range(len(self.pieces)) if ids is None else ids:
            found.add_word(self.pieces[i], value(i) if value else (len(self.pieces[i]), i, self.scores[i]))
        found.make_automaton()
        return found


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
