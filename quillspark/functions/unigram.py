"""Unigram tokenizer: normalisation, verbatim tokens, best-path segmentation, encoding."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

MARK = "▁"
# Fixed value: characters that end a word besides white space; next line is a control character here.
_BLANKS = re.compile("[^\\S\x85\x1c-\x1f]+|[​‌‍﻿]+")


def normalize(text: str) -> str:
    """NFKC, runs of blanks as one, control characters dropped, word marker in front and for every blank.

    Blanks at the start vanish, one at the end stays; only the empty text gives nothing.
    """
    text = unicodedata.normalize("NFKC", text)
    if not text:
        return ""
    spaced = re.sub(" +", " ", _BLANKS.sub(" ", text))
    kept = "".join(c for c in spaced if c == " " or unicodedata.category(c) != "Cc")
    kept = re.sub(" +", " ", kept).removeprefix(" ")
    return MARK + kept.replace(" ", MARK)


@dataclass
class Unigram:
    """Pieces with (id, score). ``added`` are tokens matched verbatim before anything else, longest first."""

    pieces: dict[str, tuple[int, float]]
    unk: int = 0
    bos: int = 1
    eos: int = 2
    added: dict[str, int] = field(default_factory=dict)
    penalty: float | None = None

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        if self.penalty is None:
            self.penalty = min((s for _, s in self.pieces.values()), default=0.0) - 10
        words = sorted((w for w in self.added if w), key=lambda w: (-len(w), w))
        self.cut = re.compile("(" + "|".join(map(re.escape, words)) + ")") if words else None

    def segment(self, s: str) -> list[int]:
        """Ids of the best path through normalised text; an unknown piece only where no piece starts.

        Every position takes the best way into it; of equally good ones that with the longest last piece.
        """
        total, token, back = [0.0], [-1], [0]  # score of the best way into a position, its last piece, where that begins
        for end in range(1, len(s) + 1):
            ways = [
                (total[begin] + piece[1], -begin, piece[0])
                for begin in range(max(0, end - self.longest), end)
                if (piece := self.pieces.get(s[begin:end]))
            ]
            if not self._starts_piece(s, end - 1):
                ways.append((total[end - 1] + self.penalty, 1 - end, self.unk))
            score, begin, found = max(ways, default=(-math.inf, 1 - end, self.unk))
            total.append(score)
            back.append(-begin)
            token.append(found)
        out, at = [], len(s)
        while at > 0:
            out.append(token[at])
            at = back[at]
        return out[::-1]

    def _starts_piece(self, s: str, at: int) -> bool:
        return any(s[at : at + n] in self.pieces for n in range(1, self.longest + 1))

    def tokens(self, text: str) -> list[int]:
        if not self.cut:
            return self.segment(normalize(text))
        out: list[int] = []
        for part in self.cut.split(text):
            out += [self.added[part]] if part in self.added else self.segment(normalize(part))
        return out

    def encode(self, text: str, most: int = 512) -> list[int]:
        """Begin and end tokens around at most ``most - 2`` pieces."""
        return [self.bos, *self.tokens(text)[: max(most - 2, 0)], self.eos]
