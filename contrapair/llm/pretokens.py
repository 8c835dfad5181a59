"""Splitting texts into pre-tokens and special tokens, as byte-level tokenizers do."""

from __future__ import annotations

from itertools import pairwise

import regex

# The published split pattern of the byte-level vocabulary. Blanks are spelled out by property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


#: A blank, then a space.
BLANK_PAIRS = tuple(chr(c) + " " for c in range(0x3001) if regex.match(r"\p{White_Space}", chr(c)))


class Splitter:
    """Cuts a text into pre-tokens; the strings of special tokens stay whole."""

    def __init__(self, specials: tuple[str, ...] = ()):
        self.find = regex.compile(SPLIT).findall
        self.specials = frozenset(specials)
        longest_first = sorted(self.specials, key=lambda s: (-len(s), s))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if specials else None

    def __call__(self, text: str) -> list[str]:
        if self.cut is None:
            return self.find(text)
        parts = self.cut(text)
        if len(parts) == 1:
            return self.find(text)
        out: list[str] = []
        for i, part in enumerate(parts):  # odd places hold the special tokens
            out += [part] if i % 2 else self.find(part)
        return out

    def cuts_at_spaces(self, text: str) -> bool:
        """Whether pre-tokens never cross a space of the text, which then belongs to what stands after it.

        A run of blanks is only cut differently by the pattern where a space follows another blank, or where a special
        token stands; such texts are left to the pattern.
        """
        return not any(pair in text for pair in BLANK_PAIRS) and not any(s in text for s in self.specials)

    def segments(self, text: str) -> list[str] | None:
        """The text cut at its spaces, without them, if pre-tokens never cross the cuts; else None."""
        return text.split(" ") if self.cuts_at_spaces(text) else None

    def pieces(self, segments: list[str]) -> list[list[str]]:
        """The pre-tokens of each segment, given with the one space it has, in front: all in one pass of the pattern.

        A blank at a segment's end would look at the space after it, so such a segment is cut by itself.
        """
        alone = [s[-1].isspace() for s in segments]
        words = self.find("".join([s for s, a in zip(segments, alone, strict=True) if not a]))
        starts = [i for i, w in enumerate(words) if w[0] == " "]
        cut = (words[a:b] for a, b in pairwise([*starts, len(words)]))
        return [self.find(s) if a else next(cut) for s, a in zip(segments, alone, strict=True)]
