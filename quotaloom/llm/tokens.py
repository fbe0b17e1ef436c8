"""Byte-level BPE files: cutting texts into chunks that tokenise independently, and remembered results per chunk."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from .common import slices


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b if b in plain else 256 + rest.index(b)) for b in range(256)]


def alone(word: str) -> bool:
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


class Chunks:
    """Values of texts put together from values of their chunks.

    A single space or line break between two other characters always starts a new pre-token (the space belongs to
    what follows; the line break stands alone), so what lies between can be tokenised once and remembered.
    Texts with other white space, or with a special token's string, go to ``whole`` as they are.
    ``encode`` maps new chunks to values.  At most ``limit`` chunks are remembered.
    """

    def __init__(self, encode: Callable[[list[str]], list], whole: Callable[[str], object], special: Sequence[str], limit: int = 400_000):
        self.encode, self.whole, self.special, self.limit = encode, whole, special, limit
        self.heads: dict[str, object] = {}  # at the start of a line
        self.tails: dict[str, object] = {}  # after a space
        self.newline = encode(["\n"])[0]

    def values(self, texts: Sequence[str]) -> list[list | object]:
        """For each text a list of the values of its chunks in order, or what ``whole`` gives."""
        out: list = []
        for lo, hi in slices(texts):
            out += self._some(texts[lo:hi])
        return out

    def _some(self, texts: Sequence[str]) -> list:
        if len(self.heads) + len(self.tails) > self.limit:
            self.heads.clear()
            self.tails.clear()
        heads, tails = self.heads, self.tails
        cut = [None if any(s in t for s in self.special) else [line.split(" ") for line in t.split("\n")] if t else [] for t in texts]
        new_heads, new_tails = set(), set()
        for lines in cut:
            for words in lines or ():
                new_heads.add(words[0])
                new_tails.update(words[1:])
        for known, new, lead in ((heads, new_heads, ""), (tails, new_tails, " ")):
            new = [w for w in new if w not in known]
            known.update((w, None) for w in new if not alone(w))
            new = [w for w in new if alone(w)]
            known.update(zip(new, self.encode([lead + w for w in new])))
        out = []
        for text, lines in zip(texts, cut):
            values: list | None = None
            if lines is not None:
                values = []
                for words in lines:
                    values.append(heads[words[0]])
                    values += map(tails.__getitem__, words[1:])
                    values.append(self.newline)
                if values:
                    values.pop()
            out.append(self.whole(text) if values is None or None in values else values)
        return out
