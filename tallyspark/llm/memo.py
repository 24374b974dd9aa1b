"""Encodings of words, kept within a bounded memory."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from struct import pack

import numpy as np

#: Words in each of the two generations that a worker keeps.
GENERATION = 120_000


def tokenizer(path: str):
    """A tokenizer of the given file, without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class Memo:
    """word -> packed ids. When a generation is full it becomes the old one, and the former old one
    goes: frequent words stay, memory is bounded, and any word can be encoded again."""

    def __init__(self, encode: Callable[[list[bytes]], Iterable[bytes]], size: int = GENERATION):
        self.encode, self.size = encode, size
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: Iterable[bytes]) -> None:
        """Make every given word known; call before `young` is read for them."""
        young, old = self.young, self.old
        missing = [w for w in words if w not in young]
        if len(young) + len(missing) > self.size:
            self.old, self.young = {**young}, {}
            young, old = self.young, self.old
            missing = list(words)
        unseen = []
        for w in missing:
            if (ids := old.get(w)) is None:
                unseen.append(w)
            else:
                young[w] = ids
        for a in range(0, len(unseen), 4096):
            part = unseen[a : a + 4096]
            young.update(zip(part, self.encode(part)))


#: Letters of the Latin alphabet, perhaps behind a space, with punctuation behind them: every
#: vocabulary here splits such a piece after its letters, and never inside them.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
_PROBES = ("Probe", "ÀÉß", "straße,", "the.", " Über", " a!!", "xqzzk###")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a character: itself if it is printable, else the next
    one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceEncoder:
    """Packed ids of pieces, as the tokenizer gives them for each.

    Plain pieces go to the tokenizer's model directly, which skips the work on offsets that nobody
    reads here. Whether that gives the same ids is tried on a few words first; else, and for all
    other pieces, the whole tokenizer runs."""

    def __init__(self, made, width: str):
        self.tokenizer, self.model, self.width = made, made.model, width
        self.code = {"<u2": "H", "<u4": "I"}[width]
        self.letters = _byte_letters()
        self.marks: dict[str, bytes] = {"": b""}
        self.lower: bool | None = None
        whole = self._whole([*_PROBES])
        for lower in (False, True):
            spaced = [p for p in _PROBES if not lower or p[0] != " "]
            if [self._plain(p, lower) for p in spaced] == [w for p, w in zip(_PROBES, whole) if p in spaced]:
                self.lower = lower
                break

    def _whole(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(pieces, add_special_tokens=False)
        return [np.array(f.ids, self.width).tobytes() for f in found]

    def _plain(self, piece: str, lower: bool) -> bytes | None:
        if not (match := _PLAIN.fullmatch(piece)) or (lower and piece[0] == " "):
            return None
        word, mark = match.groups()
        if (behind := self.marks.get(mark)) is None:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            behind = self.marks[mark] = self._whole([mark])[0]
        if lower:
            word = word.lower()
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return pack(f"<{len(tokens)}{self.code}", *[t.id for t in tokens]) + behind

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        texts = [p.decode() for p in pieces]
        if self.lower is None:
            return self._whole(texts)
        out = [self._plain(t, self.lower) for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._whole([texts[i] for i in rest]) if rest else ()):
            out[i] = ids
        return out
