"""Exact SentencePiece BPE encoding by backtracking, and decoding.

The library merges the adjacent pair of best score until no pair is a piece. The same ids are found
without merging a whole text: pieces are matched by an Aho-Corasick automaton, at every position the
longest match is tried first, and a match is taken only if merging it together with the piece before
it anew gives the same two pieces back. A sequence whose neighbours all agree in this way is what the
merges give, and any prefix has only one such sequence. A position from which no match leads on is
therefore marked as failed for good, in a bitfield, and the piece before it is taken back: every
position fails at most once, so work grows linearly with the text.

A text is cut in front of its runs of white space if no piece of the vocabulary reaches across such
a place, and around characters that no piece holds, which become byte pieces. Cuts are exact, and
what lies between them is kept for reuse.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tallyspark.llm.common import only, text_batches
from tallyspark.llm.memo import Memo

#: What the library writes for a space.
SPACE = "▁"
#: Verdicts on pairs of pieces that a worker keeps; beyond it the store starts anew.
PAIR_STORE = 400_000
#: Letters and marks that are cut apart if no piece holds such a letter in front of such a mark.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?)\"'-"
#: Stretches in each of the two generations that a worker keeps; some 200 bytes each.
GENERATION = 250_000
#: Longer stretches between two cuts are encoded each time, so that the store of stretches stays small.
LONGEST_KEPT = 200


class PieceCodec:
    """Encodes and decodes whole texts as the library does with the given model."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.vocab_size()
        self.width, self.code = ("<u2", "H") if size <= 1 << 16 else ("<u4", "I")
        self.names = [self.library.id_to_piece(i) for i in range(size)]
        plain = [
            i for i in range(size)
            if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))
        ]
        self.score = {self.names[i]: self.library.get_score(i) for i in plain}
        self.id = {self.names[i]: i for i in plain}
        self.alphabet = {c for name in self.score for c in name}
        self.byte = {int(self.names[i][1:-1], 16): i for i in range(size) if self.library.is_byte(i)}
        # A piece that its own characters don't merge to never comes out of merges.
        sound = {name for name in self.score if len(name) == 1 or self.merged(list(name)) == [name]}
        self.automaton = ahocorasick.Automaton()
        for name in sound:
            self.automaton.add_word(name, self.id[name])
        self.automaton.make_automaton()
        self.sizes = list(map(len, self.names))
        #: The next shorter piece that a piece starts with, or -1.
        self.shorter = [next((self.id[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in sound), -1) for name in self.names]
        self.pairs: dict[int, bool] = {}  # by left * size + right
        self.stretches = re.compile(self._stretches(), re.DOTALL)
        self.memo = Memo(lambda found: [*map(self._packed, found)], GENERATION)
        self.texts = [self._text(i) for i in range(size)]

    def merged(self, symbols: list[str], fence: int = 0) -> list[str] | None:
        """The symbols after all merges, best score first, then leftmost. With a fence, None as soon
        as a merge would join the first `fence` code points to the rest."""
        symbols = list(symbols)
        score, lowest = self.score, float("-inf")
        while True:
            best, at = lowest, -1
            for i in range(len(symbols) - 1):
                found = score.get(symbols[i] + symbols[i + 1])
                if found is not None and (at < 0 or found > best):
                    best, at = found, i
            if at < 0:
                return symbols
            if fence and sum(map(len, symbols[: at + 1])) == fence:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _stretches(self) -> str:
        """Matches what lies between two cuts: white space with the characters behind it, less the
        marks behind a plain word, and line ends. Only where no piece reaches across."""
        if any(SPACE in name.lstrip(SPACE) for name in self.score):
            return ".+"
        joined = "\n".join(self.score)
        marks = "".join(re.escape(c) for c in _MARKS if not re.search(f"[{_LETTERS}]{re.escape(c)}", joined))
        line = "" if "\n" in self.alphabet else "\n"
        word = f"{SPACE}*[{_LETTERS}]+(?=[{marks}])|" if marks else ""
        return f"{word}{SPACE}*[^{SPACE}{line}]+|{SPACE}+|\n"

    def _agree(self, left: int, right: int) -> bool:
        """Whether merging both pieces together anew keeps them apart."""
        if len(self.pairs) >= PAIR_STORE:
            self.pairs.clear()
        names = self.names[left], self.names[right]
        known = self.pairs[left * len(self.names) + right] = self.merged([*names[0], *names[1]], len(names[0])) is not None
        return known

    def backtracked(self, text: str) -> list[int]:
        """The ids of a text of known characters."""
        longest, pairs, sizes, shorter = self.automaton.iter_long, self.pairs, self.sizes, self.shorter
        end_of_text, size = len(text), len(self.names)
        failed = bytearray((end_of_text >> 3) + 1)
        taken: list[int] = []
        at, matches = 0, longest(text)  # goes on behind each match as long as that is taken
        piece = next(matches)[1] if text else -1
        while at < end_of_text:
            first = piece
            while piece >= 0:
                to = at + sizes[piece]
                if not failed[to >> 3] >> (to & 7) & 1:
                    if not taken:
                        break
                    if (known := pairs.get(taken[-1] * size + piece)) or (known is None and self._agree(taken[-1], piece)):
                        break
                piece = shorter[piece]
            if piece >= 0:
                taken.append(piece)
                at = to
                if at < end_of_text:
                    if piece != first or matches is None:
                        matches = longest(text, at)
                    piece = next(matches)[1]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= sizes[piece]
                piece, matches = shorter[piece], None
        return taken

    def _packed(self, stretch: str) -> bytes:
        if self.alphabet.issuperset(stretch):
            ids = self.backtracked(stretch)
            return pack(f"<{len(ids)}{self.code}", *ids)
        ids, start = [], 0
        for i, c in enumerate(stretch):
            if c not in self.alphabet:
                ids += self.backtracked(stretch[start:i])
                start = i + 1
                ids += [self.byte[b] for b in c.encode()] if self.byte else [self.library.unk_id()]
        ids += self.backtracked(stretch[start:])
        return pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without begin and end ids."""
        cut = [self.stretches.findall(self.library.normalize(t)) for t in texts]
        if not self.byte:  # the library gives a run of unknown characters one id
            cut = [["".join(own)] if own else [] for own in cut]
        self.memo.learn({s for own in cut for s in own if len(s) <= LONGEST_KEPT})
        known, out = self.memo.young, []
        for own in cut:
            packed = b"".join([known[s] if s in known else self._packed(s) for s in own])
            ids = np.frombuffer(packed, self.width)
            if not self.byte and len(ids):
                unknown = ids == self.library.unk_id()
                ids = ids[~(unknown & np.concatenate([[False], unknown[:-1]]))]
            out.append(ids)
        return out

    def _text(self, i: int) -> bytes:
        if self.library.is_byte(i):
            return bytes([int(self.names[i][1:-1], 16)])
        if self.library.is_control(i):
            return b""
        if self.library.is_unknown(i):
            return self.library.decode([i]).encode()
        return self.names[i].replace(SPACE, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes: pieces are joined, and the space that encoding puts in front goes.
        Byte pieces that are no characters together, and control pieces, are left to the library."""
        own = ids.tolist()
        if not own:
            return ""
        if not all(map(self.texts.__getitem__, own)):
            return self.library.decode(own)
        data = b"".join(map(self.texts.__getitem__, own))
        first = self.names[own[0]]
        if first[0] == SPACE and self._drops_first:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self.library.decode(own)

    @property
    def _drops_first(self) -> bool:
        if not hasattr(self, "_drops"):
            some = next((n for n in self.score if n[0] == SPACE != n[-1]), None)
            self._drops = some is not None and not self.library.decode([self.id[some]]).startswith(" ")
        return self._drops


@cache
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per given row: doc_id, ids (of the whole text), decoded.

    A null or empty text has no ids and decodes to an empty text. Control pieces written in a text
    are ordinary text, as for the library. Repeated rows and null ids each get a row; other columns
    are not looked at. A narrow pass: nothing is shuffled, so no source or group of copies is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch, texts in text_batches(batches):
            found = own.encode(texts)
            yield pa.record_batch(
                {
                    **only(batch, "doc_id"),
                    "ids": pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())),
                    "decoded": pa.array([own.decode(x) for x in found], pa.string()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_kind(docs)}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """What `encode_documents` gives, reduced in the same task to doc_id, n_tokens, ids_sha256 (decimal
    ids joined by commas) and decoded_sha256 (UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch, texts in text_batches(batches):
            found = own.encode(texts)
            listed = [",".join(map(str, x.tolist())).encode() for x in found]
            yield pa.record_batch(
                {
                    **only(batch, "doc_id"),
                    "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in listed], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in found], pa.string()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {_kind(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
