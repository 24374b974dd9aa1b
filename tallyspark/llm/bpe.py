"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts texts into chunks wherever its low bits are zero, so equal
passages give equal chunks whatever surrounds them. Texts travel to the task of their smallest
chunk hash, which brings copies and near copies together; a task encodes each distinct chunk once.

Cuts fall anywhere, also inside a word. A join is therefore repaired: the text around it is encoded
anew, widened to white space on both sides. This vocabulary drops white space, so there both sides
agree with the stored ids whatever follows, and the result equals the encoding of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import only, text_batches
from tallyspark.llm.memo import Memo, PieceEncoder, tokenizer

#: Chunks have 2**CHUNK_BITS bytes on average.
CHUNK_BITS = 9
#: Bytes of chunk texts and ids a worker keeps for reuse; beyond it the store starts anew.
CHUNK_STORE = 16 << 20
_SPACES = b" \t\n\r\x0b\x0c"
_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks (the last is the end of the data) and the rolling hashes at them.

    The hash covers the 16 bytes before a cut; a cut inside a character is left out."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):  # doubles the window
        wide = h.copy()
        wide[step:] += h[:-step] << np.uint32(step)
        h = wide
    at = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    at = at[(at < len(raw))]
    at = at[(raw[at] & 0xC0) != 0x80]
    ends = np.append(at, len(raw))
    return ends, h[ends - 1]


def routing_key(text: str) -> int:
    """The smallest chunk hash of a text: the same for copies, and likely for near copies."""
    data = text.encode("utf-8", "replace")
    ends, _ = cuts(data)
    start, least = 0, 1 << 63
    for end in ends.tolist():
        least = min(least, int.from_bytes(hashlib.blake2b(data[start:end], digest_size=8).digest(), "little") >> 1)
        start = end
    return least & ((1 << 63) - 1)


class ChunkEncoder:
    """Encodes whole texts; equal to the tokenizer on each of them."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces: list[bytes] = [b""] * (max(pieces.values()) + 1)
        for piece, i in pieces.items():
            self.pieces[i] = piece.encode()
        self.width = "<u2" if len(self.pieces) <= 1 << 16 else "<u4"
        self.words = Memo(PieceEncoder(self.tokenizer, self.width))
        self.chunks: dict[bytes, tuple[bytes, bytes, bytes] | None] = {}
        self.held = 0

    def _chunk(self, chunk: bytes) -> tuple[bytes, bytes, bytes] | None:
        """(what precedes the first white space, ids in between, what follows the last one), or
        None without white space."""
        words = chunk.split()
        if not words or (len(words) == 1 and len(words[0]) == len(chunk)):
            return None if words else (b"", b"", b"")
        head = words.pop(0) if chunk[0] not in _SPACES else b""
        tail = words.pop() if words and chunk[-1] not in _SPACES else b""
        return head, b"".join(map(self.words.young.__getitem__, words)), tail

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        data = [t.encode("utf-8", "replace") for t in texts]
        chunked = []
        for d in data:
            ends, _ = cuts(d)
            starts = [0, *ends[:-1].tolist()] if len(ends) else []
            chunked.append([d[a:b] for a, b in zip(starts, ends.tolist())])
        new = {c for own in chunked for c in own if c not in self.chunks}
        self.words.learn({w for c in new for w in c.split()})
        if self.held > CHUNK_STORE:
            self.chunks.clear()
            self.held = 0
            new = {c for own in chunked for c in own}
            self.words.learn({w for c in new for w in c.split()})
        for c in new:
            self.chunks[c] = made = self._chunk(c)
            self.held += len(c) + 200 + (len(made[1]) if made else 0)
        # Joins: a word that crosses a cut is put together again, then encoded as a whole.
        parts, joined = [], set()
        for own in chunked:
            out, open_ = [], b""
            for c in own:
                made = self.chunks[c]
                if made is None:
                    open_ += c
                    continue
                head, ids, tail = made
                out.append((open_ + head, ids))
                joined.add(open_ + head)
                open_ = tail
            out.append((open_, b""))
            joined.add(open_)
            parts.append(out)
        joined.discard(b"")
        self.words.learn(joined)
        known = self.words.young
        known[b""] = b""
        return [np.frombuffer(b"".join(x for word, ids in out for x in (known[word], ids)), self.width) for out in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """As the tokenizer's decode: this one has no decoder, so its pieces are joined by spaces."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        return b" ".join(map(self.pieces.__getitem__, ids.tolist()))


@cache
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def routed(docs: DataFrame) -> DataFrame:
    """doc_id and text, with similar texts in one task. Rebalancing splits a task that gets too
    much, such as a group of copies; each part then encodes the shared chunks once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield pa.record_batch(
                {**only(batch, "doc_id", "text"), "_route": pa.array([routing_key(t) for t in texts], pa.int64())}
            )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string, _route long").hint("rebalance", "_route").drop("_route")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per given row: doc_id, ids (of the whole text), decoded.

    A null or empty text has no ids and decodes to an empty text. Special tokens written in a text
    are found as the tokenizer finds them. Repeated rows each get a row; other columns are not
    looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch, texts in text_batches(batches):
            found = own.encode(texts)
            yield pa.record_batch(
                {
                    **only(batch, "doc_id"),
                    "ids": pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())),
                    "decoded": pa.array([own.decode(x).decode() for x in found], pa.string()),
                }
            )

    rows = routed(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """What `encode_documents` gives, reduced in the same task to doc_id, n_tokens, ids_sha256 (ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch, texts in text_batches(batches):
            found = own.encode(texts)
            yield pa.record_batch(
                {
                    **only(batch, "doc_id"),
                    "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4")).hexdigest() for x in found]),
                    "decoded_sha256": pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in found]),
                }
            )

    rows = routed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
