"""Token-id files: documents' ids, coded in blocks, in ascending id order.

The files are a Parquet dataset. A row is one block: its part (ascending ranges of doc_id) and
number, the documents that have ids in it, the coded ids and their checksum. Blocks decode alone,
so reading is a narrow pass; documents that cross blocks are joined by combining checksums or, for
the ids themselves, by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import idcoder
from tallyspark.llm.common import text_batches
from tallyspark.llm.memo import Memo, PieceEncoder, tokenizer

END_ID = 0
#: Pieces that the vocabulary's own splitting never joins: a word with the space before it, or
#: white space. Only valid without the characters below.
_PIECE = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: Code points of other white space. Texts with one of them, or with the start of a special token,
#: are encoded in one go.
_SPACES = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WHOLE = re.compile("[" + "".join(map(chr, _SPACES)) + r"]|<\|")


class TextEncoder:
    """The ids of whole texts, as the tokenizer gives them, by way of a memo of pieces."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("the id files hold ids below 65,536")
        self.pieces = Memo(PieceEncoder(self.tokenizer, "<u2"))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [None if _WHOLE.search(t) else _PIECE.findall(t.encode("utf-8", "replace")) for t in texts]
        self.pieces.learn({p for own in split if own for p in own})
        known = self.pieces.young
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u2")
            if own is None
            else np.frombuffer(b"".join(map(known.__getitem__, own)), "<u2")
            for t, own in zip(texts, split)
        ]


@cache
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


_DOCS = [("doc_no", pa.int64()), ("doc_id", None), ("begin", pa.int64()), ("n", pa.int32())]


def _schema(kind: pa.DataType) -> pa.Schema:
    docs = pa.list_(pa.struct([(n, kind if t is None else t) for n, t in _DOCS]))
    return pa.schema(
        [("part", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int32()), ("crc", pa.int64()), ("payload", pa.binary()), ("docs", docs)]
    )


def _coded(group: list[tuple[int, np.ndarray, list]], part: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    payloads = idcoder.encode([ids for _, ids, _ in group])
    for a in range(0, len(group), 256):
        yield pa.RecordBatch.from_pylist(
            [
                {"part": part, "block": block, "n_ids": len(ids), "crc": idcoder.checksum(ids), "payload": payload, "docs": docs}
                for (block, ids, docs), payload in zip(group[a : a + 256], payloads[a : a + 256])
            ],
            schema,
        )


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Write the ids of every whole text, each followed by `end_id`, in ascending doc_id order.

    A null text is empty and has its end id only; null ids come first, rows that repeat an id follow
    each other, ordered by a hash of the text. An empty table writes no block. Other columns are not
    looked at."""
    rows = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    # Rows that repeat an id may fall into two parts: the tie column is part of the range.
    sorted_rows = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = text_encoder(tokenizer_path), TaskContext.get().partitionId()
        schema, group = None, []
        block, doc_no, at = 0, 0, 0
        pieces: list[np.ndarray] = []  # of the open block
        held, inside = 0, []
        for batch, texts in text_batches(batches):
            ids_column = batch.column(batch.schema.get_field_index("doc_id"))
            schema = schema or _schema(ids_column.type)
            for doc_id, found in zip(ids_column.to_pylist(), own.encode(texts)):
                left, begin = np.append(found, np.uint16(end_id)), at
                at += len(left)
                while len(left):
                    now = left[: idcoder.BLOCK - held]
                    left = left[len(now) :]
                    pieces.append(now)
                    held += len(now)
                    inside.append({"doc_no": doc_no, "doc_id": doc_id, "begin": begin, "n": len(now)})
                    if held == idcoder.BLOCK:
                        group.append((block, np.concatenate(pieces), inside))
                        block, pieces, held, inside = block + 1, [], 0, []
                        if len(group) == idcoder.LANES:
                            yield from _coded(group, part, schema)
                            group = []
                doc_no += 1
        if held:
            group.append((block, np.concatenate(pieces), inside))
        if group:
            yield from _coded(group, part, schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = (
        "part int, block long, n_ids int, crc long, payload binary, "
        f"docs array<struct<doc_no:bigint,doc_id:{kind},begin:bigint,n:int>>"
    )
    sorted_rows.mapInArrow(run, ddl).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """(row, ids) of every block; a block that does not match its checksum is an error."""
    for batch in batches:
        for a in range(0, batch.num_rows, idcoder.LANES):
            rows = batch.slice(a, idcoder.LANES).to_pylist()
            ids = idcoder.decode([r["payload"] for r in rows], [r["n_ids"] for r in rows])
            for r, own in zip(rows, ids):
                if idcoder.checksum(own) != r["crc"]:
                    raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
                yield r, own


def _segments(files: DataFrame, with_ids: bool) -> DataFrame:
    """part, doc_no, doc_id, begin, block, n and crc (or ids) of each document's run in a block."""
    kind = files.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, docs_type = [], batch.schema.field("docs").type.value_type.field("doc_id").type
            for r, ids in _decoded([batch]):
                at = 0
                for d in r["docs"]:
                    own = ids[at : at + d["n"]]
                    at += d["n"]
                    value = own.astype("<u2").tobytes() if with_ids else idcoder.checksum(own)
                    out.append((r["part"], d["doc_no"], d["doc_id"], d["begin"], r["block"], d["n"], value))
            if out:
                part, no, doc, begin, block, n, value = zip(*out)
                yield pa.record_batch(
                    {
                        "part": pa.array(part, pa.int32()), "doc_no": pa.array(no, pa.int64()),
                        "doc_id": pa.array(doc, docs_type), "begin": pa.array(begin, pa.int64()),
                        "block": pa.array(block, pa.int64()), "n": pa.array(n, pa.int32()),
                        "value": pa.array(value, pa.binary() if with_ids else pa.int64()),
                    }
                )

    value = "binary" if with_ids else "long"
    return files.mapInArrow(run, f"part int, doc_no long, doc_id {kind}, begin long, block long, n int, value {value}")


def _parts(files: DataFrame) -> DataFrame:
    """part and the ids before it; one row for each partition that was written."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    return totals.select("part", F.coalesce(F.sum("_n").over(order), F.lit(0).cast("long")).alias("_before"))


def _joined(files: DataFrame, with_ids: bool) -> DataFrame:
    """doc_id, start, n_tokens and value (the document's ids, or their CRC-32). A document's runs
    meet in one task in block order; what is shuffled is a checksum for each run, or its ids."""
    segments = _segments(files, with_ids)
    kind = segments.schema["doc_id"].dataType.simpleString()
    value_type, value_ddl = (pa.list_(pa.int32()), "array<int>") if with_ids else (pa.int64(), "long")

    def value_of(runs: list[tuple]) -> int | np.ndarray:
        if with_ids:
            return np.concatenate([np.frombuffer(r[-1], "<u2") for r in runs]).astype(np.int32)
        crc = runs[0][-1]
        for r in runs[1:]:
            crc = idcoder.joined_checksum(crc, r[-1], r[-2])
        return crc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        doc_type = None

        def flush() -> pa.RecordBatch:
            kinds = {"part": pa.int32(), "doc_id": doc_type, "begin": pa.int64(), "n_tokens": pa.int64(), "value": value_type}
            return pa.record_batch({name: pa.array(x, t) for (name, t), x in zip(kinds.items(), zip(*out))})

        def rows():
            nonlocal doc_type
            for batch in batches:
                doc_type = batch.schema.field("doc_id").type
                yield from zip(*[c.to_pylist() for c in batch.columns])

        for (part, _), own in groupby(rows(), key=lambda r: (r[0], r[1])):
            own = list(own)  # the runs of one document
            out.append((part, own[0][2], own[0][3], sum(r[5] for r in own), value_of(own)))
            if len(out) == 4096:
                yield flush()
                out = []
        if out:
            yield flush()

    joined = (
        segments.repartition("part", "doc_no").sortWithinPartitions("part", "doc_no", "block")
        .mapInArrow(run, f"part int, doc_id {kind}, begin long, n_tokens long, value {value_ddl}")
    )
    return joined.join(_parts(files), "part").select(
        "doc_id", (F.col("begin") + F.col("_before")).alias("start"), "n_tokens", "value"
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, from the files."""
    return _joined(spark.read.parquet(path), True).withColumnRenamed("value", "ids")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (CRC-32 of the document's ids as little-endian unsigned
    32-bit integers), from the files."""
    return _joined(spark.read.parquet(path), False).withColumnRenamed("value", "ids_crc32")
