"""Exact de-duplication by counting quotient filters and byte verification.

Each partition builds one counting quotient filter per slice of the fingerprint range. Filters of
a slice merge losslessly, since each keeps its remainders sorted. Quotients that hold a fingerprint
counted more than once leave as one bit each; only texts on such a quotient are shuffled, and they
are compared byte by byte (grouped by the whole normalised text, copies collapsed before the
shuffle). A fingerprint collision therefore costs a comparison and never joins different texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import SPACE_CLASS, whole_text
from tallyspark.plans.shared import written

#: A slice of the fingerprint range is the unit of merging: about 2**22 fingerprints at most, so that the
#: filters of one slice and their merge take some 300 MB, whatever the input.
SLICE_ROWS_BITS = 22
#: The marks that are broadcast: one bit for each quotient, 1 MB at least and 32 MB at most.
MARK_BITS = (23, 28)


@dataclass(frozen=True)
class Slicing:
    """Fingerprints have 64 bits: `slice_bits` name the slice, those up to `mark_bits` the quotient that is
    marked, the rest of a slice's fingerprint is `rest_bits` long."""

    slice_bits: int
    mark_bits: int

    @property
    def rest_bits(self) -> int:
        return 64 - self.slice_bits

    @property
    def quotient_bits(self) -> int:
        return self.mark_bits - self.slice_bits

    @classmethod
    def of(cls, rows: int) -> Slicing:
        """For a number of rows: slices double with them, marks have eight bits a row up to their bound."""
        size = max(1, rows - 1).bit_length()
        mark_bits = min(MARK_BITS[1], max(MARK_BITS[0], size + 3))
        return cls(min(mark_bits - 3, max(10, size - SLICE_ROWS_BITS)), mark_bits)


class CountingQuotientFilter:
    """A lossless multiset of `bits`-wide fingerprints.

    The high `qbits` of a fingerprint are its quotient, the rest its remainder. `occupied` marks
    the quotients that occur, `run_ends` the last slot of each quotient's run, `remainders` holds
    the slots in sorted order within each run, and `counts` how often each was added.
    """

    def __init__(self, bits, qbits, occupied, run_ends, remainders, counts):
        self.bits, self.qbits = bits, qbits
        self.occupied, self.run_ends = occupied, run_ends
        self.remainders, self.counts = remainders, counts

    @classmethod
    def of(cls, sorted_values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From distinct sorted fingerprints; about one quotient for each of them."""
        qbits = max(1, int(np.ceil(np.log2(max(2, len(sorted_values))))))
        rest = np.uint64(bits - qbits)
        quotients = (sorted_values >> rest).astype(np.int64)
        occupied = np.zeros(1 << qbits, bool)
        occupied[quotients] = True
        run_ends = np.append(quotients[1:] != quotients[:-1], True)
        remainders = sorted_values & ((np.uint64(1) << rest) - np.uint64(1))
        return cls(bits, qbits, np.packbits(occupied), np.packbits(run_ends), remainders, counts)

    def values(self) -> np.ndarray:
        """The fingerprints, sorted."""
        n = len(self.remainders)
        ends = np.unpackbits(self.run_ends, count=n).astype(np.int64)
        runs = np.concatenate([[0], np.cumsum(ends)[:-1]])
        quotients = np.flatnonzero(np.unpackbits(self.occupied))[runs].astype(np.uint64)
        return (quotients << np.uint64(self.bits - self.qbits)) | self.remainders

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless: sorted remainders are merged, counts of equal ones added."""
        values = np.concatenate([f.values() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(values, kind="stable")  # runs of sorted input
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        return cls.of(values[first], np.add.reduceat(counts, first), filters[0].bits)

    def to_row(self) -> dict:
        return {
            "qbits": self.qbits,
            "occupied": self.occupied.tobytes(),
            "run_ends": self.run_ends.tobytes(),
            "remainders": self.remainders.astype("<u8").tobytes(),
            "counts": self.counts.astype("<i8").tobytes(),
        }

    @classmethod
    def from_row(cls, row: dict, bits: int) -> CountingQuotientFilter:
        return cls(
            bits,
            row["qbits"],
            np.frombuffer(row["occupied"], np.uint8),
            np.frombuffer(row["run_ends"], np.uint8),
            np.frombuffer(row["remainders"], "<u8"),
            np.frombuffer(row["counts"], "<i8"),
        )


_FILTER = pa.schema(
    [("slice", pa.int32()), ("qbits", pa.int32())]
    + [(n, pa.binary()) for n in ("occupied", "run_ends", "remainders", "counts")]
)
_FILTER_DDL = "slice int, qbits int, occupied binary, run_ends binary, remainders binary, counts binary"


def _partition_filters(cut: Slicing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(False).astype(np.int64) for b in batches]
        if not parts:
            return
        values, counts = np.unique(np.concatenate(parts).view(np.uint64), return_counts=True)
        slices = (values >> np.uint64(cut.rest_bits)).astype(np.int32)
        starts = np.flatnonzero(np.append(True, slices[1:] != slices[:-1])) if len(values) else []
        rest = (np.uint64(1) << np.uint64(cut.rest_bits)) - np.uint64(1)
        rows = []
        for a, b in zip(starts, [*starts[1:], len(values)]):
            made = CountingQuotientFilter.of(values[a:b] & rest, counts[a:b].astype(np.int64), cut.rest_bits)
            rows.append({"slice": int(slices[a]), **made.to_row()})
            if len(rows) == 256:
                yield pa.RecordBatch.from_pylist(rows, _FILTER)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FILTER)

    return run


_REPEATED = pa.schema([("slice", pa.int32()), ("bits", pa.binary()), ("n_repeated", pa.int64())])


def _merged_repeats(cut: Slicing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per slice (its rows arrive together): the quotients with a count above one."""
        rows = (row for batch in batches for row in batch.to_pylist())
        for slice_, group in groupby(rows, key=lambda r: r["slice"]):
            merged = CountingQuotientFilter.merge(
                [CountingQuotientFilter.from_row(r, cut.rest_bits) for r in group]
            )
            repeated = merged.values()[merged.counts > 1]
            if len(repeated):
                bits = np.zeros(1 << cut.quotient_bits, bool)
                bits[(repeated >> np.uint64(cut.rest_bits - cut.quotient_bits)).astype(np.int64)] = True
                yield pa.RecordBatch.from_pylist(
                    [{"slice": slice_, "bits": np.packbits(bits).tobytes(), "n_repeated": len(repeated)}],
                    _REPEATED,
                )

    return run


def repeated_quotients(fingerprints: DataFrame, column: str, cut: Slicing) -> DataFrame:
    """At most 2**slice_bits rows: `slice`, `bits` (its quotients that hold a repeated fingerprint)
    and `n_repeated`, from the filters of all partitions."""
    return (
        fingerprints.select(F.col(column).alias("_fp"))
        .mapInArrow(_partition_filters(cut), _FILTER_DDL)
        .repartition("slice")
        .sortWithinPartitions("slice")
        .mapInArrow(_merged_repeats(cut), "slice int, bits binary, n_repeated long")
    )


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS, "")


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cut: Slicing | None = None
) -> DataFrame:
    """One row per given row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space; a null text is empty, and
    empty texts are a group like any other. Of equal texts the one with the most code points stays,
    then the smallest id; null ids come last. Rows that repeat an id with an equal text count in the group's size and share the verdict
    of their id. Other columns are not looked at.

    `cut` follows from the number of rows unless given. Past some 30 million repeated texts the marks
    reach their bound and fill up: more texts that have no copy are then shuffled and compared, the
    result is the same.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("_text"))
    keyed = rows.select(
        "doc_id", F.length("_text").alias("_n"), normalised(F.col("_text")).alias("_norm")
    )
    digests = written(
        keyed.select("doc_id", F.sha2("_norm", 256).alias("_sha"), F.xxhash64("_norm").alias("_fp")),
        "exact-digests",
    )
    cut = cut or Slicing.of(digests.count())
    repeats = written(repeated_quotients(digests, "_fp", cut), "exact-repeats")
    quotient = F.shiftrightunsigned("_fp", 64 - cut.mark_bits).bitwiseAND((1 << cut.quotient_bits) - 1)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(quotient, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    bit = F.expr("shiftright(cast(_byte as int), 7 - cast(_quotient & 7 as int)) & 1") == 1
    # At most 2**mark_bits bits, so 32 MB, whatever the input: a bounded broadcast.
    suspects = (
        keyed.withColumn("_fp", F.xxhash64("_norm"))
        .withColumn("_slice", F.shiftrightunsigned("_fp", cut.rest_bits).cast("int"))
        .join(F.broadcast(repeats), F.col("_slice") == F.col("slice"))
        .withColumn("_quotient", quotient)
        .withColumn("_byte", byte)
        .filter(bit)
    )
    place = F.struct(
        (-F.col("_n")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")
    )
    groups = (
        suspects.groupBy("_norm")  # the bytes themselves: this is the verification
        .agg(F.count(F.lit(1)).alias("_size"), F.min(place).alias("_best"))
        .filter("_size > 1")
        .select(F.sha2("_norm", 256).alias("_sha"), "_size", F.col("_best.c").alias("_keep"))
    )
    return digests.join(groups, "_sha", "left").select(
        "doc_id",
        F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_size").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
