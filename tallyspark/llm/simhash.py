"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint carries a vector m(i) of radius + 1 bits; mask v keeps the bits whose vector
has an odd inner product with v. Any `radius` differing bits span a space of at most `radius`
dimensions, so some non-zero v is orthogonal to all of them: under that mask the two fingerprints
are equal. Every pair within the radius therefore meets in at least one of the 2**(radius + 1) - 1
tables, with no probability involved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import marked, only, split_by_marks, text_batches
from tallyspark.llm.graph import components
from tallyspark.plans.shared import written

#: Runs of one table value up to this many fingerprints are compared pair by pair; longer ones
#: are first merged by one-bit wildcards, and only what is still apart is compared.
SHORT_RUN = 64
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles, as an unsigned integer; 0 without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        return xxhash.xxh64_intdigest(joined, seed)  # one shingle: its own bits
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64
    )
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE_OFFSETS
    counts = np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").tobytes(), "little")


_BYTE_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and `fp` (signed 64 bits) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.record_batch({**only(batch, "doc_id"), "fp": pa.array(fps.view(np.int64))})

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """The 2**(radius + 1) - 1 masks; the non-zero vectors are dealt to the bits in turn, so each
    mask keeps about half of them."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n + 1)
    ]


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest reachable index of each of n items."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(root, high, low)
            while not np.array_equal(root, up := root[root]):
                root = up
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
    return root


def _wildcard_pairs(values: np.ndarray, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for bit in free:  # different values that agree on all other bits are one bit apart
        order = np.argsort(values & ~np.uint64(1 << bit), kind="stable")
        key = (values & ~np.uint64(1 << bit))[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        yield order[same], order[same + 1]


def _long_run_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links of one large table value, without its pairs.

    One-bit wildcards merge dense neighbourhoods in linear passes; then every item is compared, a
    block at a time, with the items that are not yet in its component. Exact for any size."""
    n = len(values)
    differing = int(np.bitwise_or.reduce(values ^ values[0]))
    free = [i for i in range(64) if differing >> i & 1]
    made: list[tuple[np.ndarray, np.ndarray]] = list(_wildcard_pairs(values, free)) if radius else []
    root = _roots(n, iter(made))
    order = np.argsort(root, kind="stable")
    values_o, root_o = values[order], root[order]
    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        block = slice(a, min(n, a + step))
        # Sorted by component: what lies behind the block's first component is another one.
        tail = np.searchsorted(root_o, root_o[a], "right")
        if tail >= n:
            break
        hit = _near(values_o[block, None], values_o[None, tail:], radius)
        hit &= root_o[block, None] != root_o[None, tail:]
        i, j = np.nonzero(hit)
        if len(i):
            # one link for each pair of components is enough
            ri, rj = root_o[block][i], root_o[tail:][j]
            _, first = np.unique(ri * np.int64(n) + rj, return_index=True)
            made.append((order[block][i[first]], order[tail:][j[first]]))
    root = _roots(n, iter(made))
    apart = np.flatnonzero(root != np.arange(n))
    return apart, root[apart]


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each table value; rows (table, key, fp) arrive sorted, so that a value's rows
    follow each other. Equal fingerprints don't occur."""
    tables, keys, fps = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64))

    def links(tables, keys, fps):
        out_a, out_b = [], []
        n = len(fps)
        change = np.flatnonzero((tables[1:] != tables[:-1]) | (keys[1:] != keys[:-1])) + 1
        starts = np.concatenate([[0], change])
        sizes = np.diff(np.append(starts, n))
        size_at = np.repeat(sizes, sizes)
        run = np.repeat(np.arange(len(starts)), sizes)
        short = size_at <= SHORT_RUN
        for d in range(1, min(SHORT_RUN, int(sizes.max(initial=0)))):
            i = np.flatnonzero((run[:-d] == run[d:]) & short[:-d])
            if not len(i):
                break
            i = i[_near(fps[i], fps[i + d], radius)]
            out_a.append(fps[i])
            out_b.append(fps[i + d])
        for k in np.flatnonzero(sizes > SHORT_RUN):
            own = fps[starts[k] : starts[k] + sizes[k]]
            a, b = _long_run_links(own, radius)
            out_a.append(own[a])
            out_b.append(own[b])
        if out_a and sum(map(len, out_a)):
            a, b = (np.concatenate(x).view(np.int64) for x in (out_a, out_b))
            yield pa.record_batch({"u": pa.array(np.maximum(a, b)), "v": pa.array(np.minimum(a, b))})

    for batch in batches:
        t, k, f = (batch.column(i).to_numpy(False) for i in range(3))
        tables, keys = np.concatenate([tables, t]), np.concatenate([keys, k])
        fps = np.concatenate([fps, f.view(np.uint64)])
        # The last value may go on in the next batch.
        whole = np.flatnonzero((tables != tables[-1]) | (keys != keys[-1])) if len(tables) else []
        if len(whole):
            cut = whole[-1] + 1
            yield from links(tables[:cut], keys[:cut], fps[:cut])
            tables, keys, fps = tables[cut:], keys[cut:], fps[cut:]
    if len(fps):
        yield from links(tables, keys, fps)


def near_links(distinct_fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (u, v) between different fingerprints that keep every pair within the radius connected.
    `distinct_fps` has one column `fp` without repeats."""
    tables = F.array(
        *[
            F.struct(
                F.lit(i).cast("int").alias("table"),
                F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("key"),
            )
            for i, m in enumerate(masks(radius))
        ]
    )
    dealt = distinct_fps.select(F.explode(tables).alias("t"), "fp").select("t.table", "t.key", "fp")
    return (
        dealt.repartition("table", "key")
        .sortWithinPartitions("table", "key")
        .mapInArrow(lambda b: bucket_links(b, radius), "u long, v long")
    )


def simhash_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per given row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    reachable over links of at most `radius` differing bits).

    A null text is empty; without a word the fingerprint is zero and links like any other. Rows that
    repeat an id each get a row. Null ids take part but are never a component's id unless all of it
    is null. Other columns are not looked at.
    """
    rows = written(fingerprints(docs, shingle, id_column, text_column), "simhash-fps")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("_least")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp"), radius))
    labelled = nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("_root")), "fp", "left").select(
        "fp", "_least", F.coalesce("_root", "fp").alias("_root")
    )
    heads = labelled.groupBy("_root").agg(F.min("_least").alias("component_id"))
    by_fp = labelled.join(heads, "_root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def simhash_dedup(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of `docs` that stay: of each component the one with the smallest doc_id (all rows of
    that id, should it repeat). Rows with a null id always stay. All columns are kept; only texts
    that may go are shuffled."""
    groups = simhash_groups(docs, radius, shingle)
    gone = written(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "simhash-gone")
    marks = written(marked(gone, F.xxhash64("_gone")), "simhash-gone-marks")
    rows = docs.select(F.col("doc_id").alias("_id"), F.struct(*docs.columns).alias("_row"))
    sure, unsure = split_by_marks(rows, F.xxhash64("_id"), marks)
    kept = unsure.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return sure.select("_row.*").unionByName(kept.select("_row.*"))
