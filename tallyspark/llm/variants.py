"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

A replaced letter takes one from a letter's count and adds one to another's, an inserted or deleted
letter changes one count by one: words one edit apart are at most two apart in the sum of absolute
differences. Words of each length are the points of a k-d tree over their letter counts. A range
search walks down a tree with all its words at once and leaves a branch as soon as the box behind it
needs more than one letter less or one letter more than a word has; words of equal length may need
one of each, the words of the next length exactly one less. What a leaf and its visitors still have
in common is checked letter by letter.

The upper levels of every tree are cut once, from a bounded sample, until a leaf stands for about
`CELL` words. Each such cell is worked on by itself: its words travel there once, and every word that
may have a near word in it visits it. A pair of equal length meets only in the cell of the greater
number, so each pair is found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import only, text_batches
from tallyspark.plans.shared import written

#: Words in a cell, about, and words in the sample that the cells are cut from.
CELL, SAMPLE = 1024, 40_000
#: Words in a leaf of a cell's own tree.
LEAF = 48
#: Counted words a worker holds before it hands them on.
HELD_WORDS = 100_000
#: Letters of words as bytes of ISO 8859-1, and their places in a count vector.
_LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_PLACE = np.zeros(256, np.int64)
_PLACE[_LETTERS] = np.arange(len(_LETTERS))
DIMS = len(_LETTERS)
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # A-Z are lower-cased before; U+00C0 to U+00FF in UTF-8


def damaged(word: bytes, doc_id: bytes) -> bytes:
    """The word, or for one in 97 (by checksum) the word without one letter."""
    h = zlib.crc32(word, zlib.crc32(doc_id + b":"))
    if h % 97:
        return word
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame, change: Callable[[bytes, bytes], bytes] = lambda word, doc_id: word) -> DataFrame:
    """word, n: how often each run of letters occurs in all texts, A-Z lower-cased, after `change`
    (of a word and its doc_id as text, both UTF-8). Counted inside tasks before anything is shuffled,
    so a word with a third of all occurrences is one row of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array([w.decode() for w in held], pa.string()), "n": pa.array(held.values(), pa.int64())})

        for batch, texts in text_batches(batches):
            ids = only(batch, "doc_id")["doc_id"].to_pylist()
            for doc_id, text in zip(ids, texts):
                own = b"" if doc_id is None else str(doc_id).encode()
                for word, n in Counter(_RUN.findall(text.encode().lower())).items():
                    held[change(word, own)] += n
                if len(held) > HELD_WORDS:
                    yield handed()
                    held.clear()
        yield handed()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """Letter counts, one row a word; counts over 255 stand as 255, which never takes words apart."""
    n = len(letters)
    spots = (np.arange(n)[:, None] * DIMS + _PLACE[letters]).ravel()
    return np.minimum(np.bincount(spots, minlength=n * DIMS).reshape(n, DIMS), 255).astype(np.int16)


def parities(counts: np.ndarray) -> np.ndarray:
    """Which letters occur an odd number of times, as 64 bits: never more bits apart than counts."""
    bits = np.uint64(1) << (np.arange(DIMS, dtype=np.uint64) % np.uint64(64))
    return np.bitwise_xor.reduce((counts & 1).astype(np.uint64) * bits, axis=1)


class Tree:
    """A k-d tree over count vectors. A node is (dimension, greatest count of the left side, left,
    right), a leaf its number."""

    def __init__(self, points: np.ndarray, most: float):
        self.leaves: list[np.ndarray] = []
        self.root = self._cut(points, np.arange(len(points)), max(1.0, most))

    def _cut(self, points: np.ndarray, own: np.ndarray, most: float):
        if len(own) > most:
            here = points[own]
            middle = np.median(here, axis=0).astype(np.int16)
            best = None
            for cut in (middle, middle - 1):  # the median may be the greatest count
                left = (here <= cut).sum(axis=0)
                lean = np.abs(2 * left - len(own))
                lean[(left == 0) | (left == len(own))] = len(own) + 1
                d = int(lean.argmin())
                if lean[d] <= len(own) and (best is None or lean[d] < best[0]):
                    best = (lean[d], d, int(cut[d]))
            if best:
                _, d, cut = best
                low = here[:, d] <= cut
                return (d, cut, self._cut(points, own[low], most), self._cut(points, own[~low], most))
        self.leaves.append(own)
        return len(self.leaves) - 1

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)

        def walk(node, own):
            if not len(own):
                return
            if isinstance(node, int):
                out[own] = node
                return
            d, cut, left, right = node
            low = points[own, d] <= cut
            walk(left, own[low])
            walk(right, own[~low])

        walk(self.root, np.arange(len(points)))
        return out

    def search(self, queries: np.ndarray, less: int, more: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries that may have a point in its box): points with at most `less` letters of
        the query missing and at most `more` added."""
        low, high = np.full(DIMS, -1, np.int64), np.full(DIMS, 1 << 20, np.int64)  # box: low < count <= high

        def walk(node, own, gone, new):
            if not len(own):
                return
            if isinstance(node, int):
                yield node, own
                return
            d, cut, left, right = node
            q = queries[own, d].astype(np.int64)
            off = gone - np.maximum(q - high[d], 0) + np.maximum(q - cut, 0)
            fits = off <= less
            before, high[d] = high[d], min(high[d], cut)
            yield from walk(left, own[fits], off[fits], new[fits])
            high[d] = before
            on = new - np.maximum(low[d] + 1 - q, 0) + np.maximum(cut + 1 - q, 0)
            fits = on <= more
            before, low[d] = low[d], max(low[d], cut)
            yield from walk(right, own[fits], gone[fits], on[fits])
            low[d] = before

        none = np.zeros(len(queries), np.int64)
        yield from walk(self.root, np.arange(len(queries)), none, none)


def one_edit(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Whether each query (rows of bytes) is one replaced letter from its point of equal length, or
    one deleted letter from its point one shorter."""
    length = points.shape[1]
    off = queries[:, :length] != points
    if queries.shape[1] == length:
        return off.sum(axis=1) == 1
    same_behind = np.cumprod((queries[:, 1:] == points)[:, ::-1], axis=1).sum(axis=1)
    same_before = np.cumprod(~off, axis=1).sum(axis=1)
    return same_before + same_behind >= length


class Cell:
    """The words of one cell (sorted), and what near words its visitors and itself have been."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, np.array(n, np.int64)
        self.letters = letters_of(words)
        self.points = counts_of(self.letters)
        self.tree = Tree(self.points, LEAF)
        self.parities = parities(self.points)
        self.near = np.zeros(len(words), np.int64)
        self.best: list[tuple[int, str] | None] = [None] * len(words)  # (-n, word): least is best

    def pairs(self, queries: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) for all near pairs."""
        equal = letters.shape[1] == self.letters.shape[1]
        odd = parities(queries)
        out_q, out_p = [], []
        for leaf, own in self.tree.search(queries, 1, int(equal)):
            held = self.tree.leaves[leaf]
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                i, j = np.nonzero(np.bitwise_count(odd[part, None] ^ self.parities[held]) <= 1 + equal)
                i, j = part[i], held[j]
                close = np.abs(queries[i] - self.points[j]).sum(axis=1) <= 1 + equal
                i, j = i[close], j[close]
                near = one_edit(letters[i], self.letters[j])
                out_q.append(i[near])
                out_p.append(j[near])
        if not out_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_q), np.concatenate(out_p)

    def _note(self, own: np.ndarray, words: list[str], n: np.ndarray, other: np.ndarray) -> None:
        """Points `own` have near words `other` (numbers into sorted words)."""
        order = np.lexsort((other, -n[other], own))
        owner, first, count = np.unique(own[order], return_index=True, return_counts=True)
        for p, at, k in zip(owner.tolist(), first.tolist(), count.tolist()):
            o = int(other[order[at]])
            found = (-int(n[o]), words[o])
            self.near[p] += k
            if self.best[p] is None or found < self.best[p]:
                self.best[p] = found

    def meet_itself(self) -> None:
        q, p = self.pairs(self.points, self.letters)  # both orders of every pair are found
        self._note(p, self.words, self.n, q)

    def meet(self, words: list[str], n: list[int]) -> pa.RecordBatch:
        """Near words of sorted visitors, of one length."""
        letters = letters_of(words)
        q, p = self.pairs(counts_of(letters), letters)
        n = np.array(n, np.int64)
        self._note(p, words, n, q)
        order = np.lexsort((p, -self.n[p], q))
        owner, first, count = np.unique(q[order], return_index=True, return_counts=True)
        best = p[order[first]]
        return _found([words[i] for i in owner], count, self.n[best], [self.words[i] for i in best])

    def result(self) -> pa.RecordBatch:
        own = np.flatnonzero(self.near)
        best = [self.best[i] for i in own]
        return _found([self.words[i] for i in own], self.near[own], [-b[0] for b in best], [b[1] for b in best])


_FOUND = "word string, k long, best_n long, best string"


def _found(words, near, best_n, best) -> pa.RecordBatch:
    return pa.record_batch(
        {"word": pa.array(words, pa.string()), "k": pa.array(near, pa.int64()), "best_n": pa.array(best_n, pa.int64()), "best": pa.array(best, pa.string())}
    )


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        yield length, np.flatnonzero(lengths == length)


#: A cell's number is its words' length times this, and the leaf.
_CELLS = 1 << 24


def cut_cells(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict[int, Tree]:
    """The upper levels of the trees, by length, from at most `sample` words (those of least hash).
    A length that the sample misses is one cell. At most `sample` leaves, whatever the input."""
    total = words.count()
    rows = words.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).collect()
    picked = [r["word"] for r in rows]
    share = len(picked) / max(1, total)
    return {
        length: Tree(counts_of(letters_of([picked[i] for i in own])), cell * share) for length, own in _by_length(picked)
    }


def _routed(batches: Iterator[pa.RecordBatch], cells: dict[int, Tree]) -> Iterator[pa.RecordBatch]:
    one = Tree(np.empty((0, DIMS), np.int16), 1)
    for batch in batches:
        for start in range(0, len(batch), 4096):
            part = batch.slice(start, 4096)
            words = part.column(0).to_pylist()
            rows, cell, kind = [], [], []

            def add(own, number, k):
                rows.append(own)
                cell.append(np.broadcast_to(number, own.shape))
                kind.append(np.full(len(own), k, np.int32))

            for length, own in _by_length(words):
                counts = counts_of(letters_of([words[i] for i in own]))
                tree = cells.get(length, one)
                home = tree.home(counts)
                add(own, length * _CELLS + home, 0)
                for leaf, found in tree.search(counts, 1, 1):
                    later = found[home[found] < leaf]
                    add(own[later], length * _CELLS + leaf, 1)
                for leaf, found in cells.get(length - 1, one).search(counts, 1, 0):
                    add(own[found], (length - 1) * _CELLS + leaf, 2)
            take = pa.array(np.concatenate(rows))
            yield pa.record_batch(
                {"cell": pa.array(np.concatenate(cell)), "kind": pa.array(np.concatenate(kind)), "word": part.column(0).take(take), "n": part.column(1).take(take)}
            )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, kind, word, n) arrive sorted: a cell's own words, then its visitors."""
    number, held_words, held_n = None, [], []
    open_: Cell | None = None

    def closed():
        nonlocal open_
        cell = open_
        if cell is None and held_words:
            cell = Cell([*held_words], held_n)
            cell.meet_itself()
        held_words.clear()
        held_n.clear()
        open_ = None
        return cell

    for batch in batches:
        cells, kinds, n = (batch.column(i).to_numpy(False) for i in (0, 1, 3))
        words = batch.column(2).to_pylist()
        edges = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(words)]):
            if a == b:
                continue
            if cells[a] != number:
                if (done := closed()) is not None:
                    yield done.result()
                number = cells[a]
            if kinds[a] == 0:
                held_words += words[a:b]
                held_n += n[a:b].tolist()
            elif held_words or open_:  # visitors of a cell without words of its own find nothing
                if open_ is None:
                    open_ = Cell([*held_words], [*held_n])
                    open_.meet_itself()
                yield open_.meet(words[a:b], n[a:b])
    if (done := closed()) is not None:
        yield done.result()


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, n_near, best_n, best: how many words of the table are one edit away, and the one of
    them with the largest n (ties: the smallest word). Words without any have no row. `words` has
    word (at least one letter, no repeats) and n."""
    cells = cut_cells(words, cell, sample)
    dealt = words.select("word", "n").mapInArrow(lambda b: _routed(b, cells), "cell long, kind int, word string, n long")
    found = dealt.repartition("cell").sortWithinPartitions("cell", "kind", "word").mapInArrow(_met, _FOUND)
    return found.groupBy("word").agg(
        F.sum("k").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("_b")
    ).select("word", "n_near", (-F.col("_b.n")).alias("best_n"), F.col("_b.best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root), root being the last word that forms lead to. Every round halves
    the way that is left and is a written table; a form has twice its word's n, so rounds are few."""
    now = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = now.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        step = now.join(on, F.col("root") == F.col("_at"), "left")
        step = written(step.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")), "variant-roots")
        now = step.select("word", "root")
        if not step.filter("_moved").limit(1).count():
            return now


def spelling_variants(words: DataFrame, factor: int = 2, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of `words` (word, n), a table without
    repeats or null words, letters a-z and U+00C0 to U+00FF.

    form is the near word with the largest n (ties: the smallest in code-point order) if that is at
    least `factor` times the word's n, else null; root the last word that forms lead to, or the word
    itself. Empty words have no near words. An empty table gives an empty one.
    """
    kept = written(words.select("word", "n"), "variant-words")
    near = near_words(kept.filter("word <> ''"), cell, sample)
    judged = kept.join(near, "word", "left").withColumn("_form", F.col("best_n") >= factor * F.col("n"))
    judged = written(
        judged.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("_form"), F.col("best")).alias("form"), F.when(F.col("_form"), F.col("best_n")).alias("form_n"),
        ),
        "variant-forms",
    )
    roots = last_forms(judged.filter("form IS NOT NULL").select("word", "form"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def document_words(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """word, n of the texts' words after `damaged`, of at least the given length and number.

    A null text has no words, a null id counts as empty. Repeated rows count again; other columns
    are not looked at."""
    counted = word_counts(docs, damaged)
    return counted.filter((F.length("word") >= least_length) & (F.col("n") >= least_n))
