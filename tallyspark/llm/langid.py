"""Language identification with spans.

A word is a run of letters. The script of its first letter narrows the candidate languages, every
letter adds the log probability of the trigram around it, and a Viterbi pass over a text's words
labels them, paying a penalty for each switch of language. All steps are array operations over a
batch of texts; the Viterbi pass advances all texts of a batch one word at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import only, text_batches

#: Hashed trigrams; the model is this many numbers for each language.
FEATURE_BITS = 14
#: Labelled documents the model is fitted on, at most (rows that repeat an id count once).
SAMPLE_DOCUMENTS = 4_000
#: Cost of one switch of language, in nats.
SWITCH_PENALTY = 12.0
#: Share of a language's letters from which it counts as written in a script.
SCRIPT_SHARE = 0.01
UNDECIDED = "und"
#: Texts handled at once, in bytes; arrays over letters are built this many letters at a time.
_BATCH, _SLICE = 2 << 20, 1 << 19

# First code points of Unicode ranges and the script of each.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"),
    (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_STARTS))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, its lower-case form, its script."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = np.arange(len(letter), dtype=np.uint32)
    for i in np.flatnonzero(letter[:0x10000]).tolist():
        if len(low := chr(i).lower()) == 1:
            lower[i] = ord(low)
    starts = np.array([s for s, _ in SCRIPT_STARTS])
    ids = np.array([SCRIPTS.index(n) for _, n in SCRIPT_STARTS], np.int8)
    return letter, lower, ids[np.searchsorted(starts, np.arange(len(letter)), "right") - 1]


@dataclass
class Words:
    """The words of some texts, in order: first and last code point (exclusive) within the joined
    text, the number of the text, the script, and a score for each language if there is a model."""

    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    script: np.ndarray
    offsets: np.ndarray
    scores: np.ndarray | None
    counts: np.ndarray | None


def words_of(texts: list[str], table: np.ndarray | None) -> Words:
    """`table` (features x languages) gives scores; without one, features are counted."""
    letter_of, lower_of, script_of = _tables()
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    letters = np.zeros(len(points) + 2, bool)
    letters[1:-1] = letter_of[points]
    begin = np.flatnonzero(letters[1:-1] & ~letters[:-2])
    end = np.flatnonzero(letters[1:-1] & ~letters[2:]) + 1
    text = np.searchsorted(ends, begin, "right")
    offsets = np.searchsorted(text, np.arange(len(texts) + 1))
    scores = None if table is None else np.zeros((len(begin), table.shape[1]), np.float32)
    counts = np.zeros(1 << FEATURE_BITS, np.int64) if table is None else None
    for a in range(0, len(points), _SLICE):
        b = min(len(points), a + _SLICE)
        low, high = max(0, a - 1), min(len(points), b + 1)
        folded = np.zeros(b - a + 2, np.uint32)
        own = letters[low + 1 : high + 1]
        folded[low - a + 1 : high - a + 1] = np.where(own, lower_of[points[low:high]], 0)
        h = folded[:-2] * np.uint32(0x9E3779B1) ^ folded[1:-1] * np.uint32(0x85EBCA77)
        h ^= folded[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        at = np.flatnonzero(letters[a + 1 : b + 1])
        if not len(at):
            continue
        features = (h[at] >> np.uint32(32 - FEATURE_BITS)).astype(np.int64)
        if table is None:
            counts += np.bincount(features, minlength=len(counts))
            continue
        word = np.searchsorted(begin, at + a, "right") - 1
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        scores[word[first]] += np.add.reduceat(table[features], first)  # a word may span two slices
    return Words(begin, end, text, script_of[points[begin]] if len(begin) else np.empty(0, np.int8), offsets, scores, counts)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # features x languages, log probabilities
    allowed: np.ndarray  # scripts x languages


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts of each language, and below -1 the letters of each script."""
    total: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch, texts in text_batches(batches, limit=_BATCH):
        langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
        for lang in sorted(set(langs)):
            w = words_of([t for t, x in zip(texts, langs) if x == lang], None)
            total[lang] = total.get(lang, 0) + w.counts
            scripts[lang] = scripts.get(lang, 0) + np.bincount(
                w.script, weights=w.end - w.begin, minlength=len(SCRIPTS)
            ).astype(np.int64)
    for lang in total:
        f, s = np.flatnonzero(total[lang]), np.flatnonzero(scripts[lang])
        yield pa.record_batch(
            {
                "lang": pa.array([lang] * (len(f) + len(s)), pa.string()),
                "feature": pa.array(np.concatenate([f, -1 - s]).astype(np.int32)),
                "n": pa.array(np.concatenate([total[lang][f], scripts[lang][s]])),
            }
        )


def train(docs: DataFrame, fold: Column | None = None, sample_documents: int = SAMPLE_DOCUMENTS) -> Model:
    """Fit on the labelled documents of `fold` (all without one) whose hashed ids are smallest, at
    most `sample_documents` of them, whole texts. What reaches the driver is one number for each
    feature and language."""
    rows = docs.select("doc_id", "text", "lang", (F.lit(True) if fold is None else fold).alias("_fold"))
    rows = rows.filter("_fold AND lang IS NOT NULL AND text IS NOT NULL")
    ids = (
        rows.select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_documents)
    )
    # At most `sample_documents` ids: a bounded broadcast.
    sample = rows.join(F.broadcast(ids), "doc_id", "left_semi").select("text", "lang")
    counts = (
        sample.mapInArrow(_count_features, "lang string, feature int, n long")
        .groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    )
    languages = sorted({r["lang"] for r in counts})
    table = np.full((1 << FEATURE_BITS, len(languages)), 0.5)
    scripts = np.zeros((len(SCRIPTS), len(languages)))
    for r in counts:
        k = languages.index(r["lang"])
        if r["feature"] >= 0:
            table[r["feature"], k] += r["n"]
        else:
            scripts[-1 - r["feature"], k] = r["n"]
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0))
    allowed[~allowed.any(1)] = True  # an unseen script narrows nothing
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32), allowed)


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of each text's words: the sum of their scores less `penalty` for each switch.
    Ties stay with the present language, then go to the first one."""
    n_words, k = scores.shape
    kind = np.int8 if k <= 128 else np.int32  # holds every language's number
    labels = np.zeros(n_words, kind)
    starts, lengths = offsets[:-1], np.diff(offsets)
    full = np.flatnonzero(lengths)
    if not len(full):
        return labels
    # A path with a switch scores at most the sum of the best scores less one penalty.
    at = starts[full]
    single = np.add.reduceat(scores.astype(np.float64), at)
    bound = np.add.reduceat(scores.max(1).astype(np.float64), at) - penalty
    sure = single.max(1) >= bound
    labels[:] = np.repeat(single.argmax(1), lengths[full]).astype(kind)
    todo = full[~sure]
    if not len(todo):
        return labels
    todo = todo[np.argsort(-lengths[todo], kind="stable")]
    begin, length = starts[todo], lengths[todo]
    state = np.zeros((len(todo), k), np.float64)
    switched, source = np.zeros((n_words, k), bool), np.zeros(n_words, kind)
    lanes = np.arange(len(todo))
    steps = int(length[min(7, len(todo) - 1)]) if len(todo) >= 8 else 0  # fewer texts go one by one
    active = [int(x) for x in np.searchsorted(-length, -np.arange(steps), "left")]
    for t in range(steps):
        m = active[t]
        at = begin[:m] + t
        if t == 0:
            state[:m] = scores[at]
            continue
        now = state[:m]
        best = now.argmax(1)
        jump = now[lanes[:m], best] - penalty
        take = jump[:, None] > now
        switched[at], source[at] = take, best
        state[:m] = np.where(take, jump[:, None], now) + scores[at]
    final = state.argmax(1)
    for lane in np.flatnonzero(length > steps).tolist():
        a, b = int(begin[lane]) + steps, int(begin[lane] + length[lane])
        rows = scores[a:b].tolist()
        now, first = ([0.0] * k, steps == 0) if steps == 0 else (state[lane].tolist(), False)
        moves = []
        for row in rows:
            if first:
                now, first = row, False
                moves.append((0, 0))
                continue
            top = max(now)
            jump, mask = top - penalty, 0
            best = now.index(top)
            for j in range(k):
                if jump > now[j]:
                    now[j] = jump
                    mask |= 1 << j
                now[j] += row[j]
            moves.append((mask, best))
        here = now.index(max(now))
        back = []
        for mask, best in reversed(moves):
            back.append(here)
            if mask >> here & 1:
                here = best
        labels[a:b] = back[::-1]
        final[lane] = here
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        here = final[:m]
        labels[at] = here
        if t:
            final[:m] = np.where(switched[at, here], source[at], here)
    return labels


SCHEMA = "lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def predict(texts: list[str], model: Model, penalty: float = SWITCH_PENALTY) -> tuple[list, list, list]:
    n, k = len(texts), len(model.languages)
    names, share, spans = [UNDECIDED] * n, [0.0] * n, [[] for _ in range(n)]
    if not k:
        return names, share, spans
    w = words_of(texts, model.table)
    if not len(w.begin):
        return names, share, spans
    w.scores[~model.allowed[w.script]] = -1e6
    labels = viterbi(w.scores, w.offsets, penalty)
    letters = np.zeros((n, k))
    np.add.at(letters, (w.text, labels), w.end - w.begin)
    best, total = letters.argmax(1), letters.sum(1)
    for i in np.flatnonzero(total).tolist():
        names[i], share[i] = model.languages[best[i]], float(letters[i, best[i]] / total[i])
    first = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (w.text[1:] != w.text[:-1])))
    last = np.append(first[1:], len(labels)) - 1
    origin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    for a, b in zip(first.tolist(), last.tolist()):
        i = int(w.text[a])
        spans[i].append(
            {"start": int(w.begin[a] - origin[i]), "end": int(w.end[b] - origin[i]), "lang": model.languages[labels[a]]}
        )
    return names, share, spans


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """One row per given row: doc_id, lang_pred, score (the share of letters labelled lang_pred) and
    spans (code points, end exclusive).

    A null, empty or letterless text is `und` with score 0 and no spans, and so is every text if no
    labelled document was given. Ties go to the first language by name. Only the text is looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, limit=_BATCH):
            names, share, spans = predict(texts, model, penalty)
            yield pa.record_batch(
                {
                    **only(batch, "doc_id"),
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(share, pa.float64()),
                    "spans": pa.array(spans, _SPAN),
                }
            )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def keep_identified(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of `docs` whose text has a language, in the given columns, with `lang` set to it; the
    others are rejected: null, empty and letterless texts, and all of them if the model has no language.
    Every row is judged for itself, so repeated rows stay or go together; ties go to the first language by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, limit=_BATCH):
            names, _, _ = predict(texts, model, penalty)
            at = batch.schema.get_field_index("lang")
            found = batch.set_column(at, batch.schema.field(at), pa.array(names, batch.schema.field(at).type))
            yield found.filter(pa.array([n != UNDECIDED for n in names]))

    return docs.mapInArrow(run, docs.schema)
