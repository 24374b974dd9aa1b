"""The whole language query, fitted and predicted again letter by letter in plain Python."""

import math
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as contract
from llm_fixtures import docs_of  # noqa: F401
from conftest import SMALL
from tallyspark.llm import langid
from tallyspark.llm.common import documents

MASK = 0xFFFFFFFF


def _folded(c):
    low = c.lower()
    return ord(low) if ord(c) < 0x10000 and len(low) == 1 else ord(c)


def _feature(before, here, after):
    h = (before * 0x9E3779B1 & MASK) ^ (here * 0x85EBCA77 & MASK) ^ (after * 0xC2B2AE3D & MASK)
    h ^= h >> 15
    return (h * 0x2C1B3C6D & MASK) >> (32 - langid.FEATURE_BITS)


def _script(c):
    return langid.SCRIPT_STARTS[bisect_right([s for s, _ in langid.SCRIPT_STARTS], ord(c)) - 1][1]


def _words(text):
    """(script, features) of each run of letters."""
    words, run = [], []
    for c in [*(text or ""), " "]:
        if c.isalpha():
            run.append(c)
        elif run:
            points = [0, *map(_folded, run), 0]
            words.append((_script(run[0]), [_feature(*points[i : i + 3]) for i in range(len(run))]))
            run = []
    return words


def _fit(rows):
    counts, letters = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        for script, features in _words(text):
            counts[lang].update(features)
            letters[lang][script] += len(features)
    languages = sorted(counts)
    size = 1 << langid.FEATURE_BITS
    total = {x: sum(counts[x].values()) + 0.5 * size for x in languages}
    least = {x: langid.SCRIPT_SHARE * max(1, sum(letters[x].values())) for x in languages}

    def allowed(script):
        found = [letters[x][script] >= least[x] for x in languages]
        return found if any(found) else [True] * len(languages)

    def score(feature, lang):
        return math.log((counts[lang][feature] + 0.5) / total[lang])

    return languages, allowed, score


def _predict(text, model):
    """The best labelling of the words by dynamic programming, then the language with most letters."""
    languages, allowed, score = model
    words = _words(text)
    if not words or not languages:
        return "und", 0.0
    value, back = None, []
    for script, features in words:
        own = [sum(score(f, x) for f in features) if ok else -1e6 for x, ok in zip(languages, allowed(script))]
        if value is None:
            value = own
            continue
        best = max(range(len(value)), key=lambda k: (value[k], -k))
        jump = value[best] - langid.SWITCH_PENALTY
        back.append([best if jump > v else k for k, v in enumerate(value)])
        value = [max(v, jump) + s for v, s in zip(value, own)]
    here = max(range(len(value)), key=lambda k: (value[k], -k))
    labels = [here]
    for step in reversed(back):
        here = step[here]
        labels.append(here)
    letters = Counter()
    for (_, features), label in zip(words, reversed(labels)):
        letters[label] += len(features)
    best = min(letters, key=lambda k: (-letters[k], k))
    return languages[best], letters[best] / sum(letters.values())


def _held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def test_whole_query_equals_plain_python(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in documents(spark, SMALL).collect()]
    assert len(rows) < langid.SAMPLE_DOCUMENTS  # so that the model is fitted on all of the fold
    model = _fit([(t, x) for d, t, x in rows if not _held_out(d) and t is not None and x is not None])
    got = {r.doc_id: r for r in contract.queries()["op9_language_id"](spark, SMALL).collect()}
    assert len(got) == len(rows) and len(model[0]) > 1
    for doc_id, text, _ in rows:
        name, share = _predict(text, model)
        found = got[doc_id]
        assert (found.held_out, found.lang_pred) == (_held_out(doc_id), name)
        assert found.score == pytest.approx(share, abs=1e-12)


def test_mixed_and_odd_texts_equal_plain_python(docs_of):
    train = [("the and that with this have", "en"), ("und nicht eine mit auf für", "de"), ("это что как для они", "ru")] * 5
    texts = [
        None, "", " \n", "123 --", "a", "İstanbul ǅ ß", "the und это that nicht что", "das ist mit the that with und eine",
        "日本 the", "это " * 40 + "the and that " * 40 + "und eine mit " * 40, "x" * 5000, "thé é", "\U00010400 the",
    ]
    model = _fit(train)
    fitted = langid.train(docs_of([(i, *r, "s") for i, r in enumerate(train)]))
    assert fitted.languages == model[0]
    got = {r.doc_id: r for r in langid.identify(docs_of(texts), fitted).collect()}
    for i, text in enumerate(texts):
        name, share = _predict(text, model)
        assert got[i].lang_pred == name and got[i].score == pytest.approx(share, abs=1e-12), text
