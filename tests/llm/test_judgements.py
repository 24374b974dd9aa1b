"""Language, quality, personal data and mixing."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import ODD, docs_of, none, odd  # noqa: F401
from conftest import SMALL
from tallyspark.llm import langid, mixing, pii, rules
from tallyspark.llm.common import documents

WORDS = {"en": "the and that with this have from they".split(), "de": "und nicht eine mit auf für wird über".split(), "ru": "это что как для они был его все".split()}


def best_labels(scores, penalty):
    """Viterbi, one word at a time, over all label sequences of short texts."""
    n, k = scores.shape
    value, back = scores[0].astype(float), []
    for t in range(1, n):
        moves = value[:, None] - penalty * (1 - np.eye(k))
        back.append(moves.argmax(0))
        value = moves.max(0) + scores[t]
    return value.max()


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    lengths = [*rng.integers(0, 60, 40), 400, 0, 1]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(0, 3, (offsets[-1], 3)).astype(np.float32)
    for penalty in (0.0, 1.5, 6.0):
        labels = langid.viterbi(scores, offsets, penalty)
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b > a:
                own, s = labels[a:b], scores[a:b].astype(float)
                got = s[np.arange(b - a), own].sum() - penalty * (own[1:] != own[:-1]).sum()
                assert got == pytest.approx(best_labels(scores[a:b], penalty), abs=1e-3)


@pytest.fixture(scope="module")
def model(docs_of):
    random.seed(7)
    rows = [(i, " ".join(random.choices(WORDS[lang], k=40)), lang, "s") for i, lang in enumerate([*WORDS] * 30)]
    return langid.train(docs_of(rows))


def test_spans_of_mixed_text(docs_of, model):
    random.seed(8)
    parts = [(lang, " ".join(random.choices(WORDS[lang], k=15))) for lang in ("en", "ru", "de")]
    text = ". ".join(t for _, t in parts)
    row = langid.identify(docs_of([text]), model).first()
    assert [(s.lang, text[s.start : s.end]) for s in row.spans] == parts


def test_scripts_narrow(model):
    assert model.allowed[langid.SCRIPTS.index("cyrillic")].tolist() == [x == "ru" for x in model.languages]
    names, share, _ = langid.predict(["xqzzk", "жщъ", "12 34", ""], model)
    assert names[1] == "ru" and names[2:] == ["und", "und"] and share[2:] == [0.0, 0.0] and names[0] != "ru"


def test_slices_do_not_change_scores(model, monkeypatch):
    texts = ["the and " * 50, "это что", "", "über" * 20]
    want = langid.words_of(texts, model.table)
    monkeypatch.setattr(langid, "_SLICE", 7)
    got = langid.words_of(texts, model.table)
    assert np.allclose(got.scores, want.scores, atol=1e-3) and got.begin.tolist() == want.begin.tolist()


def test_held_out_accuracy(spark):
    import __spark_entry__ as contract

    rows = contract.queries()["op9_language_id"](spark, SMALL).filter("held_out").collect()
    given = {r.doc_id: r.lang for r in documents(spark, SMALL).collect()}
    judged = [(given[r.doc_id], r.lang_pred) for r in rows if given[r.doc_id]]
    assert len(judged) > 20 and np.mean([a == b for a, b in judged]) >= 0.95


def test_language_of_odd_rows(odd, none, model):
    got = langid.identify(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r, o in zip(sorted(got, key=repr), ODD) if not r.spans} == {"und"}
    assert langid.identify(none, model).collect() == []
    assert langid.train(none).languages == []
    assert {r.lang_pred for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.filter("lang = 'und'").count() == 0


def plain_measures(text):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    rows = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    windows, covered = defaultdict(list), set()
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    for at in windows.values():
        if len(at) > 1:
            covered |= {j for i in at for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(rows), len(rows) - len(set(rows)), len(covered))


def test_measures_match_brute_force(docs_of):
    random.seed(9)
    texts = [None, "", " \n", "a b c d e", "a " * 9, "x y z\n" * 4]
    texts += ["".join(random.choice(["a", "b", "é", "c#"]) + random.choice([" ", " ", "\n", "\t "]) for _ in range(random.randint(1, 120))) for _ in range(120)]
    got = sorted(rules.measured(docs_of(texts)).drop("_text").collect())
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")) for r in got] == [plain_measures(t) for t in texts]


def test_order_never_changes_the_verdict(spark):
    docs = documents(spark, SMALL)
    rows = rules.measured(docs)
    first = {r.doc_id: r.kept for r in rules.quality_rules(docs, rules.default_rules()).collect()}
    second = {r.doc_id: r.kept for r in rules.quality_rules(docs, rules.default_rules()[::-1], sample_rows=1).collect()}
    assert first == second
    plan = rules.ordered_rules(rows, rules.default_rules(), 50)
    assert sorted(r.name for r in plan) == sorted(r.name for r in rules.default_rules())


def test_a_rejected_row_reaches_no_later_rule(docs_of):
    docs = docs_of([None, "a b c", "a b c d e " * 4, " ".join(f"word{i}" for i in range(30)), "x " * 9])
    by_name = {r.name: r for r in rules.default_rules()}
    unreached = rules.Rule("unreached", F.when(F.length("_text") < 10, F.raise_error("reached").cast("boolean")).otherwise(False))
    got = rules.cascade(rules.texts(docs), [by_name["few_words"], unreached, by_name["repeated_words"], by_name["capitals"]])
    rows = sorted(got.collect())
    assert [r.rejected_by for r in rows] == ["few_words", "few_words", "repeated_words", None, "few_words"]
    assert [r.n_words for r in rows] == [0, 3, 20, 30, 9]
    assert [r.n_repeat_words for r in rows] == [None, None, 20, 0, None]  # looked at only if the row gets there
    assert [r.n_letters for r in rows] == [None, None, None, 120, None]


def test_verdicts_without_measures(spark, odd, none):
    docs = documents(spark, SMALL)
    lean = rules.quality_rules(docs, measures=False)
    assert lean.columns == ["doc_id", "kept", "rejected_by"]
    assert {r.doc_id: r.kept for r in lean.collect()} == {r.doc_id: r.kept for r in rules.quality_rules(docs).collect()}
    assert rules.quality_rules(odd, measures=False).count() == len(ODD)
    assert rules.quality_rules(none, measures=False).collect() == []


def test_rules_agree_with_labels(spark):
    docs = documents(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    judged = rules.quality_rules(docs).join(labels, "doc_id").collect()
    bad = [r for r in judged if not r.quality]
    good = [r for r in judged if r.quality and r.n_words >= 10 and 100 * r.n_repeat_words <= 20 * r.n_words]
    assert np.mean([not r.kept for r in bad]) >= 0.8 and np.mean([r.kept for r in good]) >= 0.98


def test_rules_on_odd_rows(odd, none):
    got = rules.quality_rules(odd).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got if r.n_words < 10)
    assert rules.quality_rules(none).collect() == []


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19
                and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]
            if fits():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_definitions(spark):
    random.seed(11)
    parts = ["a.b", "@", "x@y.zz", ".", "-", "+", "1", "255", "256.", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-111", "+1 (017) 555-7713", " ", "(", "é", "٣", "000"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(4000)]
    texts += [r.text or "" for r in documents(spark, SMALL).collect()]
    for text in texts:
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("a" * 200_000) == [] and pii.base_spans("1" * 100_000 + "+" * 1000) == []


def test_em_separates_reliable_labelers():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    flip = lambda p: np.where(rng.random(4000) < p, ~truth, truth) * 2 - 1
    votes = np.stack([flip(0.05), flip(0.1), flip(0.1), flip(0.5) * (rng.random(4000) < 0.5)], 1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, reliability = pii.estimate(patterns, counts.astype(float))
    assert np.mean((posterior[inverse.ravel()] > 0.5) == truth) > 0.95
    assert reliability[1, 0, 2] > 0.9 and abs(reliability[1, 3, 2] - reliability[0, 3, 2]) < 0.1


def test_looser_spans(docs_of):
    random.seed(12)
    words = lambda n: " ".join(random.choices(WORDS["en"], k=n))
    texts = [f"{words(8)} call {words(1)} +1 (201) 555-{i:04d} or mail joe{i}@mail.example.com {words(5)}" for i in range(60)]
    texts += [f"{words(8)} phone (201) 555-{i:04d} {words(6)}" for i in range(30)]
    texts += [f"{words(6)} order 2015-06-{i % 28:02d} page {i} version 1.2.{i} {words(6)}" for i in range(60)]
    got = {r.doc_id: r for r in pii.find_personal_data(docs_of(texts)).collect()}
    for i, text in enumerate(texts):
        base = [(s.start, pii.KINDS.index(s.kind), s.end) for s in got[i].base]
        assert base == plain_base(text) and set(got[i].base) <= set(got[i].spans)
    assert all(len(got[i].spans) == 2 for i in range(60)) and not any(got[i].spans for i in range(90, 150))
    hidden = {r.doc_id: r.text for r in pii.masked(docs_of(texts), pii.find_personal_data(docs_of(texts))).collect()}
    assert "[phone] or mail [email]" in hidden[0] and hidden[120] == texts[120]


def test_personal_data_of_odd_rows(odd, none):
    got = pii.find_personal_data(odd).collect()
    assert len(got) == len(ODD) and all(not r.base for r in got)
    assert pii.find_personal_data(none).collect() == []
    hidden = pii.masked(odd, pii.find_personal_data(odd)).collect()
    assert sorted(map(tuple, hidden), key=repr) == sorted([(r[0], r[1] or "") for r in ODD], key=repr)
    assert pii.masked(none, pii.find_personal_data(none)).collect() == []


def test_masking_loses_and_multiplies_no_row(docs_of):
    rows = [(None, "a@b.de or c"), (None, "no data"), (None, None), (7, "x 10.1.2.3 y"), (7, "x 10.1.2.3 y"), (7, "e@f.org"), (8, "plain")]
    want = [(None, "[email] or c"), (None, "no data"), (None, ""), (7, "x [ip] y"), (7, "x [ip] y"), (7, "[email]"), (8, "plain")]
    docs = docs_of(rows)
    got = pii.masked(docs, pii.find_personal_data(docs)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_shares_meet_their_targets(spark, docs_of):
    random.seed(13)
    rows = [(i, "w " * random.randint(1, 60), "en", random.choice(["a", "a", "a", "b", None, "é", "Z"])) for i in range(900)]
    got = mixing.mix(docs_of(rows)).collect()
    sizes = {(i, s): len(t.split()) for i, t, _, s in rows}
    taken, target = defaultdict(int), {}
    for r in got:
        assert r.size == sizes[r.doc_id, r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    total = sum(sizes.values())
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    ids = sorted(r.doc_id for r in mixing.mixed_documents(docs_of(rows)).collect())
    assert ids == sorted(r.doc_id for r in got for _ in range(r.copies))
    assert sorted(map(tuple, mixing.mix(docs_of(rows).repartition(5)).collect())) == sorted(map(tuple, got)) if None not in target else True


def test_targets_stop_at_their_limit(spark):
    random.seed(14)
    for _ in range(4):
        sizes = {f"s{i}": random.choice([0, 1, 10, 1000, 100_000]) for i in range(9)} | {None: 50}
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(frame, 1.5, (5, 2, 1), 2).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        fixed = {s: 0 for s in sizes if not sizes[s]}
        while True:  # share what is left by weight, stop those above, again
            open_ = [s for s in sizes if s not in fixed]
            left = 1.5 * sum(sizes.values()) - sum(fixed.values())
            level = left / sum(weight[s] for s in open_) if open_ else 0
            over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
            if not over:
                break
            fixed |= {s: 2 * sizes[s] for s in over}
        want = fixed | {s: level * weight[s] for s in open_}
        assert got == pytest.approx(want)


def test_inclusion_follows_the_probabilities(spark):
    # Pareto sampling: documents with higher odds rank earlier more often.
    from pyspark.sql import functions as F

    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.6).alias("p"))
    ranked = rows.withColumn("r", mixing.pareto_rank(mixing.uniform(F.col("id"), "t"), F.col("p"))).orderBy("r").limit(1600)
    share = {r.p: r["count"] for r in ranked.groupBy("p").count().collect()}
    assert share[0.2] / 2000 == pytest.approx(0.2, abs=0.03) and share[0.6] / 2000 == pytest.approx(0.6, abs=0.03)


def test_mixing_odd_rows(odd, none):
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(odd).count() >= 0
    assert mixing.mix(none).collect() == [] and mixing.mixed_documents(none).collect() == []


def test_duckdb_is_the_oracle_of_three(spark):
    import __spark_entry__ as contract

    assert {n for n in contract.oracle_sql() if re.match(r"op\d", n)} == {"op1_exact_dedup", "op4_chat_format", "op5_mixing"}


@pytest.mark.parametrize("at", [" (at) ", " [at] ", " at ", " AT ", "(at)"])
def test_written_out_addresses_without_dot_word(at):
    text = f"write to jane{at}example.com today"
    assert [(text[a:b], k) for a, k, b in pii.loose_spans(text, pii.base_spans(text))] == [(f"jane{at}example.com", 0)]
    # Unrelated text has no say.
    more = text + ", see the dot"
    assert pii.loose_spans(more, pii.base_spans(more)) == pii.loose_spans(text, pii.base_spans(text))


@pytest.mark.parametrize("k", [128, 129, 300])
def test_viterbi_with_many_languages(k):
    rng = np.random.default_rng(k)
    scores = rng.normal(-9, 0.1, (60, k)).astype(np.float32)
    scores[:20, k - 1] = 0
    scores[20:40, 3] = 0
    scores[40:, k - 2] = 0
    labels = langid.viterbi(scores, np.array([0, 20, 60]), 2.0)
    assert labels.tolist() == [k - 1] * 20 + [3] * 20 + [k - 2] * 20
