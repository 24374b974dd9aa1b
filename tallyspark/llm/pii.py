"""Personal data by weak supervision.

Patterns propose spans. The ones that meet a kind's base definition always stay; looser ones
(written-out mail addresses, numbers without a plus sign or with other separators) are candidates.
Regex, checksum, gazetteer, context and boundary labelers vote on every proposal. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is; its
posteriors then train a span classifier on word shapes and neighbours over all proposals of the
corpus, which decides about the looser ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import only, text_batches
from tallyspark.plans.shared import written

KINDS = ("email", "ip", "card", "phone")
#: Hashed features of the span classifier, for each kind.
FEATURES = 1 << 10
#: Probability from which both the labelers' vote and the classifier must call a looser span personal.
THRESHOLD = 0.9
EM_ROUNDS = 50

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive forms of the base patterns: the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\bat\b|\bAT\b|@)\s?"
        r"[A-Za-z0-9-]{1,63}(?:\s?(?:\[dot\]|\(dot\)|\bdot\b|\bDOT\b|\.)\s?[A-Za-z0-9-]{1,63}){1,4}"
    ),
    "ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s\.\s?|\[dot\])[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"),
}
# What every match of the looser mail pattern contains.
_AT = re.compile(r"@|\[at\]|\(at\)|\bat\b|\bAT\b")
# Top-level domains, cue words.
TOP_LEVEL = frozenset("com org net edu gov mil info io co uk de fr es it nl eu us ca au jp cn in br ru ch at be".split())
CUES = {
    "email": frozenset("email e-mail mail contact write reach address".split()),
    "ip": frozenset("ip address host server client connect from".split()),
    "card": frozenset("card visa mastercard credit debit payment pay account".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax dial contact".split()),
}
NEGATIVE_CUES = frozenset("version license isbn issn order page section id doi figure table chapter token".split())
LABELERS = ("pattern", "check", "gazetteer", "context", "boundary")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base pattern, found from each @ outwards: linear even in long runs."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = after = m.end()
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base span, by start, then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # Short parts only, so that no part is a number of unbounded length.
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span, of any kind."""
    found = []
    has_digit = _DIGIT.search(text) is not None
    if _AT.search(text):
        found += [(m.start(), 0, m.end()) for m in _LOOSE["email"].finditer(text)]
    if has_digit:
        for kind in (1, 2, 3):
            found += [(m.start(), kind, m.end()) for m in _LOOSE[KINDS[kind]].finditer(text)]
    taken, out = sorted((a, b) for a, _, b in base), []
    for a, kind, b in sorted(found):
        if all(b <= x or a >= y for x, y in taken):
            out.append((a, kind, b))
            taken.append((a, b))
    return out


_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def votes(text: str, kind: int, start: int, end: int, is_base: bool) -> list[int]:
    """One vote for each labeler: 1 personal, -1 not, 0 no opinion."""
    span, name = text[start:end], KINDS[kind]
    digits = _digits(span)
    check, known = 0, 0
    if name == "email":
        last = re.split(r"[^A-Za-z0-9]+", span)[-1].lower()
        known = 1 if last in TOP_LEVEL else -1
        check = 1 if re.search(r"@|\bat\b|\bAT\b", span) and not re.search(r"\.\.|^\.", span) else -1
    elif name == "ip":
        parts = re.findall(r"[0-9]+", span)
        check = 1 if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1
        known = -1 if parts and int(parts[0][:4]) in (0, 255) else 1
    elif name == "card":
        check = 1 if 14 <= len(digits) <= 19 and luhn(digits) else -1
        known = 1 if digits[:1] in "3456" else 0
    else:
        check = 1 if 10 <= len(digits) <= 15 else -1
        known = 1 if re.search(r"\+|\([0-9]{3}\)|555", span) else 0
    near = {w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])[-4:]}
    context = 1 if near & CUES[name] else -1 if near & NEGATIVE_CUES else 0
    before, after = text[start - 1 : start], text[end : end + 1]
    boundary = -1 if before.isalnum() or after.isalnum() else 1
    return [1 if is_base else 0, check, known, context, boundary]


def _shape(text: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]", "a", text[:80])))


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    span = text[start:end]
    words = _WORD.findall(text[max(0, start - 24) : start])
    named = (
        f"s{_shape(span)}", f"n{len(_digits(span))}", f"l{min(9, len(span) // 4)}",
        f"b{_shape(text[max(0, start - 1):start])}", f"a{_shape(text[end:end + 1])}",
        f"p{words[-1].lower() if words else ''}",
    )
    return [kind * FEATURES + int.from_bytes(hashlib.blake2b(f.encode("utf-8", "replace"), digest_size=4).digest(), "little") % FEATURES for f in named]


_SPAN_DDL = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:string,features:array<int>>>"
_SPAN = pa.list_(
    pa.struct(
        [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]
    )
)


def proposals(docs: DataFrame) -> DataFrame:
    """One row per given row: doc_id, the digest of its text, and its spans, base and looser ones, with
    votes and features."""

    def of(text: str) -> list[dict]:
        base = base_spans(text)
        rows = [(a, k, b, True) for a, k, b in base] + [(a, k, b, False) for a, k, b in loose_spans(text, base)]
        return [
            {
                "kind": k, "start": a, "end": b, "base": is_base,
                "votes": ",".join(map(str, votes(text, k, a, b, is_base))),
                "features": features(text, k, a, b),
            }
            for a, k, b, is_base in sorted(rows)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield pa.record_batch({**only(batch, "doc_id", "text_sha256"), "found": pa.array([of(t) for t in texts], _SPAN)})

    rows = docs.select("doc_id", "text", _digest().alias("text_sha256"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_sha256 string, found {_SPAN_DDL}")


def _digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation over distinct vote patterns (rows of -1, 0, 1) and their counts.

    Returns each pattern's probability of being personal, and the labelers' reliabilities
    (class x labeler x vote)."""
    posterior = 1 / (1 + np.exp(-patterns.sum(1, dtype=float)))  # from the majority
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    reliability = np.empty((2, patterns.shape[1], 3))
    for _ in range(rounds):
        logs = np.empty((len(patterns), 2))
        for y, weight in enumerate((1 - posterior, posterior)):
            weight = weight * counts
            reliability[y] = np.einsum("p,plv->lv", weight, hot) + 1
            reliability[y] /= reliability[y].sum(1, keepdims=True)
            logs[:, y] = np.log(weight.sum() + 1) + np.einsum("plv,lv->p", hot, np.log(reliability[y]))
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return posterior, reliability


@dataclass
class Classifier:
    """`vote[kind, votes]` is the labelers' joint probability, `weights` a log odds per feature."""

    vote: dict[tuple[int, str], float]
    reliability: dict[str, np.ndarray]
    weights: np.ndarray
    prior: np.ndarray

    def accepts(self, kind: int, votes_: str, features_: list[int]) -> bool:
        if self.vote.get((kind, votes_), 0.0) < THRESHOLD:
            return False
        odds = self.prior[kind] + self.weights[features_].sum()
        return odds >= np.log(THRESHOLD / (1 - THRESHOLD))


def fit(found: DataFrame) -> Classifier:
    """From all proposals: counts of vote patterns and posterior-weighted counts of features reach
    the driver, at most 4 x 3**5 and 4 x 1,024 rows."""
    spans = found.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.features")
    rows = spans.groupBy("kind", "votes").count().collect()
    vote, reliability = {}, {}
    for kind in range(len(KINDS)):
        own = sorted((r["votes"], r["count"]) for r in rows if r["kind"] == kind)
        if own:
            patterns = np.array([[int(v) for v in p.split(",")] for p, _ in own])
            posterior, reliability[KINDS[kind]] = estimate(patterns, np.array([n for _, n in own], float))
            vote |= {(kind, p): float(x) for (p, _), x in zip(own, posterior)}
    weights, prior = np.zeros(len(KINDS) * FEATURES), np.zeros(len(KINDS))
    if vote:
        # At most 4 x 3**5 rows.
        by_vote = found.sparkSession.createDataFrame([(k, p, x) for (k, p), x in vote.items()], "kind int, votes string, p double")
        sums = (
            spans.join(F.broadcast(by_vote), ["kind", "votes"])
            .select("kind", F.explode("features").alias("feature"), F.round(F.col("p") * 1_000_000).cast("long").alias("p"))
            .groupBy("kind", "feature").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")).collect()
        )
        for kind in range(len(KINDS)):
            own = [r for r in sums if r["kind"] == kind]
            good = sum(r["p"] for r in own) / 1e6
            bad = sum(r["n"] for r in own) - good
            prior[kind] = np.log((good + 1) / (bad + 1))
            for r in own:
                p = r["p"] / 1e6
                weights[r["feature"]] = np.log((p + 1) / (good + FEATURES)) - np.log((r["n"] - p + 1) / (bad + FEATURES))
    return Classifier(vote, reliability, weights, prior)



def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per given row: doc_id, text_sha256, n_email, n_ip, n_card, n_phone (base spans), base and
    spans: arrays of (kind, start, end) by start, then kind, in code points, end exclusive.

    A null or empty text has no spans. Repeated rows are judged each for itself; without any
    proposal in the table nothing is trained. Other columns are not looked at.
    """
    found = written(proposals(docs), "pii-proposals")
    model = fit(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("found")).to_pylist()
            base = [[s for s in own if s["base"]] for own in spans]
            final = [[s for s in own if s["base"] or model.accepts(s["kind"], s["votes"], s["features"])] for own in spans]
            plain = lambda rows: pa.array(
                [[{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"]} for s in own] for own in rows], _OUT
            )
            counts = {
                f"n_{kind}": pa.array([sum(s["kind"] == k for s in own) for own in base], pa.int64())
                for k, kind in enumerate(KINDS)
            }
            yield pa.record_batch({**only(batch, "doc_id", "text_sha256"), **counts, "base": plain(base), "spans": plain(final)})

    kind = found.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    out = "array<struct<kind:string,start:bigint,end:bigint>>"
    return found.mapInArrow(run, f"doc_id {kind}, text_sha256 string, {counts}, base {out}, spans {out}")


_OUT = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def masked(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per given row: doc_id and text with each span replaced by its kind in brackets;
    overlapping spans merge under the first one's kind. `spans` is the result of `find_personal_data`.

    Spans follow from the text alone and are joined by its digest, copies collapsed first: null and
    repeated ids lose and multiply no row. A null text becomes an empty one; a text without a row in
    `spans` stays as it is."""
    pieces = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.when(
                s["start"] >= a["at"],
                F.concat(
                    a["out"],
                    F.substring("_t", (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                    F.lit("["), s["kind"], F.lit("]"),
                ),
            ).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
        lambda a: F.concat(a["out"], F.substring("_t", (a["at"] + 1).cast("int"), F.length("_t"))),
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"), _digest().alias("_sha"))
    texts = spans.filter(F.size("spans") > 0).groupBy(F.col("text_sha256").alias("_sha")).agg(F.first("spans").alias("spans"))
    text = F.when(F.col("spans").isNull(), F.col("_t")).otherwise(pieces)
    return rows.join(texts, "_sha", "left").select("doc_id", text.alias("text"))
