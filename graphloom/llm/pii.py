"""Personal data: weak labelers, their reliabilities by expectation-maximisation, and a span classifier.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.
Beyond them, candidates are long runs that mix letters and digits (keys,
tokens, passwords), telephone numbers without a plus sign and numbers like
social security numbers.  Six labelers vote yes, no or nothing on each:
patterns, a gazetteer of the words before it, and its context.  Counts of vote
patterns over *all* candidates (at most 3**6 rows) go to
expectation-maximisation, which estimates each labeler's reliability and every
pattern's posterior.  The posteriors train a logistic classifier on the span's own
features, again from counts over all candidates; candidates it accepts
become spans of the kinds ``number``, ``secret`` and ``tel``, unless
they overlap a base span.

Nulls: a null text counts as empty and has no spans.  Repeated rows give
repeated results; an empty table gives an empty one.  Offsets are code points,
ends exclusive.  Of equal starts only one candidate of a kind exists.  The time of a
text is in proportion to its length, whatever runs of letters or digits it holds.
Columns of the input but the id are left out, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import importable, slices, written

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base kinds, each in a form that reads a text once; ``emails`` finds what stands before a mark.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

CANDIDATES = (
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{12,}")),
    ("tel", re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")),
    ("number", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
)
#: Words that announce personal data or secrets.
GAZETTEER = frozenset("api apikey auth bearer call cell contact credential fax key mobile passwd password phone pin private pwd secret social ssn tel telephone token".split())
PREFIXED = re.compile(r"(?:AKIA|ASIA|AIza|gh[pousr]_|sk[-_]|xox[bp]-|eyJ)[A-Za-z0-9_-]{10,}")
HEX = re.compile(r"[0-9a-f]{12,}|[0-9A-F]{12,}")
ASSIGNED = re.compile(r"[A-Za-z_]\s*[=:]\s*[\"']?$")
WORDS = re.compile(r"[a-z]+")
NUMBERED = re.compile(r"[A-Za-z_-]+[0-9]{1,4}|[0-9]{1,4}[A-Za-z_-]+")
LABELERS = ("prefix", "hex", "assigned", "gazetteer", "entropy", "ordinary")


def digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def luhn(number: str) -> bool:
    twice = [2 * int(d) for d in number[-2::-2]]
    return (sum(int(d) for d in number[-1::-2]) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def is_card(s: str) -> bool:
    return 16 <= len(d := digits(s)) <= 19 and luhn(d)


def is_ip(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost addresses that do not overlap: from each mark left to the first letter that may stand there, then right."""
    at = last = 0
    for part in text.split("@")[:-1]:
        at += len(part)
        start = max(at - len(part) + len(part.rstrip(LOCAL)), last)
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            yield "email", start, last
        at += 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start; a match that fails its test is dropped, and the search goes on behind it."""
    found = list(emails(text))
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if is_ip(m[0])]
        found += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and is_card(m[0])]
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return found


def united(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def changes_in(s: str) -> int:
    """How often digits and other characters follow each other."""
    kinds = [c.isdigit() for c in s]
    return sum(map(ne, kinds, kinds[1:]))


def votes_on(kind: str, span: str, before: str, bits: float, changes: int) -> tuple[int, ...]:
    """1, -1 or 0 of each of ``LABELERS``."""
    return (
        1 if kind != "secret" or PREFIXED.fullmatch(span) else 0,
        (1 if HEX.fullmatch(span) and not span.isdigit() else 0) if kind == "secret" else 0,
        1 if ASSIGNED.search(before) else 0,
        1 if not GAZETTEER.isdisjoint(WORDS.findall(before[-24:].lower())) else 0,
        (1 if bits >= 3.2 and changes >= 4 else -1 if bits < 2.6 or changes < 3 else 0) if kind == "secret" else 0,
        -1 if NUMBERED.fullmatch(span) or before.endswith(("/", "@", ".", "#")) else 0,
    )


FEATURE_BITS = 10


def features_of(kind: str, span: str, before: str, bits: float, changes: int) -> int:
    """Binary features of a span, as the bits of a number."""
    flags = (kind == "secret", kind == "tel", len(span) >= 16, len(span) >= 24, bits >= 3.0, bits >= 3.5, changes >= 3, span.lower() != span and span.upper() != span, bool(ASSIGNED.search(before)), bool(NUMBERED.fullmatch(span)))
    return sum(1 << k for k, f in enumerate(flags) if f)


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, votes in base 3, features) of candidates that overlap no base span; by kind, then start."""
    if not DIGIT.search(text):
        return []
    found = []
    starts, ends = united(base)
    for kind, pattern in sorted(CANDIDATES):
        for m in pattern.finditer(text):
            at = bisect_left(starts, m.end())  # of the stretches that begin before the end, the last one reaches farthest
            if kind == "secret" and m[0].replace("-", "").isdigit() or at and ends[at - 1] > m.start():
                continue
            before = text[max(0, m.start() - 32) : m.start()]
            bits, changes = entropy(m[0]), changes_in(m[0])
            code = 0
            for v in votes_on(kind, m[0], before, bits, changes):
                code = 3 * code + v + 1
            found.append((kind, *m.span(), code, features_of(kind, m[0], before, bits, changes)))
    return found


def unpack_votes(code: int) -> list[int]:
    return [code // 3**k % 3 - 1 for k in range(len(LABELERS) - 1, -1, -1)]


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and P(vote -1, 0, 1 | class) of each labeler: (2, labelers, 3)."""
    posterior = np.clip(0.5 + 0.2 * votes.sum(axis=1), 0.02, 0.98)
    table = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack(((1 - posterior) * counts, posterior * counts))
        prior = np.clip(weight.sum(axis=1) / max(counts.sum(), 1e-9), 0.01, 0.99)
        for v in (-1, 0, 1):
            table[:, :, v + 1] = weight @ (votes == v) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + sum(np.log(table[:, k, votes[:, k] + 1]) for k in range(votes.shape[1]))
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return posterior, table


def bits_of(features: np.ndarray) -> np.ndarray:
    x = (features[:, None] >> np.arange(FEATURE_BITS)) & 1
    return np.column_stack((np.ones(len(x)), x)).astype(float)


def train_classifier(features: np.ndarray, targets: np.ndarray, counts: np.ndarray, rounds: int = 500, l2: float = 0.5) -> np.ndarray:
    """Logistic weights from soft targets by Newton steps over counts."""
    x, w = bits_of(features), np.zeros(FEATURE_BITS + 1)
    for _ in range(min(rounds, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (counts * (p - targets)) + l2 * w)
    return w


def found_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, base spans and candidates of every row."""
    importable(docs.sparkSession)
    place = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
    schema = docs.select(*keep).schema.add("base", T.ArrayType(place)).add("more", T.ArrayType(T.StructType(list(place.fields)).add("votes", "integer").add("features", "integer")))
    span = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
    types = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("votes", pa.int32()), ("features", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in types[1].value_type]
        for batch in slices(batches, len(keep)):
            base, more = [], []
            for t in batch.column(len(keep)).to_pylist():
                spans = base_spans(t)
                base.append([dict(zip(names, s, strict=False)) for s in spans])
                more.append([dict(zip(names, s, strict=True)) for s in candidates(t, spans)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(base, types[0]), pa.array(more, types[1])], names=schema.names)

    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)


def find_personal_data(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """id, ``base`` and ``spans``: arrays of (kind, start, end), the base spans and all spans of every row."""
    found = written(found_spans(docs, text, (id_col,)), "spans")
    # bounded: 3**6 vote patterns times 2**10 feature patterns at most
    seen = found.select(F.explode("more").alias("c")).groupBy("c.votes", "c.features").count().orderBy("votes", "features").collect()
    accepted: list[int] = []
    if seen:
        votes = np.array([unpack_votes(r["votes"]) for r in seen])
        counts, features = np.array([r["count"] for r in seen], float), np.array([r["features"] for r in seen])
        posterior, _ = reliabilities(votes, counts)
        weights = train_classifier(features, posterior, counts)
        each = np.unique(features)
        accepted = each[bits_of(each) @ weights >= math.log(least / (1 - least))].tolist()
    picked = F.filter("more", lambda c: F.array_contains(F.array(*map(F.lit, accepted)), c.features)) if accepted else F.filter("more", lambda _: F.lit(False))
    plain = F.transform(picked, lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end")))
    return found.select(id_col, "base", F.concat("base", plain).alias("spans"))


def shown(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
