"""Personal data by weak supervision.

Four kinds follow fixed rules (e-mail and IP addresses, card and phone numbers). Two more, secrets and account
numbers, have no sure rule: candidates are found by loose patterns, and labelers of three sorts (patterns,
gazetteers of words before the span, and the context around it) vote for, against, or not at all. Expectation-
maximisation over the counts of all vote patterns in the corpus estimates how reliable each labeler is, and gives
each pattern a probability. Those are the targets of a logistic span classifier over the span's own features,
which decides.

Vote patterns and features are small categorical tuples, so what is counted, and what comes to the driver, is
bounded by their number of combinations and not by the corpus.

Edge cases: null and empty texts have no span; places count code points, ends are exclusive; repeated rows are each
returned; empty tables give an empty result; a corpus without candidates leaves the base spans alone; spans that begin
at one place come in the order of the kinds; other columns are not read (`detect`) or stay as they are (`masked`).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, released

#: The kinds by their order, the base ones first.
KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match takes whole runs of digits, so that none can begin inside a run: the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LONG = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
_HEX = re.compile(r"[0-9a-fA-F]{32,}\Z")
_BEFORE = re.compile(r"[A-Za-z]+(?=[^A-Za-z]*\Z)")

#: Words that announce a secret, and words that announce a number.
SECRET_WORDS = frozenset("token key secret password passwd pwd api auth bearer access credential".split())
NUMBER_WORDS = frozenset("card visa mastercard account konto iban ssn passport phone tel telephone mobile fax cuenta compte".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return s.replace(" ", "").replace("-", "")


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern's matches from left to right, found from each @ so that long runs cost their length once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            out.append((start, free))
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (start, kind, end) in order, and card-like runs of digits that aren't cards."""
    out, loose = [(a, 0, b) for a, b in emails(text)], []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 9:
            digits = _only_digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
            elif 9 <= len(digits) <= 34:
                loose.append(m.span())
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out), loose


def _side(c: str) -> int:
    """Class of a neighbouring character: none, space, quote or equals sign, other sign, letter or digit."""
    if not c:
        return 0
    if c.isspace():
        return 1
    if c in "\"'=:`":
        return 2
    return 4 if c.isalnum() else 3


def describe(text: str, kind: int, start: int, end: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes (-1, 0, 1) of the labelers on a candidate, and the features that the classifier sees."""
    s, head = text[start:end], text[max(0, start - 32) : start]
    before, after = head[-1:], text[end : end + 1]
    last = _BEFORE.search(head)
    word = last[0].lower() if last else ""
    digits = sum("0" <= c <= "9" for c in s)
    share = digits / len(s)
    sides = _side(before), _side(after)
    if kind == 4:
        hexed = bool(_HEX.match(s))
        votes = (
            1 if hexed else 0,  # pattern: a long run of hex digits
            1 if share >= 0.2 and digits < len(s) else -1 if not digits else 0,  # pattern: digits among letters
            1 if word in SECRET_WORDS else 0,  # gazetteer
            1 if sides[0] == 2 and sides[1] == 2 else -1 if sides == (1, 1) else 0,  # context: quoted
            -1 if s.islower() and s.isalpha() or s.count("-") + s.count("_") > 3 else 0,  # pattern: like words
            -1 if before in "/.@" and before or after in "/@" and after else 0,  # context: part of a path
        )
        return votes, (int(hexed), min(3, len(s) // 16), min(4, int(share * 5)), *sides, int(word in SECRET_WORDS))
    n = digits
    plain = s.isdigit()
    votes = (
        1 if 13 <= n <= 19 else -1 if n < 11 or n > 24 else 0,  # pattern: as long as a card's number
        1 if luhn(_only_digits(s)) else -1,  # check digit
        1 if word in NUMBER_WORDS else 0,  # gazetteer
        1 if sides[0] in (0, 1) and sides[1] in (0, 1, 3) else -1 if 4 in sides else 0,  # context: stands alone
        1 if s[0] in "3456" else 0,  # pattern: an issuer's first digit
        1 if plain else 0,  # pattern: unbroken
    )
    return votes, (min(5, n // 4), int(plain), int(s[0] in "3456"), *sides, int(word in NUMBER_WORDS))


def examined(text: str):
    """Base spans and candidates (start, kind, end, votes, features) that touch no base span."""
    base, loose = base_spans(text)
    found = [(a, 5, b) for a, b in loose] + [(m.start(), 4, m.end()) for m in _LONG.finditer(text) if not m[0].isdigit()]
    out, reach = [], sorted((a, b) for a, _, b in base)
    for a, kind, b in sorted(found):
        if any(x < b and a < y for x, y in reach) or out and a < out[-1][2]:
            continue
        out.append((a, kind, b, *describe(text, kind, a, b)))
    return base, out


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of each vote pattern, each labeler's table P(vote | class) [labeler, class, vote + 1], and the prior (EM)."""
    m = votes.shape[1]
    p = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    table, prior = np.zeros((m, 2, 3)), 0.5
    for _ in range(rounds):
        prior = float(np.clip((weight * p).sum() / weight.sum(), 0.01, 0.99))
        for c, q in ((0, 1 - p), (1, p)):
            for v in (-1, 0, 1):
                table[:, c, v + 1] = ((votes == v) * (weight * q)[:, None]).sum(0) + 0.1
        table /= table.sum(2, keepdims=True)
        logs = np.log(table)
        one = np.log(prior) + sum(logs[i, 1, votes[:, i] + 1] for i in range(m))
        nil = np.log(1 - prior) + sum(logs[i, 0, votes[:, i] + 1] for i in range(m))
        new = 1 / (1 + np.exp(np.clip(nil - one, -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, table, prior


def _one_hot(features: tuple[int, ...]) -> list[int]:
    return [0, *(1 + 8 * i + v for i, v in enumerate(features))]


def fit_classifier(features: list[tuple[int, ...]], target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic classifier over one-hot features, for soft targets, by Newton steps with a ridge."""
    width = 1 + 8 * max(map(len, features))
    x = np.zeros((len(features), width))
    for i, f in enumerate(features):
        x[i, _one_hot(f)] = 1
    w = np.zeros(width)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(width), x.T @ (weight * (target - p)) - ridge * w)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(texts: DataFrame) -> dict[int, np.ndarray]:
    """The classifier of each kind that isn't base, from all texts (column `text`)."""

    def count(batches):
        tally: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, kind, _, votes, features in examined(text or "")[1]:
                    tally[kind, votes, features] += 1
        keys = list(tally)
        yield pa.record_batch([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([list(k[1]) for k in keys], pa.list_(pa.int32())),
            pa.array([list(k[2]) for k in keys], pa.list_(pa.int32())), pa.array([tally[k] for k in keys], pa.int64()),
        ], ["kind", "votes", "features", "n"])

    counted = texts.select("text").mapInArrow(released(count), "kind int, votes array<int>, features array<int>, n long")
    rows = counted.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect()
    out = {}
    for kind in (4, 5):
        mine = sorted((tuple(r.votes), tuple(r.features), r.n) for r in rows if r.kind == kind)
        if mine:
            votes, n = np.array([r[0] for r in mine]), np.array([r[2] for r in mine], float)
            out[kind] = fit_classifier([r[1] for r in mine], estimate(votes, n)[0], n)
    return out


def spans(text: str, model: dict[int, np.ndarray]) -> tuple[list, list]:
    """Base spans, and all spans with those that the classifier takes, as (start, kind, end) by start and kind."""
    base, found = examined(text)
    more = [(a, kind, b) for a, kind, b, _, f in found if kind in model and model[kind][_one_hot(f)].sum() >= 0]
    return base, sorted(base + more)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the count of each base kind, base_sha256 and spans."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = learn(texts)

    def run(batches):
        for batch in batches:
            got = [spans(t or "", model) for t in batch.column(1).to_pylist()]
            kinds = [Counter(k for _, k, _ in base) for base, _ in got]
            yield pa.record_batch([
                batch.column(0), *(pa.array([c[k] for c in kinds], pa.int64()) for k in range(4)),
                pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], pa.string()), pa.array([joined(every) for _, every in got], pa.string()),
            ], ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return texts.mapInArrow(released(run), f"id {texts.schema['id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str | None, model: dict[int, np.ndarray]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one, by the first's kind."""
    if not text:
        return text
    out, done = [], 0
    for a, kind, b in spans(text, model)[1]:
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with personal data masked in the text column; other columns stay."""
    model = learn(docs.select(F.col(text_col).alias("text")))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = pa.array([mask(t, model) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.record_batch([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(released(run), docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
