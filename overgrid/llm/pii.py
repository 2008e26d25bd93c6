"""Personal data by candidate gradient boosting.

Exact rules find the *base* spans of each kind (email, ip, card, phone), which always stay.  Beside them, generators
of high recall propose further spans, which may overlap: addresses written with (at) and (dot), numbers in other
groupings, phone numbers without a country sign.  Boosted trees judge each candidate by its format and its context;
a kind's threshold is calibrated on held-out candidates.

There are no labels of personal data, so the trees learn from the base rules' own finds, rewritten the ways the
generators look for (a plus sign dropped, other separators), against candidates of the same documents that touch no
find, and against finds with changed digits.  All documents teach, and a row counts as often as it occurs.  Candidates that touch a base span or a stronger candidate of their kind
are dropped.  Positions are code points of the whole text, ends exclusive.

Null texts are empty; empty texts have no spans.  Documents without finds teach nothing: then there are base spans
only.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overgrid.llm import boosting
from overgrid.llm.common import stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: Training rows that a task holds at once, and the steps in which chances are told for the thresholds.
ROWS_AT_ONCE, CHANCES = 2000, 10_000
PRECISION = 0.99

# Possessive runs: a match can only start where its run of digits does, so no text is scanned twice.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

GENERATORS = (
    ("email", re.compile(r"[\w.%+-]{1,64}\s?(?:@|\(at\)|\[at\])\s?[\w-]{1,64}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]{2,24})+")),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(dot\))\s?[0-9]{1,3}){3}(?![\w.])")),
    ("card", re.compile(r"(?<![\w])[0-9]{3,6}(?:[\x20./_-]{0,2}[0-9]{3,6}){2,4}(?![\w])")),
    ("phone", re.compile(r"(?<![\w+])(?:00[\x20.-]?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}(?:[\x20./-]?[0-9]{2,4}){1,2}(?![\w])")),
)
HINT = re.compile(r"[0-9@]|[(\[]at[)\]]")
CONTEXT = re.compile(r"mail|contact|write|call|phone|tel|fax|mobile|card|visa|credit|pay|ip|host|server|address", re.IGNORECASE)

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from the @ signs outwards."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            found.append((start, done, "email"))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[Span]:
    found = emails(text)
    found += [(*m.span(), "ip") for m in IP.finditer(text) if all(map(is_byte, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


def candidates(text: str) -> list[Span]:
    return [(*m.span(), kind) for kind, pattern in GENERATORS for m in pattern.finditer(text)]


def format_features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span and its surroundings; nothing that names the base rules' verdict alone."""
    span = text[start:end]
    digits = digits_of(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    near = CONTEXT.search(before)
    return [
        *[float(kind == k) for k in KINDS],
        len(span), len(digits), sum(c.isalpha() for c in span), len(groups), max(groups), min(groups),
        float(luhn(digits)), float(all(is_byte(g) for g in re.findall(r"[0-9]+", span))),
        span.count(" "), span.count("-"), span.count("."), span.count("/") + span.count("_"),
        float("(" in span), float("@" in span), float("at" in span and "(" in span or "[at" in span),
        len(set(digits)), float(span[:1] == "0"), float(bool(near)),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), sum(c.isdigit() for c in before + after),
    ]


@dataclass(frozen=True)
class Judge:
    """Trees and the calibrated threshold of each kind (over 1 where none is precise enough)."""

    trees: boosting.Trees
    thresholds: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        found = [c for c in candidates(text) if not _touches(c, base)]
        if not found:
            return []
        chance = self.trees.probability(np.array([format_features(text, *c) for c in found]))
        kept: list[Span] = []
        for p, span in sorted(zip(chance.tolist(), found, strict=True), key=lambda x: (-x[0], x[1])):
            if p >= self.thresholds[span[2]] and not _touches(span, kept):
                kept.append(span)
        return kept


def _touches(span: Span, others: list[Span]) -> bool:
    return any(span[0] < end and start < span[1] for start, end, _ in others)


def rewritten(text: str, span: Span) -> Iterator[tuple[str, int, int, str, bool]]:
    """``(text, start, end, kind, is personal)``: a find in the forms that only the generators see, and false ones."""
    start, end, kind = span
    found = text[start:end]
    forms = {
        "email": [found.replace("@", " (at) "), found.replace("@", "[at]").replace(".", "[dot]")],
        "ip": [found.replace(".", "[.]"), found.replace(".", " . ")],
        "card": [".".join(digits_of(found)[i : i + 4] for i in range(0, len(digits_of(found)), 4))],
        "phone": [re.sub(r"^\+[0-9]+[ .-]*", "", found), "00" + found[1:]],
    }[kind]
    digits = digits_of(found)
    wrong = str((int(digits[-1]) + 5) % 10) if digits else ""
    false = {
        "card": [digits[:-1] + wrong, ".".join(digits[i : i + 3] for i in range(0, len(digits), 3))[:-1] + wrong],
        "ip": [re.sub(r"^[0-9]+", "711", found).replace(".", " . ")],
        "phone": ["/".join((digits[-10:-8], digits[-8:-4], digits[-4:]))],
    }.get(kind, [])
    for form, good in [(f, True) for f in forms] + [(f, False) for f in false]:
        whole = text[max(0, start - 40) : start] + form + text[end : end + 40]
        at = min(start, 40)
        yield whole, at, at + len(form), kind, good


def lessons(text: str) -> list[tuple[list[float], bool]]:
    """Training rows of one document."""
    base = base_spans(text)
    rows = [(format_features(*r[:4]), r[4]) for span in base for r in rewritten(text, span)]
    rows += [(format_features(text, *c), False) for c in candidates(text) if not _touches(c, base)]
    return rows


def fit(rows: list[tuple[list[float], bool]]) -> Judge | None:
    """Trees from three quarters of the rows; thresholds of ``PRECISION`` on the rest."""
    if len({good for _, good in rows}) < 2:
        return None
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    held = np.random.default_rng(5).random(len(y)) < 0.25
    if held.all() or len(set(y[~held])) < 2:
        held[:] = False
    trees = boosting.fit(x[~held], y[~held])
    chance, thresholds = trees.probability(x), {}
    test = held if held.any() else ~held
    for k, kind in enumerate(KINDS):
        mine = test & (x[:, k] == 1)
        order = np.argsort(-chance[mine])
        right = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero((right >= PRECISION) & (np.arange(1, mine.sum() + 1) >= 5))
        thresholds[kind] = max(0.9, float(chance[mine][order][good[-1]])) if len(good) else 2.0
    return Judge(trees, thresholds)


def taught(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(x, good, n)``: the different training rows of all documents and how often each occurs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[list[float], bool]] = []
        for part in parts:
            for value in part["text"]:
                rows += lessons(value) if HINT.search(value) else []
                if len(rows) >= ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=["x", "good"])
                    rows = []
        yield pd.DataFrame(rows, columns=["x", "good"])

    rows = docs.select(text_of(F.col(f"`{text}`")).alias("text")).mapInPandas(run, "x array<double>, good boolean")
    return rows.groupBy("x", "good").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, text: str = "text") -> Judge | None:
    """Fit on all documents: trees from three quarters of the different training rows, thresholds of ``PRECISION`` on the
    rest.  The quarter is picked by a hash of the row, so equal rows are on one side."""
    rows = stored(taught(docs, text), "lessons").withColumn("held", F.pmod(F.xxhash64("x"), F.lit(4)) == 0)
    sides = {(r.held, r.good) for r in rows.select("held", "good").distinct().collect()}
    if len({good for _, good in sides}) < 2:
        return None
    if len({good for held, good in sides if not held}) < 2:
        rows, sides = rows.withColumn("held", F.lit(False)), set()
    trees = boosting.fit_table(rows.filter(~F.col("held")))
    return Judge(trees, _thresholds(rows.filter("held") if any(held for held, _ in sides) else rows, trees))


def _thresholds(rows: DataFrame, trees: boosting.Trees) -> dict[str, float]:
    """Of each kind the lowest chance from which up ``PRECISION`` of at least five rows are personal, 0.9 at least.

    Chances are told in ``CHANCES`` steps, so the driver gets that many sums for a kind at most, of any number of rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = np.array(part["x"].tolist())
                step = np.floor(trees.probability(x) * CHANCES).astype(np.int64)
                yield pd.DataFrame({"kind": x[:, : len(KINDS)].argmax(axis=1), "step": step, "good": part["good"] * part["n"], "n": part["n"]})

    sums = rows.select("x", "good", "n").mapInPandas(run, "kind bigint, step bigint, good bigint, n bigint").groupBy("kind", "step").agg(
        F.sum("good").alias("good"), F.sum("n").alias("n")
    )
    thresholds, upto = dict.fromkeys(KINDS, 2.0), {k: (0, 0) for k in range(len(KINDS))}
    for r in sorted(sums.collect(), key=lambda r: -r.step):
        good, n = upto[r.kind] = upto[r.kind][0] + r.good, upto[r.kind][1] + r.n
        if n >= 5 and good >= PRECISION * n:
            thresholds[KINDS[r.kind]] = max(0.9, r.step / CHANCES)
    return thresholds


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


FOUND = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField(c, T.StringType()) for c in ("base", "spans")])


def find_pii(docs: DataFrame, judge: Judge | None, text: str = "text", column: str = "pii") -> DataFrame:
    """``docs`` with a struct column: the number of base spans of each kind, the base spans and all spans."""

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            value = value or ""
            base = base_spans(value) if HINT.search(value) else []
            more = judge.added(value, base) if judge and HINT.search(value) else []
            rows.append((*(sum(s[2] == k for s in base) for k in KINDS), joined(base), joined(base + more)))
        return pd.DataFrame(rows, columns=[f.name for f in FOUND])

    return docs.withColumn(column, found(F.col(f"`{text}`")))


def redact(text: str, spans: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    out, done = [], 0
    for part in filter(None, spans.split(",")):
        kind, start, end = part.split(":")
        if int(start) >= done:
            out += [text[done : int(start)], f"<{kind}>"]
        done = max(done, int(end))
    return "".join([*out, text[done:]])


def op8_pii(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, train(docs))
    return found.select("doc_id", *[f"pii.n_{k}" for k in KINDS], F.sha2("pii.base", 256).alias("base_sha256"), F.col("pii.spans").alias("spans"))
