"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Generators of high recall propose spans per kind, also overlapping ones. The
spans of the base rules always stay. Every other candidate is judged by
gradient boosted trees over its format (digits, groups, separators, checksum,
parts) and its context (signs and words beside it), and is redacted above a
threshold that reaches ``PRECISION`` on rows the trees have not seen.

The trees learn from the corpus itself. Base spans are positive, and so is
each one rewritten in place into a disguised form (bracketed at and dot, other
separators). Negative are look-alikes: base spans broken so that they fail the
checks, in the same disguised forms, and candidates of the corpus that carry no
disguise or fail the checks without it. Candidates that pass them without their
disguise have no label: they are judged, and neither fitted nor calibrated on.
Thresholds see no base span, since none needs one.

Semantics: a null text is empty and has no spans. Spans are code points, end
exclusive. Matches of a kind do not overlap; spans of different kinds may.
Repeated rows give repeated results; other columns are not read. If no
candidate or only one class exists there is no model and only base spans.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .common import least_by_hash, staged

#: The order of kinds is the order of spans with equal starts.
KINDS = ("email", "ip", "card", "phone")
#: Most candidates the trees are fitted on, taken in hash order; thresholds use all others.
FIT_CANDIDATES = 20_000
#: Precision that a threshold must reach on unseen candidates, the steps of
#: probability it is sought in, and the least examples that set it.
PRECISION, STEPS, LEAST_EXAMPLES = 0.98, 1000, 20

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# a match never begins inside a run of digits: what fails at its first digit fails at each
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Generators beyond the base rules.
_AT = r"(?:\s?(?:\[at\]|\(at\)|\{at\})\s?|\sat\s|\s?@\s?)"
_DOT = r"(?:\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|\sdot\s|\.)"
_LOOSE = {
    "email": re.compile(rf"[A-Za-z0-9][\w.%+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z][A-Za-z0-9-]{{1,62}}){{1,4}}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ .\-_/]?[0-9]{3,6}){2,4}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:00|\(?0?)[0-9]{1,4}\)?(?:[ .\-/]?\(?[0-9]{2,5}\)?){2,4}(?![0-9A-Za-z])"),
}
_MAY_BE_EMAIL = re.compile(r"@|[\[({]at[\])}]| at ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Local part, at sign, dotted domain; linear in the text's length."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Matches of the base patterns: (kind, start, end, whether it passes the checks)."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b, True
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        yield "ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        yield "card", *m.span(), 14 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", *m.span(), 10 <= sum(c.isdigit() for c in m[0]) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [(k, a, b) for k, a, b, ok in base_matches(text) if ok]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Every proposed span with whether it is a base span."""
    found: dict[tuple[str, int, int], bool] = {}
    for kind, a, b, ok in base_matches(text):
        if ok or b - a >= 7:
            found[kind, a, b] = ok
    digits = _DIGIT.search(text) is not None
    for kind, pattern in _LOOSE.items():
        if (_MAY_BE_EMAIL.search(text) is not None) if kind == "email" else digits:
            for m in pattern.finditer(text):
                found.setdefault((kind, *m.span()), False)
    return [(k, a, b, ok) for (k, a, b), ok in found.items()]


# Forms that the loose generators find and the base rules do not.
_AT_FORMS = (" [at] ", "[at]", " (at) ", "(at)", " {at} ", " at ", " @ ")
_DOT_FORMS = (" [dot] ", "[dot]", " (dot) ", "(dot)", " dot ", ".")
_IP_FORMS = ("[.]", "(.)", " . ", " [.] ")
_CARD_FORMS = (".", "_", "/")
_PHONE_FORMS = ("-", ".", " ", "/")
#: Words before " at " that make no address.
_PROSE = ("look", "us", "office", "meet", "arrive", "now")
_AT_SIGN, _DOT_SIGN = re.compile(_AT), re.compile(_DOT)


def _plain_form(text: str, kind: str, a: int, b: int) -> str | None:
    """A candidate without its disguise; None if it carries none."""
    span = text[a:b]
    if kind == "email":
        at = _AT_SIGN.search(span)
        local, host = span[: at.start()], span[at.end() :]
        dots = [d for d in _DOT_SIGN.findall(host) if d != "."]
        # a lone word, " at " and a host is prose
        told = at[0].strip() != "at" or dots or re.search(r"[._%+\d-]", local)
        return f"{local}@{_DOT_SIGN.sub('.', host)}" if told and (dots or at[0] != "@") else None
    if kind == "ip":
        marks = re.findall("[^0-9]+", span)
        # ". " numbers a list
        return ".".join(re.findall("[0-9]+", span)) if all(m not in (".", ". ") for m in marks) else None
    digits = re.sub("[^0-9]", "", span)
    if kind == "card":
        return digits if re.search(r"[._/]", span) else None
    if span.startswith("00"):
        return f"+{digits[2:]}"
    return f"+{digits}" if text[a - 1 : a] == "+" or re.search(r"\([0-9]+\)", span) else None


def _label(text: str, kind: str, a: int, b: int) -> bool | None:
    """Whether a candidate beyond the base rules is personal; None if open."""
    plain = _plain_form(text, kind, a, b)
    if plain is not None and (kind, 0, len(plain), True) in base_matches(plain):
        return None
    return False


def _rewritten(kind: str, span: str) -> Iterator[tuple[str, bool]]:
    """A base span in disguised forms: itself, then broken so that it fails."""
    pick = zlib.crc32(span.encode())
    digits = re.sub("[^0-9]", "", span)

    def joined(signs: tuple[str, ...], parts: list[str]) -> str:
        return signs[pick % len(signs)].join(parts)

    def fours(number: str) -> list[str]:
        return [number[i : i + 4] for i in range(0, len(number), 4)]

    if kind == "email":
        local, host = span.split("@")
        at, dot = _AT_FORMS[pick % len(_AT_FORMS)], _DOT_FORMS[pick // 8 % len(_DOT_FORMS)]
        told = at != " at " or dot != "." or re.search(r"[._%+\d-]", local)
        yield f"{local}{at if told else ' [at] '}{host.replace('.', dot)}", True
        yield f"{_PROSE[pick % len(_PROSE)]} at {host}", False
    elif kind == "ip":
        parts = span.split(".")
        yield joined(_IP_FORMS, parts), True
        broken = [str(256 + pick // 8 % 744) if i == pick % 4 else p for i, p in enumerate(parts)]
        yield joined((*_IP_FORMS, "."), broken), False
        yield ". ".join(parts), False
    elif kind == "card":
        yield joined(_CARD_FORMS, fours(digits)), True
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + pick // 8 % 9) % 10)
        yield joined((*_CARD_FORMS, " ", "-"), fours(wrong)), False
    else:
        groups = re.findall("[0-9]+", span)
        if len(groups) < 3:
            groups = [digits[:2], *(digits[i : i + 3] for i in range(2, len(digits) - 2, 3))]
            groups[-1] += digits[sum(map(len, groups)) :]
        yield "00" + joined(_PHONE_FORMS, groups), True
        yield joined(_PHONE_FORMS, [*fours(digits[:8])[:1], digits[4:6], digits[6:9]]), False
        yield joined(_PHONE_FORMS, groups), False


def examples(text: str) -> Iterator[tuple[str, bool, bool, str, int, int]]:
    """(kind, label, whether a base span, text, start, end) to learn from."""
    for kind, a, b, base in candidates(text):
        label = True if base else _label(text, kind, a, b)
        if label is not None:
            yield kind, label, base, text, a, b
        if not base:
            continue
        before, after = text[max(0, a - 32) : a], text[b : b + 9]
        for span, good in _rewritten(kind, text[a:b]):
            # as the generators would find it there
            here = f"{before}{span}{after}"
            at = (kind, len(before), len(before) + len(span), False)
            if at in candidates(here):
                yield kind, good, False, here, at[1], at[2]


# Words that announce a kind of data, in the languages of the corpus.
_CUES = (
    ("mail", "correo", "courriel", "@"),
    ("ip", "host", "server", "addr"),
    ("card", "visa", "karte", "carte", "tarjeta", "cc"),
    ("tel", "phone", "call", "fax", "mobil", "ruf"),
    ("version", "license", "lizenz", "licence", "licencia", "page", "isbn", "id", "no", "nr"),
)
N_FEATURES = len(KINDS) + 23 + len(_CUES)


def span_features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of one candidate."""
    span = text[a:b]
    digits = re.sub("[^0-9]", "", span)
    groups = re.findall("[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    before = text[max(0, a - 24) : a].lower()
    left, right = text[a - 1 : a], text[b : b + 1]
    words = re.findall(r"[\w@]+", before)[-3:]
    at = _AT_SIGN.search(span) if kind == "email" else None
    return [
        *(float(kind == k) for k in KINDS),
        float(b - a), float(len(digits)), float(len(groups)), float(min(sizes)), float(max(sizes)),
        float(sizes[0]), float(sizes[-1]),
        float(sum(c in " \t" for c in span)), float(span.count(".")), float(span.count("-")),
        float(span.count("(") + span.count("[")), float(span.startswith("+")), float("@" in span),
        float(span.count("_") + span.count("/")), float(span.count("{")), float(span.lower().count("dot")),
        float(span.count(". ") - span.count(" . ")),
        float(at[0].strip() == "at") if at else 0.0,
        float(re.search(r"[._%+\d-]", span[: at.start()]) is not None) if at else 0.0,
        float(luhn(digits)) if digits else 0.0,
        float(max((int(g[:6]) for g in groups), default=0) <= 255),
        float(left.isalnum() or left in "._%+-") if left else 0.0,
        float(right.isalnum() or right == "@") if right else 0.0,
        *(float(any(w.startswith(c) for w in words for c in cues)) for cues in _CUES),
    ]


@dataclass
class Model:
    trees: boosting.Boosted | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, all spans) of a text, by start, then kind."""
        text = text or ""
        base = base_spans(text)
        if self.trees is None:
            return base, base
        taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
        more = [c[:3] for c in candidates(text) if not c[3] and c[0] in self.thresholds]
        if not more:
            return base, base
        p = self.trees.probability(np.array([span_features(text, *c) for c in more]))
        order = sorted(range(len(more)), key=lambda i: (-p[i], more[i][1], -more[i][2], more[i][0]))
        added = []
        for i in order:
            kind, a, b = more[i]
            if p[i] >= self.thresholds[kind] and not any(a < d and c < b for c, d in taken[kind]):
                taken[kind].append((a, b))
                added.append(more[i])
        spans = sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        return base, spans


def fit(docs: DataFrame, text: str = "text", limit: int = FIT_CANDIDATES) -> Model:
    """Fit trees on a bounded sample of candidates, thresholds on all the rest.

    Every text's examples are staged, alike ones in alike surroundings once.
    By hash they fall into two halves. At most ``limit`` examples of the first
    fit the trees. The whole second half without its base spans, as counts per
    kind and step of probability, sets per kind the least threshold whose
    precision is ``PRECISION`` there and above; a kind without such a threshold
    adds nothing.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [
                (k, ok, base, span_features(t, k, a, b), t[max(0, a - 24) : b + 8])
                for whole in part["t"]
                for k, ok, base, t, a, b in examples(whole or "")
            ]
            yield pd.DataFrame(rows, columns=["kind", "ok", "base", "x", "seen"])

    found = docs.select(F.col(text).alias("t")).mapInPandas(
        run, "kind string, ok boolean, base boolean, x array<double>, seen string"
    )
    found = staged(
        found.select(
            "kind", "ok", "base", "x", F.xxhash64("kind", "ok", "base", "x", "seen").alias("h")
        ).dropDuplicates(["h"]),
        "pii-candidates",
    )
    # the lowest bit parts the halves; both classes are needed
    rows = least_by_hash(found.where("h % 2 = 0"), "h", limit).toPandas()
    y = rows["ok"].to_numpy(bool)
    if not len(rows) or y.all() or not y.any():
        return Model()
    model = Model(boosting.fit(np.array(rows["x"].tolist(), np.float64), y.astype(np.float64)))

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.array(part["x"].tolist(), np.float64).reshape(-1, N_FEATURES)
            yield part[["kind", "ok"]].assign(p=model.trees.probability(x))

    counts = (
        found.where("h % 2 <> 0 and not base").mapInPandas(judge, "kind string, ok boolean, p double")
        .groupBy("kind", F.floor(F.col("p") * STEPS).alias("step"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("right"), F.min("p").alias("p"))
        .toPandas().sort_values("p", ascending=False)
    )
    for kind in KINDS:
        own = counts[counts["kind"] == kind]
        n, right = own["n"].cumsum().to_numpy(), own["right"].cumsum().to_numpy()
        reached = np.nonzero((right >= PRECISION * n) & (n >= LEAST_EXAMPLES))[0]
        if len(reached):
            model.thresholds[kind] = max(0.5, float(own["p"].to_numpy()[reached[-1]]))
    return model


def find(model: Model, text: Column) -> Column:
    """Struct (base, spans): arrays of (kind, start, stop) of a text column."""
    span = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("stop", "integer"))
    schema = T.StructType().add("base", span).add("spans", span)

    @F.pandas_udf(schema)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def named(spans):
            return [{"kind": k, "start": a, "stop": b} for k, a, b in spans]

        for part in parts:
            both = [model.spans(t) for t in part]
            yield pd.DataFrame(
                {"base": [named(b) for b, _ in both], "spans": [named(s) for _, s in both]},
                index=part.index,
            )

    return run(text)


def redact(model: Model, text: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets.

    Overlapping spans are replaced together, under the kind of the first.
    A null text stays null.
    """

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def clean(t):
            if t is None:
                return None
            out, at = [], 0
            for kind, a, b in model.spans(t)[1]:
                if a >= at:
                    out += [t[at:a], f"<{kind}>"]
                at = max(at, b)
            return "".join([*out, t[at:]]) if out else t

        for part in parts:
            yield pd.Series([clean(t) for t in part], index=part.index, dtype="object")

    return run(text)
