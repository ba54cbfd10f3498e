"""Personal data and secrets by weak supervision.

Loose patterns propose spans of a kind: EMAIL, PHONE, IP, CARD, NATIONAL_ID, IBAN, SECRET. Labelers of three sorts vote
on each (+1 private, -1 not, 0 no opinion). Patterns are greedy and may take in neighbouring numbers, so phones, cards and
IBANs are also proposed from each later group of digits and up to each earlier one, and proposals overlap
freely: which of them stays is decided after the vote. The labelers: regular expressions and checks of the form, gazetteers
(issuer prefixes, mail hosts, words that announce a secret), and looks at the context (isolated or inside
something longer, after a version word, in a table of numbers).

* Of overlapping proposals the fit sees the one with the most votes in sum (then the longest, then the first), so that the
  parts of a number don't outweigh the numbers themselves; the search lets all of them compete by the final classifier.
* Counts of equal (kind, votes, features) are summed over all documents; their number is bounded by the number of
  labelers and feature values, not by the corpus.
* Expectation-maximisation on the vote counts of each kind estimates how often each labeler is right, and with
  that the chance that a span is private. It starts from the majority, which keeps "private" from turning into its opposite.
* A logistic regression learns those chances from the spans' features (form, length, neighbourhood), over all
  spans weighted by count. The final classifier's log odds are those of the regression and of the votes, averaged; a
  span of which they are positive is reported.

Overlapping spans: an IBAN with right check digits stays, then the likelier, then the longer, then the first. Defined results. Null and empty
texts have no spans. Rows are judged independently, so repeated rows repeat their spans; ids may be null. A corpus
without any span gives a model that reports what the majority of labelers says. Texts are searched as a whole, whatever
their length. Digits are those of ASCII; a secret has 16 characters at least (shorter runs are ordinary words and numbers),
and no kind has a form of under five. Further columns don't matter, and redact keeps them.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "NATIONAL_ID", "IBAN", "SECRET")

# -- proposals

_PROPOSE = [
    ("EMAIL", re.compile(r"[^\s@<>\"'(),;:|]+")),
    ("IP", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])")),
    ("IBAN", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("NATIONAL_ID", re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")),
    ("CARD", re.compile(r"(?<![\w.])[0-9](?:[ -]?[0-9]){12,18}(?!\w)")),
    ("SECRET", re.compile(r"(?<![A-Za-z0-9_\-+/])(?=[A-Za-z_\-+/]*[0-9])[A-Za-z0-9_\-+/]{16,}={0,2}(?![A-Za-z0-9_\-+/])")),
    ("PHONE", re.compile(r"(?<![\w.])(?:\+|\()?[0-9][0-9\-\s().]{5,17}[0-9](?!\w)")),
]
#: Kinds written in groups: every start and end at the border of a group is a proposal of its own.
_GROUPED = {
    "IBAN": re.compile(r"(?=(\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b))"),
    "CARD": re.compile(r"(?<![\w.])(?=([0-9](?:[ -]?[0-9]){12,18}(?!\w)))"),
    "PHONE": re.compile(r"(?<![\w.+])(?=((?:\+|\()?[0-9][0-9\-\s().]{5,17}[0-9](?!\w)))"),
}
_TRIM = ".!?*#%&$]}"
_HOSTS = {"gmail", "yahoo", "hotmail", "outlook", "icloud", "proton", "aol", "gmx", "web", "mail", "example", "live", "msn", "orange", "free"}
_ENDINGS = {"com", "net", "org", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "biz", "co", "eu", "us", "ch", "at", "it", "nl"}
_SECRET_WORDS = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_ -]?key|key|bearer|auth|credential|contraseña|passwort)\W{0,6}$")
_ANNOUNCE = {
    "EMAIL": re.compile(r"(?i)(?:e-?mail|mailto|contact|write to|correo|courriel)\W{0,4}$"),
    "PHONE": re.compile(r"(?i)(?:tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono)\w*\W{0,4}$"),
    "IP": re.compile(r"(?i)(?:\bip|address|host|server|from)\W{0,4}$"),
    "CARD": re.compile(r"(?i)(?:card|visa|mastercard|amex|credit|account|tarjeta|carte|karte)\w*\W{0,4}$"),
    "NATIONAL_ID": re.compile(r"(?i)(?:ssn|social security|tax id)\W{0,4}$"),
    "IBAN": re.compile(r"(?i)(?:iban|account|konto)\W{0,4}$"),
    "SECRET": _SECRET_WORDS,
}
_NOT_PRIVATE = re.compile(r"(?i)(?:\bv|version|release|build|section|§|isbn|issn|doi|rfc|page|figure|table|commit|sha\d*|md5|checksum)\W{0,3}$")
_STRICT_MAIL = re.compile(r"[A-Za-z0-9À-ž._%+\-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$")
_STRICT_PHONE = re.compile(r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)|\d{2,4})[\s.-]\d{2,4}(?:[\s.-]\d{2,4}){0,3}$")

_COUNTRY = re.compile(r"\+\d{1,3}[\s.(-]{1,2}$")
_QUAD = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}$")


@dataclass
class Span:
    start: int
    end: int
    kind: str
    votes: tuple[int, ...] = ()
    features: tuple[int, ...] = ()
    chance: float = 0.0


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _form(kind: str, span: str, digits: str) -> int:
    """Labeler: the strict form of the kind."""
    if kind == "EMAIL":
        return 1 if len(span) <= 320 and _STRICT_MAIL.match(span) else -1
    if kind == "IP":
        return 1 if all(int(x) < 256 for x in span.split(".")) else -1
    if kind == "CARD":
        return 1 if 13 <= len(digits) <= 19 and re.fullmatch(r"\d+|\d{4}([ -]\d{4}){2,3}([ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5}", span) else -1
    if kind == "PHONE":
        return 1 if 7 <= len(digits) <= 15 and (_STRICT_PHONE.match(span) or span.startswith("+")) and not _QUAD.match(span) else -1
    if kind == "NATIONAL_ID":
        return 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
    if kind == "IBAN":
        return 1 if 15 <= len(span.replace(" ", "")) <= 34 else -1
    kinds = any(c.isdigit() for c in span) + any(c.islower() for c in span) + any(c.isupper() for c in span)
    return 1 if kinds >= 2 and len(digits) >= 2 and len(set(span)) >= 8 else -1


def _check(kind: str, span: str, digits: str) -> int:
    """Labeler: check digits, or what an arbitrary string of the form seldom has. No opinion rather than a no where
    a failed check is weak evidence."""
    if kind == "CARD":
        return 1 if _luhn(digits) else 0
    if kind == "IBAN":
        return 1 if _mod97(span.replace(" ", "")) else -1
    if kind == "SECRET":
        return 1 if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ghp_|sk-|xox)\S+", span) else 0
    if kind == "PHONE":
        return 1 if span.startswith(("+", "(")) else 0
    if kind == "IP":
        return -1 if span.startswith(("0.", "127.", "255.")) else 0
    return 0


def _gazetteer(kind: str, span: str, digits: str, before: str) -> int:
    """Labeler: lists of known parts and of announcing words."""
    if kind == "EMAIL":
        host = span.rpartition("@")[2].lower().split(".")
        return 1 if host[-1] in _ENDINGS or any(re.sub(r"\d+$", "", h) in _HOSTS for h in host) else 0
    if kind == "CARD" and digits[0] in "3456":
        return 1
    return 1 if _ANNOUNCE[kind].search(before) else 0


def _isolated(text: str, start: int, end: int) -> int:
    """Labeler: stands alone between white space or sentence punctuation."""
    left = text[start - 1] if start else " "
    right = text[end] if end < len(text) else " "
    if left.isalnum() or right.isalnum() or left in "/\\=&?" and right in "/\\=&?":
        return -1
    if right in "-./:" and text[end + 1 : end + 2].isdigit() or left in "-./:" and text[max(0, start - 2) : start - 1].isdigit():
        return -1
    return 1 if (left.isspace() or left in "\"'([{<:,;|=") and (right.isspace() or right in "\"')]}>,.;:!?|*#%&$") else 0


def _context(before: str) -> int:
    """Labeler: a word before that belongs to versions, references and checksums."""
    return -1 if _NOT_PRIVATE.search(before) else 0


def _table(text: str, start: int, end: int) -> int:
    """Labeler: the neighbours are numbers too, as in a table, or they are words."""
    left, right = text[max(0, start - 24) : start].split(), text[end : end + 24].split()
    near = [x for x in (left[-1:] + right[:1])]
    numbers = sum(any(c.isdigit() for c in x) for x in near)
    return -1 if near and numbers == len(near) else 1 if near and not numbers else 0


N_LABELERS = 6


def _describe(text: str, s: Span) -> None:
    """Votes and features of a proposed span."""
    span = text[s.start : s.end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = text[max(0, s.start - 32) : s.start]
    s.votes = (_form(s.kind, span, digits), _check(s.kind, span, digits), _gazetteer(s.kind, span, digits, before), _isolated(text, s.start, s.end), _context(before), _table(text, s.start, s.end))
    n = len(span)
    left = text[s.start - 1] if s.start else " "
    right = text[s.end] if s.end < len(text) else " "
    s.features = (
        KINDS.index(s.kind),
        int(n >= 10) + int(n >= 15) + int(n >= 25),
        int(4 * len(digits) / n),
        int(any(c.isalpha() for c in span)),
        int(any(c in " -()" for c in span)),
        0 if left.isspace() else 1 if left in "\"'" else 2,
        0 if right.isspace() else 1 if right in ".,;:!?" else 2,
        int(bool(_ANNOUNCE[s.kind].search(before))),
        int(bool(_NOT_PRIVATE.search(before))),
        int(any(c.isdigit() for c in before[-12:])),
    )


#: Number of values of each feature.
_LEVELS = (len(KINDS), 4, 5, 2, 2, 3, 3, 2, 2, 2)


def _bounds(kind: str, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Where a pattern matches; for kinds in groups also from each later group, and up to the end of each earlier one."""
    if kind == "EMAIL":  # runs on either side of an at sign: each character is looked at a few times, however long they are
        left = (0, 0)
        for m in pattern.finditer(text):
            a, b = m.span()
            if left[1] == a - 1 and left[0] < left[1] and text[a - 1] == "@":
                yield left[0], b
            left = (a, b)
        return
    if kind not in _GROUPED:
        yield from (m.span() for m in pattern.finditer(text))
        return
    for m in _GROUPED[kind].finditer(text):
        a, b = m.span(1)
        if kind == "PHONE" and _COUNTRY.search(text[max(0, a - 6) : a]):
            continue  # the number begins with its country code
        yield a, b
        for e in range(a + 5, b):
            if text[e - 1].isalnum() and not text[e].isalnum() and pattern.fullmatch(text, a, e):
                yield a, e


def foremost(spans: list[Span]) -> list[Span]:
    """The spans without those that overlap one with more votes; of as many votes the longer, then the first stays."""
    return apart(sorted(spans, key=lambda s: (-sum(s.votes), s.start - s.end)))


def apart(spans: list[Span]) -> list[Span]:
    """The spans, in the given order, without those that overlap one kept before; ordered by start."""
    starts: list[int] = []
    kept: list[Span] = []
    for s in spans:
        k = bisect.bisect_left(starts, s.end)  # those before k start before this one ends
        if k == 0 or kept[k - 1].end <= s.start:
            starts.insert(k, s.start)
            kept.insert(k, s)
    return kept


def propose(text: str) -> list[Span]:
    """Spans with votes and features; those of all kinds may overlap."""
    found: list[Span] = []
    for kind, pattern in _PROPOSE:
        if kind == "EMAIL" and "@" not in text:
            continue
        seen: set[tuple[int, int]] = set()
        for a, b in _bounds(kind, pattern, text):
            while b > a and text[b - 1] in _TRIM:
                b -= 1
            while a < b and text[a] in _TRIM:
                a += 1
            if b - a < 5 or (a, b) in seen:
                continue
            seen.add((a, b))
            s = Span(a, b, kind)
            _describe(text, s)
            found.append(s)
    return found


# -- model


@dataclass
class Model:
    """prior: chance of private for each kind; right: for each kind and labeler the chances of a vote (-1, 0, 1) for private spans and others."""

    prior: dict[str, float] = field(default_factory=dict)
    right: dict[str, np.ndarray] = field(default_factory=dict)
    weights: np.ndarray | None = None
    known: dict[tuple, float] = field(default_factory=dict)

    def votes_chance(self, kind: str, votes: tuple[int, ...]) -> float:
        if kind not in self.prior:
            total = sum(votes)
            return 1 / (1 + np.exp(-2.0 * total))
        odds = np.log(self.prior[kind] / (1 - self.prior[kind]))
        for k, v in enumerate(votes):
            odds += np.log(self.right[kind][k, 1, v + 1] / self.right[kind][k, 0, v + 1])
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    def chance(self, s: Span) -> float:
        """Looked up by (kind, votes, features), of which there is a bounded number."""
        key = (s.kind, s.votes, s.features)
        if key not in self.known:
            self.known[key] = self._chance(s)
        return self.known[key]

    def _chance(self, s: Span) -> float:
        p = min(max(self.votes_chance(s.kind, s.votes), 1e-6), 1 - 1e-6)
        odds = np.log(p / (1 - p))
        if self.weights is not None:
            odds = (odds + float(_one_hot([s.features])[0] @ self.weights)) / 2
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    def find(self, text: str) -> list[Span]:
        spans = propose(text)
        for s in spans:
            s.chance = self.chance(s)
        return apart(sorted((s for s in spans if s.chance > 0.5), key=lambda s: (s.kind != "IBAN" or s.votes[1] < 1, -s.chance, s.start - s.end, s.start)))


def _one_hot(rows: list[tuple[int, ...]]) -> np.ndarray:
    base = np.concatenate([[0], np.cumsum(_LEVELS)])
    x = np.zeros((len(rows), int(base[-1]) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        for k, v in enumerate(r):
            x[i, base[k] + v] = 1
    return x


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = 100, smooth: float = 1.0) -> tuple[float, np.ndarray]:
    """(prior, chances of each labeler's votes given other / private) from counts of vote patterns.

    The start is the majority; Dirichlet pseudo-counts that hold a labeler for better than chance keep a kind of which
    hardly any other span exists from splitting its private spans in two.
    """
    votes = np.array(list(patterns), np.int64).reshape(len(patterns), -1)
    count = np.array(list(patterns.values()), float)
    total = votes.sum(1)
    q = np.where(total > 0, 0.95, np.where(total < 0, 0.05, 0.5))
    labelers = votes.shape[1]
    strength = smooth * max(1.0, 0.02 * count.sum())
    pseudo = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]) * strength
    prior, right = 0.5, np.zeros((labelers, 2, 3))
    for _ in range(rounds):
        old = q
        prior = float(((q * count).sum() + strength) / (count.sum() + 2 * strength))
        for k in range(labelers):
            for v in (-1, 0, 1):
                at = votes[:, k] == v
                right[k, 1, v + 1] = (count * q)[at].sum() + pseudo[1, v + 1]
                right[k, 0, v + 1] = (count * (1 - q))[at].sum() + pseudo[0, v + 1]
        right /= right.sum(2, keepdims=True)
        odds = np.log(prior / (1 - prior)) + sum(np.log(right[k, 1, votes[:, k] + 1] / right[k, 0, votes[:, k] + 1]) for k in range(labelers))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(q - old).max() < 1e-6:
            break
    return prior, right


def logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on chances p, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - mu)) - ridge * w
        hess = (x * (weight * mu * (1 - mu) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(counts: dict[tuple[str, tuple[int, ...], tuple[int, ...]], int]) -> Model:
    model = Model()
    for kind in KINDS:
        patterns: Counter = Counter()
        for (k, votes, _), n in counts.items():
            if k == kind:
                patterns[votes] += n
        if patterns:
            model.prior[kind], model.right[kind] = expectation_maximisation(patterns)
    if counts:
        soft: dict[tuple[int, ...], list[float]] = {}
        for (kind, votes, features), n in counts.items():
            s = soft.setdefault(features, [0.0, 0.0])
            s[0] += n
            s[1] += n * model.votes_chance(kind, votes)
        weight = np.array([s[0] for s in soft.values()])
        model.weights = logistic(_one_hot(list(soft)), np.array([s[1] for s in soft.values()]) / weight, weight)
    return model


# -- Spark


def _suspects(text: pa.Array) -> np.ndarray:
    """Rows with a digit or an at sign: no proposal is without."""
    data, off = common.as_bytes(text)
    seen = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64), dtype=np.int64)])
    return np.flatnonzero(seen[off[1:]] > seen[off[:-1]])


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The model from the foremost of all proposed spans of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for whole in batches:
            for part in common.slices(whole):
                text = part.column(0)
                for x in text.take(pa.array(_suspects(text))).to_pylist():
                    counts.update((s.kind, s.votes, s.features) for s in foremost(propose(x)))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([list(k[1]) for k in keys], pa.list_(pa.int32())), pa.array([list(k[2]) for k in keys], pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())],
            ["kind", "votes", "features", "n"],
        )

    seen = docs.select(common.column(text_col).cast("string").alias("text")).filter("text is not null").mapInArrow(common.tidy(run), "kind string, votes array<int>, features array<int>, n long")
    # at most one row for each kind, votes and features: bounded by their numbers of values
    rows = seen.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect()
    return learn({(r["kind"], tuple(r["votes"]), tuple(r["features"])): r["n"] for r in sorted(rows, key=lambda r: (r["kind"], tuple(r["votes"]), tuple(r["features"])))})


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char, kind, chance, span) of each private span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in common.slices(whole):
                ids, rows, text = part.column(0), [], part.column(1)
                for i in _suspects(text).tolist():
                    x = text[i].as_py()
                    rows += [(i, s.start, s.end, s.kind, s.chance, x[s.start : s.end]) for s in model.find(x)]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], ["doc_id", "start_char", "end_char", "kind", "chance", "span"])

    return common.ids_and_text(docs, id_col, text_col).filter("text is not null").mapInArrow(common.tidy(run), "doc_id long, start_char int, end_char int, kind string, chance double, span string")


def redact(docs: DataFrame, model: Model, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with each private span replaced by its kind in brackets; length_col, where it exists, follows for changed texts."""
    has_length = length_col in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in common.slices(whole, text_col):
                t = part.schema.get_field_index(text_col)
                text, new, rows = part.column(t), [], []
                for i in _suspects(text).tolist():
                    x, at, out = text[i].as_py(), 0, []
                    for s in model.find(x):
                        out += [x[at : s.start], f"[{s.kind}]"]
                        at = s.end
                    if out:
                        rows.append(i)
                        new.append("".join(out) + x[at:])
                if rows:
                    cols = list(part.columns)
                    touched = np.zeros(part.num_rows, bool)
                    touched[rows] = True
                    mask = pa.array(touched)
                    cols[t] = pc.replace_with_mask(text, mask, pa.array(new, text.type))
                    if has_length:
                        k = part.schema.get_field_index(length_col)
                        cols[k] = pc.if_else(mask, pc.utf8_length(cols[t]).cast(cols[k].type), cols[k])
                    part = pa.RecordBatch.from_arrays(cols, schema=part.schema)
                yield part

    return docs.mapInArrow(common.tidy(run), docs.schema)
