"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds choose redactions.

Four base kinds (email, ip, card, phone) are defined by patterns and checks and always stand. Further generators
propose anything that might be personal or secret, with overlaps. Gradient-boosted trees, trained here on
generated examples, score each proposal by its format and its context; a threshold for each kind, set on examples
that the trees have not seen, decides.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "secret", "ssn")
KINDS = BASE + MORE

# The base patterns.
_LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generators: wide on purpose.
_DIGIT = re.compile(r"[0-9]")
_HIDDEN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{2,24})+", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:(?:\([0-9]{2,5}\)|00[0-9]{1,3}|[0-9]{2,5})[ ./-][0-9]{3,4}(?:[ ./-][0-9]{2,4}){1,2}|0[0-9]{2,4}[ ./-][0-9]{5,8})(?![0-9])")
_OTHER_IP = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}|[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?\[dot\] ?)[0-9]{1,3}){3})(?![0-9A-Za-z:])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_NAMED_SECRET = re.compile(r"(?:token|key|secret|passw(?:or)?d|passphrase|pwd|credential|auth)[a-z_-]{0,12}[\"']? ?(?:=|:|:=|=>) ?[\"'`]?([^\s\"'`,;<>]{6,})", re.I)
_BLOB = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_SIGNS = re.compile(r"[=:]")

#: Words that speak for and against a kind, sought before a proposal.
_FOR = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "cell", "contact", "reach"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "credential", "bearer"),
    "ssn": ("ssn", "social", "security", "tax id", "taxpayer"),
}
_AGAINST = ("order", "part", "version", "item", "ref", "page", "isbn", "serial", "model", "sha", "commit", "md5", "checksum", "score", "date", "invoice", "lot", "section")
_BEFORE, _AFTER = 32, 8
#: No proposal less likely than this is a span, whatever its kind's threshold.
LEAST = 0.25

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Check digit of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _emails(text: str) -> Iterator[Span]:
    """Matches of local part, @ and dotted domain, found from each @, so that time grows with the text alone."""
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        start = end + len(before.rstrip(_LOCAL_PART))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        end = m.end() if m else at + 1
        at = text.find("@", end)


def _ips(text: str) -> Iterator[Span]:
    """Four dotted numbers at a time of each dotted run."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                yield "ip", at, at + size
            at += size + 1


def base_spans(text: str | None) -> list[Span]:
    """The base kinds: leftmost non-overlapping matches of each kind; those that fail its check are dropped."""
    out: list[Span] = []
    if not text:
        return out
    out += _emails(text)
    if _DIGIT.search(text):
        if "." in text:
            out += _ips(text)
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_only_digits(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return _sorted(out)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def proposals(text: str | None) -> list[Span]:
    """What the wide generators propose beyond the base spans; spans may overlap each other."""
    out: list[Span] = []
    if not text:
        return out
    if "at" in text.lower() and ("[" in text or "(" in text):
        out += [("email", *m.span()) for m in _HIDDEN_EMAIL.finditer(text)]
    if ":" in text or "." in text:
        out += [("ip", *m.span()) for m in _OTHER_IP.finditer(text)]
    if _SIGNS.search(text):
        out += [("secret", *m.span(1)) for m in _NAMED_SECRET.finditer(text)]
    if _DIGIT.search(text):
        out += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        out += [("iban", *m.span()) for m in _IBAN.finditer(text)]
        out += [("secret", *m.span()) for m in _BLOB.finditer(text) if _DIGIT.search(m[0])]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(_only_digits(m[0])) <= 19:
                out.append(("card", *m.span()))
    return list(dict.fromkeys(out))


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a proposal."""
    kind, start, end = span
    s = text[start:end]
    n = len(s)
    digits, upper = sum("0" <= c <= "9" for c in s), sum("A" <= c <= "Z" for c in s)
    lower = sum("a" <= c <= "z" for c in s)
    seen = Counter(s)
    entropy = -sum(v / n * np.log2(v / n) for v in seen.values())
    turns = sum(("0" <= a <= "9") != ("0" <= b <= "9") for a, b in zip(s, s[1:], strict=False))
    before, after = text[max(0, start - _BEFORE) : start].lower(), text[end : end + _AFTER]
    d = _only_digits(s)
    near = before[-14:]
    return [
        *(float(kind == k) for k in KINDS),
        float(n),
        digits / n,
        upper / n,
        lower / n,
        (n - digits - upper - lower) / n,
        len(seen) / n,
        float(entropy),
        turns / n,
        float(len(d)),
        float(14 <= len(d) <= 19 and luhn(d)),
        float(kind == "iban" and _mod97(s)),
        float(s.count(":")),
        float("::" in s),
        float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float(any(w in before for w in _FOR[kind])),
        float(any(w in near for w in _FOR[kind])),
        float(any(w in before for w in _AGAINST)),
        float(any(w in near for w in _AGAINST)),
        float(before[-1:] in ("", " ", "\n")),
        float(before[-1:] in ('"', "'", "`")),
        float(bool(re.search(r"[:=] ?[\"'`]?$", before))),
        float(before[-1:] in ("/", "#", "-", ".", "_")),
        float(after[:1] in ("", " ", "\n", ".", ",", ";", '"', "'")),
    ]


@dataclass
class Tree:
    """A regression tree of fixed depth, stored level by level."""

    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.value)))):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.column[node]] > self.cut[node])
        return self.value[node - (len(self.value) - 1)]


@dataclass
class BoostedTrees:
    """Gradient boosting with the logistic loss."""

    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.25, least: int = 8, ridge: float = 1.0) -> BoostedTrees:
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        model = cls(float(np.log(p / (1 - p))))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 25)[1:-1])) for c in x.T]
        sides = [[x[:, j] > c for c in cuts[j]] for j in range(x.shape[1])]
        s = np.full(len(y), model.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-s))
            tree = cls._grow(sides, cuts, y - p, p * (1 - p), depth, least, ridge, rate)
            model.trees.append(tree)
            s = s + tree(x)
        return model

    @staticmethod
    def _grow(sides: list, cuts: list, g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float, rate: float) -> Tree:
        inner = 2**depth - 1
        column, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        rows = {0: np.ones(len(g), bool)}
        for node in range(inner):
            mine = rows.pop(node)
            best, at, right = 1e-6, None, None
            whole_g, whole_h = g[mine].sum(), h[mine].sum()
            for j, masks in enumerate(sides):
                for c, mask in zip(cuts[j], masks, strict=True):
                    r = mask & mine
                    k = int(r.sum())
                    if k < least or mine.sum() - k < least:
                        continue
                    gr, hr = g[r].sum(), h[r].sum()
                    gain = gr**2 / (hr + ridge) + (whole_g - gr) ** 2 / (whole_h - hr + ridge) - whole_g**2 / (whole_h + ridge)
                    if gain > best:
                        best, at, right = gain, (j, c), r
            if at:
                column[node], cut[node] = at
            right = np.zeros_like(mine) if right is None else right  # an unsplit node sends all rows left
            for child, part in ((2 * node + 1, mine & ~right), (2 * node + 2, right)):
                if child < inner:
                    rows[child] = part
                else:
                    value[child - inner] = rate * g[part].sum() / (h[part].sum() + ridge)
        return Tree(column, cut, value)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row."""
        s = np.full(len(x), self.start)
        for tree in self.trees:
            s = s + tree(x)
        return 1 / (1 + np.exp(-s))


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeiouaeionrstlndhcm") for _ in range(rng.randint(2, 9))) for _ in range(n))


def _token(rng: random.Random, alphabet: str, lo: int, hi: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi)))


def _card(rng: random.Random) -> str:
    body = _token(rng, "0123456789", 14, 15)
    return next(body + c for c in "0123456789" if luhn(body + c))


def _iban(rng: random.Random) -> str:
    country, body = rng.choice(["DE", "FR", "ES", "GB", "NL", "IT"]), _token(rng, "0123456789", 14, 20)
    return next(x for k in range(100) if _mod97(x := f"{country}{k:02d}{body}"))


_HEX, _ALNUM = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def example(rng: random.Random) -> tuple[str, int, bool]:
    """A generated text, where its value begins, and whether the value is personal or secret."""
    num = lambda n: _token(rng, "0123456789", n, n)
    value, good, names = rng.choice(_EXAMPLES)(rng, num)
    for_it = rng.random() < (0.85 if good else 0.15)
    against = not good and rng.random() < 0.5
    lead = rng.choice(names) if for_it else rng.choice(_AGAINST) + rng.choice([" ", ": ", " no ", "-", "/"]) if against else ""
    glue = rng.choice([" ", ": ", " is ", ' = "', ": '"]) if for_it else ""
    before = _words(rng, rng.randint(0, 6)) + " " + lead + glue
    return before + value + rng.choice(["", ".", ",", " ", '" ']) + " " + _words(rng, rng.randint(0, 4)), len(before), good


_EXAMPLES: list[Callable] = [
    lambda r, num: (f"{_words(r, 1)} [at] {_words(r, 1)} [dot] com", True, _FOR["email"]),
    lambda r, num: (f"{_words(r, 1)}(at){_words(r, 1)}.org", True, _FOR["email"]),
    lambda r, num: (f"({num(3)}) {num(3)}-{num(4)}", True, _FOR["phone"]),
    lambda r, num: (f"{num(3)}-{num(3)}-{num(4)}", True, _FOR["phone"]),
    lambda r, num: (f"0{num(3)}/{num(3)} {num(4)}", True, _FOR["phone"]),
    lambda r, num: (f"0{num(4)} {num(6)}", True, _FOR["phone"]),
    lambda r, num: (":".join(_token(r, _HEX, 1, 4) for _ in range(8)), True, _FOR["ip"]),
    lambda r, num: (":".join(_token(r, _HEX, 3, 4) for _ in range(r.randint(2, 4))) + "::" + _token(r, _HEX, 1, 4), True, _FOR["ip"]),
    lambda r, num: (r.choice(["[.]", "(.)", "[dot]"]).join(str(r.randint(0, 255)) for _ in range(4)), True, _FOR["ip"]),
    lambda r, num: (":".join(f"{r.randint(0, 59):02d}" for _ in range(3)), False, ("at", "time", "until")),
    lambda r, num: (f"{r.randint(1, 9)}:{r.randint(1, 150)}:{r.randint(1, 50)}", False, ("verse", "ratio")),
    lambda r, num: (_words(r, 1) + num(r.randint(1, 4)) + _words(r, 1), True, ("password", "passwd", "pwd", "passphrase")),
    lambda r, num: (f"{num(3)}.{num(3)}.{num(2)}", False, ("release",)),
    lambda r, num: (f"{num(4)}-{num(3)}-{num(2)}", False, ("release",)),
    lambda r, num: (f"{num(3)}-{num(2)}-{num(4)}", True, _FOR["ssn"]),
    lambda r, num: (f"{num(3)}-{num(2)}-{num(4)}", False, ("catalogue", "code")),
    lambda r, num: (_iban(r), True, _FOR["iban"]),
    lambda r, num: (r.choice(["AB", "XK", "PN", "QZ"]) + num(16), False, ("code",)),
    lambda r, num: (_token(r, _HEX, 32, 64), True, _FOR["secret"]),
    lambda r, num: (_token(r, _HEX, 32, 64), True, _FOR["secret"]),
    lambda r, num: (_token(r, _HEX, 32, 64), False, ("sha", "commit", "md5", "checksum")),
    lambda r, num: (_token(r, _ALNUM, 20, 64), True, _FOR["secret"]),
    lambda r, num: (_token(r, _ALNUM + "!#%&*", 8, 20), True, _FOR["secret"]),
    lambda r, num: (_words(r, 3).replace(" ", "_") + num(2), False, ("name", "path", "file")),
    lambda r, num: (_words(r, 4).replace(" ", "-") + "-" + num(4), False, ("name", "path", "file")),
    lambda r, num: (_words(r, 4).replace(" ", "/") + "/" + num(3), False, ("path", "key", "see")),
    lambda r, num: ("key = " + _words(r, 1) + "ing", False, ("the",)),
    lambda r, num: ("token: " + _words(r, 1) + "ation", False, ("a",)),
    lambda r, num: (_card(r), True, _FOR["card"]),
    lambda r, num: (num(16), False, ("count", "total")),
    lambda r, num: (num(r.randint(12, 19)), False, ("count", "number")),
    lambda r, num: (num(13), False, ("isbn", "ean")),
]


@dataclass
class Detector:
    """Trees and the least score of each kind."""

    trees: BoostedTrees
    least: dict[str, float]

    @classmethod
    def fit(cls, examples: int = 9000, precision: float = 0.95, seed: int = 11) -> Detector:
        """Train on two thirds of the generated examples; on the rest, set for each kind the lowest threshold with this precision, LEAST at least.

        A kind whose precision is never reached gets a threshold that nothing passes.
        """
        rng, rows, labels, kinds = random.Random(seed), [], [], []
        for _ in range(examples):
            text, at, good = example(rng)
            for span in proposals(text):
                rows.append(describe(text, span))
                labels.append(good and span[1] <= at + 2 and span[2] > at + 4)
                kinds.append(span[0])
        x, y, kinds = np.array(rows), np.array(labels, float), np.array(kinds)
        third = np.arange(len(y)) % 3 == 0
        trees = BoostedTrees.fit(x[~third], y[~third])
        score, y, kinds = trees.score(x[third]), y[third], kinds[third]
        least = {}
        for kind in KINDS:
            s, t = score[kinds == kind], y[kinds == kind]
            order = np.argsort(-s, kind="stable")
            right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
            ends = np.append(s[order][1:] < s[order][:-1], True) if len(order) else np.empty(0, bool)  # ties stand or fall together
            ok = np.nonzero((right >= precision) & ends)[0]
            least[kind] = max(LEAST, float(s[order][ok[-1]])) if len(ok) else 2.0
        return cls(trees, least)

    def find(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans): the base ones and, of what else passes its threshold, the best that overlap nothing better."""
        base = base_spans(text)
        known = set(base)
        found = [p for p in proposals(text) if p not in known]
        if not found:
            return base, base
        score = self.trees.score(np.array([describe(text, p) for p in found]))
        taken, covered = list(base), bytearray(len(text))
        for _, b, e in base:
            covered[b:e] = b"\x01" * (e - b)
        for s, span in sorted(zip(score.tolist(), found, strict=True), key=lambda q: (-q[0], q[1][1], KINDS.index(q[1][0]), q[1][2])):
            if s >= self.least[span[0]] and covered.find(1, span[1], span[2]) < 0:
                taken.append(span)
                covered[span[1] : span[2]] = b"\x01" * (span[2] - span[1])
        return base, _sorted(taken)


@cache
def default_detector() -> Detector:
    """The detector of the default examples, trained once in a process."""
    return Detector.fit()


SPAN_TYPE = "kind string, start int, end int"


def redact_text(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def with_pii(docs: DataFrame, text_col: str = "text", into: str = "pii", detector: Detector | None = None, redacted: bool = False) -> DataFrame:
    """``docs`` with a struct ``into``: base and spans, arrays of (kind, start, end) in code points, end exclusive.

    Spans are ordered by start, then kind. Null and empty texts have none. With ``redacted`` the struct also holds
    the text with every span replaced (null stays null). All rows and columns stay; an empty table gives an empty
    result. The detector is trained on generated examples only and is the same for every table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector or default_detector())
    schema = f"base array<struct<{_fields()}>>, spans array<struct<{_fields()}>>" + ", redacted string" * redacted

    @F.pandas_udf(schema)
    def detect(texts: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {"base": [], "spans": []} | ({"redacted": []} if redacted else {})
        row = lambda spans: [{"kind": k, "start": b, "end": e} for k, b, e in spans]
        for text in texts:
            base, spans = shared.value.find(text)
            out["base"].append(row(base))
            out["spans"].append(row(spans))
            if redacted:
                out["redacted"].append(redact_text(text, spans) if spans else text)
        return pd.DataFrame(out)

    return docs.withColumn(into, detect(F.col(text_col)))


def _fields() -> str:
    return ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in SPAN_TYPE.split(", "))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text_col: str = "text", detector: Detector | None = None) -> DataFrame:
    """``docs`` with their own columns and every span of personal data replaced in the text."""
    found = with_pii(docs, text_col, "__pii", detector, redacted=True)
    return found.withColumn(text_col, F.col("__pii.redacted")).drop("__pii")


def digest(spans: list[Span]) -> str:
    """SHA-256 of the spans' text, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
