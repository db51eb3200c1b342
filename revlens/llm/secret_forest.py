"""Operator 7: secret scans with a random forest that removes false findings.

Candidates are, the first of them where they overlap: whole PEM blocks; user
information in URLs; values of any length and characters that are assigned to a
credential's name; dotted tokens of three parts or more; runs of 12 or more
letters, digits, ``+ / _ -`` (and closing ``=``) with a digit in them.  Each is
described by which of these it is, its length, lines, shares and
transitions of character classes, entropy, how much of its letters the rest of
the document uses as words (dictionary coverage), path marks around it and the
word before it.  A random forest tells secrets from other findings.

The forest is trained from labelled findings, at most ``per_class`` of either
label and sort (those with the smallest hash of place and id); sorts with few of
them count as ``least_rows``.  A caller can pass a table
of them (id, start, label).  Without one, the labels come from ``rule_label``,
fixed formats of well-known keys, private keys, passwords in URLs and
assignments to credential names; the forest sees neither the formats nor the rule.

Scanning and redaction are one pass over whole texts without a shuffle.

Defined cases: null or empty texts have no candidates and stay as they are;
null ids are scanned; repeated rows are scanned each by itself; without
findings of both labels nothing is a secret, unless all findings are; extra
columns are kept by ``redact`` and ignored by ``scan``; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revlens.llm.common import bound_batches, cut

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}", re.ASCII)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----(?:.*?-----END \1-----|[A-Za-z0-9+/=\s\\]*)", re.S)
URL_USER = re.compile(r"://([^\s/?#\"'<>]+)@(?=[A-Za-z0-9\[])", re.ASCII)
ASSIGNED = re.compile(r"(?<![A-Za-z0-9_\-])([A-Za-z][A-Za-z0-9_\-]{1,60})[\"']?[ \t]{0,4}(?::=|=>|[=:])[ \t]{0,4}"
                      r"(?:\"((?:[^\"\\\n]|\\.)+)\"|'((?:[^'\\\n]|\\.)+)'|([^\s\"'`]+))", re.ASCII)
DOTTED = re.compile(r"(?<![A-Za-z0-9_.\-])[A-Za-z0-9_\-]{2,}(?:\.[A-Za-z0-9_\-]{6,}){2,}", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_DIGIT = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[A-Za-z]{3,}")
_BEFORE = re.compile(r"([A-Za-z_\-]+)\W{0,4}$", re.ASCII)
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")

# fixed values: words that name credentials or plain digests
CREDENTIAL_WORDS = ("key", "token", "secret", "password", "passwd", "pwd", "credential", "auth", "bearer", "apikey")
DIGEST_WORDS = ("sha", "md5", "commit", "checksum", "digest", "hash", "uuid", "id", "isbn", "phone", "card")
# fixed values: published formats of access keys
STRONG_WORDS = ("token", "secret", "password", "passwd", "passphrase", "pwd", "credential", "apikey", "accesskey",
                "secretkey", "privatekey")
# fixed values: what stands where a secret is left out
NO_SECRETS = frozenset("none null nil true false undefined str string bytes int optional xxx todo changeme".split())
KEY_FORMATS = (r"AKIA[0-9A-Z]{16}", r"ASIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"sk_live_[A-Za-z0-9]{16,}",
               r"xox[abprs]-[A-Za-z0-9-]{10,}", r"AIza[A-Za-z0-9_-]{35}", r"glpat-[A-Za-z0-9_-]{20}",
               r"eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+){1,4}")
_FORMAT = re.compile("|".join(f"(?:{f})" for f in KEY_FORMATS))

MASK = "[SECRET]"
_FINDINGS = "array<struct<start:int,length:int,score:double>>"


def _credential(name: str) -> bool:
    """Whether a name's last part is a credential's (api_key, dbPassword; not author or monkey)."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    while len(parts) > 1 and parts[-1].isdigit():
        parts.pop()
    last = parts[-1].removesuffix("s") if parts else ""
    return last in CREDENTIAL_WORDS or last.endswith(STRONG_WORDS)


def _strong(name: str) -> bool:
    return any(w in "".join(_PARTS.findall(name)).lower() for w in STRONG_WORDS)


def _value(m) -> tuple[int, int, str] | None:
    """(begin, end, name) of the value in a match of ASSIGNED, if a credential's name has one."""
    if not _credential(m[1]):
        return None
    group = 2 if m[2] else 3 if m[3] else 4
    a, b = m.span(group)
    s = m[group]
    if group == 4:
        if m.string[max(0, m.start() - 1):m.start()] in ("?", "&"):
            s = re.split("[&#]", s)[0]
        s = s.rstrip(",;.)]}>")
        b = a + len(s)
    elif any(c.isspace() for c in s) and not _strong(m[1]):
        return None  # a text of some words; runs in it are candidates by themselves
    return (a, b, m[1]) if s and s != MASK else None


def _spans(text: str):
    """(begin, end, sort, name) of what may be secrets, in order of rank."""
    if "-----BEGIN " in text:
        yield from ((m.start(), m.end(), 4, m[1]) for m in PEM.finditer(text))
    if "://" in text:
        yield from ((m.start(1), m.end(1), 3, "") for m in URL_USER.finditer(text))
    at = 0
    while m := ASSIGNED.search(text, at):
        v = _value(m)
        if v:
            yield v[0], v[1], 2, v[2]
        at = v[1] if v else m.end(1)  # the value of another name may hold an assignment
    yield from ((m.start(), m.end(), 1, "") for m in DOTTED.finditer(text) if _DIGIT.search(m[0]))
    yield from ((m.start(), m.end(), 0, "") for m in CANDIDATE.finditer(text) if _DIGIT.search(m[0]))


def sorted_candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(begin, end, sort, name) of the candidates, none overlapping, by place."""
    found = sorted((a, -k, b, name) for a, b, k, name in _spans(text))
    if not found:
        return []
    out: list[tuple[int, int, int, str]] = []
    for k in (4, 3, 2, 1, 0):  # of overlapping ones the first sort
        own = [(a, b, -j, name) for a, j, b, name in found if -j == k]
        if not own:
            continue
        merged, i = [], 0
        for x in own:
            while i < len(out) and out[i][1] <= x[0]:
                merged.append(out[i])
                i += 1
            if (i == len(out) or out[i][0] >= x[1]) and (not merged or merged[-1][1] <= x[0]):
                merged.append(x)
        out = merged + out[i:]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b, _, _ in sorted_candidates(text)]


def _names(before: str, words) -> bool:
    return any(w in before for w in words)


def describe(text: str, begin: int, end: int, sort: int = 0, name: str = "") -> list[float]:
    """Features of a candidate; see the module's text."""
    s = text[begin:end]
    n = len(s)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    counts = {c: s.count(c) for c in set(s)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    left, right = text[max(0, begin - 40):begin], text[end:end + 2]
    m = _BEFORE.search(left)
    before = name.lower() or (m[1].lower() if m else "")
    low = text.lower()
    known = sum(len(w) for w in _LETTERS.findall(s) if low.count(w.lower()) > 1)
    digits = [int(c) for c in s if c.isdigit()]
    luhn = 0.0
    if len(digits) == n:
        doubled = [d if (n - i) % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)]
        luhn = float(sum(doubled) % 10 == 0)
    return [float(n), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, entropy,
            sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), float(bool(_HEX.fullmatch(s))), len(counts) / n,
            known / n, float("/" in s) + float("/" in left[-1:] + right[:1]), float("@" in left[-1:] + right[:1]),
            float(left[-1:] in "=:\"'" and left != ""), float(right[:1] in "\"'" and right != ""),
            float(_names(before, CREDENTIAL_WORDS)), float(_names(before, DIGEST_WORDS)), luhn,
            float(kinds.count("o") / n), float(sort), float(s.count("\n")), float("private" in before or _strong(name)),
            float(any(c.isspace() or c in "()[]{}$" for c in s)), float(":" in s), float(s.lower() in NO_SECRETS)]


def rule_label(text: str, begin: int, end: int, sort: int | None = None, name: str = "") -> int:
    """Label of a finding by fixed rules: 1 for published key formats, private keys, passwords in URLs and values
    assigned to a credential's name."""
    if sort is None:
        sort, name = next(((k, x) for a, b, k, x in sorted_candidates(text) if (a, b) == (begin, end)), (0, ""))
    s = text[begin:end]
    if _FORMAT.fullmatch(s):
        return 1
    if sort == 4:
        return int("PRIVATE KEY" in name)
    if sort == 3:
        user, colon, password = s.partition(":")
        return int(bool(_FORMAT.fullmatch(user)) or bool(password) and password[0] not in "$<{" and password != MASK)
    if sort == 2 and _strong(name) and s.lower() not in NO_SECRETS and s[0] not in "$<{":
        if text[begin - 1:begin] in ("'", '"') and text[end:end + 1] == text[begin - 1:begin]:
            return 1
        if not re.search(r"[()\[\]{}]|^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+$", s):  # no expression of a program
            mixed = any(c.isalpha() for c in s) and any(not c.isalpha() and c not in "_.-" for c in s)
            return int(mixed or (s.isalpha() and len(s) >= 12))
    left = text[max(0, begin - 40):begin]
    m = _BEFORE.search(left)
    assigned = re.search(r"[=:]\s*[\"']?$", left) is not None
    return int(bool(m and assigned and _names(m[1].lower(), CREDENTIAL_WORDS)
                    and sum(c.isdigit() for c in s) >= 2 and not s.isdigit()))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in leaves), bound, children, share of label 1."""
    trees: list

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, bound, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                low = x[inner, feature[node]] <= bound[node]
                at[inner] = np.where(low, left[node], right[node])
            total += value[at]
        return total / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 8, least: int = 4, bins: int = 24,
         seed: int = 5) -> Forest:
    """Random forest: bootstrapped rows, a random root of the features at each split, Gini impurity."""
    if not len(y):
        return Forest([])
    rng = np.random.default_rng(seed)
    some = max(1, int(math.sqrt(x.shape[1])) + 1)
    out = []
    for _ in range(trees):
        feature, bound, left, right, value = [], [], [], [], []

        def build(rows, level):
            node = len(feature)
            share = float(y[rows].mean())
            for col, v in zip((feature, bound, left, right, value), (-1, 0.0, 0, 0, share)):
                col.append(v)
            if level == depth or len(rows) < 2 * least or share in (0.0, 1.0):
                return node
            best = (share * (1 - share) - 1e-9, None, None)
            for f in rng.choice(x.shape[1], some, replace=False):
                v = x[rows, f]
                for b in np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="lower")):
                    low = v <= b
                    k = int(low.sum())
                    if least <= k <= len(rows) - least:
                        p, q = y[rows[low]].mean(), y[rows[~low]].mean()
                        cost = (k * p * (1 - p) + (len(rows) - k) * q * (1 - q)) / len(rows)
                        if cost < best[0]:
                            best = (cost, f, b)
            if best[1] is None:
                return node
            feature[node], bound[node] = int(best[1]), float(best[2])
            low = x[rows, best[1]] <= best[2]
            left[node] = build(rows[low], level + 1)
            right[node] = build(rows[~low], level + 1)
            return node

        build(rng.integers(0, len(y), len(y)), 0)
        out.append(tuple(np.array(c) for c in (feature, bound, left, right, value)))
    return Forest(out)


def _described(batches):
    """Rows (id, text) to one row per candidate: (id, start, label by rule, sort, features)."""
    for batch in batches:
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for a, b, k, name in sorted_candidates(t or ""):
                rows.append((i, a, rule_label(t, a, b, k, name), k, np.array(describe(t, a, b, k, name)).tobytes()))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "start", "label", "sort", "x"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None,
          per_class: int = 1500, least_rows: int = 60, **options) -> Forest:
    """Forest from labelled findings, ``findings`` (id, start, label) or by ``rule_label``."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_described, "id string, start int, label int, sort int, x binary")
    if findings is not None:
        known = findings.select(F.col("id").cast("string"), F.col("start").cast("int"), F.col("label").cast("int"))
        found = found.drop("label").join(known, ["id", "start"])
    found = cut(found)
    place = F.xxhash64("id", "start", "x")
    x, y = [], []
    for value in (0, 1):
        for sort in range(5):
            part = (found.where((F.col("label") == value) & (F.col("sort") == sort)).orderBy(place, "id", "start")
                    .limit(per_class).select("x"))
            own = sorted(bytes(r.x) for r in part.collect())  # at most per_class rows of numbers
            own *= -(-least_rows // len(own)) if own and len(own) < least_rows else 1
            x += own
            y += [value] * len(own)
    if not x:
        return Forest([])
    return grow(np.stack([np.frombuffer(r) for r in x]), np.array(y), **options)


def _found(model: Forest, texts: list, threshold: float):
    """(spans of candidates, scores) for each text."""
    spans = [sorted_candidates(t or "") for t in texts]
    x = [describe(t, *c) for t, own in zip(texts, spans) for c in own]
    score = model.score(np.array(x)) if x else np.zeros(0)
    at = 0
    for own in spans:
        yield [(a, b) for a, b, _, _ in own], score[at:at + len(own)]
        at += len(own)


def mask(text, spans, hit) -> str:
    out, last = [], 0
    for (a, b), h in zip(spans, hit):
        if h:
            out += [text[last:a], MASK]
            last = b
    return "".join(out) + text[last:] if last else text


def scan(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text",
         threshold: float = 0.5) -> DataFrame:
    """One row per document: (doc_id, n_candidates, n_secrets, findings, redacted_sha256)."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                texts = batch.column(1).slice(a, 500).to_pylist()
                n, secrets, rows, digest = [], [], [], []
                for t, (spans, score) in zip(texts, _found(model, texts, threshold)):
                    hit = score >= threshold
                    n.append(len(spans))
                    secrets.append(int(hit.sum()))
                    rows.append([{"start": p, "length": q - p, "score": float(s)}
                                 for (p, q), s, h in zip(spans, score, hit) if h])
                    digest.append(hashlib.sha256(mask(t or "", spans, hit).encode()).hexdigest())
                kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 500), pa.array(n, pa.int64()), pa.array(secrets, pa.int64()),
                     pa.array(rows, kind), pa.array(digest, pa.string())],
                    ["doc_id", "n_candidates", "n_secrets", "findings", "redacted_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_candidates long, n_secrets long, findings {_FINDINGS}, "
                                "redacted_sha256 string")


def redact(docs: DataFrame, model: Forest, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All rows and columns, with secrets in the text replaced by a mask."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [mask(t, spans, score >= threshold) if t else t
                   for t, (spans, score) in zip(texts, _found(model, texts, threshold))]
            cols = list(batch.columns)
            cols[at] = pa.array(new, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return docs.mapInArrow(run, StructType(docs.schema.fields))
