"""Secret scan: patterns of known kinds, then character Markov models of random strings and identifiers.

The patterns give the base spans. What they don't cover is cut into runs of key characters; a run
whose log-likelihood ratio per character - random string over ordinary identifier, two Markov models
of order two - exceeds the threshold calibrated for its length is a span of kind ``random``. The models are
trained from labelled samples: a bounded sample of documents gives identifiers (its ordinary words)
and secrets (values that the patterns found), a seeded generator gives random strings.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# The three base patterns and the fewest characters of a secret.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

#: Runs that the models judge, and the lengths from which on they have a threshold of their own.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
LENGTHS = (12, 16, 20)
#: Longer texts give no samples, so that these are bounded.
SAMPLE_CHARS = 100_000
#: What joins a run to a base span beside it.
JOINERS = "/_=-"
WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(128, 0, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
SYMBOLS = len(ALPHABET) + 1

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns' matches, sorted; kind is an index of KINDS."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def uncovered(spans: list[Span], runs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Each stretch of the runs outside spans, and its run. Both are sorted, and read once."""
    at, covered = 0, 0  # the next span, and the end of those before
    for begin, end in runs:
        start = max(begin, covered)
        while at < len(spans) and spans[at][0] < end:
            if spans[at][0] > start:
                yield start, spans[at][0], begin, end
            covered = max(covered, spans[at][2])
            start = max(start, covered)
            at += 1
        if start < end:
            yield start, end, begin, end


class Markov:
    """Character model of contexts of two, one and no characters, each estimate resting on the next shorter one's."""

    def __init__(self, strings: list[str], strength: float = 4.0):
        n = np.zeros((SYMBOLS,) * 3)
        codes = [encoded(s) for s in strings]
        for at in range(0, len(codes), 4096):
            part = codes[at : at + 4096]
            np.add.at(n, tuple(np.concatenate([c[i : len(c) - 2 + i] for c in part]) for i in range(3)), 1)
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for counts in (n.sum(axis=(0, 1)), n.sum(axis=0), n):
            p = (counts + strength * p) / (counts.sum(axis=-1, keepdims=True) + strength)
        self.log = np.log(p)

    def loglik(self, c: np.ndarray) -> float:
        return float(self.log[c[:-2], c[1:-1], c[2:]].sum())


def encoded(s: str) -> np.ndarray:
    """Symbols of s behind two start marks."""
    return np.r_[0, 0, CODE[np.minimum(np.frombuffer(s.encode("latin-1", "replace"), np.uint8), 127)]]


def random_strings(n: int, seed: int = 7) -> list[str]:
    """Seeded random strings over the alphabets that keys are written in."""
    r = random.Random(seed)
    kinds = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-")
    return ["".join(r.choices(kinds[i % len(kinds)], k=r.randint(20, 64))) for i in range(n)]


def identifiers(words: list[str], n: int, seed: int = 17) -> list[str]:
    """Seeded identifiers of two to four of words, joined as programs do, some with a number."""
    r = random.Random(seed)
    out = []
    for _ in range(n if words else 0):
        parts, sep = r.choices(words, k=r.randint(2, 4)), r.choice(("_", "-", "/", ""))
        parts = [p.capitalize() for p in parts] if not sep else parts
        out.append(sep.join(parts + [str(r.randint(0, 999))] * (r.random() < 0.2)))
    return out


class Detector:
    """Both models and the threshold between them, from labelled strings."""

    def __init__(self, secrets: list[str], ordinary: list[str]):
        fit = lambda x: Markov(x[::2] or x)
        self.secret, self.ordinary = fit(secrets), fit(ordinary)
        # calibrated on the halves held out; runs judged are long, so words are joined to such lengths
        held = ordinary[1::2]
        joined = ["".join(held[i : i + 4])[:64] for i in range(0, len(held), 4)]
        a = sorted(self.score(s) for s in secrets[1::2] if len(s) >= 20)
        b = sorted(self.score(s) for s in joined if len(s) >= 20)
        # halfway between the highest scores of ordinary strings and the lowest of secrets, never below zero
        self.threshold = max(0.0, (a[len(a) // 100] + b[-1 - len(b) // 100]) / 2) if a and b else 0.0
        self.limits = []
        for least, most in zip(LENGTHS[:-1], LENGTHS[1:], strict=True):
            cut = [least + i % (most - least) for i in range(most - least)]
            a = sorted(self.score(s[:n]) for i, s in enumerate(secrets[1::2]) if len(s) >= (n := cut[i % len(cut)]))
            b = [s for s in held if least <= len(s) < most] + [s[:n] for i, s in enumerate(joined) if len(s) >= (n := cut[i % len(cut)])]
            b = sorted(self.score(s) for s in b)
            self.limits.append(max(0.0, (a[len(a) // 100] + b[-1 - len(b) // 100]) / 2) if a and b else self.threshold)
        self.limits.append(self.threshold)

    def limit(self, n: int) -> float:
        """The threshold of a run of n characters."""
        return self.limits[max(0, sum(n >= x for x in LENGTHS) - 1)]

    def score(self, s: str) -> float:
        c = encoded(s)
        return (self.secret.loglik(c) - self.ordinary.loglik(c)) / max(1, len(s))

    def spans(self, text: str) -> list[Span]:
        """All spans of text, those of the models included."""
        out = base_spans(text)
        more = []
        for start, end, first, last in uncovered(out, (m.span() for m in RUN.finditer(text))):
            # a joiner beside a base span belongs to neither
            while start > first and start < end and text[start] in JOINERS:
                start += 1
            while end < last and start < end and text[end - 1] in JOINERS:
                end -= 1
            s = text[start:end]
            if len(s) >= LENGTHS[0] and any(c.isalpha() for c in s) and self.score(s) > self.limit(len(s)):
                more.append((start, 3, end))
        return sorted(out + more)


def train(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> Detector:
    """From the sample_docs different documents that hash lowest by id and text: a bounded sample, the same on every run.

    Rows with a null id and texts of more than SAMPLE_CHARS characters are not sampled; rows that repeat count once.
    """
    key = F.xxhash64(id_col, text_col)
    asked = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS))
    keys = [r[0] for r in asked.select(key.alias("key")).distinct().orderBy("key").limit(sample_docs).collect()]
    rows = asked.where(key.isin(keys)).select(F.col(text_col).alias("text"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list[tuple[str, bool]] = []
            for text in pdf["text"]:
                spans = base_spans(text)
                got += [(re.split(r"[:=]", text[s:e])[-1].strip(" \"'") if k == 0 else text[s:e], True) for s, k, e in spans]
                words = [m.span() for m in WORD.finditer(text) if not any(c.isdigit() for c in m[0])]
                got += [(text[a:z], False) for a, z, *run in uncovered(spans, words) if [a, z] == run]
            yield pd.DataFrame(sorted(set(got)), columns=["s", "secret"]).astype({"s": str, "secret": bool})

    got = rows.mapInPandas(pick, "s string, secret boolean").distinct().collect() if keys else []
    ordinary = sorted(r["s"] for r in got if not r["secret"])
    ordinary += identifiers(ordinary, 2000)
    random.Random(11).shuffle(ordinary)
    secrets = sorted(r["s"] for r in got if r["secret"]) + random_strings(2000)
    random.Random(13).shuffle(secrets)
    return Detector(secrets, ordinary or ["identifier"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 1000) -> DataFrame:
    """(id_col, spans array<struct<kind, start, end>>) of every row, over its whole text.

    start and end are code points, end exclusive; spans are sorted by start, then in the order of
    KINDS. Null and empty texts have no spans; rows that repeat are scanned alike; other columns are
    ignored. A text of any length is scanned once, in time that grows with it. sample_docs bounds the
    different documents that the models learn from, not those scanned.
    """
    small_batches(docs.sparkSession)
    detector = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, sample_docs))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = detector.value
        for pdf in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in d.spans(t or "")] for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "spans": spans})

    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return out.mapInPandas(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)
