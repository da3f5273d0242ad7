"""Personal data: exact base patterns, and a linear-chain conditional random field over word-shape features that adds spans.

Base spans follow fixed patterns and checks (:func:`base_spans`) and always stay.  The field reads tokens by their shape (digits,
letters, punctuation, lengths) and the shapes next to them, with BIO tags of the four kinds.  It is trained on a small table of
labelled token sequences by stochastic gradient on the exact log-likelihood (forward-backward in numpy) and decoded by Viterbi
in numpy batches.  Sequences are stretches of ``REACH`` tokens around each token that holds a digit or an at sign, as nothing else can
be part of such data; a decoded span is added where it overlaps no base span and passes the same plausibility check as its kind.

The labelled table of the query is made from different texts of the documents, those of smallest hash: at most ``LABELLED`` stretches
(the documented bound of the fit; decoding reads every text whole), at most ``OF_TEXT`` a text as they stand with the base spans as
tags, and ``FILLED`` a text with a template put between two words.  ``TEMPLATES`` are personal data in forms that the patterns miss
(other separators, no plus sign), with their tags, and numbers that are none (dates, amounts, versions).  Stretches whose numbers
could be personal data but aren't base spans have no known label and are left out.

Null or empty texts have no spans.  Rows are independent: repeated rows, null ids and extra columns don't matter.  With an empty
labelled table the field adds nothing.
"""

from __future__ import annotations

import hashlib
import random
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import query, table

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: The base patterns, as given.
EMAIL = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = regex.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches without trying every digit of a long run as a start: a match starts where a number starts.
IP_STARTS = regex.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = regex.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, HINT, TOKEN = regex.compile("[0-9]"), regex.compile("[0-9@]"), regex.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
#: Tokens kept on either side of a token with a digit or an at sign; labelled stretches; training passes.
REACH, LABELLED, EPOCHS = 3, 400, 6
OF_TEXT, FILLED = 2, 4
#: Kind (None: no personal data) and form of what is put into texts; # is a digit.
TEMPLATES = (
    ("phone", "###-###-####"), ("phone", "(###) ###-####"), ("phone", "###.###.####"), ("phone", "### ### ####"), ("phone", "00## ### ### ####"),
    ("phone", "1-###-###-####"), ("card", "####.####.####.####"), ("card", "####/####/####/####"), ("card", "####_####_####_####"),
    ("card", "####  ####  ####  ####"), ("card", "####--####--####--####"), ("phone", "+# ### ### ####"), ("card", "#### #### #### ####"),
    (None, "####-##-##"), (None, "##/##/####"), (None, "##:##:##"), (None, "#.#.##"), (None, "#,###.##"), (None, "####"), (None, "##%"),
    (None, "####-##-##T##:##:##"), (None, "###,###,###"), (None, "##.#"), (None, "########"), (None, "####-####"), (None, "# of ###"),
)
#: Texts are searched for stretches in windows around their hints of so many characters.
MARGIN = 80
BUCKETS = 1 << 12


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def passes(kind: str, found: str) -> bool:
    if kind == "ip":
        numbers = [p.lstrip("0") for p in found.split(".")]
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in numbers)
    digits = "".join(DIGIT.findall(found))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``kind, start, end`` by start, then kind as listed; leftmost and non-overlapping per kind, failing matches dropped."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        # a match holds an at sign, so only the stretch of characters around each one is searched
        found += [(m.start(), 0, m.end()) for m in _around_at(text)]
    if DIGIT.search(text):
        for k, pattern in ((1, IP_STARTS), (2, CARD)):
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if passes(KINDS[k], m[0])]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if passes("phone", m[0])]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _around_at(text: str) -> Iterator:
    """Matches of EMAIL, found from each at sign: the pattern's first part takes all its characters before the sign."""
    floor, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in LOCAL:
            a -= 1
        m = EMAIL.match(text, a) if a < at else None
        if m:
            yield m
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def shape(token: str) -> str:
    if token[0].isdigit() and token.isascii():
        return f"d{min(len(token), 6)}"
    if token.isalpha() and token.isascii():
        case = "x" if token.islower() else "X" if token.isupper() else "Xx"
        return f"{case}{min(len(token), 4)}"
    return token if token.isascii() else "*"


def stretches(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of tokens within ``REACH`` of a token that holds a digit or an at sign; ``token, start, end``."""
    last = -1
    window: list[tuple[int, int]] = []
    for m in HINT.finditer(text):
        p = m.start()
        if window and p - MARGIN <= last:
            last = p + MARGIN
            window[-1] = (window[-1][0], last)
        else:
            last = p + MARGIN
            window.append((max(0, p - MARGIN), last))
    for a, b in window:
        # whole words at the window's ends
        while a > 0 and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum():
            b += 1
        tokens = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text, a, min(b, len(text)))]
        keep = np.zeros(len(tokens), bool)
        for k, (t, _, _) in enumerate(tokens):
            if t[0] == "@" or t[0] in "0123456789":
                keep[max(0, k - REACH) : k + REACH + 1] = True
        run: list[tuple[str, int, int]] = []
        for k, t in enumerate(tokens):
            if keep[k]:
                run.append(t)
            elif run:
                yield run
                run = []
        if run:
            yield run


def features(run: list[tuple[str, int, int]]) -> np.ndarray:
    """Feature buckets of each token: its shape, its neighbours' shapes with theirs, and whether it touches them."""
    shapes = ["<<", "<", *(shape(t) for t, _, _ in run), ">", ">>"]
    glued = [False, *(run[k][2] == run[k + 1][1] for k in range(len(run) - 1)), False]
    out = np.empty((len(run), 7), np.int64)
    for k in range(len(run)):
        s, l, r = shapes[k + 2], shapes[k + 1], shapes[k + 3]
        g, h = glued[k], glued[k + 1]
        names = (f"0{s}", f"1{l}|{s}|{g}", f"2{s}|{r}|{h}", f"3{shapes[k]}|{l}|{s}", f"4{s}|{r}|{shapes[k + 4]}", f"5{l}|{s}|{r}", f"6{g}{h}{s}")
        out[k] = [_bucket(n) for n in names]
    return out


_BUCKET: dict[str, int] = {}


def _bucket(name: str) -> int:
    b = _BUCKET.get(name)
    if b is None:
        b = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % BUCKETS
        if len(_BUCKET) < 200_000:
            _BUCKET[name] = b
    return b


def tags_of(run: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """BIO tags of a run from the spans of its text."""
    out = []
    for _, a, b in run:
        tag = 0
        for kind, x, y in spans:
            if x <= a and b <= y:
                tag = 1 + 2 * KINDS.index(kind) + (a > x)
                break
        out.append(tag)
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of features and of tag pairs."""

    def __init__(self):
        n = len(TAGS)
        self.unary, self.pair = np.zeros((BUCKETS, n)), np.zeros((n + 1, n))  # the last row of pair is the start
        for a in range(n + 1):
            for b in range(2, n, 2):  # an inside tag only follows its own kind
                if a not in (b - 1, b):
                    self.pair[a, b] = -1e4
        self.fitted = False

    def fit(self, sequences: list[tuple[list, list[int]]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> Field:
        rng = np.random.default_rng(seed)
        data = [(features(run), np.array(tags)) for run, tags in sequences if run]
        free = self.pair > -1e3
        for epoch in range(epochs if data else 0):
            step = rate / (1 + epoch)
            for k in rng.permutation(len(data)):
                f, y = data[k]
                u = self.unary[f].sum(axis=1)
                n = len(y)
                fwd, bwd = np.empty_like(u), np.zeros_like(u)
                fwd[0] = u[0] + self.pair[-1]
                for t in range(1, n):
                    fwd[t] = u[t] + _lse(fwd[t - 1][:, None] + self.pair[:-1], 0)
                for t in range(n - 2, -1, -1):
                    bwd[t] = _lse(self.pair[:-1] + (u[t + 1] + bwd[t + 1])[None], 1)
                z = _lse(fwd[-1], 0)
                grad = -np.exp(fwd + bwd - z)
                grad[np.arange(n), y] += 1
                np.add.at(self.unary, f, step * grad[:, None, :])
                self.pair[-1] += step * (np.eye(len(TAGS))[y[0]] - np.exp(fwd[0] + bwd[0] - z)) * free[-1]
                for t in range(1, n):
                    both = np.exp(fwd[t - 1][:, None] + self.pair[:-1] + (u[t] + bwd[t])[None] - z)
                    change = -both
                    change[y[t - 1], y[t]] += 1
                    self.pair[:-1] += step * change * free[:-1]
            self.unary *= 1 - decay
        self.fitted = bool(data)
        return self

    def decode(self, runs: list[list[tuple[str, int, int]]]) -> list[np.ndarray]:
        """Viterbi over many runs at once, runs of like length together."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        order = sorted(range(len(runs)), key=lambda k: len(runs[k]))
        for a in range(0, len(order), 512):
            part = order[a : a + 512]
            lengths = np.array([len(runs[k]) for k in part])
            top = int(lengths.max())
            u = np.zeros((top, len(part), len(TAGS)))
            for x, k in enumerate(part):
                u[: lengths[x], x] = self.unary[features(runs[k])].sum(axis=1)
            back = np.zeros((top, len(part), len(TAGS)), np.int8)
            score = u[0] + self.pair[-1]
            final = score.copy()
            for t in range(1, top):
                step = score[:, :, None] + self.pair[None, :-1]
                back[t] = step.argmax(axis=1)
                score = step.max(axis=1) + u[t]
                live = lengths > t
                final[live] = score[live]
            tag = final.argmax(axis=1)
            path = np.zeros((top, len(part)), int)
            for t in range(top - 1, -1, -1):
                ends = lengths - 1 == t
                if ends.any():
                    path[t, ends] = tag[ends]
                inside = lengths - 1 > t
                if inside.any():
                    path[t, inside] = back[t + 1, np.flatnonzero(inside), path[t + 1, inside]]
            for x, k in enumerate(part):
                out[k] = path[: lengths[x], x]
        return out


def _spans(run: list[tuple[str, int, int]], path: np.ndarray) -> Iterator[tuple[str, int, int]]:
    k = 0
    while k < len(run):
        tag = int(path[k])
        e = k + 1
        if tag % 2:
            while e < len(run) and path[e] == tag + 1:
                e += 1
            yield KINDS[tag // 2], run[k][1], run[e - 1][2]
        k = e


def plausible(kind: str, found: str) -> bool:
    """Checks of an added span: what its kind can't do without."""
    digits = len(DIGIT.findall(found))
    if kind == "email":
        return "@" in found and bool(regex.search("[A-Za-z]", found))
    if kind == "ip":
        return regex.fullmatch(r"[0-9]+(\.[0-9]+){3}", found) is not None and passes("ip", found)
    if kind == "card":
        return passes("card", found)
    return 9 <= digits <= 15 and regex.fullmatch(r"\+?[\x20().0-9-]+", found) is not None


def all_spans(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    more: list[list] = [list(b) for b in base]
    if not field.fitted:
        return list(zip(base, more))
    runs, owner = [], []
    for k, t in enumerate(texts):
        if t:
            for run in stretches(t):
                runs.append(run)
                owner.append(k)
    for k, run, path in zip(owner, runs, field.decode(runs)):
        for kind, a, b in _spans(run, path):
            if plausible(kind, texts[k][a:b]) and all(b <= x or y <= a for _, x, y in more[k]):
                more[k].append((kind, a, b))
    rank = KINDS.index
    return [(b, sorted(m, key=lambda s: (s[1], rank(s[0]), s[2]))) for b, m in zip(base, more)]


def fill(kind: str | None, form: str, rng: random.Random) -> str:
    """A template with digits; a card's last one makes its check sum right."""
    out = "".join(str(rng.randrange(1, 10)) if c == "#" else c for c in form)
    if kind != "card":
        return out
    return next(x for x in (out[:-1] + str(d) for d in range(10)) if luhn("".join(DIGIT.findall(x))))


def unknown(run: list[tuple[str, int, int]], tags: list[int]) -> bool:
    """Whether digits outside tagged spans are as many in a row as a number of personal data has."""
    digits = 0
    for (t, a, _), tag in zip(run, tags):
        if tag or t[0].isalpha():
            digits = 0
        elif t.isascii() and t.isdigit():
            digits += len(t)
            if digits >= 9:
                return True
    return False


def labelled_stretches(text: str) -> list[tuple[list[tuple[str, int, int]], list[int]]]:
    """Stretches of a text as they stand, then with templates put between its words."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    spans, out = base_spans(text), []
    for run in stretches(text):
        tags = tags_of(run, spans)
        if len(run) <= 60 and not unknown(run, tags):
            out.append((run, tags))
            if len(out) == OF_TEXT:
                break
    gaps = [m.start() for m in islice(regex.finditer(r"\s", text), 1_000)] or [len(text)]
    for kind, form in rng.sample(TEMPLATES, FILLED):
        p, put = rng.choice(gaps), fill(kind, form, rng)
        left, right = regex.sub("[0-9@+]", "", text[max(0, p - MARGIN) : p]), regex.sub("[0-9@+]", "", text[p : p + MARGIN])
        a, b = len(left) + 1, len(left) + 1 + len(put)
        for run in stretches(f"{left} {put} {right}"):
            out.append((run, tags_of(run, [(kind, a, b)] if kind else [])))
    return out


def labelled_table(docs: DataFrame, text_col: str = "text", limit: int = LABELLED) -> DataFrame:
    """``tokens, starts, ends, tags``: at most ``limit`` labelled stretches, of the different texts of smallest hash."""

    @F.pandas_udf("array<struct<tokens:array<string>,starts:array<int>,ends:array<int>,tags:array<int>>>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([
                [
                    {"tokens": [t for t, _, _ in run], "starts": [a for _, a, _ in run], "ends": [b for _, _, b in run], "tags": tags}
                    for run, tags in labelled_stretches(text)
                ]
                for text in part
            ])

    texts = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # hashes first, without copies; then one row of each, which every task cuts before the rows meet
    least = [r.h for r in texts.select("h").distinct().orderBy("h").limit(limit).collect()]
    one = texts.where(F.col("h").isin(least)).withColumn("n", F.row_number().over(W.partitionBy("h").orderBy("text"))).where("n = 1")
    return one.select("h", F.posexplode(cut("text")).alias("k", "s")).orderBy("h", "k").limit(limit).select("s.*")


def train(labelled: DataFrame) -> Field:
    """Fit on a small labelled table (``tokens, starts, ends, tags``)."""
    return Field().fit([(list(zip(r.tokens, r.starts, r.ends)), list(r.tags)) for r in labelled.collect()])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, field: Field, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``base`` and ``found`` (arrays of ``kind, start, end``, code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS x tags weights

    kind = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base {kind}, found {kind}")
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value

        def rows(found: list) -> list:
            return [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found]

        for part in parts:
            both = all_spans([x if isinstance(x, str) else None for x in part], own)
            yield pd.DataFrame({"base": rows([b for b, _ in both]), "found": rows([m for _, m in both])})

    return docs.select(*keep, spans(F.col(text_col)).alias("_s")).select(*keep, "_s.base", "_s.found")


@query("op8_pii_crf")
def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = find_personal_data(docs, train(labelled_table(docs)), ["doc_id"])

    def text(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("found").alias("spans"))
