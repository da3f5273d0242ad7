"""Language identification by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of labelled text is built.  A text is parsed greedily into the longest
phrases that occur in that sample; the language that needs the fewest phrases per letter wins (Ziv-Merhav cross parsing).

The automata are dense tables (state x symbol), sent to the executors once.  A task parses its texts for all languages at once:
texts are cut into segments of ``SEGMENT`` characters (a cut ends the phrase at hand, for every language alike), and numpy steps
all segments of a batch through the tables together.  Nothing is shuffled and whole texts are read.

Bounds of the fit (documented parameters): per language ``TRAIN_DOCS`` labelled texts that hold a letter, those with the smallest hash, a
piece of at most ``TRAIN_CHARS`` characters at a hashed place of each and ``TRAIN_TOTAL`` in all.  The tables take at most
2 * TRAIN_TOTAL states a language times the symbols of all samples, 4 bytes each (14 MB a language for 60 letters).  A text is null, empty or has no letter: ``und``, score 0.  Ties go to
the language first in alphabetical order.  Rows with null text or null label aren't learned from; with nothing to learn from
every text is ``und``.  Repeated rows are repeated in the result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import query, table

TRAIN_DOCS, TRAIN_CHARS, TRAIN_TOTAL = 60, 1_500, 30_000
SEGMENT = 1_024
#: Parts of a language whose sample is cut on its own before the parts meet.
PARTS = 256
#: Characters parsed at a time: bounds the memory of a task whatever the texts are.
BATCH_CHARS = 2_000_000


def _symbols(texts: list[str]) -> dict[str, int]:
    """Symbols of the lower-cased samples; 0 is a character that is in none, 1 any run of characters that aren't letters."""
    return {c: k for k, c in enumerate(sorted({c for t in texts for c in t.lower() if c.isalpha()}), 2)}


def code_table(symbols: dict[str, int]) -> np.ndarray:
    """Code of every character of the basic plane; letters beyond it count as unknown ones (:func:`encode`)."""
    codes = np.zeros(0x10000, np.uint8 if len(symbols) < 254 else np.uint16)
    for k in range(0x10000):
        c = chr(k)
        codes[k] = symbols.get(c.lower(), 0) if c.isalpha() else 1
    return codes


def encode(text: str, codes: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    coded = codes[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        distinct, which = np.unique(points[far], return_inverse=True)
        coded[far] = np.array([0 if chr(c).isalpha() else 1 for c in distinct.tolist()], coded.dtype)[which]
    return coded


def squeeze(coded: np.ndarray) -> np.ndarray:
    """One symbol for each run of characters that aren't letters."""
    if not len(coded):
        return coded
    keep = np.ones(len(coded), bool)
    keep[1:] = (coded[1:] != 1) | (coded[:-1] != 1)
    return coded[keep]


def suffix_automaton(coded: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a symbol string: ``next[state, symbol]``, 0 for none; state 1 is the start."""
    moves: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in coded.tolist():
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    dense = np.zeros((len(moves), width), np.int32)
    for s, m in enumerate(moves):
        for c, t in m.items():
            dense[s, c] = t
    return dense


class Model:
    """Languages, character codes and one automaton per language, all in one flat table."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        symbols = _symbols([t for ts in samples.values() for t in ts])
        self.codes, self.width = code_table(symbols), len(symbols) + 2
        tables, self.starts, at = [], [], 0
        for lang in self.langs:
            line = np.concatenate([squeeze(encode(t, self.codes)) for t in samples[lang]] or [np.zeros(0, np.uint8)])
            dense = suffix_automaton(line[line != 0], self.width)
            tables.append(np.where(dense > 0, dense + at, 0))
            self.starts.append(at + 1)
            at += len(dense)
        # states are kept as row offsets of the flat table, so a step is one addition and one lookup
        wide = np.int32 if at * self.width < 1 << 31 else np.int64  # many languages or large alphabets: offsets leave 32 bits
        self.flat = (np.concatenate(tables).astype(wide) * wide(self.width)).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, segments: list[np.ndarray]) -> np.ndarray:
        """Phrases of each segment for each language."""
        order = np.argsort([-len(s) for s in segments], kind="stable")
        lengths = np.array([len(segments[k]) for k in order])
        grid = np.zeros((int(lengths[0]), len(segments)), np.int32)  # a column per segment, the longest first
        for x, k in enumerate(order):
            grid[: lengths[x], x] = segments[k]
        alive = np.searchsorted(-lengths, -np.arange(len(grid)), side="left")  # columns that reach this row
        counts = np.zeros((len(self.langs), len(segments)), np.int32)
        for row, start in enumerate(self.starts):
            root = start * self.width
            state, n = np.full(len(segments), root, self.flat.dtype), counts[row]
            for y, k in enumerate(alive):
                s, c = state[:k], grid[y, :k]
                to = self.flat[s + c]
                dead = np.flatnonzero(to == 0)
                if len(dead):  # the phrase ends before this symbol, the next begins with it; an unknown symbol is a phrase
                    again = self.flat[root + c[dead]]
                    n[dead] += 1 + ((again == 0) & (s[dead] != root))
                    to[dead] = np.where(again == 0, root, again)
                state[:k] = to
            n += state != root
        back = np.empty_like(counts)
        back[:, order] = counts
        return back.T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        letters = np.zeros(len(texts), bool)
        owner: list[int] = []
        segments: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if segments:
                np.add.at(total, owner, self.phrases(segments))
            owner.clear()
            segments.clear()
            held = 0

        for k, text in enumerate(texts):
            if not text or not self.langs:
                continue
            for a in range(0, len(text), BATCH_CHARS):  # a very long text is encoded in pieces
                coded = squeeze(encode(text[a : a + BATCH_CHARS], self.codes))
                if not (coded != 1).any():
                    continue
                letters[k] = True
                for b in range(0, len(coded), SEGMENT):
                    owner.append(k)
                    segments.append(coded[b : b + SEGMENT])
                held += len(coded)
                if held >= BATCH_CHARS:
                    flush()
        flush()
        for k in np.flatnonzero(letters):
            n = np.maximum(total[k], 1)
            best = int(n.argmin())
            names[k] = self.langs[best]
            scores[k] = float((1 / n[best]) / (1 / n).sum())
        return names, scores


def training_sample(labelled: DataFrame, text_col: str, lang_col: str, seed_col: str) -> dict[str, list[str]]:
    """The bounded sample.  Every task leaves ``TRAIN_DOCS`` rows a language and part; the parts of a language are cut again on
    their own, so what one task gets in the end doesn't grow with the number of tasks."""
    # a piece starts at a hashed place of the text, so a beginning that many texts share is no language
    place = F.pmod(F.xxhash64(text_col, F.lit(1)), F.greatest(F.lit(1), F.char_length(text_col) - TRAIN_CHARS + 1)) + 1
    rows = (
        labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
        .select(F.col(lang_col).alias("lang"), F.substr(F.col(text_col), place.cast("int"), F.lit(TRAIN_CHARS)).alias("text"), F.xxhash64(seed_col).alias("h"))
        .withColumn("part", F.pmod("h", F.lit(PARTS)))
    )
    for keys in (["lang", "part"], ["lang"]):
        order = W.partitionBy(*keys).orderBy("h", "text")
        rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= TRAIN_DOCS)
    rows = rows.orderBy("lang", "n").collect()
    samples: dict[str, list[str]] = {}
    for r in rows:
        have = samples.setdefault(r.lang, [])
        if (left := TRAIN_TOTAL - sum(map(len, have))) > 0:
            have.append(r.text[:left])
    return samples


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", seed_col: str = "doc_id") -> Model:
    return Model(training_sample(labelled, text_col, lang_col, seed_col))


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score``; only the text goes into the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size bounded by the training bounds

    @F.pandas_udf("lang_pred string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in parts:
            names, scores = own.predict(texts.where(texts.notna(), None).tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.select(*keep, predicted(F.col(text_col)).alias("_p")).select(*keep, "_p.lang_pred", "_p.score")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def query_model(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out(F.col("doc_id"))))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return identify(named, query_model(docs), ["doc_id", "held_out"])
