"""Phrase collocations by vertical partitioning of a depth-truncated suffix tree.

The suffix tree of all pieces, cut off at ``DEPTH`` words, is built in parts that fit a memory budget:

1. words are counted; only those with ``LEAST`` occurrences can stand in a candidate, so other words end a suffix;
2. word prefixes of two and three words are counted; a suffix ends before a run of words that is rarer than ``LEAST``, and a prefix with
   more than ``BUDGET`` occurrences is replaced by its extensions by one word, again counted, until all fit or ``DEPTH`` is reached;
3. prefixes, in one fixed order, are cut into groups of at most twice ``BUDGET`` occurrences.  Every task cuts its texts into
   suffixes, adds up equal ones and sends them to the group of their prefix; each group sorts what it got, which puts every subtree's
   leaves next to each other, and reads the count of a node from the total of its leaves.

A word of a language is a 64-bit symbol.  That no two words share one is checked with a second hash and with the words themselves;
if any do, another seed is taken.  Prefixes are told apart by 64-bit keys, but these only route and prune: a collision costs work,
not results.  Which prefixes can be pruned is known to the tasks as a bit map of fixed size.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends and those into words at blanks and tabs.  Null or empty texts
have no words; a null language is ``und``.  Ids are not read, repeated rows count again, ties go by the contract's order (score, count, phrase
in UTF-8 byte order), extra columns don't matter.  No rows, or none that is frequent enough, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qacorpus.operators.ordering import running_totals

from .base import query, staged, table
from .bitmaps import bit_map, in_map
from .circulant import mix

DEPTH, LEAST, TOP = 5, 100, 2_000
#: Occurrences of prefixes that make up a group.
BUDGET = 1 << 18
#: Bytes of text in hand at a time, and words or suffixes added up before they are sent.
CHUNK, HELD = 1 << 21, 1 << 20
#: Prefix keys that one task of a prefix count gets, about.
PART = 1 << 21
BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)  # 0 part of a word, 1 blank, 2 end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[list(BREAKS)] = 2


def lang_salt(lang: str, seed: int) -> int:
    return int.from_bytes(blake2b(f"{seed}|{lang}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


@lru_cache(maxsize=4)
def _table(size: int, salt: int) -> np.ndarray:
    return mix(np.arange(size, dtype=np.uint64) + np.uint64(1_000_003 * salt + 77)) | np.uint64(1)


def _place_keys(longest: int, seed: int) -> np.ndarray:
    """A multiplier for each place in a word."""
    return _table(1_024, 3 * seed) if longest <= 1_024 else _table.__wrapped__(longest, 3 * seed)


class Words:
    """The words of some texts: ``symbol``, a second hash ``check``, piece numbers, and where each word stands in ``data``."""

    def __init__(self, texts: list[bytes], salts: list[int], seed: int):
        self.data = b"\n".join(texts).lower()  # bytes.lower: A-Z only; the line feed ends the last piece of a text
        b = np.frombuffer(self.data, np.uint8)
        kind = _KIND[b]
        inside = kind == 0
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = self.stop - self.start
        if not len(lengths):
            self.symbol = self.check = np.zeros(0, np.uint64)
            self.piece = np.zeros(0, np.int64)
            return
        self.piece = np.cumsum(kind == 2)[self.start]
        offsets = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
        keys = _place_keys(int(lengths.max()), seed)[place]
        bytes_in = b[inside]
        self.doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, side="right")
        salt = np.array(salts, np.uint64)[self.doc] + lengths.astype(np.uint64)
        self.symbol = mix(np.add.reduceat(_table(256, 3 * seed + 1)[bytes_in] * keys, offsets) + salt)
        self.symbol[self.symbol == 0] = 1  # zero stands for no word
        self.check = mix(np.add.reduceat(_table(256, 3 * seed + 2)[bytes_in] * (keys ^ np.uint64(0x5851F42D4C957F2C)), offsets) ^ salt)

    def texts(self, at: np.ndarray) -> pa.Array:
        lengths = self.stop[at] - self.start[at]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(self.start[at] - offsets[:-1], lengths) + np.arange(offsets[-1])
        flat = np.frombuffer(self.data, np.uint8)[take]
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])


def _cut(text: bytes) -> Iterator[bytes]:
    """Parts of a text of about ``CHUNK`` bytes, cut after the end of a piece; a longer piece stays whole."""
    a = 0
    while len(text) - a > CHUNK:
        cut = max(text.rfind(bytes([c]), a, a + CHUNK) for c in BREAKS)
        if cut < a:
            later = [x for x in (text.find(bytes([c]), a + CHUNK) for c in BREAKS) if x >= 0]
            if not later:
                break
            cut = min(later)
        yield text[a : cut + 1]
        a = cut + 1
    yield text[a:]


def _chunks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Words, list[str]]]:
    """Words of ``lang, text`` rows, some at a time, with the language of each text."""
    texts, langs, held = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part in _cut((text.as_py() or "").encode("utf-8", "surrogatepass")):
                texts.append(part)
                langs.append(lang)
                held += len(part) + 1
                if held >= CHUNK:
                    yield Words(texts, [lang_salt(x, seed) for x in langs], seed), langs
                    texts, langs, held = [], [], 0
    if texts:
        yield Words(texts, [lang_salt(x, seed) for x in langs], seed), langs


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts equal rows (of these columns) together by the first column, and where a new one starts.

    Rows that are equal in the first column only may stand mixed: then equal rows form more than one run, which is allowed.
    """
    order = np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """``symbol, check, lang, word, c``: counts of words, added up in each task before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in _chunks(batches, seed):
            if not len(words.symbol):
                continue
            order, first = _groups(words.symbol, words.check)
            at = order[first]
            names = pa.array(langs, pa.string()).take(pa.array(words.doc[at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.symbol[at].view(np.int64)), pa.array(words.check[at].view(np.int64)), names, words.texts(at),
                 pa.array(np.diff(np.append(first, len(order))))], names=["symbol", "check", "lang", "word", "c"])

    raw = docs.mapInArrow(run, "symbol long, check long, lang string, word string, c long")
    return raw.groupBy("symbol", "check", "lang", "word").agg(F.sum("c").alias("c"))


def prefix_key(symbols: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key of a sequence of symbols; its length is part of it."""
    h = np.full(len(symbols[0]), np.uint64(len(symbols)))
    for s in symbols:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s)
    return h


class Suffixes:
    """Suffixes that start at words of a chunk: symbols (zero behind the end) and lengths, cut at words or prefixes known to be rare."""

    def __init__(self, words: Words, frequent: np.ndarray, prefixes: np.ndarray | None, triples: bool):
        s, n = words.symbol, len(words.symbol)
        usable = in_map(frequent, s)
        joined = np.zeros(n, bool)  # this word and the next one
        joined[:-1] = usable[:-1] & usable[1:] & (words.piece[:-1] == words.piece[1:])
        if prefixes is not None:
            at = np.flatnonzero(joined)
            joined[at] = in_map(prefixes, prefix_key([s[at], s[at + 1]]))
        three = np.zeros(n, bool)  # this word and the next two
        three[:-1] = joined[:-1] & joined[1:]
        if triples:
            at = np.flatnonzero(three)
            three[at] = in_map(prefixes, prefix_key([s[at], s[at + 1], s[at + 2]]))
        self.at = np.flatnonzero(joined)
        self.length = np.full(len(self.at), 2, np.int64)
        on = np.ones(len(self.at), bool)
        padded = np.append(three, np.zeros(DEPTH, bool))
        for step in range(DEPTH - 2):
            on &= padded[self.at + step]
            self.length += on
        longer = np.append(s, np.zeros(DEPTH, np.uint64))
        self.symbols = [np.where(self.length > k, longer[self.at + k], np.uint64(0)) for k in range(DEPTH)]

    def cut_to(self, rows: np.ndarray, length: int) -> None:
        self.length[rows] = np.minimum(self.length[rows], length)
        for k in range(length, DEPTH):
            self.symbols[k][rows] = 0

    def prefixes(self, heavy: list[np.ndarray], known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Key and length of each suffix's prefix: one word longer where the shorter one is heavy.  A suffix that ends with a heavy prefix
        counts as one word longer than it is: other leaves of its last node are under longer prefixes.

        With ``known`` (the map of frequent prefixes) a suffix whose longer prefix is rare is cut to the heavy one, where its leaf is.
        """
        key, length = prefix_key(self.symbols[:2]), np.full(len(self.at), 2, np.int64)
        for level, keys in enumerate(heavy, 3):
            over = np.flatnonzero((length == level - 1) & np.isin(key, keys))
            length[over] = level
            more = over[self.length[over] >= level]
            longer = prefix_key([s[more] for s in self.symbols[:level]])
            if known is not None:
                ok = in_map(known, longer)
                self.cut_to(more[~ok], level - 1)
                more, longer = more[ok], longer[ok]
            key[more] = longer
        return key, length


def prefix_counts(docs: DataFrame, seed: int, parts: int, level: int, heavy: list[np.ndarray], frequent, prefixes) -> DataFrame:
    """``key, c`` of prefixes of ``level`` words with ``LEAST`` occurrences or more; beyond three words, those whose shorter prefix is heavy.

    Keys and counts travel as blocks of numbers: a part of the key range per block, added up in each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for words, _ in _chunks(batches, seed):
            suffixes = Suffixes(words, frequent.value, None if prefixes is None else prefixes.value, level > 3)
            if level < 4:
                held.append(prefix_key([s[suffixes.length >= level] for s in suffixes.symbols[:level]]))
            else:
                key, length = suffixes.prefixes(heavy, None)
                held.append(key[(length == level) & (suffixes.length >= level)])
            size += len(held[-1])
            if size >= HELD:
                yield from _sent(np.concatenate(held), parts)
                held, size = [], 0
        if size:
            yield from _sent(np.concatenate(held), parts)

    def added(block: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in block.column("counts")])
        order, first = _groups(keys)
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        often = total >= LEAST
        return pa.table({"key": pa.array(keys[order[first]][often].view(np.int64)), "c": pa.array(total[often])})

    return docs.mapInArrow(run, "part int, keys binary, counts binary").groupBy("part").applyInArrow(added, "key long, c long")


def _sent(keys: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    order, first = _groups(keys)
    keys, counts = keys[order[first]], np.diff(np.append(first, len(order))).astype(np.uint32)
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # rises with the key
    bounds = np.searchsorted(part, np.arange(parts + 1))
    full = np.flatnonzero(np.diff(bounds))
    yield pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array([keys[bounds[p] : bounds[p + 1]].tobytes() for p in full], pa.binary()),
         pa.array([counts[bounds[p] : bounds[p + 1]].tobytes() for p in full], pa.binary())], names=["part", "keys", "counts"])


SYMBOLS = [f"s{k}" for k in range(DEPTH)]


def subtrees(docs: DataFrame, seed: int, starts: np.ndarray, heavy: list[np.ndarray], frequent, prefixes) -> DataFrame:
    """Nodes of the suffix tree with ``LEAST`` occurrences or more: ``symbols``, ``d`` words, count ``a``.

    ``starts`` has the first prefix key of each group.  A task sends each group one block of its different suffixes and their counts; over
    all tasks that is at most one suffix for every word of the corpus, and at most the frequent paths once for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for words, _ in _chunks(batches, seed):
            suffixes = Suffixes(words, frequent.value, prefixes.value, True)
            key, length = suffixes.prefixes(heavy, prefixes.value)
            group = np.maximum(np.searchsorted(starts, key, side="right") - 1, 0)
            held.append([*suffixes.symbols, group, length])
            size += len(key)
            if size >= HELD:
                yield leaves([np.concatenate(x) for x in zip(*held)])
                held, size = [], 0
        if size:
            yield leaves([np.concatenate(x) for x in zip(*held)])

    def leaves(columns: list[np.ndarray]) -> pa.RecordBatch:
        order, first = _groups(prefix_key(columns[:DEPTH]), *columns[:DEPTH])
        at, counts = order[first], np.diff(np.append(first, len(order)))
        by = np.argsort(columns[-2][at], kind="stable")
        at, counts = at[by], counts[by]
        group = columns[-2][at]
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        symbols, prefix = np.stack([s[at] for s in columns[:DEPTH]], axis=1), columns[-1][at].astype(np.int8)
        spans = list(zip(cut, np.append(cut[1:], len(at))))
        return pa.RecordBatch.from_arrays(
            [pa.array(group[cut].astype(np.int32)), *(pa.array([part[a:b].tobytes() for a, b in spans], pa.binary()) for part in (symbols, prefix, counts.astype(np.int64)))],
            names=["subtree", "symbols", "prefixes", "counts"])

    def subtree(block: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in block.column(name)])
        columns = list(read("symbols", np.int64).reshape(-1, DEPTH).T)
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        prefix, c = read("prefixes", np.int8)[order], read("counts", np.int64)[order]
        total = np.concatenate([[0], np.cumsum(c)])
        new, out = np.zeros(len(c), bool), []
        new[0] = True
        for d in range(1, DEPTH + 1):
            new[1:] |= columns[d - 1][1:] != columns[d - 1][:-1]
            first = np.flatnonzero(new)
            counts = total[np.append(first[1:], len(c))] - total[first]
            # leaves of a node above its prefix stand in other groups too: such parts are added up afterwards
            keep = (columns[d - 1][first] != 0) & ((counts >= LEAST) | (np.maximum.reduceat(prefix, first) > d)) & (d > 1)
            first = first[keep]
            out.append([*(columns[k][first] if k < d else np.zeros(len(first), np.int64) for k in range(DEPTH)), np.full(len(first), d), counts[keep]])
        joined = [np.concatenate(x) for x in zip(*out)]
        return pa.table({name: pa.array(x) for name, x in zip([*SYMBOLS, "d", "a"], joined)})

    types = ", ".join(f"{k} long" for k in SYMBOLS)
    nodes = docs.mapInArrow(run, "subtree int, symbols binary, prefixes binary, counts binary").groupBy("subtree").applyInArrow(subtree, f"{types}, d long, a long")
    nodes = nodes.groupBy(*SYMBOLS, "d").agg(F.sum("a").alias("a")).where(F.col("a") >= LEAST)
    return nodes.select(F.slice(F.array(*SYMBOLS), 1, F.col("d").cast("int")).alias("symbols"), F.col("d").cast("int").alias("d"), "a")


def _heavy(prefixes: DataFrame, budget: int) -> np.ndarray:
    """Keys of more than ``budget`` occurrences, sorted; at most one for each ``budget`` words of the corpus."""
    return np.sort(prefixes.where(F.col("c") > budget).select("key").toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64))


def _starts(prefixes: DataFrame, budget: int) -> np.ndarray:
    """The first key of each group: one number for each ``budget`` occurrences."""
    # signed and unsigned order differ; keys are compared as the tasks do, unsigned
    order = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    laid = running_totals(prefixes.select(order.alias("k"), "c"), [F.col("k")], {"upto": F.col("c")})
    starts = laid.groupBy(F.expr(f"(upto - c) div {budget}")).agg(F.min("k").alias("k")).select("k").toArrow().column("k").to_numpy()
    return np.sort(starts.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63))


def _distinct_symbols(words: DataFrame) -> bool:
    return words.groupBy("symbol").agg(F.count("*").alias("m")).where("m > 1").limit(1).count() == 0


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, symbols, a, l, r, n, score`` of the candidates that stay, from counts of phrases (``symbols, d, a``) and words."""
    longer = phrases.where("d > 2")
    ends = longer.select("a", F.explode(F.array(F.slice("symbols", 1, F.col("d") - 1), F.slice("symbols", 2, F.col("d") - 1))).alias("symbols"))
    cover = ends.groupBy("symbols").agg(F.max("a").alias("cover"))
    # a longer candidate with the same count, cut to one more word, still has that count: looking one word further is enough
    kept = phrases.join(cover, "symbols", "left").where("cover is null or cover < a").drop("cover")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("d") - 1)))
    cuts = cuts.withColumns({"left": F.slice("symbols", 1, F.col("k")), "right": F.slice("symbols", F.col("k") + 1, F.col("d") - F.col("k"))})
    counts = phrases.select("symbols", "a").union(words.select(F.array("symbol"), "c"))
    both = cuts.join(counts.select(F.col("symbols").alias("left"), F.col("a").alias("l")), "left").join(
        counts.select(F.col("symbols").alias("right"), F.col("a").alias("r")), "right")
    totals = words.select("symbol", "lang", "n")
    whole = both.withColumn("symbol", F.col("symbols")[0]).join(totals, "symbol")
    wide = lambda c: c.cast("decimal(19,0)")
    product = wide(F.col("a") * 1000) * wide(F.col("n"))
    parts = whole.withColumns({"up": product, "down": wide(F.col("l")) * wide(F.col("r"))}).withColumn("score", F.expr("up div down"))
    best = parts.groupBy("symbols").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang")).alias("b"))
    return best.select("symbols", "b.lang", "b.a", "b.l", "b.r", "b.n", "b.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    for seed in range(8):
        every = staged(word_counts(rows, seed), "words")
        if _distinct_symbols(every):
            break
    else:
        raise RuntimeError("words share their symbols under every seed")
    totals = staged(every.groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    words = staged(every.where(F.col("c") >= LEAST).join(totals, "lang").select("symbol", "lang", "word", "c", "n"), "frequent")
    size = totals.agg(F.sum("n")).first()[0] or 0
    share = spark.sparkContext.broadcast
    frequent = share(bit_map(words, "symbol"))
    parts = size // PART + 1

    pairs = staged(prefix_counts(rows, seed, parts, 2, [], frequent, None), "prefixes")
    counted = staged(prefix_counts(rows, seed, parts, 3, [], frequent, share(bit_map(pairs, "key"))), "prefixes")
    every_prefix = pairs.union(counted)
    known = share(bit_map(every_prefix, "key"))
    heavy = [_heavy(pairs, budget)]
    for level in range(4, DEPTH + 1):
        # a heavy prefix has a heavy shorter one, so there is nothing to extend where no prefix of this level is heavy
        more = _heavy(counted, budget)
        if not len(more):
            break
        heavy.append(more)
        counted = staged(prefix_counts(rows, seed, parts, level, heavy, frequent, known), "prefixes")
        every_prefix = every_prefix.union(counted)
    if len(heavy) > 1:
        known = share(bit_map(every_prefix, "key"))
    starts = _starts(every_prefix, budget)
    phrases = staged(subtrees(rows, seed, starts, heavy, frequent, known), "phrases")

    best = staged(scored(phrases, words), "scored")
    named = best.select("*", F.posexplode("symbols").alias("at", "symbol")).join(words.select("symbol", "word"), "symbol")
    spelled = named.groupBy("lang", "symbols", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    phrase = F.array_join(F.col("w.word"), " ")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.select("lang", phrase.alias("phrase"), "a", "l", "r", "n", "score").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), (SELECT unnest(range(1, 6)) AS k)
  WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
covered AS (
  SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND y.k > x.k AND y.a >= x.a
    AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, array_to_string(w[1 : j], ' ') AS lp, array_to_string(w[j + 1 : k], ' ') AS rp
  FROM c, (SELECT unnest(range(1, 5)) AS j) WHERE j < k),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, j, l.a AS l, r.a AS r, n.n AS n,
    (1000::HUGEINT * cuts.a * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp AND l.k = j
  JOIN f r ON r.lang = cuts.lang AND r.phrase = rp AND r.k = cuts.k - j JOIN n ON n.lang = cuts.lang),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS m FROM s) WHERE m = 1),
ranked AS (
  SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best b WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE v.lang = b.lang AND v.phrase = b.phrase))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


@query("op11_phrase_collocations", SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
