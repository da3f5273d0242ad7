"""Fuzzy deduplication (DUP3, JN2): exact greedy first-wins under ``difflib`` similarity.

A row is dropped when an earlier *kept* row is more similar than the threshold.  The result equals the
one-by-one scan, but no pair list is ever built:

1. Exact copies of the normalised text are combined first (a hot text becomes one row).
2. The remaining texts are sorted by length and cut into tiles of bounded size, each written as one row.  Similarity above ``t``
   forces ``min(len)/max(len) > t/(2-t)``, so a tile only meets tiles inside that length window.  Tasks read the tiles that meet from
   the shared folder; no text is shuffled for a tile pair, so disk grows with the texts, not with the pairs.
3. In a (target tile, source tile) task a bound on shared runs of three characters comes first: texts are rows of a matrix of
   run counts, and one matrix product bounds the shared runs of all pairs.  The pairs it leaves meet a bound on shared
   characters and go, thousands at a time, through longest common subsequences of the texts cut down to a few letters, rare
   letters first: what these leave
   unmatched adds up over disjoint groups of letters, and most pairs are over the limit after a group or two.  Survivors are
   tested earliest first against the longest common subsequence of the whole texts (never below ``difflib``'s matches), then
   with ``difflib``; the search for a target stops at its first hit.  A task therefore returns at most one row per target,
   however many near copies there are.
4. Rows without an earlier neighbour are kept, rows whose earliest neighbour is kept are dropped, and the
   few undecided rows go round again against the newly kept ones until none is left.

All bounds hold for every pair above the threshold, so nothing is missed.
The texts of a length window still meet in tile pairs: at 0.9 of difflib a run of about five characters is all
that two similar texts surely share, so no shorter list of partners is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import WS_INNER, strip
from ..functions.text import normalize_key
from ..session import write_out
from .dedupe import first_per_key
from .ordering import running_totals

TILE_WEIGHT, ROW_WEIGHT = 4_000_000, 300  # characters + 300 per row: at most 13,000 rows or 4 MB of text in a tile
_GROUPS, _CHAR_BINS = 8, 16  # groups of letters, bins of characters in each
_BATCH = 16384  # pairs looked at together: arrays that stay in the cache
_SEARCH = 1 << 18  # pairs that a filter is built for
_RUN_COLUMNS = 256, 4096  # least and most columns of the matrices of runs
_ROWS, _COLUMNS = 256, 4096  # targets and sources in one product


def normalized_question(c):
    """Lower-cased, whitespace collapsed, everything but letters, digits, ``_`` and blanks removed."""
    return F.regexp_replace(normalize_key(c), rf"[^\p{{L}}\p{{N}}_{WS_INNER}]", "")


def _codes(texts: list[str], letters: np.ndarray) -> list[np.ndarray]:
    """Every text as the places of its characters in the sorted array ``letters``."""
    return [np.searchsorted(letters, np.frombuffer(t.encode("utf-32-le"), np.uint32)) for t in texts]


def _letter_groups(counts: np.ndarray) -> list[np.ndarray]:
    """The alphabet in groups of some ``1 / _GROUPS`` of all characters each, rare letters first."""
    order = np.argsort(counts, kind="stable")
    ends = np.cumsum(counts[order]) * _GROUPS // max(1, int(counts.sum()))
    return [g for g in np.split(order, np.flatnonzero(np.diff(ends)) + 1) if len(g)]


def _run_length(threshold: float) -> int:
    """Longest run, up to three characters, of which similar texts surely share enough for :class:`_SharedRuns` to tell."""
    return 3 if threshold >= 0.85 else 2 if threshold >= 0.75 else 1


def _numbered(values: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 for the distinct values below ``upto``, and how often each occurs; by counting where that takes little room."""
    if upto > 1 << 24:
        return np.unique(values, return_inverse=True, return_counts=True)[1:]
    counts = np.bincount(values, minlength=1)
    return (np.cumsum(counts > 0) - 1)[values], counts[counts > 0]


class _SharedRuns:
    """Upper bounds on the runs of ``q`` characters that pairs of texts share, repeats counted, by matrix products.

    Of a text of n characters with M matched ones at most ``q (n - M)`` runs hold an unmatched character, and the gaps in the other
    text of m characters part at most ``(q - 1) (m - M)`` more.  So two texts with ``2M > threshold (n + m)`` share more than
    ``((2q - 1) threshold / 2 - (q - 1)) (n + m) - (q - 1)`` runs.  The k-th occurrence of a run in a text is a feature of its own;
    features that are rarer share columns, which only raises a product.
    """

    def __init__(self, targets: list[np.ndarray], sources: list[np.ndarray], n_letters: int, threshold: float):
        q = self.q = _run_length(threshold)
        codes = [*targets, *sources]
        sizes = np.array([len(c) for c in codes])
        chars, text = np.concatenate(codes).astype(np.int64), np.repeat(np.arange(len(codes)), sizes)
        n = max(0, len(chars) - q + 1)
        whole = text[:n] == text[q - 1 :][:n]
        runs = np.zeros(n, np.int64)
        for k in range(q):
            runs = runs * n_letters + chars[k : k + n]
        text, runs = text[:n][whole], _numbered(runs[whole], n_letters**q)[0]
        # (text, run) in order, so that an occurrence's number is its distance from the first
        most = int(runs.max(initial=0)) + 1
        both = np.sort(text * most + runs)
        starts = np.flatnonzero(np.diff(both, prepend=-1))
        number = np.arange(len(both)) - np.repeat(starts, np.diff(np.append(starts, len(both))))
        text, runs = both // most, both % most
        feature, counts = _numbered(number * most + runs, most * (int(number.max(initial=0)) + 1))
        width = 1 << int(np.ceil(np.log2(max(1.0, 4.0 * len(text) / len(codes)))))
        width = min(max(width, _RUN_COLUMNS[0]), _RUN_COLUMNS[1])
        own = width - width // 4  # the commonest features have columns of their own
        place = np.empty(len(counts), np.int64)
        place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        place = np.where(place < own, place, own + (place - own) % (width - own))
        weight = (2 * q - 1) * threshold / 2 - (q - 1)
        self.rows = np.zeros((len(codes), width + 2), np.float32)
        np.add.at(self.rows.reshape(-1), text * (width + 2) + place[feature], np.float32(1))
        # two more columns take what a pair must share from the product
        t, s = slice(0, len(targets)), slice(len(targets), None)
        self.rows[t, width], self.rows[t, width + 1] = -weight * sizes[t], 1
        self.rows[s, width], self.rows[s, width + 1] = 1, -weight * sizes[s]
        self.targets, self.sources = self.rows[t], self.rows[s]

    def pairs(self, lo: int, hi: int, before: np.ndarray):
        """(target, source) of the targets ``lo`` to ``hi`` and each one's first ``before`` sources that may be similar, in order."""
        found = []
        end = int(before[lo:hi].max(initial=0))
        for j in range(0, end, _COLUMNS):
            least = -(self.q - 1) - 0.5  # the half is for rounding
            t, s = np.nonzero(self.targets[lo:hi] @ self.sources[j : min(j + _COLUMNS, end)].T > least)
            t, s = t + lo, s + j
            earlier = s < before[t]
            found.append((t[earlier], s[earlier]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        t, s = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(t, kind="stable") if len(found) > 1 else slice(None)
        return t[order], s[order]


def _char_bags(codes: list[np.ndarray], groups: list[np.ndarray], n_letters: int) -> np.ndarray:
    """(group * bins + bin, text): counts of characters, dealt into bins by group (merging only raises a minimum sum)."""
    bins = np.zeros(n_letters, np.int64)
    for g, group in enumerate(groups):
        bins[group] = g * _CHAR_BINS + np.arange(len(group)) % _CHAR_BINS
    chars = np.zeros((len(groups) * _CHAR_BINS, len(codes)), np.int32)
    for i, c in enumerate(codes):
        chars[:, i] = np.bincount(bins[c], minlength=len(chars))
    return chars


class _Subsequences:
    """Longest common subsequences of many (target, source) pairs at once, both texts cut down to one group of letters.

    The bit-vector recurrence of :func:`_common_subsequence` in 64-bit words, one array over all pairs for each word.
    """

    def __init__(self, targets: list[np.ndarray], sources: list[np.ndarray], group: np.ndarray, n_letters: int):
        number = np.zeros(n_letters, np.int64)  # 0: not of this group
        number[group] = np.arange(1, len(group) + 1)
        (text, c, at, self.t_len), (other, d, step, self.s_len) = (self._cut_down(x, number) for x in (targets, sources))
        self.width = len(group) + 1
        self.masks = np.zeros((max(1, -(-int(self.t_len.max()) // 64)), len(targets) * self.width), np.uint64)
        place = (at >> 6) * self.masks.shape[1] + text * self.width + c
        np.add.at(self.masks.reshape(-1), place, np.uint64(1) << (at & 63).astype(np.uint64))  # every bit once
        self.steps = np.zeros((int(self.s_len.max()), len(sources)), np.int64)
        self.steps[step, other] = d

    @staticmethod
    def _cut_down(texts: list[np.ndarray], number: np.ndarray):
        """Text, letter and place of every letter that is left, and the texts' lengths."""
        c = number[np.concatenate(texts)]
        left = c > 0
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[left]
        sizes = np.bincount(text, minlength=len(texts))
        return text, c[left], np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes

    def unmatched(self, t: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Letters of the group outside the longest common subsequence, both texts together."""
        out = self.t_len[t] + self.s_len[s]
        need = -(-self.t_len[t] // 64)
        for words in np.unique(need[need > 0]):
            at = np.flatnonzero(need == words)
            at = at[np.argsort(-self.s_len[s[at]], kind="stable")]  # long sources first: the short ones end earlier
            out[at] -= 2 * self._common(t[at], s[at], int(words))
        return out

    def _common(self, t: np.ndarray, s: np.ndarray, words: int) -> np.ndarray:
        state = np.full((words, len(t)), ~np.uint64(0))
        base, sizes, top = t * self.width, -self.s_len[s], np.uint64(63)
        room = np.empty((3, len(t)), np.uint64)
        for k, live in enumerate(np.searchsorted(sizes, -np.arange(int(-sizes[0])), side="left")):
            hit, total, carry = room[:, :live]
            at = base[:live] + self.steps[k][s[:live]]
            for w in range(words):
                old = state[w, :live]
                np.take(self.masks[w], at, out=hit, mode="clip")
                hit &= old
                np.add(old, hit, out=total)
                if w:
                    total += carry
                if w + 1 < words:
                    np.bitwise_and(old, ~total, out=carry)
                    carry |= hit
                    carry >>= top
                old ^= hit
                old |= total
        return np.bitwise_count(~state).sum(axis=0, dtype=np.int64)


class _PairFilter:
    """Drops pairs that can't be similar.

    A common subsequence stays one when both texts are cut down to some letters, so the letters left unmatched in disjoint groups
    add up to no more than those left unmatched in the whole texts.  A group not looked at yet counts with the differences of its
    letters' numbers, which are unmatched in any case.  Groups are looked at until a pair is over its limit.
    """

    def __init__(self, targets: list[np.ndarray], sources: list[np.ndarray], n_letters: int):
        # commonest letters, whose groups tell least, come last: most pairs never get there
        self.groups = _letter_groups(np.bincount(np.concatenate([*targets, *sources]), minlength=n_letters))
        self.t_chars, self.s_chars = (_char_bags(x, self.groups, n_letters) for x in (targets, sources))
        self.made: list[_Subsequences] = []
        self.data = targets, sources, n_letters

    def shared(self, i: int, upto: int, out: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Characters that a target shares with each of the first ``upto`` sources, whatever their order."""
        out, part = out[:upto], part[:upto]
        out[:] = 0
        for row, n in zip(self.s_chars, self.t_chars[:, i]):
            if n:
                out += np.minimum(row[:upto], n, out=part)
        return out

    def shared_by(self, t: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The same for a list of pairs."""
        out = np.zeros(len(t), np.int32)
        for of_target, of_source in zip(self.t_chars, self.s_chars):
            if of_target.any() and of_source.any():
                out += np.minimum(of_target[t], of_source[s])
        return out

    def __call__(self, t: np.ndarray, s: np.ndarray, unmatched: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Places of the pairs that may leave fewer than ``limit`` characters unmatched; ``unmatched`` is what their bags leave."""
        alive, spent = np.arange(len(t)), unmatched.copy()
        for i, group in enumerate(self.groups):
            if not len(alive):
                break
            if i == len(self.made):
                self.made.append(_Subsequences(*self.data[:2], group, self.data[2]))
            at, bt = t[alive], s[alive]
            for k in range(i * _CHAR_BINS, i * _CHAR_BINS + min(len(group), _CHAR_BINS)):
                spent[alive] -= np.abs(self.t_chars[k][at] - self.s_chars[k][bt])
            spent[alive] += self.made[i].unmatched(at, bt)
            alive = alive[spent[alive] < limit[alive]]
        return alive


def _positions(text: str) -> dict[str, int]:
    """Bit set of the positions of every character."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(text):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def _common_subsequence(masks: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence by the bit-vector recurrence."""
    full = (1 << size) - 1
    state = full
    for ch in other:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


class _Tile:
    """Texts of a tile, earliest first, so that late sources drop out of whole products."""

    def __init__(self, ord_: np.ndarray, len_: np.ndarray, norm: pa.Array, kept: np.ndarray):
        self.ord, self.len, self.norm, self.kept = ord_, len_, norm, kept

    def where(self, good: np.ndarray) -> _Tile:
        return self if good.all() else _Tile(self.ord[good], self.len[good], self.norm.filter(pa.array(good)), self.kept[good])

    @classmethod
    def of(cls, pairs: pa.RecordBatch, side: str, i: int) -> _Tile:
        ord_, len_, norm, kept = (pairs.column(side + name)[i].values for name in ("ord", "len", "norm", "kept"))
        return cls(ord_.to_numpy(), len_.to_numpy(), norm, kept.to_numpy(zero_copy_only=False))


def _may_meet(targets: _Tile, sources: _Tile, threshold: float) -> tuple[_Tile, _Tile]:
    """What is left without the texts that no text of the other tile can be similar to, by length and order."""
    ratio = threshold / (2.0 - threshold)

    def near(some: _Tile, others: _Tile) -> _Tile:
        if not len(others.len):
            return some.where(np.zeros(len(some.len), bool))
        return some.where((some.len >= others.len.min() * ratio - 1e-6) & (some.len * ratio <= others.len.max() + 1e-6))

    if len(sources.ord) and len(targets.ord):
        sources, targets = sources.where(sources.ord < targets.ord[-1]), targets.where(targets.ord > sources.ord[0])
    targets = near(targets, sources)
    return targets, near(sources, targets)


def _compare(threshold: float, autojunk: bool):
    from difflib import SequenceMatcher

    def run(targets: _Tile, sources: _Tile) -> list[tuple]:
        """(ord, hit_kept, earliest) of every target with a hit."""
        out: list[tuple] = []
        if len(targets.ord) and len(sources.ord):
            t_norm, s_norm = targets.norm.to_pylist(), sources.norm.to_pylist()
            letters = np.unique(np.frombuffer("".join([*t_norm, *s_norm]).encode("utf-32-le"), np.uint32))
            t_codes, s_codes = _codes(t_norm, letters), _codes(s_norm, letters)
            t_ord, s_ord = targets.ord, sources.ord
            t_len, s_len = targets.len, sources.len
            s_kept = sources.kept
            any_kept = bool(s_kept.any())
            bags = _PairFilter(t_codes, s_codes, len(letters))
            runs = _SharedRuns(t_codes, s_codes, len(letters), threshold)
            before = np.searchsorted(s_ord, t_ord)

            def search(i: int, cand: np.ndarray):
                """The target's earliest hit, or whether it hits a kept text."""
                n, text, masks, first = int(t_len[i]), t_norm[i], _positions(t_norm[i]), None
                for j in cand:
                    if first is not None and not s_kept[j]:
                        continue
                    if 2.0 * _common_subsequence(masks, n, s_norm[j]) <= threshold * (n + s_len[j]):
                        continue
                    if SequenceMatcher(None, text, s_norm[j], autojunk).ratio() > threshold:
                        if s_kept[j]:
                            return True, None
                        first = int(s_ord[j])
                        if not any_kept:
                            break
                return None if first is None else (False, first)

            def by_characters(t: np.ndarray, s: np.ndarray):
                total, shared = t_len[t] + s_len[s], bags.shared_by(t, s)
                good = 2.0 * shared > threshold * total
                return t[good], s[good], (total - 2 * shared)[good]

            def search_all(t: np.ndarray, s: np.ndarray, unmatched: np.ndarray):
                # only the texts of these pairs
                ts, t_at = np.unique(t, return_inverse=True)
                ss, s_at = np.unique(s, return_inverse=True)
                may = _PairFilter([t_codes[i] for i in ts], [s_codes[j] for j in ss], len(letters))
                starts = np.arange(0, len(t), _BATCH)
                # 2M > threshold * total, so fewer than this many characters are unmatched (the one is for rounding)
                limit = (1.0 - threshold) * (t_len[t] + s_len[s]) + 1.0
                good = [may(t_at[a:b], s_at[a:b], unmatched[a:b], limit[a:b]) + a for a, b in zip(starts, starts + _BATCH)]
                good = np.concatenate(good)
                t, s = t[good], s[good]
                starts = np.flatnonzero(np.diff(t, prepend=-1))
                for i, cand in zip(t[starts], np.split(s, starts[1:])):
                    hit = search(i, cand)
                    if hit is not None:
                        out.append((int(t_ord[i]), *hit))

            held, size = [], 0
            for lo in range(0, len(t_norm), _ROWS):
                t, s = runs.pairs(lo, lo + _ROWS, before)
                for a in range(0, len(t), _BATCH):
                    held.append(by_characters(t[a : a + _BATCH], s[a : a + _BATCH]))
                    size += len(held[-1][0])
                # the pairs of a target stay together
                if size and (size >= _SEARCH or lo + _ROWS >= len(t_norm)):
                    search_all(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        return out

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = run(*_may_meet(_Tile.of(batch, "t_", i), _Tile.of(batch, "s_", i), threshold))
                if found:
                    columns = zip(*found), (pa.int64(), pa.bool_(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(*columns)], ["ord", "hit_kept", "earliest"])

    return run_all


def _pack(rows: pa.Table) -> pa.Table:
    """A tile as one row."""
    rows = rows.sort_by("ord").combine_chunks()
    ends = pa.array([0, rows.num_rows], pa.int32())
    lists = {c: pa.ListArray.from_arrays(ends, rows[c].combine_chunks()) for c in ("ord", "len", "norm", "kept")}
    bounds = {"shortest": pc.min(rows["len"]), "longest": pc.max(rows["len"]), "first": rows["ord"][0], "last": rows["ord"][-1]}
    return pa.table({"tile": rows["tile"][:1], **{k: pa.array([v.as_py()], v.type) for k, v in bounds.items()}, **lists})


def _packed(rows: DataFrame) -> DataFrame:
    """Rows with ``tile, ord, len, norm, kept`` as one row for each tile, in files of their own."""
    kinds = "tile bigint, shortest int, longest int, first bigint, last bigint, ord array<bigint>, len array<int>, norm array<string>, kept array<boolean>"
    return write_out(rows.groupBy("tile").applyInArrow(_pack, kinds), "tiles", rows_per_file=1)


def _unpacked(tiles: DataFrame) -> DataFrame:
    return tiles.select("tile", F.inline(F.arrays_zip("ord", "len", "norm", "kept")))


def _neighbours(targets: DataFrame, sources: DataFrame, threshold: float, autojunk: bool) -> DataFrame:
    """Per target with a hit: whether it hit a kept source, and its earliest undecided hit.

    A Cartesian product of tiles whose tasks read the sources from the shared folder, so no text is copied for the tiles it meets.
    """
    ratio = threshold / (2.0 - threshold)
    t, s = (tiles.select([F.col(c).alias(side + c) for c in tiles.columns]) for tiles, side in ((targets, "t_"), (sources, "s_")))
    # a scan packs small files into a task per core: deal the targets out once, so that the tasks are many and alike
    parts = min(targets.count(), 4 * targets.sparkSession.sparkContext.defaultParallelism)
    if t.rdd.getNumPartitions() < parts:
        t = t.repartitionByRange(parts, "t_tile")
    near = (F.col("s_longest") >= F.col("t_shortest") * ratio - 1e-6) & (F.col("s_shortest") * ratio <= F.col("t_longest") + 1e-6)
    pairs = t.join(s.hint("shuffle_replicate_nl"), near & (F.col("s_first") < F.col("t_last")))
    hits = pairs.mapInArrow(_compare(threshold, autojunk), "ord bigint, hit_kept boolean, earliest bigint")
    return hits.groupBy("ord").agg(F.max("hit_kept").alias("hit_kept"), F.min("earliest").alias("earliest"))


def fuzzy_kept(
    df: DataFrame, column: str = "question", order: str = "ord", threshold: float = 0.9,
    autojunk: bool = True, tile_weight: int = TILE_WEIGHT,
) -> DataFrame:
    """``ord`` of every row the greedy rule keeps.

    ``autojunk=True`` follows difflib's default, which ignores frequent characters of kept texts of 200 or
    more characters, so long near copies often survive; ``False`` compares all characters.
    """
    norm = df.where(strip(F.col(column)) != "").select(
        F.col(order).cast("bigint").alias("ord"), normalized_question(F.col(column)).alias("norm")
    )
    unique = first_per_key(norm, F.col("norm")).withColumn("len", F.length("norm"))
    weighted = running_totals(unique, [F.col("len"), F.col("ord")], {"cum": F.col("len") + ROW_WEIGHT})
    # small inputs get smaller tiles, so that there are tile pairs for every core
    total = weighted.agg(F.max("cum")).first()[0] or 1
    cores = df.sparkSession.sparkContext.defaultParallelism
    tile_weight = max(1, min(tile_weight, int(total / math.ceil(math.sqrt(4 * cores)))))
    tile = F.floor(F.col("cum") / tile_weight).alias("tile")
    targets = sources = _packed(weighted.select(tile, "ord", "len", "norm", F.lit(False).alias("kept")))
    kept = None
    while True:
        found = _neighbours(targets, sources, threshold, autojunk)
        state = write_out(targets.select(F.explode("ord").alias("ord")).join(found, "ord", "left"), "round")
        new = state.where(F.col("hit_kept").isNull()).select("ord")
        kept = new if kept is None else kept.unionByName(new)
        waiting = state.where(~F.col("hit_kept"))
        pending = waiting.join(new.withColumnRenamed("ord", "earliest"), "earliest", "left_anti").select("ord")
        pending = write_out(pending, "pending")
        if pending.isEmpty():
            return kept
        marked = pending.withColumn("kept", F.lit(False)).unionByName(new.withColumn("kept", F.lit(True)))
        sources = _packed(_unpacked(targets).drop("kept").join(marked, "ord"))
        targets = _packed(_unpacked(sources).where(~F.col("kept")))


def dedupe_fuzzy(df: DataFrame, column: str = "question", order: str = "ord", **options) -> DataFrame:
    """DUP3: keep the rows chosen by :func:`fuzzy_kept`."""
    kept = fuzzy_kept(df, column, order, **options).withColumnRenamed("ord", order)
    return df.join(kept, order, "left_semi")
