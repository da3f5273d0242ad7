"""Jaccard self-join of shingle sets by signature trees.

Equal sets are one leaf.  A tree's leaves are sorted by size and first shingle; a node holds the OR of the token bitmaps below it, the
range of their sizes and how many shingles a bitmap hides at most (shingles that share a bit).  Two trees, or a tree and
itself, are traversed together: a pair of nodes is left out when their sizes are too far apart, when the largest overlap their
bitmaps allow is below what the threshold asks of their smallest sets, or when all their leaves already hang together.  Pairs of leaves
that are left are verified on full sets, so no link between different components is lost.

Which leaves come into one tree is found exactly: shingles are ordered by how many sets hold them, and sets that reach the
threshold share one of their first ``n - ceil(0.85 n) + 1`` shingles.  Shingles that one set alone holds are only counted, so most
texts have no shingle to share.  Sets that hang together by such shingles form a candidate group; groups are laid out by size in tiles of
bounded weight, a tile is one task, and a group of many tiles is traversed as pairs of tiles whose size ranges meet.  Shingles in 1 %
of all texts are known beforehand (a list of bounded length) and don't meet in the task that counts sets of a shingle.

A document's set is its distinct shingles of four words (A-Z lower-cased, words divided by ASCII white space; fewer words are one
shingle), as 64-bit hashes.  Null texts and texts without words have no set: size 0, linked with nothing, component their own id.  An id
may stand on several rows: links go by text, and a component's id is the smallest one of all its rows.  A row with a null id gets its
component's id, null if there is none.  Repeated rows are repeated in the result; extra columns don't matter.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qacorpus.operators.ordering import running_totals

from .base import query, staged, table
from .bitmaps import maybe_in
from .circulant import mix, set_hash, shingle_set
from .components import components
from .near import Threshold

WORDS = 4
LIKE = Threshold(85, 100)
#: Children of a node, bits of a leaf's bitmap for each shingle of the largest set, and the bytes all bitmaps of a tree may take.
FAN, BITS_EACH, BITMAP_BYTES = 8, 8, 1 << 26
#: Shingles of a tile, and shingles that one task of the count gets, about.
TILE, PART = 1 << 22, 1 << 22
#: Shingles added up at a time; sets that a task remembers as sent.
HELD, SEEN = 1 << 20, 1 << 17
#: A shingle is hot when this share of all texts, and as many of one lot, hold it.
HOT_SHARE, HOT_LEAST = 0.01, 64
_HOT = np.uint32(0xFFFFFFFF)


def node_of(s: np.ndarray, seed: int) -> tuple[int, int, int]:
    """A 64-bit number of a set, and the two hashes that tell sets apart."""
    a, b = set_hash(s)
    h = np.array([a, b], np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        node = mix(h[:1] * np.uint64(0x9E3779B97F4A7C15) + mix(h[1:] + np.uint64(seed)) + np.uint64(len(s)))
    return int(node.view(np.int64)[0]), a, b


def described(docs: DataFrame, words: int, seed: int, hot_least: int) -> DataFrame:
    """``id, t, n, node, h1, h2`` of every row; some rows carry shingles that many texts of their lot hold (``hot``, with counts)."""

    def often(sets: list[np.ndarray]) -> list[tuple[int, int]]:
        keys, counts = np.unique(np.concatenate(sets), return_counts=True)
        keep = counts >= max(hot_least, len(sets) // 50)
        return list(zip(keys[keep].view(np.int64).tolist(), counts[keep].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lot, size, columns = {}, 0, [[], [], [], [], []]
            last = batch.num_rows - 1
            for k, text in enumerate(batch.column(2)):
                s = shingle_set(text.as_py(), words)
                node, a, b = node_of(s, seed) if len(s) else (0, 0, 0)
                if len(s) and node not in lot:
                    lot[node] = s
                    size += len(s)
                hot = None
                if lot and (size >= 2 * HELD or k == last):
                    hot = often(list(lot.values()))
                    lot, size = {}, 0
                for column, value in zip(columns, (len(s), node, a, b, hot)):
                    column.append(value)
            hot = pa.array(columns[4], pa.list_(pa.struct([("token", pa.int64()), ("c", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:4]), hot],
                names=["id", "t", "n", "node", "h1", "h2", "hot"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, t long, n int, node long, h1 long, h2 long, hot array<struct<token: long, c: long>>")


# ---- candidate groups: which sets share one of their rarest shingles


def _blocks(part: np.ndarray, parts: int, doc: np.ndarray, sets: list[tuple[int, int, int]], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Shingles by part: the sets of each part (number, size, different keys) and how many keys follow for each."""
    order = np.argsort(part.astype(np.int16) if parts < 1 << 14 else part, kind="stable")
    doc, keys = doc[order], keys[order]
    bounds = np.searchsorted(part[order], np.arange(2 * parts + 1))
    nodes, n, m = (np.array(x) for x in zip(*sets))
    out = {"part": [], "nodes": [], "n": [], "m": [], "counts": [], "keys": []}
    for p in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[p], bounds[p + 1]
        first = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
        of = doc[a:b][first]
        out["part"].append(int(p))
        for name, value in (("nodes", nodes[of].astype(np.int64)), ("n", n[of].astype(np.int32)), ("m", m[of].astype(np.int32)),
                            ("counts", np.diff(np.append(first, b - a)).astype(np.int32)), ("keys", keys[a:b].astype(np.uint32))):
            out[name].append(value.tobytes())
    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("nodes", "n", "m", "counts", "keys"))]))


def _read(block: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in block.column(name)])


def prefix_rows(docs: DataFrame, words: int, t: Threshold, seed: int, parts: int, hot: np.ndarray) -> DataFrame:
    """``key, node``: for every set its first shingles in order of rarity, without those that no other set holds.

    A shingle is known by its part and 32 bits more; where two shingles of a set share these, the set counts as having one key less,
    which the number of first shingles (taken from the true size) allows for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, sets, tokens, size = set(), [], [], 0
        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), words)
                node = node_of(s, seed)[0] if len(s) else 0
                if not len(s) or node in sent:
                    continue
                if len(sent) < SEEN:
                    sent.add(node)
                sets.append((node, len(s)))
                tokens.append(s)
                size += len(s)
                if size >= HELD:
                    yield from flush(sets, tokens)
                    sets, tokens, size = [], [], 0
        if sets:
            yield from flush(sets, tokens)

    def flush(sets, tokens) -> Iterator[pa.RecordBatch]:
        flat, doc = np.concatenate(tokens), np.repeat(np.arange(len(sets)), [n for _, n in sets])
        part = (((flat >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        key = flat & np.uint64(0xFFFFFFFF)
        # tokens are sorted in each set, so equal keys of one part needn't be neighbours
        order = np.lexsort((key, part, doc))
        same = np.zeros(len(flat), bool)
        same[1:] = (key[order][1:] == key[order][:-1]) & (part[order][1:] == part[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        keep = order[~same]
        flat, doc, part, key = flat[keep], doc[keep], part[keep], key[keep]
        different = np.bincount(doc, minlength=len(sets))
        if len(hot):  # they pass the count: straight to the parts of the sets
            at = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
            nodes = mix(np.array([node for node, _ in sets], np.int64).view(np.uint64))
            is_hot = hot[at] == flat
            part = np.where(is_hot, parts + (nodes[doc] % np.uint64(parts)).astype(np.int64), part)
            key = np.where(is_hot, at.astype(np.uint64), key)
        yield from _blocks(part, parts, doc, [(node, n, int(m)) for (node, n), m in zip(sets, different)], key)

    def counted(block: pa.Table) -> pa.Table:
        part = block.column("part")[0].as_py()
        counts = _read(block, "counts", np.int32)
        node, n, m = (np.repeat(_read(block, x, kind), counts) for x, kind in (("nodes", np.int64), ("n", np.int32), ("m", np.int32)))
        key = _read(block, "keys", np.uint32)
        order = np.lexsort((node, key))
        node, n, m, key = node[order], n[order], m[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (node[1:] != node[:-1]) | (key[1:] != key[:-1])
        node, n, m, key = node[new], n[new], m[new], key[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        df = np.diff(np.append(first, len(key)))
        held = np.repeat(df, df)
        shared = (held > 1) | (part >= parts)
        node, n, m, df = node[shared], n[shared], m[shared], (held[shared].astype(np.uint32) if part < parts else np.full(int(shared.sum()), _HOT))
        whole = key[shared].astype(np.uint64) | np.uint64(min(part, parts) << 32)
        to = (mix(node.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[order], np.arange(parts + 1))
        out = {"part": [], "nodes": [], "n": [], "m": [], "df": [], "keys": []}
        for p in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[p] : bounds[p + 1]]
            out["part"].append(int(p))
            for name, value in (("nodes", node), ("n", n), ("m", m), ("df", df), ("keys", whole)):
                out[name].append(value[at].tobytes())
        return pa.table(out, schema=pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("nodes", "n", "m", "df", "keys"))]))

    def chosen(block: pa.Table) -> pa.Table:
        node, n, m = _read(block, "nodes", np.int64), _read(block, "n", np.int32).astype(np.int64), _read(block, "m", np.int32)
        df, key = _read(block, "df", np.uint32), _read(block, "keys", np.uint64)
        order = np.lexsort((key, df, node))
        node, n, m, key = node[order], n[order], m[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        shared = np.diff(np.append(first, len(node)))
        rank = np.arange(len(node)) - np.repeat(first, shared)
        prefix = n + (-n * t.num) // t.den + 1
        keep = rank < prefix - (m - np.repeat(shared, shared))
        return pa.table({"key": pa.array(key[keep].view(np.int64)), "node": pa.array(node[keep])})

    sent = docs.mapInArrow(run, "part int, nodes binary, n binary, m binary, counts binary, keys binary")
    shared = sent.groupBy("part").applyInArrow(counted, "part int, nodes binary, n binary, m binary, df binary, keys binary")
    return shared.groupBy("part").applyInArrow(chosen, "key long, node long")


def candidate_groups(first: DataFrame) -> DataFrame:
    """``node, component``: sets that hang together by shared first shingles."""
    anchors = staged(first.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("c")).where("c > 1").drop("c"), "anchors")
    edges = first.join(anchors, "key").where("node != v").select(F.col("node").alias("u"), "v")
    return components(edges)


# ---- signature trees


class Tree:
    """Leaves are the given sets, in the order of ``order``; levels go from the leaves up."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        n = np.array([len(s) for s in sets])
        self.order = np.lexsort((np.array([s[0] for s in sets]), n))
        self.sets = [sets[k] for k in self.order]
        signs = np.zeros((len(sets), bits // 64), np.uint64)
        hidden = np.zeros(len(sets), np.int64)
        for k, s in enumerate(self.sets):
            flags = np.zeros(bits, np.uint8)
            flags[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
            signs[k] = np.packbits(flags).view(np.uint64)
            hidden[k] = len(s) - int(flags.sum())
        n = n[self.order]
        self.levels = [(signs, n, n, hidden)]
        while len(self.levels[-1][1]) > 1:
            signs, low, high, hidden = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(signs, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(hidden, cut)))

    def labels(self, level: int, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest label of the leaves below each node of a level."""
        low = high = leaf
        for _ in range(level):
            cut = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
        return low, high


def bitmap_bits(sets: list[np.ndarray]) -> int:
    bits = 256
    while bits < BITS_EACH * max(map(len, sets)) and 2 * bits * len(sets) <= 8 * BITMAP_BYTES:
        bits *= 2
    return bits


def within_reach(a: Tree, b: Tree, level: int, i: np.ndarray, j: np.ndarray, t: Threshold) -> np.ndarray:
    """Which pairs of nodes may hold sets that reach the threshold, by sizes and by the overlap their bitmaps allow at most."""
    (sa, la, ha, ea), (sb, lb, hb, eb) = a.levels[level], b.levels[level]
    keep = (ha[i] * t.den >= lb[j] * t.num) & (hb[j] * t.den >= la[i] * t.num)
    at = np.flatnonzero(keep)
    step = max(1, (1 << 21) // sa.shape[1])
    for k in range(0, len(at), step):
        x, y = i[at[k : k + step]], j[at[k : k + step]]
        both = np.bitwise_count(sa[x] & sb[y]).sum(axis=1, dtype=np.int64)
        most = np.minimum(both + np.minimum(ea[x], eb[y]), np.minimum(ha[x], hb[y]))
        keep[at[k : k + step]] = most * (t.num + t.den) >= (la[x] + lb[y]) * t.num
    return keep


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


def traverse(a: Tree, b: Tree, t: Threshold) -> list[tuple[int, int]]:
    """Verified pairs (places in ``a`` and ``b``) that join all components of the links between the trees; ``a is b`` for a self-join."""
    same = a is b
    m = len(a.sets)
    label = np.arange(m if same else m + len(b.sets))
    of_b = 0 if same else m
    found: list[tuple[int, int]] = []

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of leaves: some of each pair of components at a time, twice as many after each round."""
        take = 1
        while len(i):
            x, y = label[i], label[of_b + j]
            open_ = x != y
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            key = np.minimum(x, y) * len(label) + np.maximum(x, y)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
            rank = np.empty(len(key), np.int64)
            rank[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
            now = rank < take
            for p, q in zip(i[now].tolist(), j[now].tolist()):
                if label[p] == label[of_b + q]:
                    continue
                s, r = a.sets[p], b.sets[q]
                if t.holds(overlap(s, r), len(s), len(r)):
                    found.append((p, q))
                    low, high = sorted((label[p], label[of_b + q]))
                    label[label == high] = low
            i, j, take = i[~now], j[~now], 2 * take

    if same and m > 1:  # neighbours in the order first: copies with small changes hang together after that
        verify(np.arange(m - 1), np.arange(1, m))
    while len(a.levels) < len(b.levels):  # roots at one height
        a.levels.append(a.levels[-1])
    while len(b.levels) < len(a.levels):
        b.levels.append(b.levels[-1])
    top = len(a.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    step = 1 << 14
    while stack:
        level, i, j = stack.pop()
        (low_a, high_a), (low_b, high_b) = a.labels(min(level, _height(m)), label[:m]), b.labels(min(level, _height(len(b.sets))), label[of_b:])
        open_ = ~((low_a[i] == high_a[i]) & (low_b[j] == high_b[j]) & (low_a[i] == low_b[j]))
        i, j = i[open_], j[open_]
        near = within_reach(a, b, level, i, j, t)
        i, j = i[near], j[near]
        if not level:
            verify(i, j) if not same else verify(i[i < j], j[i < j])
            continue
        x, y = _children(i, j, len(a.levels[level - 1][1]), len(b.levels[level - 1][1]), level > _height(m), level > _height(len(b.sets)))
        if same:
            x, y = x[x <= y], y[x <= y]
        for k in reversed(range(0, len(x), step)):
            stack.append((level - 1, x[k : k + step], y[k : k + step]))
    return found


def _height(leaves: int) -> int:
    h = 0
    while leaves > 1:
        leaves = -(-leaves // FAN)
        h += 1
    return h


def _children(i, j, count_a: int, count_b: int, flat_a: bool, flat_b: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of each pair of nodes; above its root a tree goes on as the root itself."""
    fa, fb = (1 if flat_a else FAN), (1 if flat_b else FAN)
    x = (i[:, None] * fa + np.arange(fa))[:, :, None] + np.zeros(fb, np.int64)
    y = (j[:, None] * fb + np.arange(fb))[:, None, :] + np.zeros((fa, 1), np.int64)
    ok = (x < count_a) & (y < count_b)
    return x[ok], y[ok]


def linked(nodes: list[int], sets: list[np.ndarray], sides: list[int], t: Threshold) -> list[tuple[int, int]]:
    """Links that join the components of a group: among all its sets, or between side 0 and side 1 where there are two."""
    bits = bitmap_bits(sets)
    at = [[k for k, s in enumerate(sides) if s == side] for side in (0, 1)]
    if not at[1]:
        tree = Tree(sets, bits)
        return [(nodes[tree.order[p]], nodes[tree.order[q]]) for p, q in traverse(tree, tree, t)]
    if not at[0]:
        return []
    a, b = (Tree([sets[k] for k in side], bits) for side in at)
    return [(nodes[at[0][a.order[p]]], nodes[at[1][b.order[q]]]) for p, q in traverse(a, b, t)]


def tiled(members: DataFrame, tile: int) -> DataFrame:
    """``node, component, cell, side``: the tasks that each set of a candidate group takes part in.

    Sets are laid out by group and size and cut into tiles of ``tile`` shingles; cell (i, i) joins tile i with itself, cell (i, j) two tiles
    of one group whose sizes meet.
    """
    order = [F.col("component"), F.col("n"), F.col("node")]
    laid = running_totals(members.select("component", "n", "node", F.col("n").cast("long").alias("w")), order, {"upto": F.col("w")})
    rows = staged(laid.select("component", "n", "node", F.expr(f"cast((upto - w) div {tile} as long)").alias("tile")), "tiles")
    pieces = staged(rows.groupBy("component", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high")), "pieces")
    a, b = pieces.alias("a"), pieces.alias("b")
    meet = (F.col("a.component") == F.col("b.component")) & (F.col("a.tile") < F.col("b.tile")) & (F.col("a.high") * LIKE.den >= F.col("b.low") * LIKE.num)
    pairs = a.join(b, meet).select("a.component", F.col("a.tile").alias("i"), F.col("b.tile").alias("j"))
    both = pairs.select("component", F.explode(F.array(
        F.struct(F.col("i").alias("tile"), F.lit(0).alias("side"), "i", "j"), F.struct(F.col("j").alias("tile"), F.lit(1).alias("side"), "i", "j"))).alias("p"))
    own = rows.select("node", "component", F.struct(F.col("tile").alias("i"), F.col("tile").alias("j")).alias("cell"), F.lit(0).alias("side"))
    across = rows.join(both.select("component", "p.*"), ["component", "tile"]).select("node", "component", F.struct("i", "j").alias("cell"), "side")
    return own.union(across)


def tree_links(cells: DataFrame, words: int, t: Threshold, seed: int) -> DataFrame:
    """``u, v``: links from the trees of each cell (``cell, component, side, node, text``)."""

    def run(block: pa.Table) -> pa.Table:
        groups: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        for component, side, node, text in zip(*(block.column(c).to_pylist() for c in ("component", "side", "node")), block.column("text")):
            s = shingle_set(text.as_py(), words)
            if len(s) and node_of(s, seed)[0] == node:  # a text of equal hash may be another one
                groups.setdefault(component, {})[side, node] = s
        out = []
        for group in groups.values():
            keys = list(group)
            if len(keys) > 1:
                out += linked([node for _, node in keys], [group[k] for k in keys], [side for side, _ in keys], t)
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return cells.groupBy("cell").applyInArrow(run, "u long, v long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, like: Threshold = LIKE,
                       tile: int = TILE, hot_share: float = HOT_SHARE, hot_least: int = HOT_LEAST) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id`` (smallest id reachable by links)."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    for seed in range(8):
        every = staged(described(rows, words, seed, hot_least), "described")
        classes = staged(every.where("n > 0").groupBy("node", "h1", "h2", "n").agg(F.min("id").alias("first"), F.min("t").alias("t")), "classes")
        if classes.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("sets share their numbers under every seed")
    texts, size = classes.agg(F.count("*"), F.sum("n")).first()
    often = every.where("hot is not null").select(F.inline("hot")).groupBy("token").agg(F.sum("c").alias("c"))
    # a shingle of one hundredth of all texts: at most a hundred average sets of them
    least = max(hot_least, int(texts * hot_share))
    hot = np.sort(often.where(F.col("c") >= least).select("token").toArrow().column("token").to_numpy().astype(np.int64).view(np.uint64))
    parts = (size or 0) // PART + 1
    first = staged(prefix_rows(rows.select("text"), words, like, seed, parts, hot), "first")
    groups = staged(candidate_groups(first), "groups")
    members = staged(groups.join(classes.select("node", "n", "t"), "node"), "members")
    known = maybe_in(rows.where(F.col("text").isNotNull()).select("t", "text"), "t", members, "t")
    known = known.groupBy("t", F.xxhash64("text", F.lit(1)).alias("u")).agg(F.first("text").alias("text"))
    found = staged(known.join(members.select("t", "node"), "t").select("node", "text"), "texts")
    links = staged(tree_links(tiled(members, tile).join(found, "node"), words, like, seed), "links")
    joined = components(links)
    named = classes.join(joined, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    smallest = staged(named.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    named = staged(named.join(smallest, "component").select("node", "component_id"), "named")
    out = every.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


@query("op13_ngram_jaccard_join")
def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
