"""SentencePiece encoding of the merge type with seeded merge-dropout, and lossless decoding.

Encoding follows the merge rule of a BPE piece model: a chunk (a run of spaces and the letters behind it) starts as its
characters, and an agenda of adjacent pairs, best score first and leftmost among equals, joins them.  With dropout, a candidate
merge is skipped when a hash of the pair and its place in the chunk falls under the rate.  That hash is keyed by the seed, the
document and the place of the chunk in the document, so every occurrence of a word draws on its own, and the same document gets
the same pieces under the same seed.  Characters without a piece become byte pieces.  Decoding joins pieces and bytes and gives
the text back exactly.

What is remembered between occurrences doesn't depend on their keys: the candidates of a chunk in the order in which its agenda
offers them, and for each of them the run that follows when it is the first one skipped (:class:`Runs`).  An occurrence tests all
candidates of a run with its own key and goes from run to run until none is skipped.  A run that isn't there is made where a slice
needs it more than once; any other occurrence has an agenda of its own.  The runs are bounded; chunks longer than ``LONG`` have none.

Spaces are written as U+2581; a U+2581 of the text itself becomes byte pieces, so that decoding can't take it for a space.  A
leading space is added, as the model's training does, and removed when decoding.  Null texts give null pieces and an empty text
gives none; rows are independent, so repeated rows and extra columns don't matter, and a row with a null id is keyed by its text.
No pieces are trained here.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .base import query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
DROPOUT, SEED, LONG = 0.1, 17, 64
#: Runs and candidates that a worker remembers; chunks whose candidates are tested together.
RUNS, OFFERS, SLICE = 500_000, 6_000_000, 1 << 16
#: Slots of the table of pairs, about a sixteenth of them taken; rank of no merge.
PAIR_SLOTS, NEVER = 1 << 20, 2**31 - 1
#: A chunk: spaces and what follows up to the next space.  Pieces never have a space after another character.
CHUNK = regex.compile("▁*[^▁]+|▁+")


class Pieces:
    """Piece ids, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.text)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.merges = {self.text[i]: (-model.get_score(i), xxhash.xxh32_intdigest(self.text[i]), self.text[i]) for i in plain}
        self.id = {self.text[i]: i for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(len(self.text)) if model.is_byte(i)}
        self.back = {i: b for b, i in self.byte.items()}
        assert len(self.byte) == 256, "the model needs byte pieces"
        assert all(SPACE not in p.lstrip(SPACE) for p in self.id), "a piece holds a space after another character"

        # symbols beyond the pieces: characters that only occur inside pieces
        singles = sorted({c for piece in self.id for c in piece} - set(self.id))
        self.symbol = {**self.id, **{c: len(self.text) + k for k, c in enumerate(singles)}}
        self.singles = singles
        longer = sorted((piece for piece in self.id if len(piece) > 1), key=lambda piece: self.merges[piece][0])
        # the numpy agenda needs distinct scores; only runs of spaces share one, and chunks with such a run go to the heap
        words = [piece for piece in longer if piece.strip(SPACE)]
        self.ranked = len({self.merges[piece][0] for piece in words}) == len(words)
        self.by_rank = np.array([self.id[piece] for piece in longer], np.int32)
        self.hash_by_rank = np.array([self.merges[piece][1] for piece in longer], np.uint32)
        pairs = [
            (self.symbol[piece[:k]] << 32 | self.symbol[piece[k:]], rank)
            for rank, piece in enumerate(longer) for k in range(1, len(piece)) if piece[:k] in self.symbol and piece[k:] in self.symbol
        ]
        keys, ranks = np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int32)
        self.pair_keys, self.pair_ranks = np.full(PAIR_SLOTS, -1, np.int64), np.full(PAIR_SLOTS, NEVER, np.int32)
        slots = self.slots(keys)
        while len(keys):  # open addressing: whoever finds its slot taken goes on to the next one
            free = self.pair_keys[slots] < 0
            self.pair_keys[slots[free]], self.pair_ranks[slots[free]] = keys[free], ranks[free]
            left = self.pair_keys[slots] != keys
            keys, ranks, slots = keys[left], ranks[left], (slots[left] + 1) & (PAIR_SLOTS - 1)
        points = np.full(0x110000, -1, np.int32)
        for c, k in self.symbol.items():
            if len(c) == 1:
                points[ord(c)] = k
        self.points = points

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) & (PAIR_SLOTS - 1)

    def offers(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, key: np.ndarray, threshold: int) -> np.ndarray:
        """Rank of the merge of each pair of symbols; NEVER where there is none or the keyed hash skips it."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        slots = self.slots(keys)
        found = self.pair_ranks[slots]
        here = self.pair_keys[slots]
        todo = np.flatnonzero((here != keys) & (here != -1))
        found[here != keys] = NEVER
        while len(todo):
            slots[todo] = (slots[todo] + 1) & (PAIR_SLOTS - 1)
            here = self.pair_keys[slots[todo]]
            hit = here == keys[todo]
            found[todo[hit]] = self.pair_ranks[slots[todo[hit]]]
            todo = todo[~hit & (here != -1)]
        if threshold:
            some = np.flatnonzero(found != NEVER)
            x = (self.hash_by_rank[found[some]] ^ key[some]) * np.uint32(0x9E3779B1) + at[some].astype(np.uint32) * np.uint32(0x85EBCA77)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
            found[some[x < threshold]] = NEVER
        return found

    def segment_many(self, chunks: list[str], keys: np.ndarray, threshold: int) -> list[bytes]:
        """:meth:`chunk_ids` of many chunks of at most ``LONG`` characters: all agendas of like length step together."""
        out: list[bytes] = [b""] * len(chunks)
        lengths = np.array([len(c) for c in chunks])
        order = np.argsort(lengths, kind="stable")
        for part in np.split(order, np.searchsorted(lengths[order], (6, 8, 10, 12, 16, 24, 40), side="right")):
            for a in range(0, len(part), 8_192):
                self._step_all([chunks[k] for k in part[a : a + 8_192]], part[a : a + 8_192], keys, threshold, out)
        return out

    def _step_all(self, chunks: list[str], rows: np.ndarray, keys: np.ndarray, threshold: int, out: list[bytes]) -> None:
        width = max(map(len, chunks))
        points = np.frombuffer("".join(c.ljust(width, "\0") for c in chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)
        sizes = np.array([len(c) for c in chunks])
        inside = np.arange(width) < sizes[:, None]
        # characters without a symbol are -2 - code point: they never merge
        sym = np.where(inside, self.points[points], -1).astype(np.int64)
        sym = np.where(inside & (sym < 0), -2 - points.astype(np.int64), sym)
        at = np.broadcast_to(np.arange(width), sym.shape).copy()
        key = keys[rows]
        agenda = np.full((len(sym), max(width - 1, 1)), NEVER, np.int32)
        for c in range(width - 1):
            agenda[:, c] = self.offers(sym[:, c], sym[:, c + 1], at[:, c], key, threshold)
        while len(sym):
            best = agenda.argmin(axis=1)
            n = np.arange(len(sym))
            rank = agenda[n, best]
            done = rank == NEVER
            if done.any():
                self._finish(sym[done], rows[done], out)
                live = ~done
                sym, at, agenda, key, rows, best, rank = sym[live], at[live], agenda[live], key[live], rows[live], best[live], rank[live]
                if not len(sym):
                    return
                n = np.arange(len(sym))
            sym[n, best] = self.by_rank[rank]
            # the right one of the pair goes, what follows moves up
            take = np.arange(sym.shape[1] - 1)
            take = take + (take > best[:, None])
            sym, at = np.take_along_axis(sym, take, 1), np.take_along_axis(at, take, 1)
            if agenda.shape[1] > 1:
                drop = np.arange(agenda.shape[1] - 1)
                agenda = np.take_along_axis(agenda, drop + (drop >= best[:, None]), 1)
                right = np.flatnonzero(best < sym.shape[1] - 1)
                b = best[right]
                agenda[right, b] = self.offers(sym[right, b], sym[right, b + 1], at[right, b], key[right], threshold)
                left = np.flatnonzero(best > 0)
                b = best[left] - 1
                agenda[left, b] = self.offers(sym[left, b], sym[left, b + 1], at[left, b], key[left], threshold)
            else:
                agenda = np.full((len(sym), 1), NEVER, np.int32)

    def _finish(self, sym: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        count = (sym != -1).sum(axis=1)
        plain = ((sym >= 0) & (sym < len(self.text)) | (sym == -1)).all(axis=1)
        flat = sym[sym != -1].astype("<i4").tobytes()
        end = 4 * np.cumsum(count)
        for k, (row, b, n, ok) in enumerate(zip(rows.tolist(), end.tolist(), (4 * count).tolist(), plain.tolist())):
            if ok:
                out[row] = flat[b - n : b]
                continue
            ids: list[int] = []
            for x in sym[k][: n // 4].tolist():
                if 0 <= x < len(self.text):
                    ids.append(x)
                else:
                    c = self.singles[x - len(self.text)] if x >= 0 else chr(-2 - x)
                    ids.extend(self.byte[v] for v in c.encode("utf-8", "surrogatepass"))
            out[row] = struct.pack(f"<{len(ids)}i", *ids)

    def segment(self, symbols: list[str], key: int, threshold: int, skips: frozenset[int] | None = None, offered: list | None = None) -> list[str]:
        """Agenda of merges over ``symbols``; the keyed hash skips ``threshold`` of 2^32 candidates.

        With ``skips`` those candidates are skipped instead, by their number, and every candidate's hash and place go to ``offered``.
        """
        merges = self.merges.get
        n = len(symbols)
        part: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, str, int]] = []

        def offer(i: int, j: int) -> None:
            known = merges(part[i] + part[j])
            if known is None:
                return
            if skips is not None:
                offered.append((known[1], i))
                if len(offered) - 1 not in skips:
                    heapq.heappush(agenda, (known[0], i, known[2], j))
            else:
                # the place and the pair go into the hash by way of the multipliers
                x = ((known[1] ^ key) * 0x9E3779B1 + i * 0x85EBCA77) & 0xFFFFFFFF
                if (x ^ (x >> 15)) * 0xC2B2AE3D & 0xFFFFFFFF >= threshold:
                    heapq.heappush(agenda, (known[0], i, known[2], j))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, whole, j = heapq.heappop(agenda)
            if part[i] is None or after[i] != j or part[j] is None or len(part[i]) + len(part[j]) != len(whole):
                continue  # one of the two has changed since
            part[i], part[j] = whole, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if (h := before[i]) >= 0:
                offer(h, i)
        return [p for p in part if p is not None]

    def pack(self, parts: list[str]) -> bytes:
        """Ids of symbols as packed 32-bit numbers; symbols without a piece become byte pieces."""
        out: list[int] = []
        for p in parts:
            i = self.id.get(p)
            if i is None:
                out.extend(self.byte[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(i)
        return struct.pack(f"<{len(out)}i", *out)

    def keyed_ids(self, chunk: str, key: int, threshold: int) -> bytes:
        """Ids of a chunk that has its spaces as U+2581, for the key of an occurrence."""
        return self.pack(self.segment(list(chunk), key, threshold))

    def chunk_ids(self, chunk: str, variant: int, seed: int, threshold: int) -> bytes:
        """:meth:`keyed_ids` for a key made from the chunk, a number and the seed."""
        return self.keyed_ids(chunk, xxhash.xxh32_intdigest(chunk, seed * 1_000 + variant), threshold)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def occurrence_keys(document: object, text: str, seed: int, n: int) -> np.ndarray:
    """Keys of the ``n`` chunks of a document by their places; a document without an id is told apart by its text."""
    name = b"t" + text.encode("utf-8", "surrogatepass") if document is None else f"d{document}".encode("utf-8", "surrogatepass")
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(xxhash.xxh64_intdigest(name, seed))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(end - len(self.data), len(self.data)), self.data.dtype)])
        self.data[self.n : end] = values
        self.n = end


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions ``start[k], start[k] + 1, ...``, ``count[k]`` of each."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(start - before, count)


class Runs:
    """Runs of the agenda with given skips, independent of any key.

    A run is the chunk and the numbers of its skipped candidates.  It holds the candidates behind the last skipped one (hash and
    place), for each of them the run in which it is the first skipped one (-1: not made), and the ids that come out when none is.
    """

    def __init__(self, own: Pieces):
        self.own, self.root = own, {}
        self.names: list[str] = []
        self.start, self.count, self.ids_start, self.ids_count = (Grown(np.int64) for _ in range(4))
        self.chunk, self.parent, self.skip, self.behind = (Grown(np.int32) for _ in range(4))
        self.hash, self.place, self.next, self.ids = Grown(np.uint32), Grown(np.uint32), Grown(np.int32), Grown(np.int32)
        self.root[None] = self._put([], np.array([own.byte[b] for b in SPACE.encode()]), -1, -1, -1, 0)  # a U+2581 of the text

    def _put(self, offered: list, ids: np.ndarray, chunk: int, parent: int, skip: int, behind: int) -> int:
        run = self.start.n
        for grown, value in ((self.start, self.hash.n), (self.count, len(offered)), (self.ids_start, self.ids.n), (self.ids_count, len(ids)),
                             (self.chunk, chunk), (self.parent, parent), (self.skip, skip), (self.behind, behind)):
            grown.add((value,))
        if offered:
            self.hash.add([h for h, _ in offered])
            self.place.add([i for _, i in offered])
            self.next.add(np.full(len(offered), -1, np.int32))
        self.ids.add(ids)
        return run

    def full(self) -> bool:
        return self.start.n >= RUNS or self.hash.n >= OFFERS

    def _make(self, chunk: int, parent: int, skip: int) -> int:
        skips, run = set() if skip < 0 else {skip}, parent
        while run >= 0:
            skips.add(int(self.skip.data[run]))
            run = int(self.parent.data[run])
        offered: list = []
        parts = self.own.segment(list(self.names[chunk]), 0, 0, frozenset(skips), offered)
        return self._put(offered[skip + 1 :], np.frombuffer(self.own.pack(parts), np.int32), chunk, parent, skip, skip + 1)

    def add_root(self, chunk: str) -> None:
        self.names.append(chunk)
        self.root[chunk] = self._make(len(self.names) - 1, -1, -1)

    def add_next(self, run: int, at: int) -> None:
        """The run in which the candidate at position ``at``, one of ``run``, is skipped too."""
        skip = int(self.behind.data[run]) + at - int(self.start.data[run])
        self.next.data[at] = made = self._make(int(self.chunk.data[run]), run, skip)
        assert made > run

    def walk(self, run: np.ndarray, keys: np.ndarray, threshold: int) -> np.ndarray:
        """The run in which each occurrence skips no more, -1 where it isn't there."""
        final = np.full(len(run), -1, np.int64)
        live = np.flatnonzero(run >= 0)
        run = run[live]
        while len(live):
            count = self.count.data[run]
            at = ragged(self.start.data[run], count)
            owner = np.repeat(np.arange(len(live), dtype=np.int32), count)
            x = (self.hash.data[at] ^ np.repeat(keys[live], count)) * np.uint32(0x9E3779B1) + self.place.data[at] * np.uint32(0x85EBCA77)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
            skipped = np.flatnonzero(x < threshold)
            who = owner[skipped]
            first = np.ones(len(who), bool)
            first[1:] = who[1:] != who[:-1]
            who, at = who[first], at[skipped[first]]
            ends = np.ones(len(live), bool)
            ends[who] = False
            final[live[ends]] = run[ends]
            lack = np.flatnonzero(self.next.data[at] < 0)
            places, one, often = np.unique(at[lack], return_index=True, return_counts=True)
            for place, k in zip(places[often > 1].tolist(), one[often > 1].tolist()):
                if self.full():
                    break
                self.add_next(int(run[who[lack[k]]]), place)
            there = self.next.data[at] >= 0
            live, run = live[who[there]], self.next.data[at[there]]
        return final


class Encoder:
    def __init__(self, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED):
        self.pieces, self.seed = pieces(path), seed
        self.threshold = round(dropout * 2**32)
        self.runs = Runs(self.pieces)

    def _slice(self, chunks: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some chunks one after the other, and how many each has; None is a U+2581 of the text."""
        if self.runs.full():  # words in use come back at once
            self.runs = Runs(self.pieces)
        runs, own = self.runs, self.pieces
        at = np.fromiter(map(runs.root.get, chunks, repeat(-1)), np.int64, len(chunks))
        lack = np.flatnonzero(at < 0).tolist()
        for c, n in Counter(chunks[k] for k in lack).items():
            if n > 1 and len(c) <= LONG and not runs.full():
                runs.add_root(c)
        at[lack] = [runs.root.get(chunks[k], -1) for k in lack]
        final = runs.walk(at, keys, self.threshold)
        alone = np.flatnonzero(final < 0)
        found: list[bytes] = [b""] * len(alone)
        many: list[int] = []
        for k, place in enumerate(alone.tolist()):
            c = chunks[place]
            if len(c) <= LONG and own.ranked and 2 * SPACE not in c:
                many.append(k)
            else:
                found[k] = own.keyed_ids(c, int(keys[place]), self.threshold)
        if many:
            for k, ids in zip(many, own.segment_many([chunks[p] for p in alone[many].tolist()], keys[alone[many]], self.threshold)):
                found[k] = ids
        counts = runs.ids_count.data[np.maximum(final, 0)]
        starts = runs.ids_start.data[np.maximum(final, 0)]
        counts[alone] = [len(x) // 4 for x in found]
        starts[alone] = runs.ids.n + np.cumsum(counts[alone]) - counts[alone]
        pool = np.concatenate([runs.ids.data[: runs.ids.n], np.frombuffer(b"".join(found), np.int32)])
        return pool[ragged(starts, counts)], counts

    def encode_many(self, texts: list[str | None], documents: list) -> list[np.ndarray | None]:
        """Piece ids of texts; ``documents`` and the places of the chunks key the draws."""
        chunks: list[str | None] = []
        ends, keys = [0], []
        for text, document in zip(texts, documents):
            for k, part in enumerate(text.split(SPACE) if text else ()):
                if k:
                    chunks.append(None)
                chunks.extend(CHUNK.findall(part.replace(" ", SPACE) if k else SPACE + part.replace(" ", SPACE)))
            keys.append(occurrence_keys(document, text or "", self.seed, len(chunks) - ends[-1]))
            ends.append(len(chunks))
        key = np.concatenate([np.zeros(0, np.uint32), *keys])
        parts = [self._slice(chunks[a : a + SLICE], key[a : a + SLICE]) for a in range(0, len(chunks), SLICE)]
        flat = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in parts)])
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)]))])
        return [None if t is None else flat[total[a] : total[b]] for t, a, b in zip(texts, ends, ends[1:])]

    def encode(self, text: str, document: object) -> np.ndarray:
        return self.encode_many([text], [document])[0]


@lru_cache(maxsize=2)
def encoder(path: str, dropout: float, seed: int) -> Encoder:
    """One per Python worker, so that its runs outlive a task."""
    return Encoder(path, dropout, seed)


def decode(ids, path: str = MODEL) -> str:
    """The text of piece ids, without the space that encoding puts in front."""
    p = pieces(path)
    back, text = p.back, p.text
    raw = b"".join(bytes((back[i],)) if i in back else text[i].replace(SPACE, " ").encode("utf-8") for i in ids)
    return raw.decode("utf-8", "surrogatepass")[1:] if raw[:1] == b" " else raw.decode("utf-8", "surrogatepass")


class Decoder:
    """Decodes many texts of one model: every piece's bytes in one table."""

    def __init__(self, path: str = MODEL):
        p = pieces(path)
        self.bytes = [bytes((p.back[i],)) if i in p.back else t.replace(SPACE, " ").encode("utf-8") for i, t in enumerate(p.text)]

    def decode(self, ids: list[int]) -> str:
        get = self.bytes.__getitem__
        raw = b"".join(map(get, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


def encode_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` with ``pieces`` (ids), ``n_pieces`` and ``lossless`` (decoding gave the text back); null for null text."""
    fields = [f for f in docs.schema.fields if f.name not in ("pieces", "n_pieces", "lossless")]
    names = [f.name for f in fields]
    extra = [T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, decoder = encoder(path, dropout, seed), Decoder(path)
        for batch in batches:
            ids = batch.column(names.index(id_col))
            for a in range(0, batch.num_rows, 500):  # pieces of a few hundred texts at a time
                part = batch.slice(a, 500)
                texts = part.column(names.index(text_col)).to_pylist()
                found = own.encode_many(texts, ids.slice(a, 500).to_pylist())
                same = [None if t is None else decoder.decode(x.tolist()) == t for t, x in zip(texts, found)]
                lengths = [0 if x is None else len(x) for x in found]
                offsets = pa.array(np.cumsum([0, *lengths]).astype(np.int32))
                flat = pa.array(np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int32)]), pa.int32())
                column = pa.ListArray.from_arrays(offsets, flat, mask=pa.array([x is None for x in found]))
                counts = pa.array([None if x is None else len(x) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, column, counts, pa.array(same, pa.bool_())], names=[*names, "pieces", "n_pieces", "lossless"])

    return docs.select(*names).mapInArrow(run, T.StructType([*fields, *extra]))


@query("op9_merge_dropout_pieces")
def op9_merge_dropout_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_rows(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pieces", "n_pieces", "lossless")
