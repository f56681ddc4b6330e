"""The most similar vectors of every vector, exactly: shared rare terms, or lookup tables, bounds and exact scores.

Pairs from a minimum score on are found by the rarest terms that they must share (close_pairs). Without one, an approximate search says
what score the neighbours of a vector reach at least, and all vectors whose bound reaches it are scored (class_neighbours).

For the approximate search sparse vectors are split in two. The weights of the most frequent terms are rotated into a short dense vector
and coded additively: a coarse full-dimensional codebook, whose entries are also the inverted lists, and further residual codebooks
searched with a beam, with a stored norm ratio. The few other weights are kept as they are. A list's vectors look for neighbours in the
lists nearest to it: lookup tables give the dense part of a score, matching terms add the rest.

Equal vectors are one class and searched once. The index is a table of blocks (groups of near lists) in the shared folder; a search
task reads its own block and, one after the other, the other blocks, so searching shuffles nothing, and the only broadcast is the
model, whose size the sample bounds.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.arrow import give_back, shared_tables
from quern.session import cut_lineage, new_folder

#: Scores are rounded to it before they are ranked.
STEP = 1e-6

#: Dimensions whose products and what is left of the dense parts bound a score.
BOUND = 384

#: Index parameters: terms in the dense part, its rotated size, residual codebooks and their entries, beam, rows of a list and of a
#: block aimed at, queries that look into the same lists together, such groups in a task, rows of the sample that all of it is fitted on, rows whose codes
#: a query looks at first and the most of them as a share of all, candidates of a query that are scored first.
HEAD, DIM, BOOKS, ENTRIES, BEAM, PER_LIST, PER_BLOCK, PER_GROUP, PER_TASK, SAMPLE, ROWS, SHARE, RERANK = 1024, 128, 6, 256, 2, 150, 40_000, 2400, 6, 20_000, 54_000, 0.4, 106


def _term_numbers(keys: pa.Array) -> np.ndarray:
    coded = keys.dictionary_encode()
    numbers = np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass")) >> 1 for k in coded.dictionary.to_pylist()], dtype=np.int64)
    return numbers[coded.indices.to_numpy()]


def sparse_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, terms, weights) of a map column: unit vectors; null and NaN weights are left out, rows without direction are empty."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy()) * vectors.is_valid().to_numpy(zero_copy_only=False)
    start = vectors.offsets.to_numpy()[:-1]
    at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    terms = _term_numbers(vectors.keys)[at] if len(at) else np.empty(0, np.int64)
    weights = vectors.items.to_numpy(zero_copy_only=False).astype(np.float64)[at] if len(at) else np.empty(0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    good = np.isfinite(weights) & (weights != 0)
    rows, terms, weights = rows[good], terms[good], weights[good]
    norms = np.sqrt(np.bincount(rows, weights * weights, minlength=len(sizes)))
    usable = np.isfinite(norms[rows]) & (norms[rows] > 0)
    rows, terms, weights = rows[usable], terms[usable], weights[usable] / norms[rows[usable]]
    return np.cumsum(np.bincount(rows, minlength=len(sizes))), terms, weights


def _means(rows: np.ndarray, count: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centres; empty ones start again at random rows."""
    centres = rows[rng.choice(len(rows), count, replace=len(rows) < count)].copy()
    for _ in range(rounds):
        half = (centres * centres).sum(1) / 2
        own = np.concatenate([np.argmax(rows[i : i + 8192] @ centres.T - half, axis=1) for i in range(0, len(rows), 8192)])
        order = np.argsort(own, kind="stable")
        found, first = np.unique(own[order], return_index=True)
        centres[found] = np.add.reduceat(rows[order], first, axis=0) / np.diff([*first, len(rows)])[:, None]
        empty = np.setdiff1d(np.arange(count), found)
        centres[empty] = rows[rng.choice(len(rows), len(empty))]
    return centres


class Model:
    """Codebooks and the order of the lists; everything that the index is fitted with."""

    NAMES = ("head", "turn", "span", "coarse", "books", "block", "group", "share")

    def __init__(self, **arrays: np.ndarray):
        for name in self.NAMES:
            setattr(self, name, arrays.get(name))

    @classmethod
    def fit(cls, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> Model:
        """n: the number of vectors that will be indexed; the rows given are the sample."""
        rng = np.random.default_rng(7)
        known, counts = np.unique(terms, return_counts=True)
        head = np.sort(known[np.lexsort((known, -counts))[:HEAD]])
        draft = cls(head=head, turn=np.eye(len(head), dtype=np.float32))
        rows = draft.dense(ends, terms, weights)
        _, axes = np.linalg.eigh((rows.T @ rows).astype(np.float64))
        draft.turn, draft.span = (np.ascontiguousarray(axes[:, ::-1][:, :d].astype(np.float32)) for d in (DIM, BOUND))
        rows = rows @ draft.turn
        draft.coarse = _means(rows, max(1, min(n // PER_LIST, len(rows) // 4)), 6, rng)
        own = draft.nearest(rows)
        left = rows - draft.coarse[own]
        draft.books = np.zeros((BOOKS, ENTRIES, rows.shape[1]), np.float32)
        for m in range(BOOKS):
            draft.books[m] = _means(left, ENTRIES, 5, rng)
            half = (draft.books[m] ** 2).sum(1) / 2
            left = left - draft.books[m][np.argmax(left @ draft.books[m].T - half, axis=1)]
        draft.share = share = np.bincount(own, minlength=len(draft.coarse)) * (n / max(len(rows), 1))  # rows expected in each list
        # lists are halved along their main direction, down to groups whose queries are searched together; blocks are halves on the way
        draft.block, draft.group = np.zeros(len(draft.coarse), np.int32), np.zeros(len(draft.coarse), np.int32)
        todo, blocks, groups = [(np.arange(len(draft.coarse)), False)], 0, 0
        while todo:
            lists, placed = todo.pop()
            weight = share[lists].sum()
            if not placed and (len(lists) < 2 or weight <= PER_BLOCK):
                draft.block[lists] = blocks
                blocks, placed = blocks + 1, True
            if len(lists) < 2 or weight <= PER_GROUP:
                draft.group[lists] = groups
                groups += 1
                continue
            part = draft.coarse[lists] - draft.coarse[lists].mean(0)
            order = np.argsort(part @ np.linalg.svd(part, full_matrices=False)[2][0], kind="stable")
            cut = min(max(1, int(np.searchsorted(np.cumsum(share[lists[order]]), weight / 2))), len(lists) - 1)
            todo += [(lists[order[:cut]], placed), (lists[order[cut:]], placed)]
        return draft

    def spanned(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """More of the rotated dense parts, and the length of what is still left: products of such rows are at least those of the dense parts."""
        out, tail = self.dense(ends, terms, weights, self.span), self.is_tail(terms)
        square = np.bincount(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), np.where(tail, 0, weights.astype(np.float64) ** 2), minlength=len(ends))
        left = np.sqrt(np.maximum(square - np.einsum("ij,ij->i", out, out, dtype=np.float64), 0) + 1e-6)
        return np.concatenate([out, left[:, None].astype(np.float32)], axis=1)

    def dense(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
        """The rotated dense parts."""
        turn = self.turn if turn is None else turn
        out = np.empty((len(ends), turn.shape[1]), np.float32)
        begin = np.concatenate([[0], ends]).astype(np.int64)
        for i in range(0, len(ends), 4096):
            cuts = begin[i : i + 4097]
            some, weight = terms[cuts[0] : cuts[-1]], weights[cuts[0] : cuts[-1]]
            at = np.minimum(np.searchsorted(self.head, some), max(len(self.head) - 1, 0))
            inside = self.head[at] == some if len(self.head) else np.zeros(len(some), bool)
            block = np.zeros((len(cuts) - 1, len(self.head)), np.float32)
            block[np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[inside], at[inside]] = weight[inside]
            out[i : i + 4096] = block @ turn
        return out

    def is_tail(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return np.ones(len(terms), bool)
        return self.head[np.minimum(np.searchsorted(self.head, terms), len(self.head) - 1)] != terms

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        half = (self.coarse**2).sum(1) / 2
        return np.concatenate([np.argmax(rows[i : i + 4096] @ self.coarse.T - half, axis=1) for i in range(0, len(rows), 4096)] or [np.empty(0, np.int64)])

    def encode(self, rows: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, scale): a beam search over the residual codebooks; scale is the true norm over the coded one."""
        if len(rows) > 1024:  # the costs of all beams of a piece stay in the cache
            codes, scales = zip(*(self.encode(rows[i : i + 1024], lists[i : i + 1024]) for i in range(0, len(rows), 1024)))
            return np.concatenate(codes), np.concatenate(scales)
        n = len(rows)
        left = (rows - self.coarse[lists])[:, None, :]
        codes = np.zeros((n, 1, BOOKS), np.uint8)
        row = np.arange(n)[:, None]
        for m in range(BOOKS):
            book = self.books[m]
            # squared length of each beam's residual after subtracting each entry
            cost = left @ (-2 * book.T)
            cost += (book**2).sum(1)
            cost += np.einsum("nbd,nbd->nb", left, left)[:, :, None]
            flat, best = cost.reshape(n, -1), np.empty((n, BEAM if m < BOOKS - 1 else 1), np.int64)
            for i in range(best.shape[1]):
                best[:, i] = np.argmin(flat, axis=1)
                flat[row[:, 0], best[:, i]] = np.inf
            beam, entry = best // ENTRIES, best % ENTRIES
            left = left[row, beam] - book[entry]
            codes = codes[row, beam]
            codes[:, :, m] = entry
        coded = rows - left[:, 0]
        length = np.sqrt((coded**2).sum(1))
        return codes[:, 0], np.where(length > 1e-6, np.sqrt((rows**2).sum(1)) / np.maximum(length, 1e-6), 1).astype(np.float32)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.NAMES})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        held = np.load(io.BytesIO(data))
        return cls(**{name: held[name] for name in cls.NAMES})


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), sizes


class Block:
    """Vectors of some lists, ordered by list: arrays and the block's own term numbers."""

    FIELDS = {"h1": np.int64, "h2": np.int64, "first": np.int64, "lists": np.int32, "codes": np.uint8, "scale": np.float32, "ends": np.int64, "known": np.int64, "terms": np.int32, "weights": np.float64, "tail": np.bool_}
    WIDE = 32

    def __init__(self, row: dict[str, bytes]):
        for name, kind in self.FIELDS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.codes = self.codes.reshape(-1, BOOKS)
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        sizes = self.ends - self.starts
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.tail_ends = np.cumsum(np.bincount(owner[self.tail], minlength=len(sizes)))
        self.tail_starts = np.concatenate([[0], self.tail_ends[:-1]]) if len(sizes) else self.tail_ends
        self.tail_terms, self.tail_weights = self.terms[self.tail], self.weights[self.tail]
        # for exact scores: every vector in whole strips of WIDE entries, filled up with weights of 0
        strips = -(-sizes // self.WIDE)
        self.last_strip = np.cumsum(strips)
        self.first_strip = self.last_strip - strips
        at = np.repeat(self.first_strip * self.WIDE - self.starts, sizes) + np.arange(len(self.terms))
        self.strip_terms, self.strip_weights = (np.zeros((int(strips.sum()), self.WIDE), kind) for kind in (np.int32, np.float32))
        self.strip_terms.reshape(-1)[at] = self.terms
        self.strip_weights.reshape(-1)[at] = self.weights
        self.found, self.begin = np.unique(self.lists, return_index=True)
        self.last = np.append(self.begin[1:], len(self.lists))
        self.by_scale = np.argsort(self.scale, kind="stable")

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of all entries of some rows, number of entries of each)."""
        return _spread(self.starts[rows], self.ends[rows])

    def tails(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the entries outside the dense part, in tail_terms and tail_weights."""
        return _spread(self.tail_starts[rows], self.tail_ends[rows])

    def rows_of(self, lists: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(np.isin(self.found, lists))
        return np.concatenate([np.arange(self.begin[i], self.last[i]) for i in at] or [np.empty(0, np.int64)])

    def products(self, queries: np.ndarray, who: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of some rows with the dense queries (a row each, by the block's term numbers) that they are paired with."""
        out, flat, width = np.empty(len(rows), np.float32), queries.reshape(-1), queries.shape[1]
        for i in range(0, len(rows), 1024):  # what is multiplied at once stays in the cache
            some = rows[i : i + 1024]
            at, strips = _spread(self.first_strip[some], self.last_strip[some])
            place = np.repeat(who[i : i + 1024] * width, strips)[:, None] + np.take(self.strip_terms, at, axis=0)
            sums = np.einsum("ij,ij->i", np.take(flat, place, mode="clip"), np.take(self.strip_weights, at, axis=0))
            out[i : i + 1024] = np.add.reduceat(sums, np.cumsum(strips) - strips)
        return out


#: The most that terms outside the dense part may add to an approximate score, and the approximate score of no neighbour.
TAIL_MOST, NEVER = 1.5, -32_768


def _by_score(who: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Numbers in the order of the query, then of falling score: one number sorts much faster than two."""
    return (who.astype(np.uint64) << np.uint64(32)) | ((4 - np.clip(score, -3, 3)) * (1 << 28)).astype(np.uint64)


def _products(a_row: np.ndarray, a_term: np.ndarray, a_weight: np.ndarray, b_row: np.ndarray, b_term: np.ndarray, b_weight: np.ndarray, terms: int, count: int) -> np.ndarray:
    """Scores of `count` pairs of rows, whose entries have numbers below `terms`."""
    met, i, j = np.intersect1d(a_row * np.int64(max(terms, 1)) + a_term, b_row * np.int64(max(terms, 1)) + b_term, assume_unique=True, return_indices=True)
    return np.minimum(np.bincount(met // max(terms, 1), a_weight[i] * b_weight[j], minlength=count), 1)


class _Asking:
    """Queries that look into the same lists: what they have found so far, by approximate score, and the exact scores of those."""

    def __init__(self, model: Model, rows: np.ndarray, dense: np.ndarray, wanted: np.ndarray, most: int):
        self.rows, self.wanted, self.most = rows, wanted, most
        tables = dense @ np.concatenate([model.coarse, model.books.reshape(-1, model.books.shape[2])]).T
        base = len(model.coarse)
        reach = np.abs(tables).max(0, initial=0)
        # whole numbers of 16 bits that hold any sum; a row for each codebook entry, so that a lookup moves all queries at once, and
        # rows of a multiple of eight, so that what is found can be looked through by eight
        self.step = np.float32(32_000 / (reach[:base].max(initial=0) + reach[base:].reshape(BOOKS, ENTRIES).max(1).sum() + TAIL_MOST))
        tables *= self.step
        self.tables = np.zeros((tables.shape[1], -(-len(rows) // 8) * 8), np.int16)
        self.tables[:, : len(rows)] = np.rint(tables, out=tables).T
        self.floor = np.full(len(rows), -np.inf, np.float32)  # what a target must reach to be among a query's best so far
        self.who, self.rough, self.score = np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.float32)
        self.h1, self.h2 = np.empty(0, np.int64), np.empty(0, np.int64)

    def look(self, own: Block, other: Block, numbers: np.ndarray) -> None:
        """Score all rows of the wanted lists of a block from the lookup tables, and exactly those that are among the best so far.

        numbers: the other block's numbers of the own block's terms, -1 for terms that it lacks.
        """
        q, asked = len(self.rows), np.zeros(len(other.lists), np.bool_)
        asked[other.rows_of(self.wanted)] = True
        targets = other.by_scale[asked[other.by_scale]]  # in the order of the scale one threshold does for a piece of them
        if not len(targets):
            return
        # terms of the queries, in the numbers of the other block
        at, sizes = own.entries(self.rows)
        asker, place = np.repeat(np.arange(q), sizes), numbers[own.terms[at]]
        met = place >= 0
        asker, place, weight, tail = asker[met], place[met], own.weights[at][met], own.tail[at][met]
        order = np.argsort(place[tail], kind="stable")
        t_asker, t_weight = asker[tail][order], weight[tail][order]
        begin = np.searchsorted(place[tail][order], np.arange(len(other.known) + 1))
        who, chosen, rough = self._pass(own, other, targets, begin, t_asker, t_weight)

        old = len(self.who)
        who, rough = np.concatenate([self.who, who]), np.concatenate([self.rough, rough])
        order = np.argsort(_by_score(who, rough))
        own_order = who[order]
        start = np.searchsorted(own_order, np.arange(q + 1))
        keep = order[np.arange(len(order)) - start[own_order] < self.most]
        last = np.minimum(start[:-1] + self.most, start[1:]) - 1
        enough = start[1:] - start[:-1] >= self.most
        self.floor[enough] = np.maximum(self.floor[enough], rough[order[last[enough]]])
        kept, fresh = keep[keep < old], keep[keep >= old]
        chosen = chosen[fresh - old]
        full = np.zeros((q, len(other.known)), np.float32)
        full[asker, place] = weight
        score = other.products(full, who[fresh], chosen)
        self.who, self.rough = np.concatenate([who[kept], who[fresh]]), np.concatenate([rough[kept], rough[fresh]])
        self.score = np.concatenate([self.score[kept], np.minimum(score, 1)])
        self.h1, self.h2 = np.concatenate([self.h1[kept], other.h1[chosen]]), np.concatenate([self.h2[kept], other.h2[chosen]])

    def _pass(self, own: Block, other: Block, targets: np.ndarray, begin: np.ndarray, t_asker: np.ndarray, t_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, target, approximate score) of the targets that may be among the best of a query."""
        tables, q = self.tables, self.tables.shape[1]
        base = len(tables) - ENTRIES * BOOKS
        scale = np.maximum(other.scale[targets], 1 / TAIL_MOST)
        places = np.concatenate([other.lists[targets][:, None], other.codes[targets] + (base + ENTRIES * np.arange(BOOKS))], axis=1).T.astype(np.int64)
        # what the terms outside the dense part add: target by target, the queries that have a term and the product of the weights
        at, sizes = other.tails(targets)
        word = other.tail_terms[at]
        times = (begin[1:] - begin[:-1])[word]
        hit = np.flatnonzero(times)
        word, times, where = word[hit], times[hit], np.repeat(np.arange(len(targets)), sizes)[hit]
        before = np.concatenate([[0], np.cumsum(times)])
        pick = np.repeat(begin[word] - before[:-1], times) + np.arange(before[-1])
        plus = (np.repeat(other.tail_weights[at][hit] * (self.step / scale[where]), times) * t_weight[pick]).astype(np.int16)
        spot = np.repeat(where * q, times) + t_asker[pick]
        back = np.minimum(np.searchsorted(self.rows, targets), len(self.rows) - 1) if own is other else None

        piece = max(1, (1 << 18) // (2 * q))  # all that is done with a piece of targets happens in the cache
        total, held, good = np.empty((piece, q), np.int16), np.empty((piece, q), np.int16), np.empty((piece, q), np.bool_)
        cut = before[np.searchsorted(where, np.arange(0, len(targets) + piece, piece))]

        def scored(i: int) -> np.ndarray:
            count = min(piece, len(targets) - i)
            some = total[:count]
            np.take(tables, places[0, i : i + piece], axis=0, out=some, mode="clip")
            for m in range(1, BOOKS + 1):
                some += np.take(tables, places[m, i : i + piece], axis=0, out=held[:count], mode="clip")
            a, b = cut[i // piece], cut[i // piece + 1]
            np.add.at(some.reshape(-1), spot[a:b] - i * q, plus[a:b])
            if back is not None:  # a query isn't its own neighbour
                same = np.flatnonzero(self.rows[back[i : i + count]] == targets[i : i + count])
                some[same, back[i : i + count][same]] = NEVER
            return some

        starts = range(0, len(targets), piece)
        if len(targets) > self.most and not np.isfinite(self.floor).all():  # the first floor comes from pieces spread over the targets
            some = np.concatenate([scored(i)[:, : len(self.rows)] * (scale[i : i + piece, None] / self.step) for i in starts[:: max(1, len(starts) // 8)]])
            rank = min(len(some) - 1, max(1, -(-5 * self.most * len(some) // (4 * len(targets)))))
            self.floor = np.maximum(self.floor, -np.partition(-some, rank, axis=0)[rank])
        found = []
        for i in starts:
            some = scored(i)
            low, high = scale[i], scale[min(i + piece, len(scale)) - 1]
            least = np.full(q, -NEVER - 1, np.int16)  # the columns that fill up the rows find nothing
            least[: len(self.rows)] = np.clip(np.minimum(self.floor / low, self.floor / high) * self.step - 1, NEVER + 1, -NEVER - 1)
            np.greater_equal(some, least, out=good[: len(some)])
            eights = np.flatnonzero(good[: len(some)].reshape(-1).view(np.uint64) != 0)
            if len(eights):
                met = (eights[:, None] * 8 + np.arange(8))[good.reshape(-1, 8)[eights]]
                found.append((met + i * q, some.reshape(-1)[met]))
        spot, value = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int16))
        t, who = np.divmod(spot, q)
        value = value * (scale[t] / self.step)
        enough = (value >= self.floor[np.minimum(who, len(self.rows) - 1)]) & (who < len(self.rows))
        return who[enough], targets[t[enough]], value[enough]

    def begin(self, model: Model, own: Block, k: int, least: float) -> None:
        """From the approximate search only the score that k others reach is taken."""
        at, sizes = own.entries(self.rows)
        self.k, self.spanned = k, model.spanned(np.cumsum(sizes), own.known[own.terms[at]], own.weights[at])
        order = np.lexsort((self.h2, self.h1, self.who))
        who, h1, h2 = self.who[order], self.h1[order], self.h2[order]
        new = np.concatenate([[True], (np.diff(who) != 0) | (np.diff(h1) != 0) | (np.diff(h2) != 0)])[: len(who)]
        order = order[new & ((h1 != own.h1[self.rows[who]]) | (h2 != own.h2[self.rows[who]]))]
        order = order[np.lexsort((-self.score[order], self.who[order]))]
        who = self.who[order]
        last = np.searchsorted(who, np.arange(len(self.rows))) + k - 1
        enough = last < np.searchsorted(who, np.arange(len(self.rows)), "right")
        self.floor = np.full(len(self.rows), least, np.float32)
        self.floor[enough] = np.maximum(self.score[order[last[enough]]] - 1e-5, least)
        self.found = np.empty(0, [("who", np.int64), ("grade", np.int64), ("first", np.int64), ("h1", np.int64), ("h2", np.int64), ("score", np.float64)])

    def complete(self, own: Block, other: Block, spanned: np.ndarray, numbers: np.ndarray) -> None:
        """Score exactly all rows of a block whose bound reaches a query's k best so far, and keep the k best; spanned: the block's."""
        q = len(self.rows)
        at, sizes = own.entries(self.rows)
        asker, place = np.repeat(np.arange(q), sizes), numbers[own.terms[at]]
        met = place >= 0
        asker, place, weight, tail = asker[met], place[met], own.weights[at][met], own.tail[at][met]
        full = np.zeros((q, len(other.known)), np.float32)
        full[asker, place] = weight
        order = np.argsort(place[tail], kind="stable")
        t_asker, t_weight = asker[tail][order], weight[tail][order].astype(np.float32)
        begin = np.searchsorted(place[tail][order], np.arange(len(other.known) + 1))
        mine = np.ascontiguousarray(self.spanned.T)
        for i in range(0, len(other.lists), 1024):
            targets = np.arange(i, min(i + 1024, len(other.lists)))
            bound = spanned[i : i + 1024] @ mine
            # the terms outside the dense part
            at, sizes = other.tails(targets)
            word = other.tail_terms[at]
            times = (begin[1:] - begin[:-1])[word]
            before = np.cumsum(times) - times
            pick = np.repeat(begin[word] - before, times) + np.arange(times.sum())
            spot = np.repeat(np.repeat(targets - i, sizes) * q, times) + t_asker[pick]
            np.add.at(bound.reshape(-1), spot, np.repeat(other.tail_weights[at].astype(np.float32), times) * t_weight[pick])
            spot = np.flatnonzero(bound >= self.floor - 1e-5)
            t, who = np.divmod(spot, q)
            t += i
            apart = (other.h1[t] != own.h1[self.rows[who]]) | (other.h2[t] != own.h2[self.rows[who]])
            t, who = t[apart], who[apart]
            good = other.products(full, who, t) >= self.floor[who] - 1e-5
            t, who = t[good], who[good]
            for j in range(0, len(t), 20_000):
                self._keep(own, other, numbers, who[j : j + 20_000], t[j : j + 20_000])

    def _keep(self, own: Block, other: Block, numbers: np.ndarray, who: np.ndarray, t: np.ndarray) -> None:
        """Add some pairs with their scores of 64 bits and leave the k best of each query: by score, of equal ones by the smallest id."""
        (x, x_sizes), (y, y_sizes) = own.entries(self.rows[who]), other.entries(t)
        place, pair = numbers[own.terms[x]], np.repeat(np.arange(len(who)), x_sizes)
        score = _products(pair[place >= 0], place[place >= 0], own.weights[x][place >= 0], np.repeat(np.arange(len(t)), y_sizes), other.terms[y], other.weights[y], len(other.known), len(t))
        new = np.empty(len(t), self.found.dtype)
        for name, values in (("who", who), ("grade", np.floor(score / STEP + 0.5)), ("first", other.first[t]), ("h1", other.h1[t]), ("h2", other.h2[t]), ("score", score)):
            new[name] = values
        # a class that stands in two blocks counts once
        both = np.concatenate([self.found, new[score > 0]])
        both = both[np.lexsort((both["h2"], both["h1"], both["first"], -both["grade"], both["who"]))]
        same = np.ones(len(both), bool)
        same[:1] = False
        for name in ("who", "grade", "h1", "h2"):
            same[1:] &= both[name][1:] == both[name][:-1]
        both = both[~same]
        place = np.arange(len(both)) - np.searchsorted(both["who"], both["who"])
        self.found = both[place < self.k]
        last = both[place == self.k - 1]
        self.floor[last["who"]] = np.maximum(self.floor[last["who"]], (last["grade"] - 0.5) * STEP)

    def nearest(self, own: Block) -> pd.DataFrame:
        at = self.rows[self.found["who"]]
        return pd.DataFrame({"a1": own.h1[at], "a2": own.h2[at], "b1": self.found["h1"], "b2": self.found["h2"], "score": self.found["score"]})


def search_block(model: Model, own: Block, load, lists: np.ndarray, k: int, rerank: int, rows_wanted: int, least: float) -> Iterator[pd.DataFrame]:
    """The k best other classes of every row of some of the block's lists.

    An approximate search among the nearest lists says what a neighbour must reach, then all rows of all blocks whose bound reaches it are scored.
    """
    groups: list[_Asking] = []
    for name in np.unique(model.group[lists]):
        mine = lists[model.group[lists] == name]
        rows = own.rows_of(mine)
        if not len(rows):
            continue
        at, sizes = own.entries(rows)
        dense = model.dense(np.cumsum(sizes), own.known[own.terms[at]], own.weights[at])
        # the lists nearest to the group, as many as hold the wanted rows; its own come first
        near = model.coarse[mine].mean(0) @ model.coarse.T
        near[mine] = np.inf
        order = np.argsort(-near, kind="stable")
        wanted = order[: max(len(mine), 1 + int(np.searchsorted(np.cumsum(model.share[order]), rows_wanted)))]
        for j in range(0, len(rows), 2 * PER_GROUP):  # a list of any size goes through in bounded pieces
            groups.append(_Asking(model, rows[j : j + 2 * PER_GROUP], dense[j : j + 2 * PER_GROUP], wanted, rerank))
    # its own block first: near neighbours found early keep most of the other blocks' rows from being scored exactly
    order = np.unique(model.block[np.concatenate([g.wanted for g in groups])]).tolist() if groups else []
    home = int(model.block[lists[0]])
    for block in sorted(order, key=lambda b: (b != home, b)):
        other = own if block == home else load(int(block))
        if other is None:
            continue
        place = np.minimum(np.searchsorted(other.known, own.known), len(other.known) - 1)
        numbers = np.where(other.known[place] == own.known, place, -1)
        for group in groups:
            if (model.block[group.wanted] == block).any():
                group.look(own, other, numbers)
    for group in groups:
        group.begin(model, own, k, least)
    for block in sorted(range(int(model.block.max()) + 1) if groups else [], key=lambda b: (b != home, b)):
        other = own if block == home else load(block)
        if other is None:
            continue
        place = np.minimum(np.searchsorted(other.known, own.known), len(other.known) - 1)
        numbers = np.where(other.known[place] == own.known, place, -1)
        spanned = model.spanned(other.ends, other.known[other.terms], other.weights)
        for group in groups:
            group.complete(own, other, spanned, numbers)
    for group in groups:
        yield group.nearest(own)


def _distinct_in_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The row with the smallest rec_id of each class."""
    rec_id, h1, h2 = (batch.column(c).to_numpy() for c in ("rec_id", "h1", "h2"))
    order = np.lexsort((rec_id, h2, h1))
    new = np.concatenate([[True], (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)])[: len(order)]
    return batch.take(pa.array(np.sort(order[new])))


ROW = "rec_id bigint, h1 bigint, h2 bigint, terms binary, weights binary"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ROW of batches (rec_id, vector): unit vectors in the order of their term numbers, and two hashes of them; rows without direction drop out."""
    for batch in batches:
        ends, terms, weights = sparse_rows(batch.column("vector"))
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        _, place = np.unique(terms, return_inverse=True)
        order = np.argsort(np.repeat(np.arange(len(ends)), ends - begin) * max(len(terms), 1) + place)  # by row, then by term
        # digits that scaling alone changes are left out, so that vectors of one direction are equal
        terms, weights = terms[order].tobytes(), (np.round(weights[order], 12) + 0.0).tobytes()
        full = np.flatnonzero(ends > begin)
        cuts = list(zip(begin[full].tolist(), ends[full].tolist()))
        some, other = [terms[8 * a : 8 * b] for a, b in cuts], [weights[8 * a : 8 * b] for a, b in cuts]
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t + w) for t, w in zip(some, other)), ">i8").astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rec_id").take(pa.array(full)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(some, pa.binary()), pa.array(other, pa.binary())], names=["rec_id", "h1", "h2", "terms", "weights"]
        )


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, terms, weights) of the rows of a packed batch."""
    terms, weights = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("terms", np.int64), ("weights", np.float64)))
    return np.cumsum(pc.binary_length(batch.column("weights")).to_numpy(zero_copy_only=False) // 8).astype(np.int64), terms, weights


def _bytes_of(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix of bytes as one binary value."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def _cosines(a: pa.RecordBatch, b: pa.RecordBatch) -> np.ndarray:
    """The exact scores of packed rows side by side."""
    (a_ends, a_terms, a_weights), (b_ends, b_terms, b_weights) = _unpacked(a), _unpacked(b)
    known, place = np.unique(np.concatenate([a_terms, b_terms]), return_inverse=True)
    rows = [np.repeat(np.arange(len(e)), np.diff(e, prepend=0)) for e in (a_ends, b_ends)]
    return _products(rows[0], place[: len(a_terms)], a_weights, rows[1], place[len(a_terms) :], b_weights, len(known), len(a_ends))


#: Parts of a vector whose lengths bound a score, rows with one term that a task holds, and pairs for each row of a term that are written.
PARTS, HELD, PAIRS = 64, 4_000_000, 100


def close_pairs(rows: DataFrame, n: int, least: float) -> DataFrame | None:
    """(a1, a2, b1, b2, score): all pairs of the classes of packed rows with a score of at least `least` > 0, both ways round; None if they are too many to be listed.

    What is left of a unit vector without its rarest terms is soon shorter than `least` and can't reach that score alone, so both of a
    pair have one of those rarest terms in common. The rows of a term are compared by the lengths of PARTS parts of the vectors,
    whose products add up to at least the score; the pairs that this leaves are scored from the whole vectors.
    """
    share = SAMPLE / max(n, 1)
    sampled = rows.filter(F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))) if share < 1 else rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpacked(_distinct_in_batch(b))[1] for b in batches if b.num_rows]
        known, counts = np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True)
        place = np.empty(len(known), np.int64)
        place[np.argsort(counts, kind="stable")] = np.arange(len(known))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (known, place)], names=["known", "place"])

    # any order of the terms does that is the same everywhere; those that the sample lacks come first
    order = rows.sparkSession.sparkContext.broadcast(tuple(map(bytes, sampled.repartition(1).mapInArrow(count, "known binary, place binary").first())))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = (np.frombuffer(x, np.int64) for x in order.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = _distinct_in_batch(batch)
            ends, terms, weights = _unpacked(batch)
            sizes, square = np.diff(ends, prepend=0), weights * weights
            row = np.repeat(np.arange(len(ends)), sizes)
            at = np.minimum(np.searchsorted(known, terms), max(len(known) - 1, 0))
            rank = np.where(known[at] == terms, place[at], -1) if len(known) else np.full(len(terms), -1)
            by = np.lexsort((terms, rank, row))
            before = np.cumsum(square[by]) - square[by]
            before -= np.repeat(before[ends - sizes], sizes)
            chosen = by[before <= 1 - least * least + 1e-6]
            parts = np.sqrt(np.bincount(row * PARTS + terms % PARTS, square, minlength=len(ends) * PARTS)).reshape(-1, PARTS)
            parts = np.minimum(np.ceil(parts * 255), 255).astype(np.uint8)
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            for i in range(0, len(chosen), 50_000):
                some = chosen[i : i + 50_000]
                who = row[some]
                yield pa.RecordBatch.from_arrays([pa.array(terms[some]), pa.array(h1[who]), pa.array(h2[who]), _bytes_of(parts[who])], names=["term", "h1", "h2", "parts"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray | None]:
        """The distinct rows of one term after the other; None in place of more than can be held."""
        kind, held, size, last = [("h1", np.int64), ("h2", np.int64), ("parts", np.uint8, (PARTS,))], [], 0, None
        for batch in batches:
            term, parts = batch.column("term").to_numpy(), batch.column("parts")
            rows, start = np.empty(batch.num_rows, kind), int(np.frombuffer(parts.buffers()[1], np.int32)[parts.offset]) if batch.num_rows else 0
            rows["h1"], rows["h2"] = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            rows["parts"] = np.frombuffer(parts.buffers()[2], np.uint8)[start : start + len(rows) * PARTS].reshape(-1, PARTS) if len(rows) else 0
            cuts = [0, *(np.flatnonzero(np.diff(term)) + 1).tolist(), len(term)]
            for a, b in zip(cuts[: len(term)], cuts[1:]):
                if size and term[a] != last:
                    yield np.concatenate(held) if size <= HELD else None
                    held, size = [], 0
                last, size = term[a], size + b - a
                held = [*held, rows[a:b]] if size <= HELD else []
        if size:
            yield np.concatenate(held) if size <= HELD else None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, waiting = ["a1", "a2", "b1", "b2"], []

        def written() -> pa.RecordBatch:
            arrays = [np.concatenate(x) for x in zip(*waiting)]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

        for rows in lists(batches):
            if rows is not None:
                order = np.lexsort((rows["h2"], rows["h1"]))
                rows = rows[order[np.concatenate([[True], (np.diff(rows["h1"][order]) != 0) | (np.diff(rows["h2"][order]) != 0)])]]
                lengths, left = rows["parts"].astype(np.float32) / 255, PAIRS * len(rows) + 100_000
                for i in range(0, len(rows) - 1, 512):
                    for j in range(i, len(rows), 8192):
                        x, y = np.nonzero(lengths[i : i + 512] @ lengths[j : j + 8192].T >= least - 1e-4)
                        x, y = x + i, y + j
                        x, y = x[x < y], y[x < y]
                        left -= len(x)
                        if len(x) and left >= 0:
                            waiting.append((rows["h1"][x], rows["h2"][x], rows["h1"][y], rows["h2"][y]))
                    if left < 0:
                        break
            if rows is None or left < 0:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 4, names=names)
                for _ in batches:  # one such term is enough
                    pass
                return
            if sum(len(w[0]) for w in waiting) > 100_000:
                yield written()
        if waiting:
            yield written()

    listed = rows.mapInArrow(rarest, "term bigint, h1 bigint, h2 bigint, parts binary").repartition("term").sortWithinPartitions("term")
    pairs = cut_lineage(listed.mapInArrow(compare, "a1 bigint, a2 bigint, b1 bigint, b2 bigint").distinct())
    if not pairs.filter("a1 IS NULL").isEmpty():
        return None
    both = cut_lineage(pairs.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).unionByName(pairs.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"))).distinct())
    met = rows.join(F.broadcast(both) if both.count() <= 1_000_000 else both, ["h1", "h2"], "left_semi")
    vectors = cut_lineage(met.dropDuplicates(["h1", "h2"]))
    sides = [vectors.select(F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.struct("terms", "weights").alias(s)) for s in "ab"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = _cosines(*(pa.RecordBatch.from_struct_array(batch.column(s)) for s in "ab"))
                enough = np.flatnonzero(scores >= least)
                a1, a2, b1, b2 = (batch.column(c).to_numpy()[enough] for c in ("a1", "a2", "b1", "b2"))
                twice = [pa.array(np.concatenate(x)) for x in ((a1, b1), (a2, b2), (b1, a1), (b2, a2), (scores[enough], scores[enough]))]
                yield pa.RecordBatch.from_arrays(twice, names=["a1", "a2", "b1", "b2", "score"])

    return pairs.join(sides[0], ["a1", "a2"]).join(sides[1], ["b1", "b2"]).mapInArrow(score, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, score double")


def class_neighbours(rows: DataFrame, n: int, k: int, rerank: int = RERANK, look_at: int = ROWS, least: float = 0.0) -> DataFrame:
    """(a1, a2, b1, b2, score): for each class of packed rows its k nearest other classes, of those with a score of at least `least`; n is the number of classes.

    rerank, look_at: candidates and rows of the approximate search that comes first. They decide how long the search takes, not what it finds.
    """
    spark = rows.sparkSession
    share = SAMPLE / max(n, 1)
    sampled = rows.filter(F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))) if share < 1 else rows

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_distinct_in_batch(b) for b in batches if b.num_rows]
        if held:
            data = _distinct_in_batch(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            yield pa.RecordBatch.from_arrays([pa.array([Model.fit(*_unpacked(data), n).to_bytes()], pa.binary())], names=["model"])

    # the sample is bounded, so one task may hold it; only the sample is moved there, and duplicates are dropped before
    trimmed = sampled.mapInArrow(lambda bs: (_distinct_in_batch(b) for b in bs if b.num_rows), sampled.schema).repartition(1)
    fitted = trimmed.mapInArrow(fit, "model binary").collect()
    if not fitted:
        return spark.createDataFrame([], "a1 bigint, a2 bigint, b1 bigint, b2 bigint, score double")
    data = fitted[0]["model"]
    shared = spark.sparkContext.broadcast(bytes(data))
    model = Model.from_bytes(bytes(data))
    schema = "block int, h1 bigint, h2 bigint, first bigint, list int, codes binary, scale float, terms binary, weights binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            if not batch.num_rows:
                continue
            known = known or Model.from_bytes(shared.value)
            batch = _distinct_in_batch(batch)
            dense = known.dense(*_unpacked(batch))
            lists = known.nearest(dense)
            codes, scale = known.encode(dense, lists)
            yield pa.RecordBatch.from_arrays(
                [pa.array(known.block[lists]), batch.column("h1"), batch.column("h2"), batch.column("rec_id"), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), batch.column("terms"), batch.column("weights")],
                names=["block", "h1", "h2", "first", "list", "codes", "scale", "terms", "weights"],
            )

    def build(key: tuple, table: pa.Table) -> pa.Table:
        model = Model.from_bytes(shared.value)
        frame = table.select(["list", "h1", "h2", "first"]).to_pandas()
        order = frame.sort_values(["first"]).drop_duplicates(["h1", "h2"]).sort_values(["list", "h1", "h2"]).index.to_numpy()
        table = table.take(pa.array(order))
        terms, weights = table.column("terms").to_pylist(), table.column("weights").to_pylist()
        ends = np.cumsum([len(w) // 8 for w in weights]).astype(np.int64)
        numbers = np.frombuffer(b"".join(terms), np.int64)
        known, local = np.unique(numbers, return_inverse=True)
        arrays = {
            "h1": table.column("h1").to_numpy(), "h2": table.column("h2").to_numpy(), "first": table.column("first").to_numpy(), "lists": table.column("list").to_numpy(), "codes": b"".join(table.column("codes").to_pylist()), "scale": table.column("scale").to_numpy(),
            "ends": ends, "known": known, "terms": local.astype(np.int32), "weights": np.frombuffer(b"".join(weights), np.float64), "tail": model.is_tail(known)[local],
        }
        row = {"block": [key[0].as_py()], **{n: [a if isinstance(a, bytes) else np.ascontiguousarray(a).astype(Block.FIELDS[n]).tobytes()] for n, a in arrays.items()}}
        return pa.table(row, schema=pa.schema([("block", pa.int32()), *((n, pa.binary()) for n in Block.FIELDS)]))

    index = new_folder(spark)
    columns = ", ".join(f"{n} binary" for n in Block.FIELDS)
    blocks = rows.mapInArrow(encode, schema).groupBy("block").applyInArrow(build, f"block int, {columns}")
    blocks.write.partitionBy("block").option("compression", "none").parquet(index)  # codes and hashes don't shrink, and blocks are read often

    # a task has some groups of lists of one block; all else it needs it reads from the index
    tasks = []
    for b in range(int(model.block.max()) + 1):
        names = np.unique(model.group[model.block == b])
        for part in np.array_split(names, max(1, len(names) // PER_TASK)):
            tasks.append((b, [int(x) for x in np.flatnonzero(np.isin(model.group, part))]))
    wanted = int(min(look_at, max(SHARE * n, 4 * PER_LIST)))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Model.from_bytes(shared.value)

        def load(block: int) -> Block | None:
            for table in shared_tables(f"{index}/block={block}"):
                return Block({name: table.column(name).chunk(0)[0].as_buffer() for name in Block.FIELDS})
            return None

        for frame in frames:
            for block, lists in (tasks[i] for i in frame["id"]):
                own = load(block)
                if own is not None:
                    yield from search_block(known, own, load, np.asarray(lists), k, rerank, wanted, least)
                own = None
                give_back()

    return spark.range(0, len(tasks), 1, len(tasks)).mapInPandas(search, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, score double")


def nearest_records(records: DataFrame, id_col: str = "chunk_id", vector_col: str = "vector", k: int = 10, min_score: float | None = None, rerank: int = RERANK, look_at: int = ROWS) -> DataFrame:
    """(rec_id, rank, other_id, score) of the k most similar other records of every record with a usable vector, by cosine.

    look_at: rows whose codes a query looks at first, at most SHARE of all; rerank: those of them that are scored for a start. All that
    may be nearer is scored after that, so none is missed. Scores are at most 1 and rounded to 6 digits, ties go to the smaller id.
    min_score leaves out pairs whose score before rounding is below it. Null and empty vectors, vectors whose finite weights are all zero, and rows without
    an id take no part; repeated rows count once, and should copies of a record differ, the vector with the greatest hash stands for it.
    Records with equal vectors are searched once and meet each other exactly, the smallest k ids first. A table with fewer than two
    records gives no rows; other columns are ignored.
    """
    given = records.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(vector_col).cast("map<string,double>").alias("vector"))
    rows = cut_lineage(given.mapInArrow(packed, ROW))
    ends = [f(c).alias(f"{n}_{c}") for c in ("h1", "h2") for n, f in (("low", F.min), ("high", F.max))]
    members = cut_lineage(rows.groupBy("rec_id").agg(*ends))
    differ = not members.filter("low_h1 <> high_h1 or low_h2 <> high_h2").isEmpty()
    if differ:
        top = rows.groupBy("rec_id").agg(F.max(F.struct("h1", "h2")).alias("h"))
        members = cut_lineage(top.select("rec_id", "h.h1", "h.h2"))
    else:
        members = members.select("rec_id", F.col("high_h1").alias("h1"), F.col("high_h2").alias("h2"))
    classes = cut_lineage(members.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("size"), F.min("rec_id").alias("first")))
    n = classes.count()
    if differ:  # vectors that stand for no record must not take the places of others
        rows = rows.join(members, ["rec_id", "h1", "h2"], "left_semi")
    near = None
    if min_score is not None and min_score > STEP:  # a score just below may round to the same and come before it
        near = close_pairs(rows, n, min_score - STEP)
    if near is None:
        # equal rows encoded in other batches may come into two blocks
        near = cut_lineage(class_neighbours(rows, n, k, rerank, look_at, max((min_score or 0) - STEP, 0))).dropDuplicates(["a1", "a2", "b1", "b2"])
    found = _expand(members, classes, near, k)
    return (found if min_score is None else found.filter(F.col("exact") >= min_score)).drop("exact")


def _expand(members: DataFrame, sizes: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Neighbours of classes (h1, h2, size, first) as neighbours of records: first the own class, then the others by score, at most k each."""
    # classes with over 1/1000 of all records are fewer than 1000 and broadcast, so that none gathers in one task
    large = max((sizes.agg(F.sum("size").alias("t")).first()["t"] or 0) // 1000, 1000)
    huge = F.broadcast(sizes.filter(F.col("size") > large).select("h1", "h2", "size"))
    rest = members.join(huge.select("h1", "h2"), ["h1", "h2"], "left_anti")
    several = members.join(huge, ["h1", "h2"]).unionByName(rest.join(sizes.filter((F.col("size") > 1) & (F.col("size") <= large)).select("h1", "h2", "size"), ["h1", "h2"]))
    # at most k + 1 members stand for a class as neighbours; the row-number limit is applied before the shuffle
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("rec_id"))
    several = several.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("rec_id")).alias("ids"), F.first("size").alias("size"))
    few = sizes.filter("size = 1").select("h1", "h2", F.array("first").alias("ids"), "size").unionByName(several)
    # k classes hold the k nearest records, where of equal scores the class with the smallest id comes first
    place = F.row_number().over(Window.partitionBy("a1", "a2").orderBy("minus", F.col("ids")[0]))
    others = (
        near.withColumn("minus", -F.round("score", 6))
        .join(few.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), "ids"), ["b1", "b2"])
        .withColumn("place", place)
        .filter(F.col("place") <= k)
        .groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2"))
        .agg(F.collect_list(F.struct("minus", "score", "ids")).alias("near"))
    )
    pool = few.join(others, ["h1", "h2"], "left").filter((F.col("size") > 1) | F.col("near").isNotNull())
    own = F.when(F.col("size") > 1, F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("minus"), i.alias("other_id"), F.lit(1.0).alias("exact"))))
    others = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["minus"], i.alias("other_id"), x["score"].alias("exact")))))
    empty = F.array().cast("array<struct<minus:double,other_id:bigint,exact:double>>")
    # one more than k, as a record of the class itself may be among them
    pool = pool.select("h1", "h2", "size", F.slice(F.array_sort(F.concat(F.coalesce(own, empty), F.coalesce(others, empty))), 1, k + 1).alias("best"))
    hot_members = members.join(F.broadcast(pool.filter(F.col("size") > large)), ["h1", "h2"])
    every = hot_members.unionByName(rest.join(pool.filter(F.col("size") <= large), ["h1", "h2"]))
    mine = F.slice(F.filter("best", lambda x: x["other_id"] != F.col("rec_id")), 1, k)
    return every.select("rec_id", F.posexplode(mine).alias("pos", "hit")).select("rec_id", (F.col("pos") + 1).alias("rank"), "hit.other_id", (-F.col("hit.minus")).alias("score"), "hit.exact")
