"""Unbounded n-gram scores of all texts of a corpus, each by all the other texts.

The corpus lies in shards of about SHARD_TOKENS tokens.  The longest context that another text has is found
by a search over lengths, in rounds: up to DENSE by ROUNDS, then doubled a few times at once, then in parts.
In a round a shard sorts the runs of the lengths asked for by their hashes, with the count of each, the counts
of all shards are summed by hash, and the sums come back in the shard's own order.  A suffix array of the
shard would have equal runs as neighbours too, but takes longer to make than these sorts, and half the disk.

Beyond DENSE only branches are searched: positions where a run of DENSE tokens occurs less often than the
DENSE - 1 tokens before its last.  Elsewhere whatever comes before those tokens is followed by that last one
wherever it occurs, so the longest run is that of the position before and one more, with the same count.  All
places of a run of more than DENSE tokens that another text has are branches, or none is, so counts are whole.

No shard is searched for the texts of another one, which would take shards times texts; the numbers that
move are those of the runs that may still occur elsewhere, so the work grows as the corpus does.
With K the longest context of a token w that other texts have, c(K) its count there and N their tokens:

    p_0(w) = max(c(w), 1) / (N + 1),   p(w) = (c(K w) + a p_0(w)) / (c(K) + a)
"""

from __future__ import annotations

import gc
import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import textkernel as tk
from tarnwick.llm.session import checkpoint_dir, cut, shuffle_partitions

SHARD_TOKENS, BUCKET_RUNS = 2_000_000, 3_000_000
#: Lengths asked for one by one, by round; the last is DENSE, and that before it has a round of its own.
ROUNDS = ((1, 2), (3,), (4,))
DENSE = ROUNDS[-1][-1]
#: Beyond DENSE a round doubles a length so often, and cuts a gap between lengths into 4 parts, or 8 if it is WIDE.
LEVELS, WIDE = 3, 32
_BASE, _LENGTH, _TEXT = 0x9FB21C651E98DF25, np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_PIECE = 1 << 17
_FIXED = "shard long, tokens long, texts binary"
_STATE = "shard long, open long, state binary"
_SPLIT = f"{_STATE}, texts binary"


def _argsort(key: np.ndarray) -> np.ndarray:
    """np.argsort of numbers from 0, several times as fast: the highest bits are sorted with the index below them, then what is tied in those."""
    n = len(key)
    if n < 2:
        return np.arange(n)
    key = key.astype(np.uint64, copy=False)
    bits = n.bit_length()
    lost = np.uint64(max(0, int(key.max()).bit_length() + bits - 64))
    order = ((key >> lost) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    order.sort()
    order = (order & np.uint64((1 << bits) - 1)).astype(np.int64)
    if lost:
        sorted_ = key[order]
        bad = np.flatnonzero(sorted_[1:] < sorted_[:-1])
        if len(bad) > 1000:
            return np.argsort(key)
        if len(bad):
            top = sorted_ >> lost
            for lo in np.unique(np.searchsorted(top, top[bad])):
                hi = np.searchsorted(top, top[lo], side="right")
                order[lo:hi] = order[lo:hi][np.argsort(sorted_[lo:hi])]
    return order


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of ids from 0; suffixes are first sorted by two ids, then by twice as many each time.

    Only suffixes that are still tied are sorted again.
    """
    n = len(ids)
    if n < 2:
        return np.arange(n)
    key = ids.astype(np.uint64) << np.uint64((int(ids.max()) + 1).bit_length())
    key[:-1] |= ids[1:].astype(np.uint64) + np.uint64(1)
    sa = _argsort(key)
    new = np.r_[True, key[sa[1:]] != key[sa[:-1]]]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = head, -1
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
    h = 2
    while len(tied):
        own = sa[tied]
        key = (rank[own].astype(np.uint64) << np.uint64(n.bit_length())) | (rank[np.minimum(own + h, n)] + 1).astype(np.uint64)
        order = _argsort(key)
        own, key = own[order], key[order]
        sa[tied] = own
        new = np.r_[True, key[1:] != key[:-1]]
        head = np.maximum.accumulate(np.where(new, tied, 0))
        rank[own] = head
        tied = tied[~(new & np.r_[new[1:], True])]
        h *= 2
    return sa


def _pack(x) -> bytes:
    raw = pickle.dumps(x, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(x: bytes):
    return pickle.loads(pa.Codec("zstd").decompress(memoryview(x)[8:], int.from_bytes(x[:8], "little"), asbytes=True))


def _planes(x: np.ndarray) -> np.ndarray:
    """The lowest bytes of all numbers, then the next ones, and so on: they are packed better so."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)


def _unplaned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.T).view(np.uint32)[:, 0]


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text of every token, and its place in it."""
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return row, np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)


def _heads(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of equal neighbours, and its size."""
    head = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return head, np.diff(np.r_[head, len(x)])


def _same(key: np.ndarray) -> np.ndarray:
    """How often each value occurs."""
    if not len(key):
        return np.zeros(0, np.int64)
    order = _argsort(key)
    _, n = _heads(key[order])
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(n, n)
    return out


class _Runs:
    """Hashes of the runs of length tokens that end at given positions, for tokens in a row."""

    def __init__(self, vocabulary: np.ndarray, at: np.ndarray):
        n = len(at)
        powers = lambda base: np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(vocabulary[at] * powers(_BASE)[:n])] if n else np.zeros(1, np.uint64)
        self.inverse = powers(pow(_BASE, -1, 1 << 64))

    def hashes(self, pos: np.ndarray, length) -> np.ndarray:
        """Made piece by piece, as what is worked with takes several times the room of the hashes."""
        out, length = np.empty(len(pos), np.uint64), np.broadcast_to(length, len(pos))
        for at in range(0, len(pos), _PIECE):
            n = length[at : at + _PIECE].astype(np.int64)
            end = pos[at : at + _PIECE].astype(np.int64) + 1
            out[at : at + _PIECE] = tk.mix64((self.sums[end] - self.sums[end - n]) * self.inverse[end - n] + n.astype(np.uint64) * _LENGTH)
        return out


class Known:
    """What is known of a shard: how often each token occurs in all texts, and of the longest run asked for that ends at each position and that another text has, its length and count there.

    before: how often runs of DENSE - 1 tokens that another text has occur in all, between two rounds; in the
    end branch says which positions are searched further, and total has how often their runs of DENSE tokens occur.
    """

    def __init__(self, shard: "Shard"):
        n = len(shard.at)
        self.round, self.single = 0, np.zeros(len(shard.vocabulary), np.uint32)
        self.before, self.total, self.branch = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, bool)
        self.length, self.count = np.zeros(n, np.uint8), np.zeros(n, np.uint32)

    def __getstate__(self):
        return self.round, *(_planes(x) for x in (self.single, self.before, self.total, self.count)), np.packbits(self.branch), len(self.branch), self.length

    def __setstate__(self, x):
        self.round, (self.single, self.before, self.total, self.count) = x[0], map(_unplaned, x[1:5])
        self.branch, self.length = np.unpackbits(x[5], count=x[6]).astype(bool), x[7]


class Shard:
    """Texts, as places in a vocabulary of their tokens' hashes."""

    def __init__(self, ids: list[int | None], sizes: np.ndarray, hashes: np.ndarray):
        self.ids, self.sizes = ids, sizes
        order = _argsort(hashes)
        hashes = hashes[order]
        head, n = _heads(hashes)
        self.vocabulary = hashes[head]
        self.at = np.empty(len(hashes), np.uint32)
        self.at[order] = np.repeat(np.arange(len(head), dtype=np.uint32), n)

    def __getstate__(self):
        return self.ids, self.sizes, packed_hashes(self.vocabulary), _planes(self.at)

    def __setstate__(self, x):
        self.ids, self.sizes, self.vocabulary, self.at = *x[:2], unpacked_hashes(x[2]), _unplaned(x[3])

    def _asked(self, known: Known):
        """(length, positions by their run's hash, size of each run, its hash, text of every token) by length of the round."""
        row, place = _places(self.sizes)
        runs = _Runs(self.vocabulary, self.at)
        is_open = known.length == (ROUNDS[known.round - 1][-1] if known.round else 0)
        for length in ROUNDS[known.round]:
            pos = np.flatnonzero(is_open & (place >= length - 1))
            h = runs.hashes(pos, length)
            order = _argsort(h)
            h = h[order]
            head, n = _heads(h)
            yield length, pos[order], n, h[head], row

    def request(self, known: Known) -> tuple[np.ndarray, np.ndarray]:
        """(hash, count) of the runs to ask for, by hash."""
        found = [(h, n) for _, _, n, h, _ in self._asked(known)]
        if len(found) == 1:
            return found[0]
        h = np.concatenate([h for h, _ in found])
        order = _argsort(h)
        return h[order], np.concatenate([n for _, n in found])[order]

    def answer(self, known: Known, sums: np.ndarray) -> int:
        """Takes the sums for request(), in its order; returns how many positions are to be asked for next."""
        asked, at = list(self._asked(known)), 0
        if len(asked) > 1:
            order, totals = _argsort(np.concatenate([x[3] for x in asked])), sums
            sums = np.empty(len(totals), np.int64)
            sums[order] = totals
        for length, own, n, h, row in asked:
            total = np.repeat(sums[at : at + len(h)], n)
            at += len(h)
            group, mine = np.repeat(np.arange(len(h)), n), np.ones(len(own), np.int64)
            several = np.flatnonzero(np.repeat(n, n) > 1)
            mine[several] = _same(group[several] * len(self.sizes) + row[own[several]])
            other = total - mine
            if length == 1:
                known.single[self.at[own]] = total
            some = other > 0
            known.length[own[some]] = length
            if length > 1:  # those of tokens are told by single
                known.count[own[some]] = other[some]
            if length >= DENSE - 1:
                whole = np.zeros(len(self.at), np.uint32)
                whole[own] = total
            if length == DENSE - 1:
                known.before = whole[known.length == length]
            if length == DENSE:
                before = np.zeros(len(self.at), np.uint32)
                before[known.length >= DENSE - 1] = known.before
                is_deep = known.length == DENSE
                known.branch = np.r_[False, is_deep[1:] & is_deep[:-1] & (whole[1:] < before[:-1])]
                known.total, known.before = whole[known.branch], known.before[:0]
        known.round += 1
        return int((known.length == ROUNDS[known.round - 1][-1]).sum())

    def deep(self, known: Known) -> tuple["Deep", "Search"]:
        """The stretches of positions at which a run of DENSE tokens ends that another text has, with the tokens that such runs cover, and the search from there."""
        is_deep = known.length == DENSE
        first = np.flatnonzero(is_deep & ~np.r_[False, is_deep[:-1]])
        last = np.flatnonzero(is_deep & ~np.r_[is_deep[1:], False])
        return Deep(self, known, first, last), Search(known)


class Search:
    """What is known of a shard's branches, which are told by their index.

    doubling: (branch, a, total) whose run of a tokens others have, and which look at 2 a, 4 a and so on next;
    halving: (branch, a, gap, totals at a and at a + gap), where the run of a tokens occurs elsewhere and not all
    its occurrences go on to a + gap.
    """

    def __init__(self, known: Known):
        n = len(known.total)
        self.length, self.count = np.full(n, DENSE, np.uint32), known.count[known.branch]
        self.doubling = [np.arange(n, dtype=np.uint32), np.full(n, DENSE, np.uint32), known.total]
        self.halving = [np.zeros(0, np.uint32) for _ in range(5)]

    def __getstate__(self):
        return [_planes(x) for x in (self.length, self.count, *self.doubling, *self.halving)]

    def __setstate__(self, x):
        self.length, self.count, *rest = map(_unplaned, x)
        self.doubling, self.halving = rest[:3], rest[3:]


class Deep:
    """Stretches of a shard, apart from the rest: no run of more than DENSE tokens that another text has leaves one.

    All who may have a run of some length ask for it in the same round.  seats: where the branches are.
    """

    def __init__(self, shard: Shard, known: Known, first: np.ndarray, last: np.ndarray):
        branches = np.flatnonzero(known.branch)
        of = np.searchsorted(first, branches, side="right") - 1
        some, of = np.unique(of, return_inverse=True)  # stretches without a branch aren't looked at
        first, last = first[some], last[some]
        self.sizes = last - first + DENSE
        row, place = _places(self.sizes)
        at = first[row] - (DENSE - 1) + place
        self.text = _places(shard.sizes)[0][first]
        vocabulary, ids = np.unique(shard.at[at], return_inverse=True)
        self.vocabulary, self.at = shard.vocabulary[vocabulary], ids.astype(np.uint32)
        self.seats = ((np.cumsum(self.sizes) - self.sizes)[of] + branches - first[of] + DENSE - 1).astype(np.uint32)

    def __getstate__(self):
        return self.sizes, self.text, packed_hashes(self.vocabulary), _planes(self.at), _planes(self.seats)

    def __setstate__(self, x):
        self.sizes, self.text, self.vocabulary, self.at, self.seats = *x[:2], unpacked_hashes(x[2]), *map(_unplaned, x[3:])

    def _asked(self, s: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of doubling, then halving: branch, length that is looked at, whether it fits in the stretch; the texts of the branches; and the hashes of those that fit."""
        step, _, entry, part = _parts(s.halving[2])
        inner = part > 0
        entry, part = entry[inner], part[inner]
        branch = np.r_[np.repeat(s.doubling[0], LEVELS), s.halving[0][entry]]
        length = np.r_[(s.doubling[1][:, None] << np.arange(1, LEVELS + 1, dtype=np.uint32)).ravel(), s.halving[1][entry] + step[entry] * part.astype(np.uint32)]
        row, place = (x[self.seats] for x in _places(self.sizes))
        fits = length <= place[branch] + 1
        return branch, length, fits, self.text[row], _Runs(self.vocabulary, self.at).hashes(self.seats[branch[fits]], length[fits])

    def request(self, s: Search) -> tuple[np.ndarray, np.ndarray]:
        h = np.sort(self._asked(s)[4])
        head, n = _heads(h)
        return h[head], n

    def answer(self, s: Search, sums: np.ndarray) -> int:
        branch, length, fits, text, h = self._asked(s)
        total, other = np.zeros(len(branch), np.uint32), np.zeros(len(branch), np.uint32)
        order = _argsort(h)
        of = np.empty(len(h), np.uint32)
        of[order] = np.repeat(sums, _heads(h[order])[1])
        total[fits] = of
        again = np.flatnonzero(of > 1)  # a run that occurs once in all is in no other text
        at = np.flatnonzero(fits)[again]
        other[at] = of[again] - _same(h[again] + text[branch[at]].astype(np.uint64) * _TEXT)
        more = np.flatnonzero((other > 0) & (length > s.length[branch]))
        more = more[np.argsort(length[more], kind="stable")]
        s.length[branch[more]], s.count[branch[more]] = length[more], other[more]
        (p, a, ta), (q, b, gap, tb, tc) = s.doubling, s.halving
        k = len(p) * LEVELS
        high, has = total[:k].reshape(-1, LEVELS), other[:k].reshape(-1, LEVELS) > 0
        low, begins = np.c_[ta, high[:, :-1]], np.c_[np.ones(len(p), bool), has[:, :-1]]
        e, j = np.nonzero(begins & (low != high))
        begin = a[e] << j.astype(np.uint32)
        new = [(p[e], begin, begin, low[e, j], high[e, j])]
        s.doubling = [p[has[:, -1]], a[has[:, -1]] << np.uint32(LEVELS), high[has[:, -1], -1]]
        step, parts, entry, part = _parts(gap)
        inner, outer = part > 0, part < parts[entry] - 1
        low, high, begins = tb[entry], tc[entry], np.ones(len(entry), bool)
        low[inner], high[outer], begins[inner] = total[k:], total[k:], other[k:] > 0
        split = np.flatnonzero(begins & (low != high) & (step[entry] > 1))
        e = entry[split]
        new.append((q[e], b[e] + step[e] * part[split].astype(np.uint32), step[e], low[split], high[split]))
        s.halving = [np.concatenate([x[c] for x in new]) for c in range(5)]
        return len(s.doubling[0]) + len(s.halving[0])


def _parts(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Size and number of the parts of each gap, a power of two; and of every part, its gap and number."""
    parts = np.where(gap >= WIDE, 8, np.minimum(gap, 4)).astype(np.uint32)
    return gap // np.maximum(parts, 1), parts, *_places(parts)


def scores(shard: Shard, known: Known, search: Search, tokens: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(natural logarithm of the probability, longest context that another text has) of every token, of a corpus of so many tokens."""
    row, place = _places(shard.sizes)
    length, count = known.length.astype(np.int64), known.count.copy()
    is_deep = known.length == DENSE
    length[known.branch], count[known.branch] = search.length, search.count
    own = np.arange(len(length))
    last = np.maximum.accumulate(np.where(is_deep & ~np.r_[False, is_deep[:-1]] | known.branch, own, 0))[is_deep]  # where the run is known that goes on here
    length[is_deep], count[is_deep] = length[last] + own[is_deep] - last, count[last]
    single = known.single[shard.at] - _same(row.astype(np.int64) * len(shard.vocabulary) + shard.at)
    count[length == 1] = single[length == 1]
    p = np.maximum(single, 1) / (tokens - shard.sizes[row] + 1)
    context = np.where(place > 0, np.r_[0, length[:-1]], 0)
    of = np.flatnonzero(context)
    runs_on = length[of] == context[of] + 1
    p[of] = (np.where(runs_on, count[of], 0) + alpha * p[of]) / (count[of - 1].astype(float) + alpha)
    return np.log(p), context


# ---------------------------------------------------------------- the rounds


def _shards(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        tokens = 0

        def made() -> pa.RecordBatch:
            s = Shard([i for ids, _, _ in held for i in ids], np.concatenate([s for _, s, _ in held]), np.concatenate([h for _, _, h in held]))
            return pa.RecordBatch.from_arrays([pa.array([own + k], pa.int64()), pa.array([len(s.at)], pa.int64()), pa.array([_pack(s)], pa.binary())], ["shard", "tokens", "texts"])

        for b in batches:
            ids = b.column(0).to_pylist()
            for at, col in tk.slices(b.column(1)):
                h, row = tk.token_hashes(col)
                sizes = np.bincount(row, minlength=len(col)).astype(np.int64)
                ends = np.cumsum(sizes)
                lo = 0
                while lo < len(col):  # a shard ends between texts
                    base = int(ends[lo] - sizes[lo])
                    hi = max(lo + 1, int(np.searchsorted(ends, base + size - tokens, side="right")))
                    some = np.flatnonzero(sizes[lo:hi]) + lo
                    if len(some):
                        held.append(([ids[at + r] for r in some], sizes[some], h[base : int(ends[hi - 1])]))
                        tokens += int(ends[hi - 1]) - base
                    if tokens >= size or hi < len(col):
                        if held:
                            yield made()
                        held, tokens, k = [], 0, k + 1
                    lo = hi
        if held:
            yield made()

    return run


def packed_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes: the first, then the steps to the next ones, in six bytes each if they all fit."""
    steps = np.diff(h)
    if len(steps) and int(steps.max()) >> 48:
        return b"8" + h.tobytes()
    return b"6" + h[:1].tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_hashes(x: bytes) -> np.ndarray:
    if len(x) == 1:
        return np.zeros(0, np.uint64)
    if x[:1] == b"8":
        return np.frombuffer(x, np.uint64, offset=1)
    steps = np.zeros(((len(x) - 9) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(x, np.uint8, offset=9).reshape(-1, 6)
    return np.cumsum(np.r_[np.frombuffer(x, np.uint64, 1, 1), steps.reshape(-1).view("<u8")])


def _narrow(n: np.ndarray) -> np.ndarray:
    """Counts in a byte each where they all fit."""
    return n.astype(np.uint8) if len(n) and int(n.max()) < 256 else n


def _bounds(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of sorted hashes begin, and the end."""
    return np.r_[np.searchsorted(h, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)), len(h)]


def _opened(texts: pa.Table, told: pa.Table):
    """The shard of a group or its stretches, what is known of it, and the sums that came for its last request."""
    shard = _unpack(texts.column("texts")[0].as_py())
    kind = told.column("kind").to_numpy()
    state = [x.as_py() for x in told.filter(pa.array(kind == 0)).column("data")]
    sums = [_unpack(x.as_py()) for x in told.filter(pa.array(kind == 1)).sort_by("bucket").column("data")]
    known = _unpack(state[0]) if state else Known(shard)
    return shard, known, np.concatenate([np.zeros(0, np.uint32), *sums]).astype(np.int64)


def _request(shard: Shard | Deep, known: Known | Search) -> tuple[np.ndarray, np.ndarray]:
    return shard.request(known)


def _ask(buckets: int):
    def run(key, texts: pa.Table, told: pa.Table) -> pa.Table:
        h, n = _request(*_opened(texts, told)[:2])
        n = n.astype(np.uint32)
        cuts = _bounds(h, buckets)
        some = np.flatnonzero(cuts[1:] > cuts[:-1])
        return pa.table([
            pa.array(some.astype(np.int32)), pa.array(np.full(len(some), key[0].as_py()), pa.int64()),
            pa.array([packed_hashes(h[cuts[k] : cuts[k + 1]]) for k in some], pa.binary()), pa.array([_pack(_narrow(n[cuts[k] : cuts[k + 1]])) for k in some], pa.binary())],
            ["bucket", "shard", "hashes", "counts"])

    return run


def _sum(asked: pa.Table) -> pa.Table:
    hashes = [unpacked_hashes(x.as_py()) for x in asked.column("hashes")]
    counts = np.concatenate([_unpack(x.as_py()) for x in asked.column("counts")])
    h = np.concatenate(hashes)
    order = _argsort(h)
    head, n = _heads(h[order])
    total = np.empty(len(h), np.uint32)
    total[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), head), n)
    ends = np.cumsum([len(x) for x in hashes])
    out = [_pack(_narrow(total[e - len(x) : e])) for x, e in zip(hashes, ends)]
    return pa.table([asked.column("shard"), pa.array([1] * len(out), pa.int32()), asked.column("bucket"), pa.array(out, pa.binary())], ["shard", "kind", "bucket", "data"])


def _take(key, texts: pa.Table, told: pa.Table) -> pa.Table:
    shard, known, found = _opened(texts, told)
    left = shard.answer(known, found)
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([left], pa.int64()), pa.array([_pack(known)], pa.binary())], ["shard", "open", "state"])


def _split(key, texts: pa.Table, told: pa.Table) -> pa.Table:
    shard, known, _ = _opened(texts, told)
    deep, search = shard.deep(known)
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([len(deep.seats)], pa.int64()), pa.array([_pack(search)], pa.binary()), pa.array([_pack(deep)], pa.binary())], ["shard", "open", "state", "texts"])


_OUT = "doc_id long, n_tokens int, log_prob double, bits_per_token double, mean_context double, longest_context int"


def _finish(tokens: int, alpha: float):
    def run(key, texts: pa.Table, told: pa.Table) -> pa.Table:
        shard, known, _ = _opened(texts, told)
        search = _unpack(told.filter(pa.array(told.column("kind").to_numpy() == 2)).column("data")[0].as_py())
        log, context = scores(shard, known, search, tokens, alpha)
        sizes, row = shard.sizes, _places(shard.sizes)[0]
        total = np.bincount(row, log, len(sizes))
        longest = np.maximum.reduceat(context, np.cumsum(sizes) - sizes)
        return pa.table([pa.array(shard.ids, pa.int64()), pa.array(sizes.astype(np.int32)), pa.array(total), pa.array(-total / sizes / np.log(2)), pa.array(np.bincount(row, context, len(sizes)) / sizes), pa.array(longest.astype(np.int32))], [x.split()[0] for x in _OUT.split(", ")])

    return run


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session, named by what follows spark.sql with __ for dots, while something is computed."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def score_each(docs: DataFrame, *, alpha: float = 0.5, shard_tokens: int = SHARD_TOKENS, bucket_runs: int = BUCKET_RUNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, bits_per_token, mean_context, longest_context) of every text, by all other texts of docs.

    log_prob is the sum of natural logarithms; the contexts are the longest before each token that another
    text has, of any length.  Occurrences in the text itself, and its tokens, don't count; copies of it in
    other rows do.  Tokens are separated by white space, in lower case, and runs of them are compared by 64-bit
    hashes; the driver holds none of them.  The shards lie partitioned in the shared folder and stay where
    they are; what moves in a round are the runs asked for, their sums, and what is known by then.

    Defined cases: a null or empty text is left out; one with a null id counts for the others but isn't
    returned; rows that repeat an id are texts of their own, scored each; a very long text makes a shard of
    its own, with a few log n numbers for each branch among n tokens that another text has; a text without others has probability 1 a
    token; an empty table gives an empty result; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("length(text) > 0")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/ngram-lm-{uuid.uuid4().hex}"

    def kept(made: Callable[[], DataFrame], name: str, schema: str = _STATE) -> DataFrame:
        """What is made, from files: a checkpoint would keep its estimated size, which a cogroup squares in each round.

        Its shuffle files go as soon as it is written: those of several rounds don't lie on disk together.
        """
        with _settings(spark, classic__shuffleDependency__fileCleanup__enabled="true"):
            made().write.parquet(f"{folder}/{name}")
        free()
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    def total(df: DataFrame, name: str) -> int:
        with _settings(spark, classic__shuffleDependency__fileCleanup__enabled="true"):
            return df.agg(F.coalesce(F.sum(name), F.lit(0))).first()[0]

    def free() -> None:
        """The shuffle files of what nothing refers to any more go, instead of when the driver happens to collect its garbage."""
        gc.collect()
        spark.sparkContext._jvm.System.gc()

    def gone(name: str) -> None:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def told(state: DataFrame, kind: int = 0) -> DataFrame:
        return state.select("shard", F.lit(kind).alias("kind"), F.lit(0).alias("bucket"), F.col("state").alias("data"))

    def next_round(fixed: DataFrame, state: DataFrame) -> DataFrame:
        fixed = fixed.groupBy("shard")
        asked = fixed.cogroup(told(state).groupBy("shard")).applyInArrow(_ask(buckets), "bucket int, shard long, hashes binary, counts binary")
        sums = asked.groupBy("bucket").applyInArrow(_sum, "shard long, kind int, bucket int, data binary")
        return fixed.cogroup(told(state).union(sums).groupBy("shard")).applyInArrow(_take, _STATE)

    # with adaptive plans the checkpoint wouldn't know how it is partitioned, and be shuffled in each round
    with _settings(spark, adaptive__enabled="false", classic__shuffleDependency__fileCleanup__enabled="true"):
        fixed = cut(texts.mapInArrow(_shards(shard_tokens), _FIXED).repartition(shuffle_partitions(spark), "shard"))
    free()
    tokens = total(fixed, "tokens")
    if not tokens:
        return spark.createDataFrame([], _OUT)
    fixed = fixed.select("shard", "texts")
    buckets = max(shuffle_partitions(spark), -(-tokens // bucket_runs))
    known = spark.createDataFrame([], _STATE)
    for k in range(len(ROUNDS)):
        known = kept(lambda: next_round(fixed, known), f"dense-{k}")  # noqa: B023
        if k:
            gone(f"dense-{k - 1}")
    split = fixed.groupBy("shard").cogroup(told(known).groupBy("shard")).applyInArrow(_split, _SPLIT)
    state, k = kept(lambda: split, "deep-0", _SPLIT), 0
    if total(state, "open"):
        with _settings(spark, adaptive__enabled="false", classic__shuffleDependency__fileCleanup__enabled="true"):
            deep = cut(state.select("shard", "texts").repartition(shuffle_partitions(spark), "shard"))
        free()
        while total(state, "open"):
            state = kept(lambda: next_round(deep, state), f"deep-{k + 1}")  # noqa: B023
            gone(f"deep-{k}")
            k += 1
    return fixed.groupBy("shard").cogroup(told(known).union(told(state, 2)).groupBy("shard")).applyInArrow(_finish(tokens, alpha), _OUT).where("doc_id is not null")
