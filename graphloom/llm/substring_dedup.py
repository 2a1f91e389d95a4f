"""Substring dedup by compact windows.

Each word shingle of a document has a min-hash value. A compact window (l, c, r)
says that every run of shingles that lies in [l, r] and holds c has its minimum
at c, so one row stands for all those runs. Windows are the nodes of the
Cartesian tree of the values; only those that hold a run of SEED shingles count,
which leaves about 2 / (SEED + 1) of a document's positions. Of WORDS words that
match at most one, inside, is changed, added or left out, so one side of it is a
run of SEED equal shingles or more, and both documents have a window at its
minimum: windows leave out no match, whatever the hash function.

Of a run of SEED shingles, half lies to the left or to the right of its minimum:
windows meet by the hash of either half. Of those that meet, windows with the
same words as far around as a match may reach are copies, and each is paired with
the first of them only. The firsts of different words are all compared with each
other, in blocks of bounded size; a window is paired with those that cover most
to its left and right, and with one of each group that it connects. Windows at each
place of a line repeated on and on share what their pairs cover. So a passage
that thousands share costs rows in proportion, and none that matches is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bloom import bloom_filter, may_hold
from .jaccard_join import _groups
from .scratch import materialize, unused
from .textops import U64, _power_tables, mix, word_slices
from .worker import tidy

SHINGLE, WORDS = 5, 50
#: Similarity of each WORDS words of a passage, and the least over all of one that is aligned word for word, or of others.
NUM, DEN = 80, 100
LEAST_NUM, FLOOR_NUM = 75, 60
#: Shingles of WORDS words, those that two such runs share, and the least unbroken run of them.
WIDTH = WORDS - SHINGLE + 1
NEED = -(-2 * NUM * WIDTH // (NUM + DEN))
SEED = (NEED + 1) // 2
#: Windows that are compared in one task, each with each; larger groups are dealt into blocks, of which each two meet.
GROUP = 16384
#: Words of pairs that are compared at once.
VERIFY_WORDS = 1 << 19
_PAIR = ["a", "b", "diag", "lo", "hi"]
_PLACE = U64((1 << 22) - 1)
_MULTIPLIERS = np.array([mix(np.array([i + 101], U64))[0] | U64(1) for i in range(64)])
_SEEDS = [mix(np.array([i + 1], U64))[0] for i in range(16)]


def sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of each run of ``width`` values."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    fill = a.max() if best is np.minimum else a.min()
    blocks = np.concatenate([a, np.full(-len(a) % width, fill, a.dtype)]).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def compact_windows(value: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all windows of ``width`` or more, over documents that lie one after another."""
    n = len(value)
    low = sliding(value, width, np.minimum)
    if not len(low):
        return (np.zeros(0, np.int64),) * 3
    low = np.where(doc[: len(low)] == doc[width - 1 :], low, U64(0))  # no run crosses documents
    pad = np.zeros(width - 1, U64)
    top = sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    chosen = np.flatnonzero((top == value) & (top > 0))
    # The Cartesian tree of the chosen values: nearest smaller value to either side.
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    first = starts[np.searchsorted(starts, chosen, side="right") - 1]
    last = np.append(starts[1:], n)[np.searchsorted(starts, chosen, side="right") - 1] - 1
    left, right = first.copy(), last.copy()
    stack: list[int] = []
    values, owner, places = value[chosen].tolist(), first.tolist(), chosen.tolist()
    for i, v in enumerate(values):
        while stack and (owner[stack[-1]] != owner[i] or values[stack[-1]] > v):
            j = stack.pop()
            if owner[j] == owner[i]:
                right[j] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    return left, chosen, right


def _run_codes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` shingles."""
    code, n = h, 1
    while n < size:
        step = min(n, size - n)
        code, n = mix(code[: len(code) - step] * U64(0x9E3779B97F4A7C15) + code[step:]), n + step
    return code


def _thinned(h: np.ndarray, doc: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows without those at each place of a stretch of one shingle: its first, its last, and some between stand for them."""
    n, half = len(h), SEED // 2
    begin = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    number, starts = np.cumsum(begin) - 1, np.flatnonzero(begin)
    first = starts[number[c]]
    last = np.append(starts[1:], n)[number[c]] - 1
    moved = (last - first >= half) & ((c - first) % (WIDTH // 2) != 0)
    if not moved.any():
        return l, c, r
    one = np.flatnonzero(moved)[np.unique(last[moved], return_index=True)[1]]
    keep = ~moved & ~np.isin(c, last[one])
    return tuple(np.concatenate(x) for x in ((l[keep], first[one]), (c[keep], last[one]), (r[keep], np.maximum(r[one], last[one]))))


@tidy
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, context, doc_id, c, l, r, right): [l, r] is as far as a match that holds c may reach; equal contexts, equal words there.

    ``right`` is 1 for keys of left halves whose right half is a key, too.
    """
    half = SEED // 2
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, words in word_slices(batch.column(1)):
            h, doc = words.shingles(SHINGLE)
            count = np.bincount(doc, minlength=words.n_docs)
            keep = count[doc] >= WIDTH
            h, doc = h[keep], doc[keep]
            if not len(h):
                continue
            ends = np.cumsum(np.where(count >= WIDTH, count, 0))
            first = ends - np.where(count >= WIDTH, count, 0)
            place = (np.arange(len(h)) - first[doc]).astype(U64)
            value = mix(h ^ _SEEDS[0])
            # Of equal shingles in a run the first counts: low bits are the place.
            l, c, r = compact_windows((value & ~_PLACE) | (place & _PLACE) | U64(1 << 22), doc, SEED)
            l, c, r = _thinned(h, doc, l, c, r)
            at = first[doc[c]]
            start, stop = np.maximum(c - WIDTH + 1, at), np.minimum(c + WIDTH, ends[doc[c]])
            up, down = _power_tables(len(h))
            total = np.concatenate([np.zeros(1, U64), np.cumsum(h * up[: len(h)])])
            context = mix((total[stop] - total[start]) * down[start] + mix(((stop - start) * 256 + c - start).astype(U64)))
            code = _run_codes(h, half + 1)
            right, left = np.flatnonzero(c + half <= r), np.flatnonzero(c - half >= l)
            key = np.concatenate([code[c[right]], mix(code[c[left] - half])]) | U64(1)
            w = np.concatenate([right, left])
            cols = (key.view(np.int64), context[w].view(np.int64), ids[a + doc[c[w]]].astype(np.int64), *(x[w].astype(np.int32) for x in (c - at, start - at, stop - at - 1)))
            twice = np.concatenate([np.zeros(len(right), bool), c[left] + half <= r[left]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, twice)], ["key", "context", "doc_id", "c", "l", "r", "right"])


@tidy
def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams windows in order of (key, context, doc_id, c); holds three of them between batches.

    Pairs are of the first of a context with its others, but for those that lie
    between others of a document which cover the same, and with the first of the
    key. Rows without b are the firsts of several contexts of an odd key, and the
    first of another document in each: (key, none, doc_id, c, the last column).
    """
    held: np.ndarray | None = None  # first of the open key, first of the open context, last
    for batch in batches:
        rows = np.stack([x.to_numpy().astype(np.int64) for x in batch.columns], 1)
        if not len(rows):
            continue
        n_held = 0
        if held is not None:
            rows, n_held = np.concatenate([held, rows]), 3
        new_key = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
        new_context = new_key | np.concatenate([[True], rows[1:, 1] != rows[:-1, 1]])
        index = np.arange(len(rows))
        of_key = np.maximum.accumulate(np.where(new_key, index, 0))
        of_context = np.maximum.accumulate(np.where(new_context, index, 0))
        with_ = np.where(new_context, of_key, of_context)
        # Copies between two others of their document and of WIDTH places: what these cover holds all that they would.
        span = rows[:, 3] // WIDTH
        follows = ~new_context & (np.roll(rows[:, 2], 1) == rows[:, 2]) & (np.roll(span, 1) == span)
        use = (with_ != index) & (index >= n_held) & (rows[with_, 2] != rows[:, 2]) & ~(follows & np.append(follows[1:], False))
        x, y = rows[with_[use]], rows[use]
        held = rows[[of_key[-1], of_context[-1], -1]]
        # A context's first, where it isn't the key's only one, and its first of another document.
        doc, fresh = rows[:, 2], index >= n_held
        more = new_context & ~new_key & fresh
        other = ~new_context & fresh & (doc != doc[of_context]) & (np.roll(doc, 1) == doc[of_context])
        some = np.unique(np.concatenate([np.flatnonzero(more | other), of_key[more]]))
        some = some[rows[some, 0] & 1 == 1]
        if len(some):
            cols = (rows[some, 0], rows[some, 2], rows[some, 3], rows[some, -1])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.nulls(len(some), pa.int64()), *map(pa.array, cols[1:])], _PAIR)
        if not len(x):
            continue
        swap = (x[:, 2] > y[:, 2])[:, None]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        diag = y[:, 3] - x[:, 3]
        lo, hi = np.maximum(x[:, 4], y[:, 4] - diag), np.minimum(x[:, 5], y[:, 5] - diag)
        # A match that holds this minimum lies in both windows.
        wide = hi - lo + 1 >= WIDTH
        x, y, diag, lo, hi = x[wide], y[wide], diag[wide], lo[wide], hi[wide]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[:, 2], y[:, 2], diag, lo, hi)], _PAIR)


def _shared_runs(hit: np.ndarray) -> np.ndarray:
    """Where runs of WIDTH with NEED hits begin, in each row."""
    total = np.zeros((len(hit), hit.shape[1] + 1), np.uint8)
    np.cumsum(hit, axis=1, dtype=np.uint8, out=total[:, 1:])
    return total[:, WIDTH:] - total[:, :-WIDTH] >= NEED


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Number of distinct codes of each row, but for those below 0."""
    rows = np.sort(rows, axis=1)
    return np.count_nonzero((rows[:, 1:] != rows[:, :-1]) & (rows[:, 1:] >= 0), axis=1) + (rows[:, 0] >= 0)


def _alike(code: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether the comparison of words finds a match in each pair of rows of codes (below 0: none)."""
    out = np.zeros(len(u), bool)
    place = np.arange(code.shape[1])
    for i in range(0, len(u), 256):
        x, y = code[u[i : i + 256]], code[v[i : i + 256]]
        both = (x >= 0) & (y >= 0)
        found = _shared_runs((x == y) & both).any(1)
        far = np.flatnonzero(~found)
        if len(far):
            x, y = np.where(both, x, -1)[far], np.where(both, y, -2)[far]
            same, sides = x[:, :, None] == y[:, None, :], []
            for side, hit in ((x, same.any(2)), (y, same.any(1))):
                good = _shared_runs(hit)
                first, stop = good.argmax(1), good.shape[1] - good[:, ::-1].argmax(1) + WIDTH - 1
                inside = (place >= first[:, None]) & (place < stop[:, None]) & good.any(1)[:, None]
                # From first to last hit.
                hit &= inside
                inside &= (place >= hit.argmax(1)[:, None]) & (place < (len(place) - hit[:, ::-1].argmax(1))[:, None])
                sides.append(np.where(inside, side, -1))
            n, m, every = _distinct(sides[0]), _distinct(sides[1]), _distinct(np.concatenate(sides, 1))
            found[far] = (n > 0) & (m > 0) & ((n + m - every) * DEN >= every * FLOOR_NUM)
        out[i : i + 256] = found
    return out


def _classes(part: np.ndarray) -> np.ndarray:
    """A hash of each row of shingle codes; rows with a 0 (none) are a class each."""
    mixed = (part * _MULTIPLIERS[: part.shape[1]]).sum(1) | U64(1 << 32)
    return np.where((part != 0).all(1), mixed, np.arange(len(part)).astype(U64))


def _chains(doc: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The first row of each row's chain: rows of one key and document, in order, whose keys' shingles overlap or touch."""
    begin = np.concatenate([[True], (doc[1:] != doc[:-1]) | (c[1:] - c[:-1] > SEED // 2 + 1)])
    return np.maximum.accumulate(np.where(begin, np.arange(len(doc)), 0))


def _matches(codes: np.ndarray, doc: np.ndarray, c: np.ndarray, barred: list[np.ndarray]) -> list[tuple[int, int]]:
    """(u, v) to be paired, of rows of shingle codes (0: none) that have their minimum, at c, in the middle, in order of doc and c.

    Each v with those of lesser documents whose matches reach most to either
    side, and with one of each group that its matches connect. Rows of one class
    in an array of ``barred`` (0: none) are not compared. Nor are two of a group where v's
    pairs reach already as far as any row could. A line repeated on and on has a row
    at each of its places: such a chain is one member of a group, and what a pair of one
    of its rows covers word for word around another counts as this one's reach.
    """
    n, flat = len(codes), codes.ravel()
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]])
    code = np.empty(len(flat), np.int32)
    code[order] = np.cumsum(new) - 1
    code = np.where(codes == 0, -1, code.reshape(codes.shape))
    # Codes of two documents or more; rows are in order of doc.
    begin = np.flatnonzero(new)
    owner = np.repeat(doc, codes.shape[1])[order]
    several = np.append((owner[begin] != owner[np.append(begin[1:], len(flat)) - 1]) & (flat[order[begin]] != 0), False)
    alive = np.flatnonzero(_shared_runs(several[code]).any(1))
    if len(alive) < n:  # the others match no row
        return [(int(alive[u]), int(alive[v])) for u, v in _matches(codes[alive], doc[alive], c[alive], [x[alive] for x in barred])] if len(alive) > 1 else []
    # An unbroken run of SEED shingles around the middle holds one of these whole.
    short, mid = SEED - 4, WIDTH - 1
    runs = [_classes(codes[:, mid - before : mid - before + short]) for before in (*range(0, short - 1, 5), short - 1)]
    column = np.where(several, np.cumsum(several), 0)
    width = np.count_nonzero(several) + 1

    def ends(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = _shared_runs(hit)
        return good.argmax(1), np.where(good.any(1), good.shape[1] - good[:, ::-1].argmax(1), 0)

    def holders(rows: slice) -> np.ndarray:
        """Which codes each of the rows holds."""
        out = np.zeros((rows.stop - rows.start, width), bool)
        out[np.arange(len(out))[:, None], column[code[rows]]] = True
        out[:, 0] = False
        return out

    whole = holders(slice(0, n)) if n * width <= 64 << 20 else None
    best_first, best_stop, chain = np.full(n, WIDTH), np.zeros(n, np.int64), _chains(doc, c)
    group, chain_ends = chain.copy(), np.searchsorted(chain, chain, side="right")
    picked: list[tuple[int, int]] = []
    step = max(1, min(64, (32 << 20) // width))
    for i in range(0, n, step):
        chunk = slice(i, min(n, i + step))
        link = np.zeros((chunk.stop - i, n), bool)
        for x in runs:
            link |= x[chunk, None] == x[None]
        # As far as a row that held all codes of these would reach.
        holds = whole[chunk] if whole is not None else holders(chunk)
        can_first, can_stop = ends(holds.any(0)[column[code[i:]]])
        settled = np.concatenate([np.ones(i, bool), (best_first[i:] <= can_first) & (best_stop[i:] >= can_stop)])
        link[:, i:] &= can_stop > 0
        link &= (doc[chunk, None] < doc[None]) & ~(settled[None] & (group[chunk, None] == group[None]))
        for x in barred:
            link &= (x[chunk, None] != x[None]) | (x[chunk, None] == 0)
        us, vs = np.nonzero(link)
        if not len(us):
            continue
        parts = [ends(holds[us[k : k + 16384, None], column[code[vs[k : k + 16384]]]]) for k in range(0, len(us), 16384)]
        first, stop = (np.concatenate(x) for x in zip(*parts))
        some = stop > 0
        us, vs, first, stop = us[some] + i, vs[some], first[some], stop[some]
        if whole is not None and len(us):  # the same the other way round, which spares comparisons
            some = np.concatenate([ends(whole[vs[k : k + 16384, None], column[code[us[k : k + 16384]]]])[1] for k in range(0, len(us), 16384)]) > 0
            us, vs, first, stop = us[some], vs[some], first[some], stop[some]
        if not len(us):
            continue
        parts = [ends((code[us[k : k + 16384]] == (of_v := code[vs[k : k + 16384]])) & (of_v >= 0)) for k in range(0, len(us), 16384)]
        aligned_first, aligned_stop = (np.concatenate(x) for x in zip(*parts))
        known = np.zeros(len(us), np.int8)  # 1: they match, -1: they don't

        def take(at: np.ndarray, once=None) -> None:
            fresh = at[known[at] == 0]
            known[fresh] = np.where(_alike(code, us[fresh], vs[fresh]), 1, -1)
            at = at[known[at] == 1]
            if once is not None:  # one for each two groups
                at = at[np.unique(once(at), return_index=True)[1]]
            for k in at.tolist():
                picked.append((int(us[k]), int(vs[k])))
                group[group == group[us[k]]] = group[vs[k]]
            np.minimum.at(best_first, vs[at], first[at])
            np.maximum.at(best_stop, vs[at], stop[at])
            at = at[aligned_stop[at] > 0]
            # As reach of each row of the chain whose minimum is covered, counted from that row.
            rows = chain_ends[vs[at]] - chain[vs[at]]
            of, k = np.repeat(np.arange(len(at)), rows), np.arange(rows.sum())
            row = chain[vs[at]][of] + k - (np.cumsum(rows) - rows)[of]
            moved = c[vs[at]][of] - c[row]
            begin, end = aligned_first[at][of] + moved, aligned_stop[at][of] + moved
            held = (begin < WIDTH) & (end > 0)
            np.minimum.at(best_first, row[held], np.maximum(begin[held], 0))
            np.maximum.at(best_stop, row[held], np.minimum(end[held], WIDTH))

        for reach, further in ((first + c[vs], lambda: first < best_first[vs]), (-stop - c[vs], lambda: stop > best_stop[vs])):  # noqa: B023
            order = np.lexsort((us, aligned_first - aligned_stop, reach, chain[vs]))
            while len(order := order[(known[order] == 0) & further()[order]]):
                take(order[np.concatenate([[True], chain[vs[order[1:]]] != chain[vs[order[:-1]]]])])
        of_groups = lambda at: np.minimum(group[us[at]], group[vs[at]]) * n + np.maximum(group[us[at]], group[vs[at]])
        tries = 1
        while len(at := np.flatnonzero((group[us] != group[vs]) & (known == 0))):
            which = of_groups(at)
            order = np.argsort(which, kind="stable")
            at, which = at[order], which[order]
            begin = np.concatenate([[True], which[1:] != which[:-1]])
            take(at[np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0)) < tries], of_groups)
            tries *= 4
    return picked


@tidy
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of whole groups, from rows (sub, doc_id, c, right, at, words, block) in order; word ``at`` is the document's word c.

    ``right`` says that the window meets others by its right half too; rows of one
    block meet elsewhere, but for 0.
    """
    out: list[tuple] = []
    for rows in _groups(batches):
        doc, c, right, at = (rows.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3, 4))
        if (doc == doc[0]).all():
            continue
        x = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint32)
        size = pc.binary_length(rows.column(5)).to_numpy().astype(np.int64) // 4
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(x)) - (np.cumsum(size) - size)[row]
        inside = np.flatnonzero(row[: len(x) - SHINGLE + 1] == row[SHINGLE - 1 :])
        codes = np.zeros((len(size), 2 * WIDTH - 1), U64)
        codes[row[inside], (WIDTH - 1 - at[row] + place)[inside]] = _shingle_codes(x)[inside]
        after = size - SHINGLE - at
        half = _classes(codes[:, WIDTH - 1 : WIDTH + SEED // 2])
        for u, v in _matches(codes, doc, c, [np.where(right, half, U64(0)), rows.column(6).to_numpy()]):
            out.append((doc[u], doc[v], c[v] - c[u], c[u] - min(at[u], at[v]), c[u] + min(after[u], after[v])))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], _PAIR)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], _PAIR)


def _word_hashes(bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, words in word_slices(batch.column(1)):
                some = np.flatnonzero(may_hold(bloom.value, ids[a:b]))
                h = words.hash.astype(np.uint32)
                rows = [h[words.first[i] : words.first[i + 1]].tobytes() for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][some]), pa.array(rows, pa.binary())], ["doc_id", "words"])

    return tidy(run)


def _shingle_codes(words: np.ndarray) -> np.ndarray:
    m = max(0, len(words) - SHINGLE + 1)
    out = np.zeros(m, U64)
    for j in range(SHINGLE):
        out = out * U64(0x9E3779B97F4A7C15) + words[j : j + m].astype(U64)
    return mix(out)


def _shared(u: np.ndarray, v: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which codes of each row of u are among those of the same row of v, and the other way round."""
    by_row = mix(row.astype(U64))
    every = np.concatenate([mix(u + by_row), mix(v + by_row)])
    order = np.argsort(every)
    every = every[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    hit = np.zeros(len(every), bool)
    if len(starts):
        first = order < len(u)
        both = np.logical_or.reduceat(first, starts) & np.logical_or.reduceat(~first, starts)
        hit[order] = np.repeat(both, np.diff(np.append(starts, len(every))))
    return hit[: len(u)], hit[len(u) :]


def _covered(hit: np.ndarray, width: int, need: int, least: int = 0) -> list[tuple[int, int]]:
    """Merged ranges of shingles whose runs of ``width`` hold ``need`` hits, from first to last hit.

    Ranges of a similarity under ``least`` are cut into ranges of runs that reach it.
    """
    total = np.concatenate([[0], np.cumsum(hit)])
    good = np.flatnonzero(total[width:] - total[:-width] >= need)
    if not len(good):
        return []
    cut = np.flatnonzero(np.diff(good) > width) + 1
    hits = np.flatnonzero(hit)
    ranges = []
    for g in np.split(good, cut):
        while len(g):
            held, n = total[g + width] - total[g[0]], g + width - g[0]
            k = int(np.flatnonzero(held * (DEN + least) >= 2 * least * n)[-1])
            ranges.append((g[0], g[k] + width))
            g = g[k + 1 :]
    return [(int(hits[np.searchsorted(hits, p)]), int(hits[np.searchsorted(hits, q) - 1]) + 1) for p, q in ranges]


@tidy
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Equal words need no comparison.
        equal_words = pc.equal(batch.column(4), batch.column(5))
        if pc.any(equal_words).as_py():
            a, b, diag, lo, x, _ = batch.filter(equal_words).columns
            n, start = pa.array(pc.binary_length(x).to_numpy().astype(np.int64) // 4), pc.add(lo, diag)
            yield pa.RecordBatch.from_arrays([b, start, n, a, lo, n, pa.array(np.ones(len(n)))], list(_FOUND))
            batch = batch.filter(pc.invert(equal_words))
        size = pc.binary_length(batch.column(4)).to_numpy().astype(np.int64) // 4
        at = np.concatenate([[0], np.cumsum(size)])
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(at, at[i] + VERIFY_WORDS, side="right")) - 1)
            if out := _compare(batch.slice(i, j - i), WIDTH, NEED):
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.float64())], list(_FOUND))
            i = j


def _compare(batch: pa.RecordBatch, width: int, need: int) -> list[tuple]:
    """Passages of rows (a, b, diag, lo, words of a, words of b); a row's two runs of words are equally long."""
    x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32) for c in (4, 5))
    size = pc.binary_length(batch.column(4)).to_numpy().astype(np.int64) // 4
    row = np.repeat(np.arange(len(size)), size)
    m = max(0, len(x) - SHINGLE + 1)
    inside = row[:m] == row[SHINGLE - 1 :]
    equal, same = x == y, np.ones(m, bool)
    for j in range(SHINGLE):
        same &= equal[j : j + m]
    same, u, v = same[inside], _shingle_codes(x)[inside], _shingle_codes(y)[inside]
    in_u, in_v = _shared(u, v, row[:m][inside])
    ends = np.cumsum(np.maximum(0, size - SHINGLE + 1))
    out = []
    for a, b, diag, lo, p, q in zip(*(batch.column(c).to_pylist() for c in range(4)), (ends - np.maximum(0, size - SHINGLE + 1)).tolist(), ends.tolist()):
        aligned, hit_u, hit_v = same[p:q], in_u[p:q], in_v[p:q]
        done = np.zeros(q - p, bool)
        for s, t in _covered(aligned, width, need, LEAST_NUM):
            held, done[s:t] = int(aligned[s:t].sum()), True
            out.append((b, lo + diag + s, t - s + SHINGLE - 1, a, lo + s, t - s + SHINGLE - 1, held / (2 * (t - s) - held)))
        if np.count_nonzero(hit_v) == np.count_nonzero(aligned):  # no shingle but those of this alignment
            continue
        # Words were added or left out: compare as sets what this alignment doesn't cover.
        in_b = [(s, t) for s, t in _covered(hit_v, width, need) if not done[s:t].all()]
        in_a = _covered(hit_u, width, need) if in_b else []
        for s, t in in_b if in_a else []:
            f, g = max(in_a, key=lambda r: min(r[1], t) - max(r[0], s))  # the range beside it
            both, every = len(np.intersect1d(u[p + f : p + g], v[p + s : p + t])), len(np.union1d(u[p + f : p + g], v[p + s : p + t]))
            if both * DEN >= every * FLOOR_NUM:
                out.append((b, lo + diag + s, t - s + SHINGLE - 1, a, lo + f, g - f + SHINGLE - 1, both / every))
    return out


_FOUND = ("doc_id", "start_word", "n_words", "source_id", "source_start_word", "source_n_words", "similarity")


def least_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids that several rows share: the least of their texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    shared = materialize(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "passage-shared-ids")
    return rows.join(shared, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of WORDS words or more that a document shares with an earlier one.

    One row for each pair and alignment found: (doc_id, start_word, n_words,
    source_id, source_start_word, source_n_words, similarity), source_id < doc_id.
    Two runs of words match when the Jaccard similarity of their 5-word shingles
    is 0.8 or more over each WORDS words. Rows don't list each pair that matches:
    what a document shares with documents of lower id is covered by its rows, and
    passages that match are connected by rows, directly or through others.
    Texts of fewer words, null texts and null doc_ids take no part; repeats
    within one document don't count. Of rows that share a doc_id the least text
    stands for it. Other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    shared = materialize(least_texts(docs), "passage-least-texts")
    if not shared.isEmpty():
        base = base.join(shared.select("doc_id"), "doc_id", "left_anti").unionByName(shared)
    windows = base.mapInArrow(_windows, "key long, context long, doc_id long, c int, l int, r int, right int")
    context = docs.sparkSession.sparkContext
    pair = "a long, b long, diag long, lo long, hi long"

    def of_pairs(rows, *more):
        return rows.groupBy("a", "b", "diag", *more).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    stars = windows.repartition("key").sortWithinPartitions("key", "context", "doc_id", "c").mapInArrow(_stars, pair)
    met = of_pairs(stars, F.when(F.col("b").isNull(), F.col("lo")).alias("c"))
    met = materialize(met.select(*_PAIR), "passage-windows")
    apart, copies = met.filter("b is null").select(F.col("a").alias("key"), F.col("diag").alias("doc_id"), F.col("lo").alias("c"), F.col("hi").alias("right")), met.filter("b is not null")
    # Of two windows of a key the pair is there already; more are compared each with each.
    groups = apart.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
    apart = materialize(apart.join(groups.filter("rows > 2 and x < y").select("key", "rows"), "key"), "passage-firsts")
    ids = copies.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(apart.select("doc_id"))
    bloom = context.broadcast(bloom_filter(ids))
    words = materialize(base.mapInArrow(_word_hashes(bloom), "doc_id long, words binary").dropDuplicates(["doc_id"]), "passage-words")
    blocks = F.when(F.col("rows") > GROUP, F.ceil(F.col("rows") / (GROUP // 2))).otherwise(1).cast("int")
    block = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, block).alias("x"), F.greatest(x, block).alias("y")))
    start = F.greatest(F.col("c") - (WIDTH - 1), F.lit(0))
    around = F.substring("words", (start * 4 + 1).cast("int"), ((F.col("c") - start + WIDTH - 1 + SHINGLE) * 4).cast("int"))
    around = apart.join(words, "doc_id").select("key", "rows", "doc_id", "c", "right", (F.col("c") - start).alias("at"), around.alias("words"))
    around = around.withColumn("meets", F.explode(meets)).select(F.xxhash64("key", "meets").alias("sub"), "doc_id", "c", "right", "at", "words", F.when(F.col("meets.x") == F.col("meets.y"), 0).otherwise(block + 1).alias("block"))
    near = around.repartition("sub").sortWithinPartitions("sub", "doc_id", "c").mapInArrow(_near, pair)
    pairs = materialize(of_pairs(copies.unionByName(near)), "passage-pairs")

    def part(start, end):
        return F.substring("words", (start * 4 + 1).cast("int"), ((end - start + SHINGLE) * 4).cast("int"))

    left = pairs.join(words.withColumnRenamed("doc_id", "a"), "a").select("a", "b", "diag", "lo", "hi", part(F.col("lo"), F.col("hi")).alias("x"))
    both = left.join(words.withColumnRenamed("doc_id", "b"), "b").select(
        "a", "b", "diag", "lo", "x", part(F.col("lo") + F.col("diag"), F.col("hi") + F.col("diag")).alias("y")
    )
    schema = "doc_id long, start_word long, n_words long, source_id long, source_start_word long, source_n_words long, similarity double"
    return both.mapInArrow(_verify, schema).dropDuplicates(["doc_id", "start_word", "n_words", "source_id"])


def _cut(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the column ``name`` of spans: their texts without the words of the spans."""
        for batch in batches:
            at, spans = batch.schema.get_field_index("text"), batch.column(batch.schema.get_field_index(name)).to_pylist()
            texts, out = batch.column(at), []
            for i, marks in enumerate(spans):
                text = texts[i].as_py()
                _, _, w = next(word_slices(pa.array([text], pa.large_string()), lower=False))
                raw, keep, pos = text.encode(), [], 0
                for s, n in sorted((m["start_word"], m["n_words"]) for m in marks):
                    e = min(s + n, len(w.start)) - 1
                    if e < s:
                        continue
                    if w.start[s] > pos:
                        keep.append(raw[pos : w.start[s]])
                    pos = max(pos, int(w.end[e]))
                text = b"".join([*keep, raw[pos:]]).decode()
                out.append(text if text.split() else None)
            cols = list(batch.columns)
            cols[at] = pa.array(out, pa.string())
            names = [n for n in batch.schema.names if n != name]
            yield pa.RecordBatch.from_arrays([c for c, n in zip(cols, batch.schema.names) if n != name], names)

    return tidy(run)


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that a document of lower id holds too.

    The first document with a passage keeps it. A document of which no word is
    left goes; documents without a repeated passage are untouched, and so are
    rows that share their doc_id with a lesser text. Rows keep their columns;
    n_chars, where there is one, is counted anew for cut texts.
    """
    spans, least = unused(docs, "spans"), unused(docs, "least_text")
    found = repeated_passages(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias(spans))
    shared = least_texts(docs).select("doc_id", F.xxhash64("text").alias(least))
    marked = docs.join(found, "doc_id", "left").join(shared, "doc_id", "left")
    mine = F.coalesce(F.col(least) == F.xxhash64(F.col("text").cast("string")), F.lit(True))
    marked = marked.withColumn(spans, F.when(mine, F.col(spans))).select(*docs.columns, spans)
    whole = marked.filter(F.col(spans).isNull()).drop(spans)
    cut = marked.filter(F.col(spans).isNotNull()).mapInArrow(_cut(spans), docs.schema).filter("text is not null")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(cut)
