"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.

Lines (split at newlines) are near duplicates where the Jaccard similarity of their
8-byte shingle sets is 0.8 or more (fewer bytes: the line itself is its shingle).
Links are closed transitively; of each component the line of the smallest
(doc_id, text hash, line number) stays, and the others are removed. Lines of white space only
are neither compared nor removed.

Steps.
1. Lines of equal bytes are one line from here on: per 64-bit line hash the first
   place, aggregated map-side.
2. Signatures: `HASHES` (5) hash functions split their range into `BINS` (18); the
   least value of each bin is kept, and an empty bin borrows from the next full one.
   Bin k of all five functions is band k, so 0.8-similar lines of some hundred
   shingles share a band with probability 1 - (1 - 0.8^5)^18 = 0.9992. Lines of 64
   different shingles or more sign the half of them that has an even hash
   (`band_hashes`); README has the recall measured by line length.
3. Bands meet in hash-partitioned binary blocks (13 bytes an entry). Only sets of
   two lines or more go on; equal member sets of several bands go on once.
4. The texts of those lines, and of no others, meet their sets. A Bloom filter of at
   most `BLOOM_BYTES` keeps the other texts on the map side; it may pass too many,
   never too few, so its bound costs shuffle, not results.
5. Sets of `JOINED` members or fewer that have their least member in common become one, as near copies share several bands
   each. Members of a set are compared exactly, unless they are linked already. A set of
   more than `CHUNK` members or `CHUNK_BYTES` of text is dealt out as pairs of chunks,
   so that a task holds two chunks (or two lines, if these are longer) whatever the
   set's size. A task gives a spanning forest of its links.
6. `components` joins the forests (distributed union-find).

Nulls: a null text is empty and has no line; a null doc_id comes first. Rows are told
apart by doc_id and a hash of the text, so rows that share an id (or have none) are
documents of their own; rows equal in both count as one. A line of any length is one
line, signed and compared as a whole. Empty tables give empty results; extra columns of
any name are carried along unchanged by `drop_repeated_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c
from ._common import U64

SHINGLE, SIMILAR = 8, 0.8
HASHES, BINS = 5, 18
#: Lines of so many different shingles sign half of them.
FEW = 64
#: Bytes of text in hand while lines are found and signed: small enough for the cache of a core.
SLICE = 1 << 18
CHUNK, CHUNK_BYTES = 2048, 4 << 20
#: Sets of so many members at most are joined with those of the same least member: 2 * BINS of them, as a line has so many bands.
JOINED = 32
#: Lines x shingles of a set that is compared as a matrix.
MATRIX_CELLS = 4_000_000
#: Text in hand while comparing.
VERIFY_BYTES = 1 << 20
BLOOM_BYTES = 16 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def lines_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, number) of every line that isn't blank; numbers count all lines of the row from 0."""
    n = len(offs) - 1
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offs, breaks, side="right") - 1
    has = np.flatnonzero(np.diff(offs) > 0)
    starts = np.concatenate([offs[has], breaks + 1])
    rows = np.concatenate([has, row_of_break])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    begin = np.searchsorted(rows, np.arange(n + 1))
    number = np.arange(len(rows)) - begin[rows]
    ends = np.empty(len(rows), np.int64)
    ends[:-1] = starts[1:] - 1
    last = begin[1:][np.diff(begin) > 0] - 1
    ends[last] = offs[rows[last] + 1]
    ink = np.concatenate([[0], np.cumsum(~_BLANK[data])])
    keep = ink[ends] > ink[starts]
    return starts[keep], ends[keep], rows[keep], number[keep]


def shingle_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of every shingle of lines, repeats included; a short line gives the hash of its bytes."""
    size = ends - starts
    long = np.flatnonzero(size >= SHINGLE)
    n = size[long] - SHINGLE + 1
    line = np.repeat(long, n)
    at = np.repeat(starts[long] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    if len(data) >= SHINGLE:
        two = data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << U64(8)
        four = two[:-2] | two[2:] << U64(16)
        eight = four[:-4] | four[4:] << U64(32)
        h = c.mix(eight[at])
    else:
        h = np.zeros(0, np.uint64)
    short = np.flatnonzero(size < SHINGLE)
    if len(short):
        h = np.concatenate([h, c.span_hashes(data, None, starts[short], ends[short]) | U64(1)])
        line = np.concatenate([line, short])
    return h, line


def signatures(h: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """uint64 band hashes, (n, BINS), of mixed shingle hashes. A function is the upper half of a product with an odd number: 20
    bits of value, 12 that pick the bin."""
    out = np.zeros((n, BINS), np.uint64)
    empty = np.uint32(0xFFFFFFFF)
    base = (line * BINS).astype(np.int64)
    for f in range(HASHES):
        part = (h * _SEEDS[f]).view(np.uint32)[1::2].copy()  # the upper halves
        sig = np.full(n * BINS, empty, np.uint32)
        np.minimum.at(sig, base + ((part & np.uint32(4095)) * np.uint32(BINS) >> np.uint32(12)), part >> np.uint32(12))
        sig = sig.reshape(n, BINS)
        some = np.flatnonzero((sig == empty).any(axis=1))
        if len(some):
            full = sig[some]
            # The next full bin of each, round the end; a line without a shingle has none.
            there = np.where(np.concatenate([full, full], axis=1) != empty, np.arange(2 * BINS), 2 * BINS)
            there = np.minimum.accumulate(there[:, ::-1], axis=1)[:, ::-1][:, :BINS]
            step = there - np.arange(BINS)
            mine = np.take_along_axis(full, there % BINS, axis=1) + (step * 0x9E3779B1 & 0xFFFFFFFF).astype(np.uint32)
            mine[there[:, 0] == 2 * BINS] = empty
            sig[some] = mine
        out = c.mix(out * U64(0xA0761D6478BD642F) + sig.astype(np.uint64))
    return out


def _monotonous(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: float) -> np.ndarray:
    """Whether each line may have fewer than `least` different shingles: whether its first ones fill fewer of 1,024 cells. A
    line that has fewer fills fewer for certain. x: a hash of the shingle at each place."""
    size = np.minimum(ends - starts - SHINGLE + 1, 112)
    line = np.repeat(np.arange(len(starts)), size)
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    seen = np.zeros((len(starts), 1024), bool)
    seen[line, (x[at] >> U64(54)).astype(np.int64)] = True
    return np.count_nonzero(seen, axis=1) < least


def band_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, (n, BINS) band hashes) of lines, those near `FEW` different shingles twice.

    Lines of FEW different shingles or more sign those of even hash, half of them, which are the same in both lines of a
    pair; others sign all. Two lines of similarity 0.8 differ in this number by a factor of 0.8 at most, so lines around
    FEW sign both ways, and every pair meets in one of the two. (Signing both ways otherwise costs time only.)"""
    size = np.maximum(ends - starts - SHINGLE + 1, 1)
    out = []
    many = np.flatnonzero(size >= SIMILAR * FEW)
    short = size < FEW / SIMILAR
    if len(many):
        n = len(data) - SHINGLE + 1
        two = data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << U64(8)
        four = two[:-2] | two[2:] << U64(16)
        x = (four[:-4] | four[4:] << U64(32)) * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(32)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(29)
        short[many] |= _monotonous(x, starts[many], ends[many], FEW / SIMILAR)
        # Number of the line that a position's shingle lies in, -1 between lines.
        first, stop = starts[many], ends[many] - SHINGLE + 1
        edge = np.empty(2 * len(many) + 1, np.int64)
        edge[0:-1:2], edge[1::2], edge[-1] = first, stop, n
        name = np.full(2 * len(many) + 1, -1, np.int32)
        name[1::2] = np.arange(len(many), dtype=np.int32)
        number = np.repeat(name, np.diff(edge, prepend=0))
        at = np.flatnonzero((number >= 0) & (x.astype(np.uint8) & np.uint8(1) == 0))
        sig = signatures(x[at], number[at], len(many))
        # A line without a shingle of even hash has few shingles, and signs all of them.
        filled = np.bincount(number[at], minlength=len(many)) > 0
        out.append((many[filled], sig[filled]))
    few = np.flatnonzero(short)
    if len(few):
        h, line = shingle_hashes(data, starts[few], ends[few])
        out.append((few, c.mix(signatures(h, line, len(few)) + U64(1))))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offs in c.slices(batches, "text", SLICE):
        starts, ends, row, number = lines_of(data, offs)
        yield pa.RecordBatch.from_arrays([pa.array(c.signed(c.span_hashes(data, None, starts, ends))), *(x.take(pa.array(row)) for x in rows.columns[:2]), pa.array(number.astype(np.int32))], names=["line", "doc_id", "row_key", "number"])


def _band_blocks(n_buckets: int):
    """(bucket, keys, lines, sizes): entries of several slices, dealt by band hash, as binary. A size is the number of bits of a
    line's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        size = 0

        def flush():
            lines, long, sig = (np.concatenate(x) for x in zip(*held))
            held.clear()
            sig += np.arange(BINS, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
            key = c.mix(sig.ravel())
            del sig
            b = ((key >> U64(32)) % U64(n_buckets)).astype(np.uint16 if n_buckets < 65536 else np.int64)
            order = np.argsort(b, kind="stable")
            b, key = b[order], key.astype(np.uint32)[order]
            order //= BINS  # the line of each entry
            who, long = lines[order], long[order]
            del order
            cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            ends = np.append(cuts[1:], len(b))
            return pa.RecordBatch.from_arrays([pa.array(b[cuts].astype(np.int32)), pa.array([key[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()), pa.array([who[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()), pa.array([long[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary())], names=["bucket", "keys", "lines", "sizes"])

        for _, data, offs in c.slices(batches, "text", SLICE):
            starts, ends, _, _ = lines_of(data, offs)
            if not len(starts):
                continue
            lines = c.span_hashes(data, None, starts, ends)
            if len(seen) > 400_000:
                seen.clear()
            new = [i for i, x in enumerate(lines.tolist()) if not (x in seen or seen.add(x))]
            if not new:
                continue
            line, sig = band_hashes(data, starts[new], ends[new])
            held.append((lines[new][line], np.ceil(np.log2((ends - starts)[new][line] + 1)).astype(np.uint8), sig))
            size += len(line)
            if size >= 60_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: (set, members, sizes) of every band value that two lines or more share, equal sets of the
    partition once. A small set is named by its least member, a large one by all."""
    seen: set[int] = set()

    def done(keys: list[bytes], lines: list[bytes], sizes: list[bytes]):
        k, who, long = np.frombuffer(b"".join(keys), np.uint32), np.frombuffer(b"".join(lines), np.uint64), np.frombuffer(b"".join(sizes), np.uint8)
        # By band value, then by the upper half of the line's hash: one sort of 64-bit keys. Lines of equal halves (one in 2^32) may
        # stand in any order; then a member may come twice, which costs time only.
        order = np.argsort(k.astype(np.uint64) << U64(32) | who >> U64(32))
        k, who, long = k[order], who[order], long[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (who[1:] != who[:-1])
        k, who, long = k[new], who[new], long[new]
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(cuts, len(k)))
        many = np.flatnonzero(size > 1)
        if not len(many):
            return None
        name = c.mix(np.add.reduceat(c.mix(who), cuts) + size.astype(np.uint64))
        called = np.where(size <= JOINED, np.minimum.reduceat(who, cuts), name)[many]
        names, members, widths = [], [], []
        for s, x, lo, n in zip(name[many].tolist(), called.tolist(), cuts[many].tolist(), size[many].tolist()):
            if s not in seen:
                seen.add(s)
                names.append(x)
                members.append(who[lo : lo + n].tobytes())
                widths.append(long[lo : lo + n].tobytes())
        if not names:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c.signed(np.array(names, np.uint64))), pa.array(members, pa.binary()), pa.array(widths, pa.binary())], names=["set", "members", "sizes"])

    bucket, held = None, ([], [], [])
    for batch in batches:
        for b, *entries in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if b != bucket:
                if held[0] and (got := done(*held)):
                    yield got
                bucket, held = b, ([], [], [])
            for to, x in zip(held, entries):
                to.append(x)
    if held[0] and (got := done(*held)):
        yield got


def _chunks(long: np.ndarray) -> np.ndarray:
    """The chunk of each member of a set, from 0: at most CHUNK members, and CHUNK_BYTES of text or one line."""
    most = 2.0**long
    if len(long) <= CHUNK and most.sum() <= CHUNK_BYTES:
        return np.zeros(len(long), np.int64)
    upto = np.cumsum(most)
    out, lo, k = np.empty(len(long), np.int64), 0, 0
    while lo < len(long):
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK_BYTES, side="right"))
        hi = min(max(hi, lo + 1), lo + CHUNK)
        out[lo:hi] = k
        lo, k = hi, k + 1
    return out


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(set, members, sizes) of rows sorted by set: all members of the rows of a name, once."""

    def whole() -> tuple[int, np.ndarray, np.ndarray]:
        who, long = (np.frombuffer(b"".join(x), t) for x, t in ((have, np.int64), (have.values(), np.uint8)))
        if len(have) > 1:
            who, first = np.unique(who, return_index=True)
            long = long[first]
        return name, who, long

    name, have = None, {}
    for batch in batches:
        for s, members, sizes in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if s != name:
                if have:
                    yield whole()
                name, have = s, {}
            have[members] = sizes
    if have:
        yield whole()


def _memberships(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, task) of each member: one task for a set, or for each pair of chunks of a large one."""
    lines, tasks, size = [], [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(lines)), pa.array(np.repeat(np.array(tasks, np.uint64).view(np.int64), [len(x) for x in lines]))], names=["line", "task"])

    for name, who, long in _named(batches):
        chunk = _chunks(long)
        parts = int(chunk[-1]) + 1
        edge = np.searchsorted(chunk, np.arange(parts + 1))
        for a in range(parts):
            for b in range(a + 1, parts) if parts > 1 else [0]:
                lines.append(np.concatenate([who[edge[k] : edge[k + 1]] for k in sorted({a, b})]) if parts > 1 else who)
                pair = np.array([name, a << 32 | b]).view(np.uint64)
                tasks.append(int(c.mix(pair[:1] + c.mix(pair[1:]))[0]))
                size += len(lines[-1])
                if size >= 50_000:
                    yield flush()
                    lines, tasks, size = [], [], 0
    if lines:
        yield flush()


def _active_texts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom: np.ndarray = shared.value
        sent: set[int] = set()
        for _, data, offs in c.slices(batches, "text", SLICE):
            starts, ends, _, _ = lines_of(data, offs)
            if not len(starts):
                continue
            h, first = np.unique(c.span_hashes(data, None, starts, ends), return_index=True)
            ok = c.may_hold(bloom, h)
            if len(sent) > 500_000:
                sent.clear()
            raw = data.tobytes()
            who, text = [], []
            for x, lo, hi in zip(h[ok].tolist(), starts[first][ok].tolist(), ends[first][ok].tolist()):
                if x not in sent:
                    sent.add(x)
                    who.append(x)
                    text.append(raw[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(c.signed(np.array(who, np.uint64))), pa.array(text, pa.binary())], names=["line", "body"])

    return run


def linked(bodies: list[bytes], similar: float = SIMILAR) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among lines: pairs are compared exactly unless they are connected already, or too unlike in size."""
    if not bodies:
        return
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum([len(b) for b in bodies])
    h, line = shingle_hashes(data, np.concatenate([[0], ends[:-1]]), ends)
    terms, term = np.unique(h, return_inverse=True)
    forest = c.Forest(len(bodies))
    if len(bodies) * len(terms) <= MATRIX_CELLS:
        has = np.zeros((len(bodies), len(terms)), np.float32)
        has[line, term] = 1
        shared = (has @ has.T).astype(np.float64)  # counts below 2^24: exact
        size = shared.diagonal()
        for i, k in np.argwhere(np.triu(shared >= similar * (size[:, None] + size - shared) - 1e-9, 1)).tolist():
            if forest.join(i, k):
                yield i, k
        return
    order = np.lexsort((term, line))
    term, line = term[order], line[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (line[1:] != line[:-1])
    term, line = term[new], line[new]
    size = np.bincount(line, minlength=len(bodies))
    begin = np.concatenate([[0], np.cumsum(size)])
    apart = len(bodies) - 1
    # Each line against all later lines of other components at once: shingles shared are counted through an inverted list.
    by = np.argsort(term, kind="stable")
    where = np.searchsorted(term[by], np.arange(len(terms) + 1))
    holders = line[by]
    for i in range(len(bodies)):
        mine = term[begin[i] : begin[i + 1]]
        lo, hi = where[mine], where[mine + 1]
        n = hi - lo
        got = holders[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        shared = np.bincount(got, minlength=len(bodies))
        shared[: i + 1] = 0
        j = np.flatnonzero(shared)
        s = shared[j]
        for k in j[s >= similar * (size[i] + size[j] - s) - 1e-9].tolist():
            if forest.join(i, k):
                apart -= 1
                yield i, k
        if not apart:
            return


def _shingle_set(t: bytes) -> np.ndarray:
    """The different shingles of a line of SHINGLE bytes or more, as integers."""
    return np.unique(np.lib.stride_tricks.sliding_window_view(np.frombuffer(t, np.uint8), SHINGLE).copy().view(np.uint64)[:, 0])


def _exact(a: bytes, b: bytes) -> bool:
    if min(len(a), len(b)) < SHINGLE:
        return a == b
    x, y = _shingle_set(a), _shingle_set(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both) - 1e-9


def _small_tasks(task: np.ndarray, bodies: list[bytes], most: int) -> list[tuple[int, int]]:
    """Links among the lines of many tasks of at most `most` lines each, all tasks at once. task: 0, 1, ... of each line, ascending."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum([len(b) for b in bodies])
    h, line = shingle_hashes(data, np.concatenate([[0], ends[:-1]]), ends)
    # One sort by 52 bits of task and shingle, and line: holders of a shingle stand side by side.
    key = (h + (task.astype(np.uint64) * _SEEDS[0])[line]) * _SEEDS[1] >> U64(12) << U64(12) | line.astype(np.uint64)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    who, shingle = (key & U64(4095)).astype(np.int64), key >> U64(12)
    size = np.bincount(who, minlength=len(bodies))
    # Lines of a task are neighbours, so a pair is its first line and a step below `most`.
    shared = np.zeros(len(bodies) * most, np.int64)
    same = np.flatnonzero(shingle[1:] == shingle[:-1])
    for d in range(1, most):
        if d > 1:
            same = same[: np.searchsorted(same, len(shingle) - d)]
            same = same[shingle[same] == shingle[same + d]]
        if not len(same):
            break
        shared += np.bincount(who[same] * most + who[same + d] - who[same], minlength=len(shared))
    out = []
    for p in np.flatnonzero(shared).tolist():
        i, j, k = p // most, p // most + p % most, int(shared[p])
        over = k - SIMILAR * (size[i] + size[j] - k)
        # Close calls are settled on the bytes themselves, as 52 bits may collide.
        if over > 2 or (over > -2 and _exact(bodies[i], bodies[j])):
            out.append((i, j))
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, line, body) sorted by task: links (a, b), for each batch of tasks a spanning forest."""
    held: list[tuple[list[int], list[bytes]]] = []
    size = weight = 0
    most = 8

    def flush():
        lines = sorted({x for who, _ in held for x in who})
        place = {x: i for i, x in enumerate(lines)}
        forest = c.Forest(len(lines))
        small = [(who, bodies) for who, bodies in held if len(who) <= most]
        links = []
        if small:
            flat = [x for who, _ in small for x in who]
            task = np.repeat(np.arange(len(small)), [len(who) for who, _ in small])
            links += [(flat[i], flat[j]) for i, j in _small_tasks(task, [b for _, bs in small for b in bs], most)]
        for who, bodies in held:
            if len(who) > most:
                links += [(who[i], who[j]) for i, j in linked(bodies)]
        kept = [(x, y) for x, y in links if forest.join(place[x], place[y])]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], names=["a", "b"])

    task, who, bodies = None, [], []
    for batch in batches:
        for t, w, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if t != task:
                if len(who) > 1:
                    held.append((who, bodies))
                    size += len(who)
                    weight += sum(map(len, bodies))
                    if size >= 300 or weight >= VERIFY_BYTES:
                        yield flush()
                        held, size, weight = [], 0, 0
                task, who, bodies = t, [], []
            who.append(w)
            bodies.append(body)
    if len(who) > 1:
        held.append((who, bodies))
    if held:
        yield flush()


def line_links(docs: DataFrame) -> DataFrame:
    """Links (a, b) between line hashes that connect exactly the near-duplicate lines."""
    spark = docs.sparkSession
    n = c.n_buckets(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    blocks = texts.mapInArrow(c.lean(_band_blocks(n)), "bucket int, keys binary, lines binary, sizes binary")
    sets = c.deal(blocks, n).sortWithinPartitions("bucket").mapInArrow(c.lean(_sets), "set bigint, members binary, sizes binary")
    members = c.cut(sets.repartition("set").sortWithinPartitions("set").mapInArrow(c.lean(_memberships), "line bigint, task bigint"))
    shared = spark.sparkContext.broadcast(c.bloom(members.select("line").distinct(), BLOOM_BYTES))
    # Dealt before they are grouped: a task sends a line once, so there is little to combine on the map side.
    bodies = texts.mapInArrow(c.lean(_active_texts(shared)), "line bigint, body binary").repartition("line").groupBy("line").agg(F.first("body").alias("body"))
    tasks = members.join(bodies, "line").select("task", "line", "body")
    return tasks.repartition(n, "task").sortWithinPartitions("task").mapInArrow(c.lean(_verify), "a bigint, b bigint")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, number) of every line to remove, once."""
    rows = docs.select("doc_id", c.row_key().alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    places = c.cut(rows.mapInArrow(c.lean(_places), f"line bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key bigint, number int"))
    # Lines that occur once and are near no other stay, and take no further part.
    twice = places.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    member = c.components(line_links(docs))
    active = c.cut(twice.join(member, twice["line"] == member["node"], "full").select(F.coalesce("line", "node").alias("line"), F.coalesce("root", "line").alias("root")))
    place = F.struct("doc_id", "row_key", "number")
    kept = places.join(active, "line").groupBy("root").agg(F.min(place).alias("kept"))
    # By line, not by component: the places are dealt in the same way for both joins, and a frequent line's can be split.
    fate = active.join(kept, "root").select("line", "kept")
    return places.join(fate, "line").where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("row_key") == F.col("kept.row_key")) & (F.col("number") == F.col("kept.number")))).select("doc_id", "row_key", "number").distinct()


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed and the removed lines' numbers, comma-joined in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = removals(docs).groupBy(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).agg(F.count("*").alias("n_removed"), F.array_join(F.array_sort(F.collect_list("number")), ",").alias("removed_lines"))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = docs.select("doc_id", c.row_key().alias("row_key"), F.coalesce(breaks + (F.octet_length("text") > 0).cast("int"), F.lit(0)).cast("bigint").alias("n_lines"))
    out = rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["row_key"] == gone["gone_key"]), "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, without the removed lines; a text that loses its last line with ink is empty. n_chars,
    where there is such a column, is the new length."""
    docs, back = c.plain(docs, "doc_id", "text", "n_chars")
    gone = removals(docs).groupBy(F.col("doc_id").alias("lost_id"), F.col("row_key").alias("lost_key")).agg(F.collect_set("number").alias("lost"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["lost_id"]) & (c.row_key() == gone["lost_key"]), "left")
    # Lines as a column of their own, as the text is split once; numbers that stay by one hash set, whatever their number.
    joined = joined.select(*docs.columns, "lost", F.when(F.col("lost").isNotNull(), F.split("text", "\n")).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    joined = joined.select(*docs.columns, "lost", F.when(F.col("lost").isNotNull(), F.transform(stay, lambda i: F.get(F.col("lines"), i))).alias("left"))
    text = F.when(F.col("lost").isNull() | F.col("text").isNull(), F.col("text")).when(F.exists("left", lambda x: x.rlike(r"[^ \t-\r]")), F.array_join("left", "\n")).otherwise(F.lit(""))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lost").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return back(out.select(*docs.columns))


OP6_SQL = None
