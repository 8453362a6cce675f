"""N-gram Jaccard join with set-relation skipping, and the groups that its links form.

Sets are distinct 5-word shingles (64-bit hashes of lower-cased words); equal sets are one class. Two sets link when
100 * intersection >= 80 * union. Shingles are ordered from rare to frequent (by a bounded table of the shingles that
tasks meet repeatedly, then by hash), and linked sets share one within their prefixes, so prefixes are dealt by shingle
into lists. Lists that the table expects to be long are dealt over several tasks.

Index-level skipping: a list is ordered by set size and position and cut into blocks; a block is skipped as a whole
when its sizes and least position rule out the needed overlap with the probing set.

Answer-level skipping: in each list, sets are first compared with a few leaders drawn by lot (alike in all lists; the
leaders of a long list go to all its tasks). Sets that link with a leader are in its group, so pairs inside a group need
no comparison; a few turns with other leaders settle nearly all lists. For the pairs across groups that remain, the
answer is derived from the two sets' overlaps with a common leader where these decide it (symmetric differences obey the
triangle inequality), or from parity signatures, which bound the difference from below; the rest is compared, each set's
nearest pair first, by sending one set of a pair to the other. No bound ever drops a link. Lists and sets stay
distributed; what reaches the driver is counts, the bounded table of frequent shingles and a bitmap of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Cells of the frequency table, entries of it, and how often a task must meet a shingle to report it.
CELL_BITS, HEAVY, REPORT = 24, 1 << 19, 3
#: Shingles that a task counts at once.
COUNTED = 1 << 21
#: Prefix rows that a task deals at once.
PREFIX_ROWS = 1 << 17
#: Rows of a list that are skipped or probed together.
LIST_BLOCK = 64
#: Expected rows of a list from which it is dealt over several tasks.
LIST_ROWS = 4096
#: Sets of a list that all others are compared with in a turn, and turns before the rest is compared pair by pair.
LEADERS, TURNS = 6, 2
#: Bits of a signature inside lists; pairs are checked with as many bits as the set has shingles, and no fewer than these.
SIGNATURE_BITS = 1024
#: Rows (under 40 bytes each, so 8 MB) up to which a side is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000
#: The same for rows with a signature of SIGNATURE_BITS (under 200 bytes).
BROADCAST_SIGNATURES = 40_000
#: Bits of the map of wanted documents that is sent to the scan where they are too many to broadcast.
MAP_BITS = 24
LINKED = "9 * common >= 4 * (na + nb)"
_GOLD = 0x9E3779B97F4A7C15
_ALL = 0xFFFFFFFFFFFFFFFF


def need(a, b):
    """Least intersection with which sets of sizes a and b link."""
    return -(-4 * (a + b) // 9)


def probe_length(n):
    """Shingles of a set of size n that a linked set of at most its size must share one of."""
    return n + (-4 * n // 5) + 1


def index_length(n):
    """The same for linked sets of at least its size."""
    return n + (-8 * n // 9) + 1


def _identity(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Id of a set and a second hash that tells sets with one id apart."""
    one = C.mix64(s * np.uint64(_GOLD) + np.uint64(seed)).sum(dtype=np.uint64)
    two = C.mix64((s ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
    both = C.mix64(np.array([one, two], np.uint64) + np.uint64(len(s))).view(np.int64)
    return int(both[0]), int(both[1])


def _signature(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of many cells: two signatures differ in no more bits than the sets do."""
    bits = max(SIGNATURE_BITS, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).tobytes()


def _fold(blobs: list[bytes], width: int) -> np.ndarray:
    """Signatures of one length as rows of ``width`` bytes: cells whose numbers agree in the low bits are one cell then."""
    x = np.frombuffer(b"".join(blobs), np.uint64).reshape(len(blobs), -1, width // 8)
    return np.bitwise_xor.reduce(x, axis=1)


def _differ(x: np.ndarray, y: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether signatures prove that sets of these sizes do not link."""
    return (na + nb - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) // 2 < need(na, nb)


@C.frugal
def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose signatures leave a link open, with the bits in which these differ."""
    for batch in batches:
        na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        width = np.array([(len(u), len(v)) for u, v in zip(x, y, strict=True)]).reshape(-1, 2)
        bits = np.zeros(len(x), np.int64)
        for u, v in np.unique(width, axis=0).tolist():
            at = np.flatnonzero((width[:, 0] == u) & (width[:, 1] == v))
            least = min(u, v)
            apart = _fold([x[i] for i in at], least) ^ _fold([y[i] for i in at], least)
            bits[at] = np.bitwise_count(apart).sum(1, dtype=np.int64)
        keep = pa.array((na + nb - bits) // 2 >= need(na, nb))
        yield pa.record_batch([c.filter(keep) for c in (batch.column(0), batch.column(1), pa.array(bits))], names=["a", "b", "bits"])


@C.frugal
def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = [_fold([s], SIGNATURE_BITS // 8).tobytes() for s in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(sig, pa.binary())], names=["cs", "sig"])


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    buf, off = C.buffers(column)
    for _, _, b, o in C.blocks(buf, off):
        yield from C.shingle_sets(b, o)


def _often(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sets hold REPORT times or more, and how often; the list is emptied, and one sorted copy is all that is made of it."""
    every = np.concatenate(held) if held else np.empty(0, np.uint64)
    held.clear()
    every.sort()
    more = every[REPORT - 1 :] == every[: max(0, len(every) - REPORT + 1)]
    more[1:] &= every[1 : len(more)] != every[: max(0, len(more) - 1)]
    at = np.flatnonzero(more)
    u = every[at]
    return u.view(np.int64), np.searchsorted(every, u, side="right") - at


def _profile(seed: int):
    """(kind 0, doc_id, set id, size, second hash, text hash, signature) per document, (kind 1, shingle, count) per shingle that a task repeats."""
    names = ["kind", "a", "b", "n", "c", "m", "sig"]

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        u, n = _often(held)
        zero = pa.array(np.zeros(len(u), np.int64))
        return pa.record_batch([pa.array(np.ones(len(u), np.int8)), pa.array(u), pa.array(n), zero, zero, zero, pa.nulls(len(u), pa.binary())], names=names)

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            sid, check, n, sig = [], [], [], []
            for s in _sets(batch.column(1)):
                k, c = _identity(s, seed) if len(s) else (0, 0)
                sid.append(k)
                check.append(c)
                n.append(len(s))
                sig.append(_signature(s) if len(s) else None)
                if len(s) and k not in seen:
                    seen.add(k)
                    held.append(s)
                    size += len(s)
                    if size > COUNTED:
                        yield repeated(held)
                        held, size = [], 0
            yield pa.record_batch([pa.array(np.zeros(len(n), np.int8)), batch.column(0), pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(check, pa.int64()), batch.column(2), pa.array(sig, pa.binary())], names=names)
        yield repeated(held)

    return run


def _draw(sid: np.ndarray, turn: int) -> np.ndarray:
    """A lot that a set has in common in all lists."""
    return C.mix64(sid.view(np.uint64) ^ np.uint64((turn + 1) * _GOLD & _ALL))


def _deal(sid: np.ndarray, salts: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, parts and homes of the rows of long lists: each row has one part, the likely leaders are in all of them."""
    draw = _draw(sid, turn)
    home = (C.mix64(draw * np.uint64(_GOLD)) % salts.astype(np.uint64)).astype(np.int64)
    rows = np.arange(len(sid))
    lead = np.flatnonzero((salts > 1) & (draw.astype(np.float64) * (salts * LIST_ROWS) < 2.0 * LEADERS * 2.0**64))
    again = np.repeat(lead, salts[lead])
    part = np.arange(len(again)) - np.repeat(np.cumsum(salts[lead]) - salts[lead], salts[lead])
    other = part != home[again]
    rows, part = np.concatenate([rows, again[other]]), np.concatenate([home, part[other]])
    return rows, part, part == home[rows]


def _prefixes(frequent: tuple[np.ndarray, np.ndarray], seed: int):
    """Dealt rows (shingle, part, set id, size << 32 | position, parts, home) of each set's prefix; a set seen before in the task is skipped."""

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.zeros(1 << CELL_BITS, np.uint8)
        np.maximum.at(level, (frequent[0] >> np.uint64(64 - CELL_BITS)).astype(np.int64), frequent[1])
        many = np.maximum(np.ceil(2.0 ** ((np.arange(256) + 1) / 4) / LIST_ROWS), 1).astype(np.int64)
        seen: set[int] = set()
        token, sid, size, salts = [], [], [], []

        def dealt() -> pa.RecordBatch:
            n = np.array([len(t) for t in token])
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            packed = np.repeat(np.array(size, np.int64), n) << 32 | at
            t, s, p = np.concatenate(token).view(np.int64), np.repeat(np.array(sid, np.int64), n), np.concatenate(salts)
            for x in (token, sid, size, salts):
                x.clear()
            rows, part, home = _deal(s, p, 0)
            return pa.record_batch([pa.array(x) for x in (t[rows], part.astype(np.int32), s[rows], packed[rows], p[rows].astype(np.int32), home)], names=["token", "part", "sid", "np", "salts", "home"])

        held = 0
        for batch in batches:
            for s in _sets(batch.column(0)):
                if not len(s):
                    continue
                k, _ = _identity(s, seed)
                if k in seen:
                    continue
                seen.add(k)
                p = probe_length(len(s))
                r = level[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                first = np.flatnonzero(r == 0)
                if len(first) < p:
                    hot = np.flatnonzero(r)
                    first = np.concatenate([first, hot[np.lexsort((s[hot], r[hot]))]])
                first = first[:p]
                token.append(s[first])
                salts.append(many[r[first]])
                sid.append(k)
                size.append(len(s))
                held += p
                if held > PREFIX_ROWS:
                    yield dealt()
                    held = 0
        if token:
            yield dealt()

    return run


def _dealt(turn: int):
    """Rows of lists, dealt for a turn with leaders."""

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, salts = batch.column("sid").to_numpy(), batch.column("salts").to_numpy().astype(np.int64)
            rows, part, _ = _deal(sid, salts, turn)
            at = pa.array(rows)
            cols = [batch.column(k).take(at) for k in ("token", "sid", "np", "group")]
            yield pa.record_batch([cols[0], pa.array(part.astype(np.int32)), *cols[1:]], names=["token", "part", "sid", "np", "group"])

    return run


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    return [np.concatenate(c) for c in zip(*got, strict=True)] if got else []


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted keys is the first of its group."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _leader_pairs(token: np.ndarray, part: np.ndarray, sid: np.ndarray, packed: np.ndarray, group: np.ndarray, turn: int) -> np.ndarray:
    """Pairs of the sets of each list with its LEADERS first by lot, if of another group and not ruled out."""
    order = np.lexsort((_draw(sid, turn), part, token))
    token, part, sid, packed, group = token[order], part[order], sid[order], packed[order], group[order]
    first = np.flatnonzero(_starts(token, part))
    size_of = np.diff(np.append(first, len(token)))
    start, length = np.repeat(first, size_of), np.repeat(size_of, size_of)
    size, pos = packed >> 32, packed & 0xFFFFFFFF
    rows = np.arange(len(token))
    out = []
    for k in range(LEADERS):
        i = np.flatnonzero(length > k)
        j = start[i] + k
        other = (rows[i] != j) & (group[i] != group[j])
        i, j = i[other], j[other]
        ok = _may_link(size[i], pos[i], size[j], pos[j])
        out.append(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])])[:, ok])
    return np.unique(np.concatenate(out, 1), axis=1)


@C.frugal
def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists with two sets or more (kind 0: shingle, set id, size << 32 | position, sets in the list, parts) and their first pairs (kind 1: a, b)."""
    got = _columns(batches)
    if not got:
        return
    order = np.lexsort((got[2], got[1], got[0]))
    token, part, sid, packed, salts, home = (x[order] for x in got)
    del got, order
    new = _starts(token, part, sid)
    token, part, sid, packed, salts, home = (x[new] for x in (token, part, sid, packed, salts, home))
    count = np.diff(np.append(np.flatnonzero(_starts(token, part)), len(token)))
    count = np.repeat(count, count)
    several = (count > 1) | (salts > 1)
    token, part, sid, packed, salts, home, count = (x[several] for x in (token, part, sid, packed, salts, home, count))
    pairs = _leader_pairs(token, part, sid, packed, sid, 0)
    listed = [x[home] for x in (token, sid, packed, np.where(salts > 1, LIST_ROWS, count), salts.astype(np.int64))]
    none = np.zeros(pairs.shape[1], np.int64)
    cols = [np.concatenate(x) for x in zip(listed, [pairs[0], pairs[1], none, none, none], strict=True)]
    kind = np.concatenate([np.zeros(len(listed[0]), np.int8), np.ones(len(none), np.int8)])
    yield pa.record_batch([pa.array(kind), *map(pa.array, cols)], names=["kind", "token", "sid", "np", "cnt", "salts"])


def _lead(turn: int):
    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _columns(batches)
        if got and len(got[0]):
            u = _leader_pairs(*got, turn)
            yield pa.record_batch([pa.array(u[0]), pa.array(u[1])], names=["a", "b"])

    return run


def _with_first(turn: int):
    """Rows of lists, with the first set by lot of their list or part of it."""

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _columns(batches)
        if not got or not len(got[0]):
            return
        token, sid, packed, group, salts = got
        order = np.lexsort((_draw(sid, turn), token))
        token, sid, packed, group, salts = token[order], sid[order], packed[order], group[order], salts[order]
        first = np.flatnonzero(_starts(token))
        lead = np.repeat(sid[first], np.diff(np.append(first, len(token))))
        yield pa.record_batch([pa.array(x) for x in (token, sid, packed, group, salts, lead)], names=["token", "sid", "np", "group", "salts", "lead"])

    return run


@C.frugal
def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows dealt for the comparison of all that is left: long lists go to the cells of a triangle, so that any two of their parts meet in one."""
    for batch in batches:
        sid, salts = batch.column("sid").to_numpy(), batch.column("salts").to_numpy().astype(np.int64)
        home = (C.mix64(_draw(sid, 99)) % salts.astype(np.uint64)).astype(np.int64)
        rows = np.repeat(np.arange(len(sid)), salts)
        other = np.arange(len(rows)) - np.repeat(np.cumsum(salts) - salts, salts)
        mine = home[rows]
        part = np.minimum(mine, other) * salts[rows] + np.maximum(mine, other)
        at = pa.array(rows)
        cols = [batch.column(k).take(at) for k in ("token", "sid", "np", "group", "lead", "diff", "sig")]
        yield pa.record_batch([*cols, pa.array(part), pa.array(mine)], names=["token", "sid", "np", "group", "lead", "diff", "sig", "part", "home"])


def _may_link(na, pa_, nb, pb):
    """Whether two sets whose prefixes hold the same shingle at these positions are left by size and position."""
    small_is_a = (na < nb) | (na == nb)
    small_n, small_p = np.where(small_is_a, na, nb), np.where(small_is_a, pa_, pb)
    large_n = np.where(small_is_a, nb, na)
    in_index = (small_p < index_length(small_n)) | ((na == nb) & (pb < index_length(nb)))
    return (5 * small_n >= 4 * large_n) & in_index & _fits(na, pa_, nb, pb)


def _fits(na, pa_, nb, pb):
    """Whether sets of these sizes that first meet at these positions can link."""
    low = need(na, nb)
    return (na - pa_ >= low) & (nb - pb >= low)


@C.frugal
def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one list and two groups whose answer the leaders leave open."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    sig = np.concatenate([np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64).reshape(b.num_rows, -1) for b in batches])
    token, sid, packed, group, lead, common, part, home = _columns(b.select(["token", "sid", "np", "group", "lead", "diff", "part", "home"]) for b in batches)
    order = np.lexsort((sid, packed, part, token))
    token, sid, packed, group, lead, common, part, home, sig = (c[order] for c in (token, sid, packed, group, lead, common, part, home, sig))
    size, pos = packed >> 32, packed & 0xFFFFFFFF
    edge = np.append(np.flatnonzero(_starts(token, part)), len(token))
    left, right = [], []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if (group[a:b] == group[a]).all():
            continue
        n, p = size[a:b], pos[a:b]
        m = b - a
        # in a cell of two parts, pairs inside one part are another cell's
        two = bool((home[a:b] != home[a]).any())
        block = np.arange(0, m, LIST_BLOCK)
        least_p = np.minimum.reduceat(p, block)
        n_lo, n_hi = n[block], n[np.minimum(block + LIST_BLOCK, m) - 1]
        for y in range(0, m, LIST_BLOCK):
            yy = np.arange(y, min(y + LIST_BLOCK, m))
            # blocks of sets no larger than these whose sizes and least position leave room for the overlap
            low = need(n_lo, n[yy[0]])
            for x in np.flatnonzero((block <= y) & (5 * n_hi >= 4 * n[yy[0]]) & (n_hi - least_p >= low)).tolist():
                xx = np.arange(block[x], min(block[x] + LIST_BLOCK, m))
                i, j = np.meshgrid(xx, yy, indexing="ij")
                ok = (i < j) & (group[a + i] != group[a + j]) & _may_link(n[i], p[i], n[j], p[j])
                if two:
                    ok &= home[a + i] != home[a + j]
                if not ok.any():
                    continue
                i, j = a + i[ok], a + j[ok]
                known = (lead[i] == lead[j]) & (common[i] >= 0) & (common[j] >= 0)
                # sizes of the differences to the leader bound the difference of the two from below
                apart = np.abs(common[i] - common[j])
                most = (size[i] + size[j] - apart) // 2
                settled = (known & (most < need(size[i], size[j]))) | _differ(sig[i], sig[j], size[i], size[j])
                left.append(sid[i[~settled]])
                right.append(sid[j[~settled]])
    if any(map(len, left)):
        x, y = np.concatenate(left), np.concatenate(right)
        u = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        yield pa.record_batch([pa.array(u[0]), pa.array(u[1])], names=["a", "b"])


@C.frugal
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sizes and intersections of (a, b) from their sets."""
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        out = np.empty((3, batch.num_rows), np.int64)
        for k in range(batch.num_rows):
            x, y = np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(large, small)
            out[:, k] = len(x), len(y), int((large[np.minimum(at, len(large) - 1)] == small).sum())
        yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, out)], names=["a", "b", "na", "nb", "common"])


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Join:
    def __init__(self, spark: SparkSession, docs: DataFrame, scratch: C.Scratch):
        self.spark, self.scratch = spark, scratch
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark"))

    def run(self) -> DataFrame:
        """(sid, group) of all sets with a link."""
        save = self.scratch.save
        C.shrink(self.spark)
        self._identify()
        frequent = self._frequent()
        dealt = self.docs.select("text").mapInArrow(_prefixes(frequent, self.seed), "token long, part int, sid long, np long, salts int, home boolean")
        lists = save(dealt.repartition("token", "part").mapInArrow(_lists, "kind byte, token long, sid long, np long, cnt long, salts long"), "lists")
        C.shrink(self.spark)
        self.compared = self.groups = None
        self._compare_new(lists.where("kind = 1").select(F.col("token").alias("a"), F.col("sid").alias("b")).distinct())
        # in a list of no more than LEADERS sets every pair has been looked at
        lists = lists.where((F.col("kind") == 0) & (F.col("cnt") > LEADERS)).drop("kind", "cnt")
        for turn in range(1, TURNS):
            rows = self._mixed(lists)
            if rows.isEmpty():
                return self.groups
            dealt = rows.mapInArrow(_dealt(turn), "token long, part int, sid long, np long, group long").repartition("token", "part")
            self._compare_new(dealt.mapInArrow(_lead(turn), "a long, b long").distinct())
        rows = self._mixed(lists)
        if not rows.isEmpty():
            self._compare_new(self._open_pairs(rows).distinct())
        return self.groups

    def _identify(self) -> None:
        """Class of every document; another seed is taken if two sets get one id."""
        for seed in range(64):
            self.seed = seed
            profile = self.scratch.save(self.docs.mapInArrow(_profile(seed), "kind byte, a long, b long, n long, c long, m long, sig binary"), "profile")
            self.profile = profile
            self.members = profile.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sid"), "n", F.col("m").alias("mark"))
            found = profile.where("kind = 0 and n > 0").groupBy(F.col("b").alias("sid")).agg(
                F.min("a").alias("first"), F.max("n").alias("n"), (F.min("c") < F.max("c")).alias("clash"), F.count("a").alias("docs"), F.any_value("sig").alias("sig")
            )
            self.classes = self.scratch.save(found, "classes")
            if self.classes.where("clash").isEmpty():
                return
        raise RuntimeError("different sets share an id under every seed")

    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingles that tasks repeat and four times the binary logarithms of their counts; HEAVY at most, the most frequent ones."""
        level = F.least(F.floor(4 * F.log2("c")), F.lit(255)).cast("int")
        counted = self.scratch.save(self.profile.where("kind = 1").groupBy("a").agg(F.sum("b").alias("c")).select("a", level.alias("level")), "frequent")
        n = dict(counted.groupBy("level").count().collect())
        least, total = 256, 0
        while least > 0 and total + n.get(least - 1, 0) <= HEAVY:
            least -= 1
            total += n.get(least, 0)
        got = counted.where(F.col("level") >= least).toArrow()
        return got["a"].to_numpy().view(np.uint64), got["level"].to_numpy().astype(np.uint8)

    def _mixed(self, lists: DataFrame) -> DataFrame:
        """Rows of the lists that hold sets of two groups, with the group."""
        g = _maybe_broadcast(self.groups.toDF("gs", "g"), self.n_grouped)
        rows = self.scratch.save(lists.join(g, F.col("sid") == F.col("gs"), "left").select("token", "sid", "np", F.coalesce("g", "sid").alias("group"), "salts"), "grouped")
        mixed = rows.groupBy("token").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 < g1").select(F.col("token").alias("t2"))
        return self.scratch.save(rows.join(mixed, F.col("token") == F.col("t2"), "left_semi"), "mixed")

    def _open_pairs(self, rows: DataFrame) -> DataFrame:
        led = rows.repartition("token").mapInArrow(_with_first(TURNS - 1), "token long, sid long, np long, group long, salts long, lead long")
        led = led.withColumn("a", F.least("sid", "lead")).withColumn("b", F.greatest("sid", "lead"))
        known = self.compared.select("a", "b", (F.col("na") + F.col("nb") - 2 * F.col("common")).alias("diff"))
        led = led.join(_maybe_broadcast(known, self.compared.count()), ["a", "b"], "left")
        diff = F.when(F.col("sid") == F.col("lead"), F.lit(0)).otherwise(F.coalesce("diff", F.lit(-1))).cast("long")
        ids = self.scratch.save(rows.select("sid").distinct(), "ids")
        n = ids.count()
        sigs = self.classes.join(_maybe_broadcast(ids, n), "sid", "left_semi").select("sid", "sig").mapInArrow(_shorten, "cs long, sig binary")
        led = led.withColumn("diff", diff).join(F.broadcast(sigs) if n <= BROADCAST_SIGNATURES else sigs, F.col("sid") == F.col("cs"))
        cells = led.select("token", "sid", "np", "group", "lead", "diff", "sig", "salts").mapInArrow(_grid, "token long, sid long, np long, group long, lead long, diff long, sig binary, part long, home long")
        return cells.repartition("token", "part").mapInArrow(_across, "a long, b long")

    def _compare_new(self, pairs: DataFrame) -> None:
        """Compare the pairs whose answer nothing tells yet, and extend ``compared`` and ``groups``."""
        if self.compared is not None:
            pairs = pairs.join(self.compared.select("a", "b"), ["a", "b"], "left_anti")
        pairs = self.scratch.save(pairs, "pairs")
        known = self._classes_of(pairs).select("sid", "n", "sig")
        one, two = known.toDF("sa", "na", "x"), known.toDF("sb", "nb", "y")
        both = pairs.join(one, F.col("a") == F.col("sa")).join(two, F.col("b") == F.col("sb")).select("a", "b", "na", "nb", "x", "y")
        left = self.scratch.save(both.mapInArrow(_sift, "a long, b long, bits long"), "sifted")
        # each set's nearest pair first; most of the other pairs are then inside a group and need no comparison
        ends = left.select(F.explode(F.array("a", "b")).alias("k"), F.struct("bits", "a", "b").alias("p"))
        self._verify(ends.groupBy("k").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct())
        if self.groups is not None:
            ga, gb = (_maybe_broadcast(self.groups.toDF(*k), self.n_grouped) for k in (("sa", "ga"), ("sb", "gb")))
            rest = left.select("a", "b").join(self.compared.select("a", "b"), ["a", "b"], "left_anti")
            rest = rest.join(ga, F.col("a") == F.col("sa"), "left").join(gb, F.col("b") == F.col("sb"), "left")
            rest = self.scratch.save(rest.where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b"), "rest")
            if not rest.isEmpty():
                self._verify(rest)
        self.scratch.drop(pairs)

    def _classes_of(self, pairs: DataFrame) -> DataFrame:
        """Rows of ``classes`` for the ends of pairs."""
        ids = self.scratch.save(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "ids")
        return self.classes.join(_maybe_broadcast(ids, ids.count()), "sid", "left_semi")

    def _verify(self, pairs: DataFrame) -> None:
        """Compare pairs of sets, cut from the whole texts of one document of each class; the set in fewer pairs travels to the other."""
        C.shrink(self.spark)
        pairs = self.scratch.save(pairs, "ends")
        degree = self.scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("d")), "degree")
        n = degree.count()
        da, db = (_maybe_broadcast(degree.toDF(*k), n) for k in (("sa", "da"), ("sb", "db")))
        first_is_hub = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
        dealt = pairs.join(da, F.col("a") == F.col("sa")).join(db, F.col("b") == F.col("sb"))
        dealt = self.scratch.save(dealt.select(F.when(first_is_hub, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first_is_hub, F.col("b")).otherwise(F.col("a")).alias("member")), "dealt")
        # a set's pairs towards sets with more pairs are no more than the root of twice all pairs
        travel = dealt.groupBy("member").agg(F.collect_list("hub").alias("to"))
        one = self._cut(dealt.select(F.col("hub").alias("sid")).distinct().withColumn("to", F.array("sid")), n).toDF("sa", "hub", "x")
        two = self._cut(travel.withColumnRenamed("member", "sid"), n).toDF("member", "sb", "y")
        both = one.join(two, F.col("hub") == F.col("sb"))
        swap = F.col("hub") > F.col("member")
        done = both.select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b"), F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"))
        done = self.scratch.save(done.mapInArrow(_compare, "a long, b long, na long, nb long, common long"), "compared")
        self.compared = done if self.compared is None else self.compared.unionByName(done)
        self._link(done.where(LINKED).select("a", "b"))

    def _cut(self, wanted: DataFrame, n: int) -> DataFrame:
        """(sid, to, set): the sets of (sid, to: list), once for each entry of the list."""
        seed = self.seed
        rows = self.classes.join(_maybe_broadcast(wanted.withColumnRenamed("sid", "w"), n), F.col("sid") == F.col("w")).select("sid", F.col("first").alias("d"), "to", "docs")
        texts = self.docs
        if n <= BROADCAST_ROWS:
            rows = F.broadcast(rows)
        else:
            texts = self._thinned(texts, rows)
        # documents that share an id are told apart by their set; equal ones of them would bring it twice
        texts = texts.join(rows, F.col("doc_id").eqNullSafe(F.col("d"))).select("sid", "to", "text")

        @C.frugal
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                want, to, sid, where, blob = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], [], []
                for w, t, s in zip(want, to, _sets(batch.column(2)), strict=True):
                    if len(s) and _identity(s, seed)[0] == w:
                        sid += [w] * len(t)
                        where += t
                        blob += [s.tobytes()] * len(t)
                yield pa.record_batch([pa.array(sid, pa.int64()), pa.array(where, pa.int64()), pa.array(blob, pa.binary())], names=["sid", "to", "s"])

        out = texts.mapInArrow(cut, "sid long, to long, s binary")
        return out.dropDuplicates(["sid", "to"]) if self._ids_repeat() else out

    def _thinned(self, texts: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows whose doc_id may be wanted, by a bitmap of fixed size, so that few texts are shuffled."""
        # cells are counted from 1, as Spark's bitmap functions do
        cell = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(0))), F.lit(1 << MAP_BITS)) + 1
        bits = wanted.select(cell(F.col("d")).alias("c")).groupBy(F.expr("bitmap_bucket_number(c)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(c))").alias("m"))
        held = np.zeros((1 << MAP_BITS) // 8, np.uint8)
        for r in bits.collect():
            at = (r["k"] - 1) * len(r["m"])
            part = np.frombuffer(bytes(r["m"]), np.uint8)[: max(0, len(held) - at)]
            held[at : at + len(part)] = part
        keep = self.spark.sparkContext.broadcast(held)

        def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = keep.value
            for batch in batches:
                at = batch.column(2).to_numpy()
                yield batch.select([0, 1]).filter(pa.array((m[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

        return texts.select("doc_id", "text", (cell(F.col("doc_id")) - 1).alias("c")).mapInArrow(thin, "doc_id long, text string")

    def _ids_repeat(self) -> bool:
        if not hasattr(self, "_repeat"):
            self._repeat = not self.members.groupBy("doc_id").count().where("count > 1").isEmpty()
        return self._repeat

    def _link(self, links: DataFrame) -> None:
        """Bring new links into ``groups``: components of the groups that they connect, then new labels."""
        save = self.scratch.save
        if self.groups is None:
            self.groups = save(self.spark.createDataFrame([], "sid long, group long"), "groups")
            self.n_grouped = 0
        ga, gb = (_maybe_broadcast(self.groups.toDF(*k), self.n_grouped) for k in (("sa", "ga"), ("sb", "gb")))
        ends = save(links.join(ga, F.col("a") == F.col("sa"), "left").join(gb, F.col("b") == F.col("sb"), "left").select("a", "b", F.coalesce("ga", "a").alias("x"), F.coalesce("gb", "b").alias("y")), "links")
        label = self._components(ends.where("x != y").select("x", "y").distinct())
        # sets that get their first group, and sets whose group moves
        known = self.groups.select("sid", "group")
        fresh = ends.select(F.col("a").alias("sid"), F.col("x").alias("group")).union(ends.select("b", "y")).distinct().join(known.select(F.col("sid").alias("k")), F.col("sid") == F.col("k"), "left_anti")
        moved = _maybe_broadcast(label.toDF("v", "to"), label.count())
        self.groups = save(known.union(fresh).join(moved, F.col("group") == F.col("v"), "left").select("sid", F.coalesce("to", "group").alias("group")), "groups")
        self.n_grouped = self.groups.count()

    def _components(self, links: DataFrame) -> DataFrame:
        """(v, to): the smallest end that links reach, by pointer jumping; ends without a link are left out."""
        both = self.scratch.save(links.union(links.select("y", "x")).toDF("a", "b"), "edges")
        n = both.count()
        label = self.scratch.save(both.groupBy(F.col("a").alias("sid")).agg(F.least(F.min("b"), F.col("a")).alias("group")), "labels")
        while n:
            near = both.join(_maybe_broadcast(label.toDF("v", "group"), n), F.col("b") == F.col("v")).groupBy("a").agg(F.min("group").alias("near"))
            step = label.join(near, F.col("sid") == F.col("a")).select("sid", "group", F.least("group", "near").alias("to"))
            # a label's own label is as good and farther on
            jump = step.join(_maybe_broadcast(label.toDF("v", "far"), n), F.col("to") == F.col("v"), "left")
            new = self.scratch.save(jump.select("sid", "group", F.least("to", F.coalesce("far", "to")).alias("to")), "labels")
            done = new.where("group != to").isEmpty()
            self.scratch.drop(label)
            label = new.select("sid", F.col("to").alias("group"))
            label._scratch_path = new._scratch_path
            if done:
                break
        return label


def classes(spark: SparkSession, docs: DataFrame, scratch: C.Scratch | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id; ``with_text`` adds mark (xxhash64 of the text) and group.

    Null and empty texts have no shingles (group null) and are their own component, as is a row with a null doc_id that
    links with nothing. Repeated rows are in one component. An empty table gives no rows; other columns are not touched.
    """
    C.small_batches(spark)
    scratch = scratch or C.Scratch(spark, "jaccard")
    join = Join(spark, docs, scratch)
    groups = join.run()
    groups = _maybe_broadcast(groups.withColumnRenamed("sid", "gs"), join.n_grouped)
    rows = join.members.join(groups, F.col("sid") == F.col("gs"), "left").select("doc_id", F.col("n").alias("n_shingles"), "mark", F.when(F.col("n") > 0, F.coalesce("group", "sid")).alias("label"))
    rows = scratch.save(rows, "labelled")
    least = scratch.save(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "least")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    out = C.attach(rows, least, ["label"], ["least"], total, ["doc_id", "mark"])
    extra = ["mark", F.col("label").alias("group")] if with_text else []
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), *extra)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, C.table(spark, sf_dir, "documents"))


#: DuckDB SQL for the rows of ``op3``: shingles as strings, pairs by counting, components by a recursive closure.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
           ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.c + q.c - i)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN both_ways ON b = x)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
