"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, their links and the groups that links form.

1. Each document becomes a sorted set of 64-bit shingle hashes, read once. Its size, a 128-bit fingerprint of the set and its
   signatures are written as a table; documents with the same fingerprint have one representative from there on.
2. Any two linked sets share a signature. Below PARTS_FROM percent these are a set's rarest shingles, as many as it could miss
   and one; all shingles are counted for that, into two bitmaps. At higher thresholds no counts are needed: a set of over SMALL
   shingles is cut into d + 1 parts or more, by hash range, where d is the largest number of shingles in which two linked sets of
   that size class differ: at least one part then agrees. Smaller sets use pairs of their lowest shingles (two linked sets share
   two of them). Signatures are plain rows from here on, so Spark combines, spills and splits them: a signature's smallest
   document is an aggregate, and documents are joined to it.
3. Documents that signatures connect are a block. Long passages that many documents share can connect too many; blocks over a
   limit are signed again without their most frequent shingles. What is over it still is cut into chunks by size class, since
   linked sets lie in one class or in neighbouring ones, and each pair of such chunks is a unit: no task holds more than two.
4. In each unit a T-occurrence search takes every set as a query against the smaller ones. DivideSkip sets the longest inverted
   lists aside, merges the short ones by a heap that skips, and probes the long ones by binary search, until a set reaches its
   required overlap or cannot any more. Every candidate is verified, so every link between different sets is counted.
5. Links give the groups. Documents with the same set count by their number, so pairs of copies are never made.

No candidate is dropped at any step. Set elements are 64-bit hashes, so two different shingles are taken for one with a
chance of about n*n / 2**65 in n shingles.
"""

import bisect
import heapq
from collections.abc import Iterator
from math import exp, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, tidy
from .components import connected_components

SMALL = 48
ROWS = 1_000  #: documents that a task signs before it sends their rows
HELD = 1_000_000  #: shingles that a task holds before it counts and sends them
FREQUENT = 1_000_000  #: shingles that are left out of the signatures of large blocks, at most: 8 MB
BLOCK = 1_000_000  #: shingles of a unit that one task searches
HEAP = 20_000  #: postings of a query's short lists up to which a heap merges them; more are merged as sorted runs by numpy
FEW = 16  #: candidates up to which all long lists are probed at once
PARTS_FROM = 90  #: percent from which sets are signed by parts, and below which by their rarest shingles
BROADCAST_ROWS = 200_000  #: of three or four longs, up to which a side of a join is broadcast
MU = 0.0085  #: DivideSkip's weight of the longest list's length
U = np.uint64


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        v = self[w] = xxhash.xxh3_64_intdigest(w)
        return v


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles, A-Z lower-cased; of fewer words, one of them all; of none, none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, U)
    if len(w) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], U)
    if len(_words) > 60_000:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, w), U, len(w))
    n = len(w) - k + 1
    x = _mix(h[:n])
    for i in range(1, k):
        x = _mix(x * U(0xD6E8FEB86659FD93) + h[i : i + n])
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]]


class Signatures:
    """Which signatures a set of a size emits, for links at percent / 100 or more."""

    def __init__(self, percent: int):
        self.t, self.classes, self.cuts = percent, {}, {}

    def largest(self, n: int) -> int:
        """The largest set that can be linked to one of n."""
        return 100 * n // self.t

    def prefix(self, n: int) -> int:
        """Lowest elements of which two linked sets share two: n less the least overlap, and 2."""
        return n + (-self.t * n // 100) + 2

    def class_of(self, n: int) -> int:
        lo, c = SMALL + 1, 0
        while self.largest(lo) < n:
            lo, c = self.largest(lo) + 1, c + 1
        return c

    def parts(self, c: int, thin: bool = False) -> tuple[int, int, int]:
        """(parts, spare parts, elements that a part needs to be strong) of class c.

        With `spare` parts beyond d + 1, a set of which at most so many parts are weak has a strong one that agrees. Spare parts
        are chosen so that few sets of the class have more weak ones. `thin` is for sets without their frequent elements, which
        may be much smaller: four times the parts, of which most may be empty.
        """
        if (c, thin) not in self.classes:
            lo, least = SMALL + 1, SMALL + 1
            for _ in range(c):
                lo, least = self.largest(lo) + 1, lo
            d = 2 * self.largest(lo) * (100 - self.t) // (100 + self.t)
            found = (4 * (d + 1), 4 * (d + 1) - d - 1, 1) if thin else None
            for strong, spare in [] if thin else [(2, x) for x in range(1, d // 2 + 3)] + [(1, x) for x in range(1, d // 2 + 3)]:
                m = d + 1 + spare
                load = least / m
                weak = m * exp(-load) * (1 + load if strong == 2 else 1)
                if weak + 3 * weak**0.5 + 1 <= spare:
                    found = (m, spare, strong)
                    break
            self.classes[c, thin] = found or (d + 1 + d // 2 + 2, d // 2 + 2, 1)
        return self.classes[c, thin]

    def of(self, s: np.ndarray, frequent: np.ndarray | None = None) -> np.ndarray:
        """The signatures of a sorted set.

        `frequent` is any sorted set of elements, here those that many documents share. Two linked sets differ in at most d
        elements outside it as well, so parts of the other elements alone do; only a set with too few of these for its strong
        parts emits the signatures of its whole set too. Prefixes take frequent elements last. Which elements are frequent
        never decides what is found, only how many unlinked documents share a signature.
        """
        n, out = len(s), []
        if isinstance(frequent, Rarity):
            order = s[np.argsort(frequent.rank(s), kind="stable")]
            if n > self.largest(SMALL):
                return np.sort(_mix(order[: self.prefix(n) - 1] + U(0x632BE59BD9B4E019)))
            pairs = self._pairs(order[: min(n, self.prefix(n))])
            return np.unique(np.concatenate([*pairs, _mix(order[: self.prefix(n) - 1] + U(0x632BE59BD9B4E019))] if n > SMALL else pairs)) if pairs or n > SMALL else np.empty(0, U)
        often = np.zeros(n, bool) if frequent is None or not len(frequent) else frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        if n <= self.largest(SMALL):
            out += self._pairs(np.r_[s[~often], s[often]][: min(n, self.prefix(n))])
        if n > SMALL:
            own = self.class_of(n)
            for c in (own, own + 1):
                strong, weak = self._parts(s[~often], c, frequent is not None)
                out.append(strong)
                if weak is not None and frequent is not None:
                    strong, weak = self._parts(s, c)
                    out.append(_mix(strong + U(0x9FB21C651E98DF25)))
                if weak is not None:
                    out.append(_mix(weak + U(0x2545F4914F6CDD1D)))
        return np.unique(np.concatenate(out)) if out else np.empty(0, U)

    @staticmethod
    def _pairs(p: np.ndarray) -> list[np.ndarray]:
        if len(p) < 2:
            return []
        i, j = np.triu_indices(len(p), 1)
        return [_mix(_mix(np.minimum(p[i], p[j])) * U(3) + np.maximum(p[i], p[j]))]

    def _parts(self, s: np.ndarray, c: int, thin: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(keys of strong parts, and of weak ones where there are more than spare: two such sets may agree in these alone)."""
        m, spare, strong = self.parts(c, thin)
        if m not in self.cuts:
            self.cuts[m] = np.array([(i << 64) // m for i in range(1, m)], U)
        mixed = np.r_[U(0), np.cumsum(_mix(s ^ U(0x5851F42D4C957F2D)), dtype=U)]
        at = np.r_[0, np.searchsorted(s, self.cuts[m]), len(s)]
        sums, size = mixed[at[1:]] - mixed[at[:-1]], np.diff(at)
        key = _mix(_mix(sums) + U(1 + c * 1_000_003 + thin * 500_009) + np.arange(m, dtype=U) * U(0xA24BAED4963EE407))
        weak = size < strong
        return key[~weak], key[weak] if weak.sum() > spare else None


def _signed(batches: Iterator[pa.RecordBatch], k: int, percent: int, order: "np.ndarray | Rarity | None" = None) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, hi, lo, sigs): a set's size, fingerprint and signatures; of equal sets in a run of rows one has the signatures."""
    signs = Signatures(percent)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            n, hi, lo, sigs, seen = [], [], [], [], set()
            for text in part.column(1):
                s = shingles(text.as_py(), k)
                fp = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                hi.append(fp >> 64)
                lo.append(fp & 0xFFFFFFFFFFFFFFFF)
                sigs.append(signs.of(s, order) if len(s) and fp not in seen else np.empty(0, U))
                seen.add(fp)
            ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            cols = [part.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(x, U).view(np.int64)) for x in (hi, lo)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs).view(np.int64)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "hi", "lo", "sigs"])
    _words.clear()


def _edges(sigs: DataFrame) -> DataFrame:
    """(a, b) of (rep, sigs): documents and the smallest one that shares a signature with them."""
    flat = sigs.select("rep", F.explode("sigs").alias("sig"))
    lead = flat.groupBy("sig").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("sig", "a")
    return flat.join(lead, "sig").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def _runs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[np.ndarray]:
    """Sorted shingles of many documents at a time; each document has each of its shingles once."""
    held, n = [], 0
    for batch in batches:
        for text in batch.column(0):
            held.append(shingles(text.as_py(), k))
            n += len(held[-1])
            if n >= HELD:
                yield np.sort(np.concatenate(held))
                held, n = [], 0
    if n:
        yield np.sort(np.concatenate(held))
    _words.clear()


def _counts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(x, c): shingles with their counts inside a run."""
    for x in _runs(batches, k):
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        yield pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(x)]))], names=["x", "c"])


RARE_BITS = (20, 27)  #: least and most of the bits that index the two bitmaps; 27 are 16 MB each
MANY = 32
RANGE = 4_000_000  #: shingles that one group of the count takes, as an average


class Rarity:
    """Two bitmaps over the top bits of a shingle's hash: whether two documents have it, and whether MANY have. Hashes that share
    a bit share its answer, which makes an order of shingles a little less good and never wrong."""

    def __init__(self, twice: np.ndarray, many: np.ndarray):
        self.bits, self.log = (twice, many), len(twice).bit_length() + 2

    def rank(self, s: np.ndarray) -> np.ndarray:
        """0, 1 or 2 for shingles of one, some and many documents."""
        i = s >> U(64 - self.log)
        at, bit = (i >> U(3)).astype(np.int64), (i & U(7)).astype(np.uint8)
        return sum((b[at] >> bit) & 1 for b in self.bits)


def _cut(x: np.ndarray, log: int, ranges: int) -> np.ndarray:
    """The range of each hash, so that a range is a run of bytes of the bitmaps."""
    return ((x >> U(64 - log + 3)) * U(ranges) >> U(log - 3)).astype(np.int64)


def _tops(batches: Iterator[pa.RecordBatch], k: int, log: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Packed (range, top 32 bits of shingles)."""
    for x in _runs(batches, k):
        where = _cut(x, log, ranges)
        at = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        top = (x >> U(32)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(where[at].astype(np.int32)), pa.array([top[i:j].tobytes() for i, j in zip(at, [*at[1:], len(x)])], pa.binary())], names=["r", "x"])


def _segments(t: pa.Table, log: int) -> pa.Table:
    """(first byte, bytes of the one bitmap, of the other) of one range."""
    x = np.sort(np.frombuffer(b"".join(t["x"].to_pylist()), np.uint32))
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    count, x = np.diff(np.r_[first, len(x)]), x[first] >> (32 - log)
    lo, hi = (int(x[0]) >> 3, int(x[-1]) >> 3) if len(x) else (0, 0)
    out = []
    for least in (2, MANY):
        bits = np.zeros((hi - lo + 1) * 8, np.uint8)
        bits[x[count >= least].astype(np.int64) - lo * 8] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return pa.table({"at": pa.array([lo], pa.int64()), "twice": pa.array([out[0]], pa.binary()), "many": pa.array([out[1]], pa.binary())})


def rarity(texts: DataFrame, k: int) -> Rarity:
    """Counts the shingles of all texts. Groups and bitmaps follow the counted characters, and the bitmaps have a largest size."""
    words = (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // 5 + 1
    log = min(max(RARE_BITS[0], (2 * words).bit_length()), RARE_BITS[1])
    ranges = min(max(64, words // RANGE), 1 << (log - 3))
    twice, many = np.zeros(1 << (log - 3), np.uint8), np.zeros(1 << (log - 3), np.uint8)
    parts = texts.select("text").mapInArrow(tidy(lambda it: _tops(it, k, log, ranges)), "r int, x binary").groupBy("r").applyInArrow(lambda t: _segments(t, log), "at long, twice binary, many binary")
    for r in parts.toLocalIterator():  # the two bitmaps, piece by piece
        for whole, part in ((twice, r["twice"]), (many, r["many"])):
            whole[r["at"] : r["at"] + len(part)] |= np.frombuffer(bytes(part), np.uint8)
    return Rarity(twice, many)


class Index:
    """Inverted lists of sets in order of size, each list's documents ascending, as two arrays."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        _, tok, often = np.unique(np.concatenate(sets) if sets else np.empty(0, U), return_inverse=True, return_counts=True)
        shared = often[tok] > 1  # a shingle of one set alone takes part in no overlap
        number = np.cumsum(often > 1, dtype=np.int64) - 1
        doc, tok = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[shared], number[tok[shared]]
        order = np.argsort(tok, kind="stable")
        self.posts, place = doc[order], np.empty(len(tok), np.int64)
        place[order] = np.arange(len(tok))
        start = np.r_[0, np.cumsum(often[often > 1])]
        self.at = np.searchsorted(doc, np.arange(len(sets) + 1))
        self.low, self.length = start[tok], place - start[tok]  # of each set's shingles: the list, and its part before the set

    def lists(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, lengths) of the lists of a set's shingles, as far as smaller sets are in them; shortest first."""
        low, n = self.low[self.at[q] : self.at[q + 1]], self.length[self.at[q] : self.at[q + 1]]
        low, n = low[n > 0], n[n > 0]
        order = np.argsort(n, kind="stable")
        return low[order], n[order]


def heap_merge(lists: list[list[int]], want: int) -> Iterator[tuple[int, int]]:
    """(document, count) of those in `want` lists or more, smallest first; lists that cannot take part are skipped ahead."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= want:
        c, popped = heap[0][0], []
        while heap and heap[0][0] == c:
            popped.append(heapq.heappop(heap))
        if len(popped) >= want:
            yield c, len(popped)
            to = c + 1
        else:
            while heap and len(popped) < want - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            to = heap[0][0]
        for _, i, at in popped:
            at = bisect.bisect_left(lists[i], to, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))


def run_merge(posts: np.ndarray, low: np.ndarray, n: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """heap_merge() of lists that hold very many postings: a stable sort, which merges the runs that it finds."""
    x = np.sort(posts[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], kind="stable")
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    count = np.diff(np.r_[first, len(x)])
    return x[first[count >= want]].astype(np.int64), count[count >= want]


def links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position, all earlier positions that it links to) among sets in order of size: DivideSkip's T-occurrence search."""
    index = Index(sets)
    posts, sizes = index.posts, index.sizes
    for q, n in enumerate(sizes.tolist()):
        least = -(-percent * n // 100)  # the overlap that the smallest partner needs
        low, length = index.lists(q)
        if not n or len(low) < least:
            continue
        long = min(int(least / (MU * log2(max(2, int(length[-1]))) + 1)), least - 1)
        cut, want = len(low) - long, least - long
        if length[:cut].sum() <= HEAP:
            found = list(heap_merge([posts[i : i + m].tolist() for i, m in zip(low[:cut].tolist(), length[:cut].tolist())], want))
            if not found:
                continue
            c, count = (np.array(x, np.int64) for x in zip(*found))
        else:
            c, count = run_merge(posts, low[:cut], length[:cut], want)
        need = -(-percent * (n + sizes[c]) // (100 + percent))
        some = (sizes[c] >= least) & (count + long >= need)
        c, count, need = c[some], count[some], need[some]
        if not len(c):
            continue
        if len(c) <= FEW:  # few candidates: their probes of all long lists in step, each halving its own range
            lo, hi = (np.repeat(x[cut:, None], len(c), 1) for x in (low, low + length))
            end = hi.copy()
            for _ in range(int(length[-1]).bit_length()):
                mid = (lo + hi) >> 1
                less = (posts[np.minimum(mid, len(posts) - 1)] < c) & (lo < hi)
                lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            count = count + ((lo < end) & (posts[np.minimum(lo, len(posts) - 1)] == c)).sum(0)
        else:
            left = long
            for i, m in zip(low[cut:].tolist(), length[cut:].tolist()):
                x = posts[i : i + m]
                at = np.searchsorted(x, c)
                count = count + (x[np.minimum(at, m - 1)] == c)
                left -= 1
                if left % 16 == 0 and not (alive := count + left >= need).all():
                    c, count, need = c[alive], count[alive], need[alive]
        c = c[count >= need]
        if len(c):
            yield q, c


GROUP, COUNT, LINK = range(3)


def search_unit(docs: list[tuple], cross: bool, percent: int, pairs: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, a, b) of a unit's (id, set, chunk, weight): groups as (smallest id, id), each id's weight of links, and with `pairs`
    the links, in runs of bounded size. In a unit of two chunks only links between the two count."""
    docs = sorted({(d[0], d[1].tobytes()): d for d in docs}.values(), key=lambda d: (len(d[1]), d[0]))
    ids, chunk, weight = (np.array([d[i] for d in docs], np.int64) for i in (0, 2, 3))
    total, up, a, b, held = np.zeros(len(docs), np.int64), np.arange(len(docs)), [], [], 0

    def roots(x: np.ndarray) -> np.ndarray:
        r = up[x]
        while (up[r] != r).any():
            r = up[r]
        up[x] = r
        return r

    for q, found in links([d[1] for d in docs], percent):
        found = found[ids[found] != ids[q]]
        if cross:
            found = found[chunk[found] != chunk[q]]
        total[q] += weight[found].sum()
        total[found] += weight[q]
        tops = np.unique(roots(np.r_[found, q]))
        up[tops] = tops[0]
        if pairs:
            a.append(np.minimum(ids[found], ids[q]))
            b.append(np.maximum(ids[found], ids[q]))
            held += len(found)
            if held >= HELD:
                yield LINK, np.concatenate(a), np.concatenate(b)
                a, b, held = [], [], 0
    if held:
        yield LINK, np.concatenate(a), np.concatenate(b)
    if len(docs):
        top, smallest = roots(np.arange(len(docs))), np.full(len(docs), np.iinfo(np.int64).max)
        np.minimum.at(smallest, top, ids)
        yield GROUP, smallest[top][smallest[top] != ids], ids[smallest[top] != ids]
        yield COUNT, ids[total > 0], total[total > 0]


def _search(batches: Iterator[pa.RecordBatch], k: int, percent: int, pairs: bool) -> Iterator[pa.RecordBatch]:
    """Rows (block, unit, doc_id, lo, text, chunk, weight), each unit's in a row, to (kind, a, b)."""

    def of(docs: list[tuple], unit: str) -> Iterator[pa.RecordBatch]:
        for kind, a, b in search_unit(docs, "-" in unit, percent, pairs):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    now, docs = (None, ""), []
    for batch in batches:
        for block, unit, doc, lo, text, chunk, weight in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), *(batch.column(i).to_pylist() for i in (5, 6))):
            if (block, unit) != now:
                yield from of(docs, now[1])
                now, docs = (block, unit), []
            s = shingles(text.as_py(), k)
            if xxhash.xxh3_128_intdigest(s.tobytes()) & 0xFFFFFFFFFFFFFFFF == lo & 0xFFFFFFFFFFFFFFFF:  # else another text of this id
                docs.append((doc, s, chunk, weight))
    yield from of(docs, now[1])
    _words.clear()


def _small(df: DataFrame) -> DataFrame:
    """To be broadcast where it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _units(members: DataFrame, signs: Signatures, block: int) -> DataFrame:
    """(doc_id, lo, block, unit, chunk) of (doc_id, lo, n, block, total). A block within the limit is one unit; a larger one is cut
    by size class and hash, and its units are chunks alone and pairs of chunks of one class or of neighbouring classes."""
    whole = members.where(F.col("total") <= block).select("doc_id", "lo", "block", F.lit("0").alias("unit"), F.lit(0).cast("long").alias("chunk"))
    bounds, at = [], 1
    while at < 1 << 40:
        bounds.append(at)
        at = signs.largest(at) + 1
    cls = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("n")))
    large = members.where(F.col("total") > block).select("doc_id", "lo", "block", "n", cls.alias("c"))
    per = large.groupBy("block", "c").agg(F.ceil(F.sum("n") / (block / 2)).cast("int").alias("k"))
    per = per.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("c", "k"))).alias("ks"))  # as many entries as size classes
    cut = large.join(_small(per), "block").withColumn("h", F.pmod(F.xxhash64("doc_id", "lo"), F.element_at("ks", F.col("c"))).cast("int"))
    name = lambda c, h: F.concat(c.cast("string"), F.lit(":"), h.cast("string"))
    count = lambda c: F.coalesce(F.try_element_at("ks", c), F.lit(0))
    upto = lambda c: F.when(count(c) > 0, F.sequence(F.lit(0), count(c) - 1)).otherwise(F.array().cast("array<int>"))
    own, c = name(F.col("c"), F.col("h")), F.col("c")
    pair = lambda a, b: F.concat(a, F.lit("-"), b)
    same = F.transform(F.filter(upto(c), lambda x: x != F.col("h")), lambda x: pair(name(c, F.least(x, F.col("h"))), name(c, F.greatest(x, F.col("h")))))
    above = F.transform(upto(c + 1), lambda x: pair(own, name(c + 1, x)))
    below = F.transform(upto(c - 1), lambda x: pair(name(c - 1, x), own))
    cut = cut.select("doc_id", "lo", "block", F.explode(F.concat(F.array(own), same, above, below)).alias("unit"), (c.cast("long") * (1 << 32) + F.col("h")).alias("chunk"))
    return whole.unionByName(cut)


class Joined:
    """What a join found: `signed` (doc_id, n, hi, lo) of all rows, `copies` (hi, lo, rep, weight) of sets that several documents
    have, and `found` (kind, a, b) between representatives."""

    def __init__(self, df: DataFrame, tmp: Scratch, words: int, percent: int, id_col: str, text_col: str, block: int, pairs: bool = False):
        spark = df.sparkSession
        src = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
        rare = spark.sparkContext.broadcast(rarity(src, words)) if percent < PARTS_FROM else None
        schema = "doc_id long, n long, hi long, lo long, sigs array<long>"
        signed = tmp.save(src.mapInArrow(tidy(lambda it: _signed(it, words, percent, rare and rare.value)), schema), "signed")
        if rare:
            rare.unpersist()
        known = signed.where("doc_id is not null and n > 0")
        sets = known.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sigs").alias("sigs"), F.count("*").alias("rows"))
        sets = tmp.save(sets, "sets")
        self.signed = signed.drop("sigs")
        weight = known.join(_small(sets.where("rows > 1").select("hi", "lo", "rep")), ["hi", "lo"]).select("hi", "lo", "rep", "doc_id").distinct().groupBy("hi", "lo", "rep").agg(F.count("*").alias("weight"))
        self.copies = tmp.save(weight, "copies")
        members = tmp.save(self._blocks(_edges(sets.select("rep", "sigs")), sets, tmp, "blocks"), "members")
        large = members.where(F.col("total") > block)
        total = large.agg(F.sum("n")).first()[0]
        if total and not rare:  # documents that share long passages may be one block: sign them again without the shingles that many share
            texts = src.join(_small(large.select("doc_id").distinct()), "doc_id")
            least = max(20, -(-total // FREQUENT))
            counted = texts.select("text").mapInArrow(tidy(lambda it: _counts(it, words)), "x long, c long").groupBy("x").agg(F.sum("c").alias("c"))
            often = np.sort(np.array([r["x"] for r in counted.where(F.col("c") >= least).select("x").collect()], np.int64).view(U))  # FREQUENT at most
            frequent = spark.sparkContext.broadcast(often)
            again = texts.mapInArrow(tidy(lambda it: _signed(it, words, percent, frequent.value)), schema).groupBy("hi", "lo").agg(F.max("sigs").alias("sigs"))
            again = tmp.save(again.join(sets.select("hi", "lo", "rep"), ["hi", "lo"]).select("rep", "sigs"), "again")
            finer = self._blocks(_edges(again), sets, tmp, "finer").join(_small(large.select("doc_id").distinct()), "doc_id", "left_semi")
            members = tmp.save(members.where(F.col("total") <= block).unionByName(finer), "finer-members")
        units = _units(members, Signatures(percent), block)
        units = units.join(_small(self.copies.select(F.col("rep").alias("doc_id"), "lo", "weight")), ["doc_id", "lo"], "left").withColumn("weight", F.coalesce("weight", F.lit(1)).cast("long"))
        units = src.join(_small(units), "doc_id").select("block", "unit", "doc_id", "lo", "text", "chunk", "weight")
        units = units.repartition("block", "unit").sortWithinPartitions("block", "unit")
        self.found = tmp.save(units.mapInArrow(tidy(lambda it: _search(it, words, percent, pairs)), "kind int, a long, b long"), "found")

    @staticmethod
    def _blocks(edges: DataFrame, sets: DataFrame, tmp: Scratch, name: str) -> DataFrame:
        """(doc_id, lo, n, block, total) of the representatives that edges connect; total is the block's number of shingles."""
        found = connected_components(edges, tmp, name)
        nodes = found.select(F.col("node").alias("rep"), F.col("root").alias("block")).unionByName(found.select(F.col("root").alias("rep"), F.col("root").alias("block")).distinct())
        rows = sets.select("rep", "lo", "n").join(_small(nodes), "rep").select(F.col("rep").alias("doc_id"), "lo", "n", "block")
        return rows.join(_small(rows.groupBy("block").agg(F.sum("n").alias("total"))), "block").select("doc_id", "lo", "n", "block", "total")

    def members(self) -> DataFrame:
        """The rows of `signed` with rep (the smallest document that has the set) and weight (the documents that have it)."""
        d = self.signed.join(_small(self.copies), ["hi", "lo"], "left")
        return d.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.when(F.col("n") > 0, F.coalesce("weight", F.lit(1))).otherwise(1).alias("weight"))


def near_links(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(all links (a, b), a < b, between documents that represent different sets; membership (doc_id, rep)).

    Documents with the same set have one representative: two documents are linked when their representatives are, or when these
    are one and the set is not empty. There are as many rows as links of different sets. Null ids have no part in either; an
    empty table gives two empty ones, and further columns of any name are not read.
    """
    j = Joined(df, Scratch(df.sparkSession, "ngram-links"), words, percent, id_col, text_col, block, True)
    return j.found.where(F.col("kind") == LINK).select("a", "b").distinct(), j.members().where("doc_id is not null").select("doc_id", "rep").distinct()


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each input row: (doc_id, n_shingles, component_id, n_links).

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct shingles of `words` words; component_id
    is the smallest doc_id that links reach, and n_links the number of other documents that a document links to, copies among
    them. Empty and null texts have no shingles and no links. Rows that repeat an id count as one document, linked by either
    text; where such texts differ, n_links of a row counts the links of its own text. A row with a null id has its size and null
    for the others. A text of any length is one set. An empty table gives an empty one, and further columns of any name are
    not read.
    """
    tmp = Scratch(df.sparkSession, "ngram-join")
    j = Joined(df, tmp, words, percent, id_col, text_col, block)
    several = j.signed.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).where("x <> y").select("doc_id")
    m = tmp.save(j.members(), "rows")
    twice = m.where("n > 0").join(_small(several), "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))  # one id with different texts
    roots = connected_components(j.found.where(F.col("kind") == GROUP).select("a", "b").unionByName(twice), tmp, "groups")
    far = j.found.where(F.col("kind") == COUNT).groupBy("a").agg(F.sum("b").alias("far"))
    known = tmp.save(roots.select(F.col("node").alias("rep"), "root").join(far.select(F.col("a").alias("rep"), "far"), "rep", "full"), "known")
    out = m.join(_small(known), "rep", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("far", F.lit(0)) + F.col("weight") - 1).otherwise(0)).cast("long").alias("n_links"),
    )


def drop_near_copies(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose document is the first of its group, with all their columns; rows with a null id stay, and so do empty
    and null texts and all rows of a repeated id that stays. Column names of df never clash with those used here."""
    g = Scratch(df.sparkSession, "near-copies").save(near_duplicates(df, words, percent, id_col, text_col).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    gone = _small(g.toDF(fresh(df, "gone")))
    return df.join(gone, df[id_col].cast("long") == gone[gone.columns[0]], "left_anti")
