"""Exact dedup with counting quotient filters.

Each partition builds a counting quotient filter of its 64-bit fingerprints: slots of remainders with three bits, runs in order
of their quotients, and counters in slots of their own. Filters are cut by their fingerprints' first bits, so equal ranges of all
partitions meet, and merge by their sorted remainders without loss. Only rows whose fingerprint is counted more than once
are grouped by their bytes; the texts of all others are never shuffled.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, few_rows, fresh, tidy

U = np.uint64
SLICE_ROWS = 1_000_000  #: counted rows for each merge task
LOAD = 0.75  #: of a filter's slots
BROADCAST_ROWS = 1_000_000  #: of 8-byte fingerprints; with more, the join shuffles


class CountingQuotientFilter:
    """A quotient filter of 64-bit fingerprints that share their first `prefix` bits, with exact counts.

    The next q bits are the quotient, the others the remainder. A slot has a remainder and three bits: occupied (its own number is
    the quotient of some fingerprint), continuation (it goes on a run), shifted (it lies past its quotient's slot). The
    remainders of one quotient are a run, sorted, at the quotient's slot or after the run before; runs may go on past the last
    quotient. Continuation without shift can't happen to a remainder: it marks a slot that holds a digit of (count - 1) of the
    remainder before it. Whole fingerprints can be read back, so merging filters of any sizes loses nothing.
    """

    def __init__(self, slots: np.ndarray, bits: np.ndarray, q: int, prefix: int = 0, top: int = 0):
        self.slots, self.q, self.prefix, self.top = slots, q, prefix, top
        self.occupied, self.continuation, self.shifted = bits
        self.r = 64 - prefix - q

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, prefix: int = 0, top: int = 0, q: int | None = None) -> "CountingQuotientFilter":
        """The filter of fingerprints in any order; equal ones add up."""
        fp, n = _collapse(*_sorted(np.asarray(fingerprints, U), counts))
        q = max(1, int(np.ceil(np.log2(max(2, len(fp) / LOAD))))) if q is None else q
        r = 64 - prefix - q
        quotient = ((fp << U(prefix)) >> U(64 - q)).astype(np.int64)
        remainder, rest = fp & U((1 << r) - 1), (n - 1).astype(U)
        digits = sum((rest >> U(k) > 0).astype(np.int64) for k in range(0, 64, r))  # of r bits each
        size = 1 + digits
        first = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if len(fp) else np.empty(0, np.int64)
        before = np.cumsum(size) - size
        start = before[first] + np.maximum.accumulate(quotient[first] - before[first]) if len(fp) else first  # a run begins where it may, or after the one before
        run = np.cumsum(np.isin(np.arange(len(fp)), first)) - 1
        at = start[run] + before - before[first][run] if len(fp) else first
        end = int(at[-1] + size[-1]) if len(fp) else 0
        slots, bits = np.zeros(max(1 << q, end), U), np.zeros((3, max(1 << q, end)), bool)
        slots[at] = remainder
        bits[0, quotient] = True
        bits[1, at] = True
        bits[1, at[first]] = False
        bits[2, at] = at != quotient
        for k in range(int(digits.max(initial=0))):
            has = digits > k
            slots[at[has] + 1 + k] = (rest[has] >> U(k * r)) & U((1 << r) - 1)
            bits[1, at[has] + 1 + k] = True
        return cls(slots, bits, q, prefix, top)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, counts), sorted: the runs in slot order belong to the occupied quotients in order."""
        digit = self.continuation & ~self.shifted
        here = np.flatnonzero((self.occupied | self.continuation | self.shifted) & ~digit)
        run = np.cumsum(~self.continuation[here]) - 1
        quotient = np.flatnonzero(self.occupied)[run].astype(U)
        fp = (quotient << U(self.r)) | self.slots[here]
        if self.prefix:
            fp |= U(self.top) << U(64 - self.prefix)
        n, at = np.ones(len(here), np.int64), np.flatnonzero(digit)
        owner = np.searchsorted(here, at) - 1
        np.add.at(n, owner, (self.slots[at] << (U(self.r) * (at - here[owner] - 1).astype(U))).astype(np.int64))
        return fp, n

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint is in the filter, by a walk from its cluster's begin to its run."""
        if self.prefix and fingerprint >> (64 - self.prefix) != self.top:
            return 0
        quotient, remainder = (fingerprint >> self.r) & ((1 << self.q) - 1), fingerprint & ((1 << self.r) - 1)
        if not self.occupied[quotient]:
            return 0
        digit = lambda i: self.continuation[i] and not self.shifted[i]
        b = quotient
        while self.shifted[b] or digit(b):
            b -= 1
        s, k = b, b
        while k < quotient:  # as many runs on as there are occupied quotients
            s += 1
            while s < len(self.slots) and self.continuation[s]:
                s += 1
            k += 1
            while not self.occupied[k]:
                k += 1
        while True:
            j, n = s + 1, 1
            while j < len(self.slots) and digit(j):
                n += int(self.slots[j]) << (self.r * (j - s - 1))
                j += 1
            if int(self.slots[s]) == remainder:
                return n
            if j >= len(self.slots) or not self.continuation[j]:
                return 0
            s = j

    def slices(self, bits: int) -> Iterator["CountingQuotientFilter"]:
        """Filters of the ranges of equal first bits; only those that hold anything."""
        fp, n = self.items()
        part = fp >> U(64 - bits) if bits else np.zeros(len(fp), U)
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(fp) else []
        for i, j in zip(at, [*at[1:], len(fp)]):
            yield CountingQuotientFilter.build(fp[i:j], n[i:j], bits, int(part[i]))

    def dump(self) -> tuple[int, bytes, bytes]:
        """(q, remainders in as many bytes as they need, the three bits of all slots)."""
        width = max(1, -(-self.r // 8))
        return self.q, self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), np.packbits([self.occupied, self.continuation, self.shifted], axis=1).tobytes()

    @classmethod
    def load(cls, q: int, slots: bytes, bits: bytes, prefix: int, top: int) -> "CountingQuotientFilter":
        width = max(1, -(-(64 - prefix - q) // 8))
        raw = np.frombuffer(slots, np.uint8).reshape(-1, width)
        whole = np.zeros((len(raw), 8), np.uint8)
        whole[:, :width] = raw
        return cls(whole.view("<u8").ravel(), np.unpackbits(np.frombuffer(bits, np.uint8).reshape(3, -1), axis=1, count=len(raw)).astype(bool), q, prefix, top)

    @classmethod
    def merge(cls, filters: Iterator["CountingQuotientFilter"], prefix: int = 0, top: int = 0) -> "CountingQuotientFilter":
        """One filter of all: sorted runs of like size are merged two by two, as they come."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for f in filters:
            held.append(f.items())
            while len(held) > 1 and len(held[-2][0]) < 2 * len(held[-1][0]):
                held.append(_zip(held.pop(), held.pop()))
        while len(held) > 1:
            held.append(_zip(held.pop(), held.pop()))
        fp, n = held[0] if held else (np.empty(0, U), np.empty(0, np.int64))
        return cls.build(fp, n, prefix, top)


def _sorted(fp: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    n = np.ones(len(fp), np.int64) if counts is None else np.asarray(counts, np.int64)
    if len(fp) < 2 or (fp[1:] >= fp[:-1]).all():
        return fp, n
    order = np.argsort(fp, kind="stable")
    return fp[order], n[order]


def _collapse(fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours added up."""
    if not len(fp):
        return fp, n
    first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
    return fp[first], np.add.reduceat(n, first)


def _zip(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs merged: each element's place is its own position and that in the other run."""
    fp, n = np.empty(len(a[0]) + len(b[0]), U), np.empty(len(a[0]) + len(b[0]), np.int64)
    for (x, c), y, side in ((a, b[0], "left"), (b, a[0], "right")):
        at = np.arange(len(x)) + np.searchsorted(y, x, side)
        fp[at], n[at] = x, c
    return _collapse(fp, n)


def _normal(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp, sha[, text]) where text is lower-cased in A-Z only."""
    for b in few_rows(batches):
        low = [(t.as_py() or "").encode().lower() for t in b.column(1)]
        cols = [b.column(0), pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in low], np.uint64).view(np.int64)), pa.array([hashlib.sha256(t).digest() for t in low], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols + [pa.array(low, pa.binary())] * with_text, names=["doc_id", "fp", "sha"] + ["text"] * with_text)


def _build(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(slice, q, slots, bits): a partition's filter, cut by the first bits."""
    whole = CountingQuotientFilter.merge(CountingQuotientFilter.build(b.column(0).to_numpy().view(U)) for b in batches)
    for f in whole.slices(bits):
        q, slots, marks = f.dump()
        yield pa.RecordBatch.from_arrays([pa.array([f.top], pa.int32()), pa.array([q], pa.int32()), pa.array([slots], pa.binary()), pa.array([marks], pa.binary())], names=["slice", "q", "slots", "bits"])


def _merge(key: tuple, table: pa.Table, bits: int) -> pa.Table:
    """The fingerprints of one slice that are counted more than once."""
    top = key[0].as_py()
    parts = (CountingQuotientFilter.load(q.as_py(), s.as_py(), b.as_py(), bits, top) for q, s, b in zip(table["q"], table["slots"], table["bits"]))
    fp, n = CountingQuotientFilter.merge(parts, bits, top).items()
    return pa.table({"fp": fp[n > 1].view(np.int64), "n": n[n > 1]})


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bits: int | None = None) -> DataFrame:
    """One row for each input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. The largest id of a group stays.
    Rows that repeat both id and text are one document: all carry its decision. A null id stays only where its group has
    no other. An empty table gives an empty one; a text of any length is one fingerprint. 2**slice_bits tasks merge filters, if
    not given, one for each SLICE_ROWS counted rows and 16 at least. Further columns of any name are not read.
    """
    spark = df.sparkSession
    tmp = Scratch(spark, "exact-dedup")
    src = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    keys = tmp.save(src.mapInArrow(tidy(lambda it: _normal(it, False)), "doc_id long, fp long, sha binary"), "keys")
    bits = max(4, (keys.count() // SLICE_ROWS).bit_length()) if slice_bits is None else slice_bits
    slices = keys.select("fp").mapInArrow(tidy(lambda it: _build(it, bits)), "slice int, q int, slots binary, bits binary")
    many = tmp.save(slices.groupBy("slice").applyInArrow(lambda key, t: _merge(key, t, bits), "fp long, n long"), "many")
    few = many.count() <= BROADCAST_ROWS
    texts = src.mapInArrow(tidy(lambda it: _normal(it, True)), "doc_id long, fp long, sha binary, text binary")
    marked = texts.join(F.broadcast(many.select("fp")) if few else many.select("fp").hint("merge"), "fp", "left_semi")
    groups = tmp.save(marked.groupBy("fp", "sha", "text").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("text"), "groups")
    out = keys.join(groups, ["fp", "sha"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _with_sha(batches: Iterator[pa.RecordBatch], at: int, name: str) -> Iterator[pa.RecordBatch]:
    for b in few_rows(batches):
        sha = pa.array([hashlib.sha256((t.as_py() or "").encode().lower()).digest() for t in b.column(at)], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns, sha], names=[*b.schema.names, name])


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns, whatever their names; of rows that repeat both id and text, one stays.

    Null and empty texts are equal, so one of them stays; a null id stays only where its group has no other. An empty table gives
    an empty one.
    """
    tmp = Scratch(df.sparkSession, "drop-copies")
    sha, i, k = (fresh(df, x) for x in ("dedup_sha", "dedup_id", "dedup_key"))
    g = tmp.save(exact_groups(df, id_col, text_col).where("group_size > 1"), "groups").select(F.col("doc_id").alias(i), F.unhex("text_sha256").alias(k), "kept")
    gone = tmp.save(g.where("not kept").select(i, k).distinct(), "gone")
    twice = tmp.save(g.where("kept").groupBy(i, k).agg(F.count("*").alias("c")).where("c > 1").select(i, k), "twice")
    schema = T.StructType([*df.schema.fields, T.StructField(sha, T.BinaryType())])
    rows = df.mapInArrow(tidy(lambda it, at=df.columns.index(text_col): _with_sha(it, at, sha)), schema)

    def on(keys: DataFrame):
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS // 8 else keys
        return keys, rows[id_col].cast("long").eqNullSafe(keys[i]) & (rows[sha] == keys[k])

    left = rows.join(*on(gone), "left_anti")
    if twice.isEmpty():
        return left.drop(sha)
    keys, cond = on(twice)
    return left.join(keys, cond, "left_anti").unionByName(left.join(keys, cond, "left_semi").dropDuplicates([id_col, sha])).drop(sha)
