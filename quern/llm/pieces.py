"""SentencePiece encoding and decoding, from a public model file whose path is a parameter.

An Aho-Corasick automaton over the pieces reads a text once; at each position its output links give every piece that ends
there, and each relaxes the best path to that position. For a unigram model the path with the largest sum of scores wins.
In a BPE model the scores are merge ranks and don't add up to the right segmentation; there a piece may follow another
only if merging the two pieces' text alone gives these two back. Exactly one path of such pieces reaches each position, and
it is what merging would have given. Characters without a piece become their bytes.

The automaton works on pieces with U+2581 put back to a space, so a U+2581 in a text is an ordinary character and decoding
gives back every text. Where no piece has a space after another character, a text falls into independent chunks at spaces, and
where none has anything else after a letter, also at the ends of words: no piece can cross such a cut. A bounded table of
chunks keeps what was encoded before.
"""

import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import nextafter

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

MARK = "▁"
CHUNKS = 110_000  #: encodings in each of the two tables of a Python worker
PAIRS = 524_287  #: places for answers to whether a piece may follow another: 4 MB
ROWS = 256  #: rows encoded at once


class _Chunks(dict):
    """Encodings of chunks. A full table becomes the older one, whose chunks come back when they are met."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, c: str) -> bytes:
        got = self.older.get(c)
        if got is None:
            got = self.encode(c)
        if len(c) <= 64:
            if len(self) >= CHUNKS:
                self.older = dict(self)
                self.clear()
            self[c] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Pieces:
    def __init__(self, model: bytes, kind: str = "bpe"):
        s = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.kind, size = kind, s.get_piece_size()
        self.table: list[bytes] = []
        self.byte = [0] * 256
        self.ids: dict[str, int] = {}
        self.scores = [s.get_score(i) for i in range(size)]
        for i in range(size):
            p = s.id_to_piece(i)
            if s.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.table.append(bytes([int(p[3:5], 16)]))
            elif s.is_control(i) or s.is_unknown(i) or s.is_unused(i):
                self.table.append(b"")
            else:
                self.ids[p.replace(MARK, " ")] = i
                self.table.append(p.replace(MARK, " ").encode())
        self.alphabet, self.longest = {c for p in self.ids for c in p}, max(map(len, self.ids), default=1)
        self.foreign = re.compile("[^" + "".join(map(re.escape, sorted(self.alphabet))) + "]")
        self.chunk = re.compile(self._cuts())
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if kind != "bpe" or self.merge(p) == [i]:
                self.automaton.add_word(p, (len(p), i, self.scores[i]))
        self.automaton.make_automaton()
        self.pairs = array("q", bytes(8 * PAIRS))  # by the pair modulo PAIRS: twice the pair, and whether the second may follow
        self.texts = [t.decode("utf-8", "replace") for t in self.table]
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.cache = _Chunks(self._chunk)

    def _cuts(self) -> str:
        """The pattern of chunks between which no piece reaches."""
        if any(" " in p.lstrip(" ") for p in self.ids):
            return r"(?s).+"
        line = "" if "\n" in self.alphabet else r"\n"
        words = "".join(map(re.escape, sorted(c for c in self.alphabet if c.isalpha())))
        if not words or any(re.search(f"[{words}][^{words}]", p) for p in self.ids):
            return rf" *[^ {line}]+| +" + f"|{line}" * bool(line)
        return f"{line}|" * bool(line) + rf" *[^{words} {line}]*[{words}]*"  # spaces, other characters, then letters

    def merge(self, text: str) -> list[int]:
        """Joins the neighbours of the best score, leftmost first, until none join: the definition of BPE.

        Pairs wait in a heap and parts are a linked list, so long runs cost n log n. It settles which pieces may follow one another,
        and texts of spaces alone, whose pieces share one score.
        """
        n, ids, scores = len(text), self.ids, self.scores
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))  # of the part that begins at each place
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and end[b] - a <= self.longest and (i := ids.get(text[a : end[b]])) is not None:
                heapq.heappush(heap, (-scores[i], a, end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, e = heapq.heappop(heap)
            b = after[a] if end[a] else n
            if b >= n or end[b] != e:
                continue  # one of the two has changed since
            end[a], end[b], after[a] = e, 0, after[b]
            if after[a] < n:
                before[after[a]] = a
                offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < n:
            out.append(ids.get(text[a : end[a]], -1))
            a = after[a]
        return out

    def _halves(self, i: int) -> tuple[int, int] | None:
        """The two pieces that the last merge of a piece's text joins; None for one character."""
        got = self.halves.get(i, 0)
        if got == 0:
            text, got = self.texts[i], None
            for k in range(1, len(text)):  # of all cuts into two pieces that merging leaves apart until the end, there is one
                a, b = self.ids.get(text[:k]), self.ids.get(text[k:])
                if a is not None and b is not None and self._apart(a, b, self._rank(i)):
                    got = (a, b)
                    break
            self.halves[i] = got
        return got

    def _rank(self, i: int) -> float:
        """Smaller is merged earlier; single characters are there from the start."""
        return -self.scores[i] if len(self.texts[i]) > 1 else float("-inf")

    def _apart(self, a: int, b: int, limit: float) -> bool:
        """Whether no piece across the border of a and b is merged before `limit`: both are taken apart again, the later merge first,
        and at each step the pieces that touch must not have been joined before the later of them was made."""
        ids, texts = self.ids, self.texts
        while True:
            c = ids.get(texts[a] + texts[b])
            if c is not None and self._rank(c) < limit:
                return False
            x, y = self._rank(a), self._rank(b)
            if x == y == float("-inf"):
                return True
            if x > y:
                limit, a = x, self._halves(a)[1]
            else:  # a border left of b with the score of b is merged first, being further left
                limit, b = nextafter(y, float("inf")), self._halves(b)[0]

    def _follows(self, a: int, b: int) -> bool:
        """Whether merging the texts of two pieces gives these two back. Pieces of several spaces share one score: merged outright."""
        if "  " in self.texts[a] + self.texts[b]:
            return self.merge(self.texts[a] + self.texts[b]) == [a, b]
        return self._apart(a, b, float("inf"))

    def _path(self, text: str) -> list[int]:
        """Ids of a text whose every character is in the alphabet."""
        if self.kind != "bpe":
            return self._best(text)
        return self._only(text) if text.strip(" ") else self.merge(text)

    def _only(self, text: str) -> list[int]:
        """The one path of pieces of which each may follow the one before."""
        n, size, pairs = len(text), len(self.table), self.pairs
        last, back = [-1] * (n + 1), [0] * (n + 1)
        last[0] = 0
        for end, (length, i, _) in self.automaton.iter(text):
            to = end + 1
            if last[to] >= 0:
                continue
            at = to - length
            a = last[at]
            if a < 0:
                continue
            if at:
                key = a * size + i
                got = pairs[key % PAIRS]
                if got >> 1 != key:
                    got = pairs[key % PAIRS] = 2 * key + self._follows(a, i)
                if not got & 1:
                    continue
            last[to], back[to] = i, at
        if last[n] < 0:
            return self.merge(text)
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        out.reverse()
        return out

    def _best(self, text: str) -> list[int]:
        """The path with the best sum of scores; of equal ones, that of the longer last piece."""
        n = len(text)
        score: list[float | None] = [0.0] + [None] * n
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, (length, i, s) in self.automaton.iter(text):
            at, to = end + 1 - length, end + 1
            if score[at] is None:
                continue
            s += score[at]
            if score[to] is None or s > score[to]:
                score[to], last[to], back[to] = s, i, at
        if score[n] is None:
            return self.merge(text)
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def _chunk(self, text: str) -> bytes:
        if not self.foreign.search(text):
            return array("i", self._path(text)).tobytes()
        ids: list[int] = []
        at = 0
        for m in self.foreign.finditer(text):
            if at < m.start():
                ids += self._path(text[at : m.start()])
            ids += [self.byte[b] for b in m[0].encode()]
            at = m.end()
        if at < len(text):
            ids += self._path(text[at:])
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, as 4-byte integers one after another."""
        return b"".join(map(self.cache.__getitem__, self.chunk.findall(" " + text))) if text else b""

    def decode(self, ids) -> str:
        raw = b"".join(map(self.table.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(model: bytes, kind: str) -> Pieces:
    return Pieces(model, kind)


def read_model(path: str) -> bytes:
    """The model file, read on the driver; it travels with the tasks (half a MB for 32,000 pieces)."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model: bytes, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids array<int>[, round_trip]), one row for each input row, without a shuffle.

    round_trip says whether decoding the ids gives the text back. Null and empty texts have no ids; repeated rows and null
    ids of documents are encoded alike, and an empty table gives an empty one. Rows are taken a few at a time, so memory follows
    the longest texts, and time a text's length (n log n in a run of spaces). Further columns of any name are not read.
    """
    item = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model, kind)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                raw = [p.encode(t) for t in texts]
                ends = np.cumsum([0] + [len(r) // 4 for r in raw]).astype(np.int32)
                values = np.frombuffer(b"".join(raw), np.int32)
                cols = [part.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)).cast(item)]
                if check:
                    cols.append(pa.array([p.decode(values[i:j].tolist()) == t for i, j, t in zip(ends, ends[1:], texts)]))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_pieces", "ids", "round_trip"][: len(cols)])
        p.cache.forget()  # the worker lives on for other stages

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_pieces long, ids array<int>" + ", round_trip boolean" * check)


def decode(df: DataFrame, model: bytes, kind: str = "bpe", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text, null elements nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model, kind)
        for b in batches:
            texts = [p.decode([i for i in ids or () if i is not None]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(df[id_col].cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
