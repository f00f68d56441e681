"""Best-fit-decreasing packing of tokenised documents into sequences.

Best-fit decreasing puts the next longest piece into the open sequence with the least room that still
holds it. Sequences with equal room are interchangeable and lengths are bounded by the capacity, so the
plan for any number of pieces follows from how many there are of each length: a segment tree over the
remaining capacities finds the tightest open sequences, and runs of them take pieces of one length at
once. The plan is a list of runs; pieces find their place in it by their rank in the order of length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlight.llm import common
from kinlight.llm.token_counts import load_tokenizer
from kinlight.plans.lineage import cut
from kinlight.plans.numbering import numbered

CAPACITY = 4096
END_ID = 1
#: Words of one generation that a worker remembers the ids of; two generations are kept.
CACHE_LIMIT = 1 << 18
#: Texts whose unknown words are encoded together.
TOGETHER = 32
#: The words that the tokenizer's pattern keeps of a lower-cased text in printable Latin-1.
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t-\r {_LETTER}{_NUMBER}]+")
UNUSUAL = re.compile("[^\t-\r -~\xa1-\xac\xae-\xff]")


class RoomTree:
    """A segment tree over remaining capacities 0 to ``capacity``: which have open sequences."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.open = [0] * (2 * self.size)

    def set(self, room: int, value: int) -> None:
        i = room + self.size
        self.open[i] = value
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, length: int) -> int:
        """The smallest room of at least ``length`` with an open sequence, or -1."""
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def pack_lengths(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The best-fit-decreasing plan for ``counts[length]`` pieces of each length: rows (first rank,
    length, first sequence, pieces a sequence, offset). Ranks go by falling length; a row holds from its
    first rank until the next row's, and its sequences take that many pieces each in turn.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    tree, plan, rank, sequences = RoomTree(capacity), [], 0, 0

    def opened(room: int, first: int, n: int) -> None:
        if room:
            rooms.setdefault(room, []).append((first, n))
            tree.set(room, 1)

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                first, n = sequences, -(-left // each)
                sequences += n
            else:
                each = room // length
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, 0)
            need = -(-left // each)
            if n > need:
                opened(room, first + need, n - need)
                n = need
            took = min(left, n * each)
            plan.append((rank, length, first, each, capacity - room))
            full, rest = divmod(took, each)
            if full:
                opened(room - each * length, first, full)
            if rest:
                opened(room - rest * length, first + full, 1)
            rank += took
            left -= took
    return np.array(plan, np.int64).reshape(-1, 5)


class WordIds:
    """Ids of words as little-endian bytes. When the memory is full, words become the old generation, from
    which those that are used again come back; the rest is forgotten at the next turn."""

    def __init__(self, path: str):
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokenizer = load_tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def learn(self, words: set[str]) -> None:
        """Make words known. Unknown ones are encoded in one text: every word ends in the one piece that
        ends words."""
        if len(self.now) > CACHE_LIMIT:
            self.old, self.now = self.now, {}
        missing = words.difference(self.now)
        new = list(missing.difference(self.old))
        self.now.update((w, self.old[w]) for w in missing.difference(new))
        ids = self._encode(" ".join(new))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(new):
            raw, at = ids.tobytes(), (cuts * 4).tolist()
            self.now.update(zip(new, [raw[a:b] for a, b in zip([0, *at], at, strict=False)], strict=True))
        else:
            self.now.update((w, self._encode(w).tobytes()) for w in new)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts. One with characters outside printable Latin-1 and white space, or with what
        may be a special string, is left to the library, whose normaliser may change it."""
        words = [None if "<|" in t or UNUSUAL.search(t) else WORDS.findall(t.lower()) for t in texts]
        self.learn(set().union(*[w for w in words if w]))
        known = self.now.__getitem__
        return [self._encode(t).tobytes() if w is None else b"".join(map(known, w)) for t, w in zip(texts, words, strict=True)]


def _piece_batches(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(path)
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids_of = chain.from_iterable(known.ids(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER))
            for doc_id, text_key, ids in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), ids_of, strict=True):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, text_key, piece, start, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, _PIECE_TYPES, strict=True)], _PIECE_NAMES)

    return run


_PIECE_NAMES = ["doc_id", "text_key", "piece", "start", "length", "ids_crc32"]
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_PIECES = "doc_id long, text_key long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of each row of ``docs(doc_id, text)``: its ids and ``end_id``, cut at ``capacity``."""
    common.small_text_batches(docs.sparkSession)
    return docs.select("doc_id", common.text_key().alias("text_key"), "text").mapInArrow(common.trimmed(_piece_batches(tokenizer_path, capacity, end_id)), _PIECES)


def _placing(plan: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("row_no").to_numpy(zero_copy_only=False)
            rows = plan[np.searchsorted(plan[:, 0], rank, side="right") - 1]
            nth = rank - rows[:, 0]
            sequence, offset = rows[:, 2] + nth // rows[:, 3], rows[:, 4] + nth % rows[:, 3] * rows[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PLACED), pa.array(sequence), pa.array(offset)], [*_PLACED, "sequence_id", "offset"])

    return run


_PLACED = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``capacity`` tokens: one row per piece with
    doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A document is its ids and ``end_id``; only longer ones are cut, at every ``capacity`` tokens. Null and
    empty texts are the end id alone. Special strings inside texts give their ids, as the library does by
    default. Pieces of equal length are placed in the order of id (null first), text and piece, so the
    result depends on the rows alone; repeated rows are packed as often as they come. An empty table gives
    an empty result; other columns are ignored.

    The driver gets one count per length (``capacity`` at most) and makes a plan from them, whatever the
    number of documents; texts are tokenised once and never shuffled.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut_up = cut(pieces(docs, tokenizer_path, capacity, end_id))
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row.length] = row.n
    plan = pack_lengths(counts, capacity)
    ranked, _ = numbered(cut_up, [F.desc("length"), "doc_id", "text_key", "piece"])
    return ranked.mapInArrow(_placing(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
