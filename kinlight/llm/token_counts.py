"""Token counts by a two-tier lookup on the map side.

Texts are cut into pieces at which the tokenizer never merges. The counts of frequent pieces are in one
table that is broadcast; a piece that isn't there is encoded once per worker and remembered. No piece of
a text is shuffled: which ones are frequent is guessed from a bounded sample of texts, and whatever the table
lacks is only slower, never wrong.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinlight.llm import common

#: Entries of the broadcast table.
FREQUENT = 1 << 15
#: The sample that the table is made from: texts, and distinct pieces of a text, of at most so many characters.
SAMPLE_TEXTS, SAMPLE_PIECES, SAMPLE_LENGTH = 2048, 256, 32
#: Pieces that a worker remembers, of at most so many characters.
CACHE_LIMIT, CACHE_LENGTH = 1 << 18, 256
OVER_LIMIT = 512

#: White space as the Unicode property has it, which the tokenizer's pattern uses.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the space before it; white space that no word takes. No merge crosses their borders.
PIECES = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")


def load_tokenizer(path: str):
    """The tokenizer of a file, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def special_strings(tokenizer) -> list[str]:
    """Strings that the tokenizer takes out of a text before it cuts words."""
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def _text_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The commonest pieces of each text with their counts."""
    for batch in batches:
        for text in batch.column(0).to_pylist():
            top = Counter(p for p in PIECES.findall(text or "") if len(p) <= SAMPLE_LENGTH).most_common(SAMPLE_PIECES)
            yield pa.RecordBatch.from_arrays([pa.array([[k for k, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["pieces", "counts"])


def frequent_pieces(docs: DataFrame, most: int = FREQUENT, sample: int = SAMPLE_TEXTS) -> list[str]:
    """At most ``most`` frequent pieces of ``sample`` texts. They only make counting faster, so it doesn't matter
    which texts: the first partitions are read until there are enough, and nothing is shuffled."""
    counts: Counter[str] = Counter()
    for row in docs.select("text").mapInArrow(common.trimmed(_text_pieces), "pieces array<string>, counts array<long>").take(sample):
        counts.update(dict(zip(row.pieces, row.counts, strict=True)))
    return [p for p, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


class Lengths(dict):
    """Piece to token count: the frequent table, with what this worker has encoded since."""

    def __init__(self, tokenizer, frequent: list[str], counts: bytes):
        super().__init__(zip(frequent, counts, strict=True))
        self.tokenizer, self.table = tokenizer, (frequent, counts)

    def learn(self, pieces: set[str]) -> None:
        if len(self) + len(pieces) > CACHE_LIMIT + len(self.table[0]):
            self.clear()
            self.update(zip(*self.table, strict=True))
        new = [p for p in pieces if p not in self]
        self.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))

    def total(self, pieces: list[str]) -> int:
        """The tokens of a text's pieces; long ones that are new are counted and not remembered."""
        try:
            return sum(map(self.__getitem__, pieces))
        except KeyError:
            long = [p for p in pieces if len(p) > CACHE_LENGTH]
            self.learn({p for p in pieces if len(p) <= CACHE_LENGTH})
            tokens = sum(map(len, self.tokenizer.encode_batch_fast(long, add_special_tokens=False)))
            return tokens + sum(self[p] for p in pieces if len(p) <= CACHE_LENGTH)


def _counter(path: str, frequent: list[str], lengths: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        special = special_strings(tokenizer)
        known = Lengths(tokenizer, frequent, lengths)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if not text:
                    out.append(0)
                elif any(s in text for s in special):
                    out.append(len(tokenizer.encode(text, add_special_tokens=False)))
                else:
                    out.append(known.total(PIECES.findall(text)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = OVER_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) for each row of ``docs``.

    Counts are those of the tokenizer's library for the whole text without added special tokens; a text
    that holds a special string is given to the library whole. Null and empty texts have no bytes and no
    tokens. Repeated rows come out as often as they came in; null ids stay null; other columns are
    ignored. An empty table gives an empty result. Memory: the broadcast table (``FREQUENT`` pieces, made from
    ``SAMPLE_TEXTS`` texts at most), a cache of ``CACHE_LIMIT`` pieces a worker, and one Arrow batch.
    """
    common.small_text_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast(StringType()).alias("text"))
    frequent = frequent_pieces(docs)
    known = load_tokenizer(tokenizer_path).encode_batch_fast(frequent, add_special_tokens=False)
    usable = [(p, len(e)) for p, e in zip(frequent, known, strict=True) if len(e) < 256]
    count = _counter(tokenizer_path, [p for p, _ in usable], bytes(n for _, n in usable))
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(common.trimmed(count), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
