"""Language identification by unigram pieces with segmentations summed out.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a word is
the sum over all its segmentations into pieces of the products of their probabilities, which a forward
pass over the word's characters adds up for all languages at once. Words are independent, so a worker
remembers the likelihoods of words that it has seen.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlight.llm import common

#: Runs of letters, and of other numbers than digits (as in "\u00bd" or "\u00b2"), at which words end.
LETTERS = re.compile(r"[^\W\d_]+")
#: Words above this many letters are scored letter by letter in logs, and aren't remembered.
LONG = 64
#: What the vocabulary puts before a word.
MARK = "\u2581"
#: Added to each piece's count in each language, and the probability of a letter outside the vocabulary.
SMOOTHING = 0.05
UNKNOWN = 1e-7
#: Likelihoods below this are summed again in logs, as products may have run out of float64.
TINY = 1e-250
#: Words that a worker remembers, and distinct words that a task counts before it cuts them into pieces.
CACHE_LIMIT = 1 << 18
FLUSH_WORDS = 1 << 17
#: Characters of texts after which a task cuts the words it has counted, however few.
FLUSH_LETTERS = 32 << 20


def words_of(text: str) -> list[str]:
    """The lower-cased runs of letters (Unicode category L) of a text, however long."""
    found = LETTERS.findall(text.lower())
    if not text.isascii() and not "".join(found).isalpha():
        found = [part for w in found for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    return found


def load_vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _piece_batches(path: str):
    """Counts of pieces by language, and of documents as piece -1, in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path)
        words: dict[str, Counter] = defaultdict(Counter)
        totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(vocabulary.get_piece_size() + 1, np.int64))
        letters = 0

        def flush() -> None:
            for lang, counted in words.items():
                ids = vocabulary.encode(list(counted), num_threads=1)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for one in ids for i in one), np.int64, int(sizes.sum()))
                weights = np.repeat(np.fromiter(counted.values(), np.int64, len(ids)), sizes)
                np.add.at(totals[lang], flat, weights)
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                totals[lang][-1] += 1
                words[lang].update(words_of(text))
                letters += len(text)
            if letters > FLUSH_LETTERS or sum(map(len, words.values())) > FLUSH_WORDS:
                flush()
                letters = 0
        flush()
        for lang, counts in totals.items():
            piece = np.flatnonzero(counts)
            n = counts[piece]
            piece[piece == len(counts) - 1] = -1
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(piece), pa.array(n)], ["lang", "piece", "n"])

    return run


@dataclass
class PieceModel:
    """Languages in order, their log shares of documents, and piece probabilities (pieces x languages)."""

    languages: list[str]
    prior: np.ndarray
    probability: np.ndarray


def train(docs: DataFrame, vocabulary_path: str, fold: int = 1) -> PieceModel:
    """Learn from every document with a language and a text whose fold (crc32 of the id as text, modulo
    3) isn't ``fold``. Each task sums its own counts; pieces times languages come to the driver."""
    common.small_text_batches(docs.sparkSession)
    known = docs.filter("lang is not null and text is not null").filter(~is_held_out(fold)).select("lang", "text")
    counted = known.mapInArrow(common.trimmed(_piece_batches(vocabulary_path)), "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    lang, piece, n = counted.column("lang").to_pylist(), counted.column("piece").to_numpy(), counted.column("n").to_numpy()
    languages = sorted(set(lang))
    of = {x: i for i, x in enumerate(languages)}
    table = np.zeros((load_vocabulary(vocabulary_path).get_piece_size() + 1, len(languages)))
    table[piece, [of[x] for x in lang]] = n
    prior = np.log((table[-1] + 1) / (table[-1].sum() + len(languages)))
    table = table[:-1] + SMOOTHING
    return PieceModel(languages, prior, table / table.sum(axis=0) if languages else table)


def is_held_out(fold: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == fold, F.lit(False))


class WordScores:
    """Log-likelihoods of words under each language, by the forward algorithm."""

    def __init__(self, vocabulary_path: str, model: PieceModel):
        vocabulary = load_vocabulary(vocabulary_path)
        n = vocabulary.get_piece_size()
        self.pieces = {}
        for i in range(n):
            piece = vocabulary.id_to_piece(i)
            if not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i)) and MARK not in piece[1:]:
                self.pieces[piece] = i
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.pieces.items():
            self.matcher.add_word(piece, i << 8 | len(piece))
        self.matcher.make_automaton()
        self.longest = max(map(len, self.pieces), default=1)
        self.table = np.vstack([model.probability, np.full(len(model.languages), UNKNOWN)])
        self.logs = np.log(self.table)
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def _forward(self, words: list[str]) -> np.ndarray:
        """The sum over all segmentations of each word. The matcher finds every piece at every place of all
        words in one text; pieces are then added up by the place in the word where they end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        stops = np.cumsum(sizes)
        begins = stops - sizes
        text = MARK + MARK.join(words)
        found = np.fromiter(chain.from_iterable(self.matcher.iter(text)), np.int64).reshape(-1, 2)
        end, piece, length = found[:, 0] + 1, found[:, 1] >> 8, found[:, 1] & 255
        alone = np.ones(len(text) + 1, bool)
        alone[0], alone[end[length == 1]] = False, False
        other = np.flatnonzero(alone)  # letters that are no piece
        end, length = np.concatenate((end, other)), np.concatenate((length, np.ones_like(other)))
        piece = np.concatenate((piece, np.full_like(other, len(self.table) - 1)))
        place = end - np.repeat(begins, sizes)[end - 1]
        order = np.lexsort((end, place))
        end, start, piece = end[order], (end - length)[order], piece[order]
        reached = np.zeros((len(text) + 1, self.table.shape[1]))
        fresh = np.zeros(len(text) + 1, bool)
        fresh[begins] = True
        bounds = np.append(0, np.cumsum(np.bincount(place, minlength=1)))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a < b:
                # a word's first place is the last place of the word before, whose sum is another
                before = np.where(fresh[start[a:b], None], 1.0, reached[start[a:b]])
                new = np.flatnonzero(np.concatenate(([True], end[a + 1 : b] != end[a : b - 1])))
                reached[end[a:b][new]] = np.add.reduceat(before * self.table[piece[a:b]], new, axis=0)
        likelihood = reached[stops]
        low = np.flatnonzero((likelihood < TINY).any(axis=1))
        found = np.log(np.where(likelihood < TINY, 1.0, likelihood))
        for i in low:
            found[i] = self._forward_logs(words[i])
        return found

    def _forward_logs(self, word: str) -> np.ndarray:
        """The same sum in logs, which no number of small factors brings to zero, for one word of any length.
        Only the sums of as many places back as the longest piece has letters are held."""
        text, unknown = MARK + word, len(self.table) - 1
        matches = self.matcher.iter(text)
        found = next(matches, None)
        span = self.longest + 1
        reached = np.zeros((span, self.table.shape[1]))
        for end in range(1, len(text) + 1):
            starts, pieces, alone = [], [], True
            while found is not None and found[0] + 1 == end:
                length = found[1] & 255
                alone = alone and length > 1
                starts.append((end - length) % span)
                pieces.append(found[1] >> 8)
                found = next(matches, None)
            if alone:
                starts.append((end - 1) % span)
                pieces.append(unknown)
            reached[end % span] = np.logaddexp.reduce(reached[starts] + self.logs[pieces], axis=0)
        return reached[len(text) % span]

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.rows)
        if len(self.rows) + len(new) > CACHE_LIMIT:
            self.rows, self.scores = {}, self.scores[:0]
            new = words
        usual, long = sorted(w for w in new if len(w) <= LONG), sorted(w for w in new if len(w) > LONG)
        parts = [self._forward(usual[i : i + 8192]) for i in range(0, len(usual), 8192)]
        parts += [self._forward_logs(w)[None, :] for w in long]
        first = len(self.rows)
        self.rows.update(zip(usual + long, range(first, first + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, *parts])
        self.passing = long

    def forget_long(self) -> None:
        """Forget the long words of the last texts, which are the last to be learnt."""
        for word in self.passing:
            del self.rows[word]
        self.scores = self.scores[: len(self.rows)]

    def of_texts(self, texts: list[list[str]]) -> np.ndarray:
        """Summed log-likelihoods (texts x languages)."""
        self.learn(set().union(*texts))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        out = np.zeros((len(texts), self.scores.shape[1]))
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(self.scores[rows], (np.cumsum(sizes) - sizes)[some], axis=0)
        self.forget_long()
        return out


def _scorer(vocabulary_path: str, model: PieceModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(vocabulary_path, model)
        for batch in batches:
            column = batch.column("text").to_pylist()
            names, sure = [], []
            for i in range(0, len(column), 256):
                texts = [words_of(t or "") for t in column[i : i + 256]]
                total = scores.of_texts(texts) + model.prior
                total -= total.max(axis=1, keepdims=True) if model.languages else 0
                share = np.exp(total)
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1) if model.languages else np.zeros(len(texts), np.int64)
                for d, words in enumerate(texts):
                    known = bool(words) and bool(model.languages)
                    names.append(model.languages[best[d]] if known else "und")
                    sure.append(float(share[d, best[d]]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, vocabulary_path: str, model: PieceModel, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score, the posterior of the predicted language, for each row of
    ``docs``. The prediction depends on the text alone.

    Letters are those of Unicode category L. Text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was
    learnt. Ties go to the language that sorts first. Null ids are not held out. Repeated rows come out as
    often as they came in; an empty table gives an empty result. A task holds one Arrow batch, a cache of
    ``CACHE_LIMIT`` words of at most ``LONG`` letters and the model (pieces x languages). Every segmentation of a
    word counts, however long it is; the time is in proportion to its length.
    """
    common.small_text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(common.trimmed(_scorer(vocabulary_path, model)), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", is_held_out(fold).alias("held_out"), "lang_pred", "score")
