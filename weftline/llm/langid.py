"""Language ID by unigram pieces whose segmentations are summed out.

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece,
learned by expectation maximisation over word counts: the E step is a forward-backward pass over
all segmentations of a word, the M step sums expected counts. A text's score under a language is
the sum of the log forward probabilities of its words, that is, of its runs of letters in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import bytetext as B
from weftline.llm import pieces as P
from weftline.llm.memo import Memo
from weftline.llm.session import cut, mapped

FLOOR = 1e-7  # probability of a character that no piece covers
LONG = 24  # letters of words whose forward sums may leave a float's range: their logs are summed instead
SPAN = 4096  # places of a long word whose pieces are looked up at a time
ROWS = 4096
BLOCK = 64  # languages that are learned and scored at once
TOP = "_lang_top"  # column with the best log probability so far
CHAINED = 4  # blocks that are scored between two checkpoints, each in a worker of its own


@dataclass(frozen=True)
class LanguageModel:
    path: str
    languages: tuple[str, ...]
    probability: tuple[np.ndarray, ...]  # piece x language, by blocks of languages in their order
    prior: np.ndarray


def _forward(grams: list[np.ndarray], length: int, table: np.ndarray, owner: np.ndarray | None = None) -> list[np.ndarray]:
    """Forward sums at each place; ``table`` has a row for each piece, then one of 0, and ``owner`` picks one column per row."""
    width = table.shape[1] if owner is None else 1
    total = [np.ones((len(grams[0]), width))]
    for end in range(1, length + 1):
        here = np.zeros((len(grams[0]), width))
        for k in range(1, min(end, len(grams)) + 1):
            here += total[end - k] * _weight(grams, k, end - k, table, owner)
        total.append(here)
    return total


def _weight(grams: list[np.ndarray], k: int, start: int, table: np.ndarray, owner: np.ndarray | None) -> np.ndarray:
    at = grams[k - 1][:, start]
    p = table[at] if owner is None else table[at, owner][:, None]
    return np.where((at < 0)[:, None], FLOOR, p) if k == 1 else p


def _log_sum(terms: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over the first axis."""
    most = terms.max(axis=0)
    most = np.where(np.isneginf(most), 0, most)
    with np.errstate(divide="ignore"):
        return most + np.log(np.exp(terms - most).sum(axis=0))


def _log_places(pieces: P.Pieces, rows: np.ndarray, table: np.ndarray, owner: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """``_forward`` in logs, place by place. Only the last ``longest`` places are held, and pieces are looked up for SPAN places at a time."""
    n, length = rows.shape
    longest = min(pieces.longest, length)
    window = np.full((longest, n, table.shape[1] if owner is None else 1), -np.inf)  # the latest place first
    window[0] = 0
    yield window[0].copy()
    with np.errstate(divide="ignore"):
        for low in range(0, length, SPAN):
            first = max(0, low - longest + 1)
            grams = P.substrings(pieces, rows[:, first : low + SPAN])
            for end in range(low + 1, min(low + SPAN, length) + 1):
                terms = np.stack([window[k - 1] + np.log(_weight(grams, k, end - k - first, table, owner)) for k in range(1, min(end, longest) + 1)])
                window[1:] = window[:-1].copy()
                window[0] = _log_sum(terms)
                yield window[0].copy()


def _long_expected(pieces: P.Pieces, rows: np.ndarray, table: np.ndarray, owner: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
    """Adds the expected piece counts of long words of equal length to ``counts``."""
    n, length = rows.shape
    ahead = np.stack([x[:, 0] for x in _log_places(pieces, rows, table, owner)])
    back = np.full((length + 1, n), -np.inf)
    back[length] = 0
    with np.errstate(divide="ignore"):
        for high in range(length, 0, -SPAN):
            low = max(0, high - SPAN)
            grams = P.substrings(pieces, rows[:, low : high + pieces.longest - 1])
            for place in range(high - 1, low - 1, -1):
                steps = range(1, min(length - place, len(grams)) + 1)
                terms = np.stack([np.log(_weight(grams, k, place - low, table, owner)[:, 0]) + back[place + k] for k in steps])
                back[place] = _log_sum(terms)
                share = np.exp(terms + ahead[place] - ahead[length]) * times
                for k, s in zip(steps, share, strict=True):
                    np.add.at(counts, (grams[k - 1][:, place - low], owner), s)


def _padded(probability: np.ndarray) -> np.ndarray:
    return np.concatenate([probability, np.zeros((1, probability.shape[1]))])  # -1 picks the last row


def _word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of letters, and the number of them before each text."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = P.letters()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:] = inside[1:] != inside[:-1]
    edge[at] = True
    marks = np.flatnonzero(edge)
    keep = inside[marks[:-1]] if len(marks) else np.zeros(0, bool)
    start, end = marks[:-1][keep], marks[1:][keep]
    return start, end, np.searchsorted(start, at)


def _by_length(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(numbers of words, matrix of their code points) for words of equal length, ROWS at a time."""
    length = end - start
    order = np.argsort(length, kind="stable")
    for low, high in zip(*(lambda c: (np.flatnonzero(np.r_[True, c]), np.flatnonzero(np.r_[c, True]) + 1))(np.diff(length[order]) != 0), strict=True) if len(order) else ():
        most = max(1, min(ROWS, ROWS * LONG // max(1, int(length[order[low]]))))
        for a in range(low, high, most):
            some = order[a : min(a + most, high)]
            yield some, P.matrix(data, start[some], int(length[some[0]]), P.SPACE)


def _expected(path: str, probability: np.ndarray):
    """E step over (language number, word, n): expected counts of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = P.load(path), _padded(probability)
        counts = np.zeros((table.shape[0], table.shape[1]))
        for batch in batches:
            data, at = P.column_codes(batch.column("word"))
            start, end, first = _word_spans(data, at)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            owner, times = batch.column("number").to_numpy()[row], batch.column("n").to_numpy()[row]
            for some, rows in _by_length(data, start, end):
                mine = owner[some]
                if rows.shape[1] > LONG:
                    _long_expected(pieces, rows, table, mine, times[some], counts)
                    continue
                grams, length = P.substrings(pieces, rows), rows.shape[1]
                ahead = _forward(grams, length, table, mine)
                back = [np.ones((len(some), 1))]  # of place length, length - 1, ...
                share = times[some] / np.maximum(ahead[length][:, 0], 1e-300)
                for place in range(length - 1, -1, -1):
                    here = np.zeros((len(some), 1))
                    for k in range(1, min(length - place, len(grams)) + 1):
                        w = _weight(grams, k, place, table, mine) * back[length - place - k]
                        here += w
                        np.add.at(counts, (grams[k - 1][:, place], mine), (ahead[place] * w)[:, 0] * share)
                    back.append(here)
        piece, language = np.nonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(piece, pa.int32()), pa.array(counts[piece, language])], ["number", "piece", "n"])

    return run


def fit(labelled: DataFrame, rows_per_language: int = 1000, block: int = BLOCK, rounds: int = 3, path: str | None = None) -> LanguageModel:
    """A model from ``labelled``'s columns doc_id, text, lang.

    Reads whole texts of a sample of about ``rows_per_language`` rows of every language, chosen by a hash of doc_id (and
    at most twice as many in all), ``block`` languages at a time. Null lang, null text and texts without letters teach
    nothing. Without labelled rows the model has no languages.
    """
    path = path or P.default_path()
    known = labelled.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    counts = sorted(known.groupBy("lang").count().collect())
    total = sum(r["count"] for r in counts)
    blocks = [counts[i : i + block] for i in range(0, len(counts), block)]
    learned = tuple(_learned(known, b, rows_per_language, rounds, path) for b in blocks)
    P.forget()
    return LanguageModel(path, tuple(r["lang"] for r in counts), learned, np.array([r["count"] / total for r in counts]))


def _learned(known: DataFrame, counts: list, rows_per_language: int, rounds: int, path: str) -> np.ndarray:
    """Piece x language probabilities of the languages of ``counts``."""
    spark = known.sparkSession
    rates = spark.createDataFrame([(i, r["lang"], min(1.0, rows_per_language / r["count"])) for i, r in enumerate(counts)], "number int, lang string, rate double")
    chosen = (
        known.join(F.broadcast(rates), "lang")  # at most a block of rows
        .filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.ceil(F.col("rate") * (1 << 20)))
        .select("number", "text")
        .limit(2 * rows_per_language * len(counts))
    )
    words = cut(chosen.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("number", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).groupBy("number", "word").agg(F.count("*").alias("n")))
    size = len(P.load(path).ids)
    probability = np.full((size, len(counts)), 1 / size)
    for _ in range(rounds):
        got = mapped(words, _expected(path, probability), "number int, piece int, n double").groupBy("number", "piece").agg(F.sum("n").alias("n")).toArrow()
        expected = np.full((size, len(counts)), 0.05)
        expected[got["piece"].to_numpy(), got["number"].to_numpy()] += got["n"].to_numpy()
        probability = expected / expected.sum(axis=0)
    return probability


def _score(path: str, languages: tuple[str, ...], probability: np.ndarray, prior: np.ndarray, later: bool):
    """Scores a block of languages; ``later``: the rows have the best of the blocks before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table, width = P.load(path), _padded(probability), len(languages)
        names = np.array([*languages, "und"], object)
        most = max(1 << 12, (1 << 20) // width)
        memo, held = Memo(most), np.zeros((0, width), np.float32)
        for batch in B.slices(batches, "text"):
            data, at = P.column_codes(pc.utf8_lower(batch.column("text")))
            start, end, first = _word_spans(data, at)
            value = np.zeros((batch.num_rows, width))
            if len(start):
                hashes, back = np.unique(B.spans(P.code_sums(data), start, end), return_inverse=True)
                rows = memo.find(hashes)
                fresh = rows < 0
                if not memo.room(int(fresh.sum())):
                    memo, held = Memo(max(most, len(hashes))), np.zeros((0, width), np.float32)
                    rows, fresh = np.full(len(hashes), -1, np.int32), np.ones(len(hashes), bool)
                if fresh.any():
                    where = np.zeros(len(hashes), np.int64)
                    where[back] = np.arange(len(start))
                    new = where[fresh]
                    got = np.empty((len(new), width), np.float32)
                    for some, matrix in _by_length(data, start[new], end[new]):
                        if matrix.shape[1] > LONG:
                            for last in _log_places(pieces, matrix, table):  # noqa: B007
                                pass
                            got[some] = last
                        else:
                            got[some] = np.log(_forward(P.substrings(pieces, matrix), matrix.shape[1], table)[-1])
                    rows[fresh] = memo.add(hashes[fresh])
                    held = np.concatenate([held, got])
                full = np.flatnonzero(np.diff(first))
                value[full] = np.add.reduceat(held[rows[back]], first[full], axis=0, dtype=np.float64) + np.log(prior)
            known = np.diff(first) > 0
            best, top = value.argmax(axis=1), value.max(axis=1)
            score, name = 1 / np.exp(value - top[:, None]).sum(axis=1), names[np.where(known, best, width)]
            if later:
                before, held_score = batch.column(TOP).to_numpy(), np.where(known, batch.column("score").to_numpy(), 1.0)
                name = np.where(top > before, name, np.array(batch.column("lang_pred").to_pylist(), object))
                both = np.maximum(top, before)
                score, top = 1 / (np.exp(before - both) / held_score + np.exp(top - both) / score), both
            kept = [c for c in batch.schema.names if c not in (TOP, "lang_pred", "score")] if later else batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array(name, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(top)],
                [*kept, "lang_pred", "score", TOP],
            )

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score (the posterior of lang_pred, 0 to 1).

    Words are whole runs of letters, however long; a word is summed over all its segmentations. Repeated rows have
    equal results, an empty table gives no rows. A text that is null or has no letter is ``und`` with score 0, as is every text under a model without languages.
    Ties go to the language that sorts first. Columns of ``docs`` with the two names are replaced; others stay.
    """
    docs = docs.drop("lang_pred", "score")
    if not model.languages:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    own = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() == TOP}
    docs = docs.withColumnsRenamed(own)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField(TOP, T.DoubleType())])
    first = 0
    for i, probability in enumerate(model.probability):
        some = slice(first, first + probability.shape[1])
        first = some.stop
        if i and i % CHAINED == 0:
            docs = cut(docs)
        docs = mapped(docs, _score(model.path, model.languages[some], probability, model.prior[some], i > 0), schema)
    return docs.drop(TOP).withColumnsRenamed({new: c for c, new in own.items()})


def held_out() -> Column:
    """Whether a row of the query is held out: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
