"""Phrase collocation mining: candidates from sketch upper bounds, exact counts by guarded automata.

A phrase is as frequent as a threshold only if all its words, pairs and triples are. A first sketch bounds the counts of words and
pairs of neighbours, a second one those of triples whose pairs reach the threshold. Texts then fall into runs: the longest stretches whose
triples reach it, and the pairs that do so outside of them. Equal runs become one row with their number, so what the corpus repeats is scanned
once. A third sketch over the runs bounds phrases of all lengths; those that reach the threshold are the candidates. They are dealt to blocks by their first two words, each block
is compiled into automata, and shards of the runs are scanned for overlapping matches: a phrase matches between blanks only.
The sums are exact counts, and thresholds apply to them. Sketches never decide more than what is worth counting; where
they are too narrow for a corpus, there is more to count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import bytetext as B
from weftline.llm.session import cut, dropped, mapped, stored

LONGEST = 5  # words
SLICE = 1 << 20  # bytes of text that are counted at once
BLOCK_BITS = 16  # buckets of a sketch that one row holds
MOST_BITS = 27  # buckets of a sketch: that many bytes in a worker for thresholds up to 255, two or four times as many beyond
AUTOMATON = 50_000  # candidates that a block holds on average
SHARD_BYTES = 1 << 23  # of runs that a task scans with one block
MOST_LANGUAGES = 10_000  # totals of more languages aren't broadcast
SALTS = 64  # parts of a language that are ranked before the language is

_STOPS = np.zeros(256, bool)
_STOPS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ORDER = B.seeded(LONGEST + 1, 13)  # a factor for each place of a phrase; odd, so that no bit is lost
_ORDER |= np.uint64(1)


class Words:
    """The words of many texts: lower-cased bytes, spans, hashes that know their language, and whether a word's next one is in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = B.raw(texts)
        self.data = _LOWER[data]
        n = len(self.data)
        outside = _STOPS[data] | _BLANKS[data]
        edge = np.zeros(n + 1, bool)
        edge[1:n] = outside[1:] != outside[:-1]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        inside = ~outside[at[:-1]] if n else np.zeros(0, bool)
        self.start, self.end = at[:-1][inside], at[1:][inside]
        first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(first))
        piece = np.cumsum(_STOPS[data])[self.start] if n else self.start
        self.joined = np.zeros(len(self.start), bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])
        self.langs = langs.dictionary_encode()
        names, bounds = B.raw(self.langs.dictionary)
        of_lang = B.spans(B.byte_sums(names, 2), bounds[:-1], bounds[1:])
        hashes = B.spans(B.byte_sums(self.data), self.start, self.end)
        self.hashes = hashes ^ of_lang[self.langs.indices.to_numpy()[self.text]] if len(self.start) else hashes

    def grams(self, length: int, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all phrases of ``length`` words whose neighbours are ``linked`` (a word to its next)."""
        first = np.flatnonzero(linked[: len(linked) - 1]) if length > 1 else np.arange(len(self.start))
        for k in range(1, length - 1):
            first = first[linked[first + k]]
        total = np.full(len(first), length, np.uint64)
        for k in range(length):
            total += B.mix(self.hashes[first + k]) * _ORDER[k]
        return first, B.mix(total)

    def strings(self, first: np.ndarray, count: np.ndarray) -> pa.Array:
        """``count`` words from each of ``first``, each word with a blank behind it."""
        word = B.runs(first, count)
        size = self.end[word] - self.start[word] + 1
        at = np.cumsum(size)
        out = np.append(self.data, np.uint8(32))[B.runs(self.start[word], size)]
        out[at - 1] = 32
        ends = np.r_[0, at][np.cumsum(count)] if len(count) else np.zeros(0, np.int64)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(out))

    def lang(self, first: np.ndarray) -> pa.Array:
        return self.langs.take(pa.array(self.text[first])).dictionary_decode()


def _summed(lang: pa.Array, kind: int, gram: pa.Array, n: pa.Array) -> pa.RecordBatch:
    """A row for each distinct (lang, gram) with the sum of n."""
    found = pa.table([lang, gram, n], ["lang", "gram", "n"]).group_by(["lang", "gram"], use_threads=False).aggregate([("n", "sum")])
    lang, gram, n = (found.column(c).combine_chunks() for c in ("lang", "gram", "n_sum"))
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(np.full(len(n), kind, np.int32)), gram.cast(pa.string()), n.cast(pa.int64())], ["lang", "kind", "gram", "n"])


def _kind(least: int) -> type:
    return np.uint8 if least < 1 << 8 else np.uint16 if least < 1 << 16 else np.uint32


def _linked(words: Words, sketch: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """Which words reach the threshold, and which of them do so with their next one."""
    known = sketch.reach(words.grams(1, words.joined)[1])
    linked = words.joined.copy()
    linked[:-1] &= known[:-1] & known[1:]
    pair, hashes = words.grams(2, linked)
    linked[pair] = sketch.reach(hashes)
    return known, linked


def _counted(bits: int, least: int, lengths: range, weighted: bool, below: Sketch | None):
    """Rows of a task's sketch: a block of buckets, the places that aren't zero and their counts, which stop at the type's greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, _kind(least))
        most = min(int(np.iinfo(table.dtype).max), 1 << 31)
        for batch in B.slices(batches, "text", SLICE):
            words = Words(batch.column("text"), batch.column("lang"))
            n = batch.column("n").to_numpy() if weighted else None
            linked = words.joined if below is None else _linked(words, below)[1]
            for length in lengths:
                first, hashes = words.grams(length, linked)
                place, back, times = np.unique(hashes >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
                if weighted:
                    times = np.bincount(back, np.minimum(n[words.text[first]], most), len(place)).astype(np.int64)
                table[place] = np.minimum(table[place].astype(np.int64) + times, most)
        size = min(bits, BLOCK_BITS)
        for block, counts in enumerate(table.reshape(-1, 1 << size)):
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([counts[at].tobytes()], pa.binary())], ["block", "places", "counts"])

    return run


def _heavy(least: int, size: int):
    """For each block the buckets whose sum is ``least`` or more, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "counts")), strict=True):
                if block not in sums:
                    sums[block] = np.zeros(size, np.int64)
                sums[block][np.frombuffer(places, np.uint16)] += np.frombuffer(counts, _kind(least))
        for block, total in sums.items():
            if (total >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "bits"])

    return run


class Sketch:
    """Which buckets of a count-min sketch with one row reach the threshold. ``reach`` holds for every phrase whose count does.

    With a sketch ``below`` of words and pairs only phrases are counted whose pairs reach the threshold there.
    """

    def __init__(self, rows: DataFrame, least: int, lengths: range, text_bytes: int, weighted: bool = False, below: Sketch | None = None):
        self.bits = min(MOST_BITS, max(12, (4 * text_bytes // least).bit_length()))
        size = 1 << min(self.bits, BLOCK_BITS)
        parts = mapped(rows, _counted(self.bits, least, lengths, weighted, below), "block int, places binary, counts binary")
        blocks = mapped(parts.repartition("block"), _heavy(least, size), "block int, bits binary").toArrow()  # an eighth of 2 ** MOST_BITS bytes at most
        self.packed = np.zeros((1 << self.bits) // 8, np.uint8)
        for block, packed in zip(blocks["block"].to_pylist(), blocks["bits"].to_pylist(), strict=True):
            self.packed[block * size // 8 : (block + 1) * size // 8] = np.frombuffer(packed, np.uint8)

    def reach(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0


TOTAL, WORD, RUN = 0, 1, 2


def _parted(sketch: Sketch, triples: Sketch):
    """Rows (lang, kind, gram, n): numbers of words, the frequent words, and the runs of two words and more. Each frequent pair is in one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text", SLICE):
            words = Words(batch.column("text"), batch.column("lang"))
            if not len(words.start):
                continue
            every = np.arange(len(words.start))
            ones = pa.array(np.ones(len(every), np.int64))
            langs = words.lang(every)
            yield _summed(langs, TOTAL, pa.repeat(pa.scalar("", pa.large_string()), len(every)), ones)
            known, linked = _linked(words, sketch)
            chosen = every[known]
            yield _summed(langs.filter(pa.array(known)), WORD, words.strings(chosen, np.ones(len(chosen), np.int64)), ones.slice(0, len(chosen)))
            third, hashes = words.grams(3, linked)
            chain = np.zeros(len(linked) + 1, bool)
            chain[third] = triples.reach(hashes)
            before = np.r_[False, chain[:-1]]
            begins, ends = np.flatnonzero(chain & ~before), np.flatnonzero(~chain & before)  # ends: the last but one word of each run
            alone = np.flatnonzero(linked & ~chain[:-1] & ~before[:-1])
            first, count = np.r_[begins, alone], np.r_[ends - begins + 2, np.full(len(alone), 2)]
            yield _summed(words.lang(first), RUN, words.strings(first, count), pa.array(np.ones(len(first), np.int64)))

    return run


def _candidates(sketch: Sketch, longest: int):
    """Rows (lang, kind, gram, n) of the distinct phrases of two words and more that reach the threshold in the sketch; kind is their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text", SLICE):
            words = Words(batch.column("text"), batch.column("lang"))
            for length in range(2, longest + 1):
                first, hashes = words.grams(length, words.joined)
                first = first[sketch.reach(hashes)]
                yield _summed(words.lang(first), length, words.strings(first, np.full(len(first), length)), pa.array(np.zeros(len(first), np.int64)))

    return run


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the candidates in the runs of each (block, shard); rows come sorted, a shard's candidates (n is null) before its runs."""
    group, phrases, automata = None, {}, {}

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, (_, counts) in automata.items():
            found = [(p, c) for p, c in zip(phrases[lang], counts, strict=True) if c]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([p for p, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], ["lang", "phrase", "n"])

    for batch in batches:
        for *key, lang, text, n in zip(*(batch.column(c).to_pylist() for c in ("block", "shard", "lang", "text", "n")), strict=True):
            if key != group:
                yield from counted()
                group, phrases, automata = key, {}, {}
            if n is None:
                phrases.setdefault(lang, []).append(text)
            elif lang in phrases:
                if lang not in automata:
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                    for i, phrase in enumerate(phrases[lang]):
                        automaton.add_word(f" {phrase}", i)
                    automaton.make_automaton()
                    automata[lang] = automaton, [0] * len(phrases[lang])
                automaton, counts = automata[lang]
                for _, i in automaton.iter(f" {text}"):
                    counts[i] += n
    yield from counted()


def _words(text: str | Column) -> Column:
    return F.split(F.rtrim(text), " ")


def count_phrases(docs: DataFrame, least: int = 100, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all words and phrases of up to ``longest`` words that occur ``least`` times or more in a language, and (lang, n) of all its words.

    Texts are whole; A-Z become lower case, .,;:!? and line ends part pieces, blanks and tabs part words; phrases are within pieces, with
    one blank between words, and overlapping occurrences count. Null texts are empty, null languages ``und``. Repeated rows count each, other columns are
    ignored, an empty table gives no rows.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = "lang string, kind int, gram string, n long"
    pairs = Sketch(texts, least, range(1, 3), total)
    triples = Sketch(texts, least, range(3, 4), total, below=pairs)
    counts, path = stored(mapped(texts, _parted(pairs, triples), schema).groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")))
    totals = cut(counts.filter(F.col("kind") == TOTAL).select("lang", "n"))
    words = counts.filter((F.col("kind") == WORD) & (F.col("n") >= least)).select("lang", F.rtrim("gram").alias("phrase"), F.col("n").alias("f"))
    runs = counts.filter(F.col("kind") == RUN).select("lang", F.col("gram").alias("text"), "n")
    total = runs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = Sketch(runs, least, range(2, longest + 1), total, weighted=True)
    candidates, other = stored(mapped(runs, _candidates(sketch, longest), schema).select("lang", "gram").distinct())
    blocks = 1 + candidates.count() // AUTOMATON
    shards = 1 + total // (blocks * SHARD_BYTES)
    own = _words("gram")
    dealt = candidates.select(F.pmod(F.xxhash64("lang", own[0], own[1]), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", F.col("gram").alias("text"), F.lit(None).cast("long").alias("n"))
    if blocks == 1:
        owners = F.array(F.lit(0))
    else:
        split = _words("text")
        owners = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(split) - 2), lambda i: F.pmod(F.xxhash64("lang", split[i], split[i + 1]), F.lit(blocks)).cast("int")))
    sent = runs.select(F.explode(owners).alias("block"), F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"), "lang", "text", "n")
    together = dealt.withColumn("shard", F.col("shard").cast("int")).unionByName(sent).repartition(blocks * shards, "block", "shard").sortWithinPartitions("block", "shard", F.col("n").isNotNull())
    found = mapped(together, _scanned, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    phrases = cut(words.unionByName(found.filter(F.col("f") >= least).withColumn("phrase", F.rtrim("phrase"))))
    for table in (path, other):
        dropped(docs.sparkSession, table)
    return phrases, totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words and more among ``phrases`` (lang, phrase, f); ``totals`` has (lang, n).

    Each cut of a phrase scores floor(1000 * a * n / (l * r)), by whole numbers of 38 digits; the least counts, of equal ones that after fewest words.
    """
    sized = phrases.withColumn("words", _words("phrase"))
    many = sized.filter(F.size("words") > 1)
    cuts = many.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("array_join(slice(words, 1, k), ' ')")).withColumn("rest", F.expr("array_join(slice(words, k + 1, size(words)), ' ')")).drop("words")
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    few = totals.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES
    joined = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(F.broadcast(totals) if few else totals, "lang")
    score = F.expr("(cast(a as decimal(18,0)) * cast(1000 as decimal(4,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = joined.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def inner(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most) of every phrase of two words and more inside longer ones among ``phrases``, with the greatest f of these."""
    spans = F.expr("""flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))""")
    return phrases.withColumn("words", _words("phrase")).filter(F.size("words") > 2).select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, percent: int = 100, most: int = 2000) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score, as ``count_phrases`` and ``scored`` have them.

    A phrase inside a longer one that has ``percent`` of its count or more gives way to it. Ranks follow score, count and then the phrase's bytes.
    """
    phrases, totals = count_phrases(docs, least, longest)
    kept = scored(phrases, totals).join(inner(phrases), ["lang", "phrase"], "left").filter((F.col("most").isNull()) | (100 * F.col("most") < percent * F.col("a"))).drop("most")
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    good = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most)
    ranked = good.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
