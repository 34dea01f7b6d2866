"""Toxicity by weak supervision: voters, a generative label model of their accuracies and correlations, a linear classifier.

Voters are short lists of abusive words, patterns (threats, abuse of the reader, shouting, masked words, courtesy), lists of words and word
beginnings that the labelled rows of one fold suggest, and the annotator whose labels are given. A voter says toxic, clean or
nothing; one learned from a fold says nothing about that fold. The label model is a mixture of two classes in which every voter has a
probability of each vote, given the class and the voter that it depends on most; expectation maximisation fits it, and the
dependencies are a forest of the pairs whose votes agree beyond what the class explains. A linear classifier over words and
word beginnings learns the posteriors. Documents are scored by the classifier alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import bytetext as B
from weftline.llm import pieces as P
from weftline.llm.session import cut, mapped

CUT = 0.5
FOLDS = 2
BEGINNINGS = range(3, 9)  # letters of a word's beginning
LETTERS = range(2, 5)  # of scripts that don't part words
TERMS = 2048  # of a learned list, and of the classifier
EVIDENCE = 16.0  # log likelihood ratio that a term, or a pair of voters, needs
PENALTY = 1e-5
_WHOLE = np.uint64(0xA24BAED4963EE407)

# fixed values: a few words of abuse by language and kind
LISTS = {
    "minds": "idiot idiots moron morons stupid dumb imbecile dimwit cretin fool brainless",
    "worth": "worthless pathetic loser losers trash garbage scum vermin clown useless failure",
    "disgust": "disgusting vile revolting repulsive sickening filthy gross creep",
    "german": "idiot idioten dumm blöd trottel abschaum widerlich wertlos versager dreckig schwachkopf ekelhaft",
    "french": "idiot idiote imbécile stupide crétin ordure minable dégoûtant abruti débile",
    "spanish": "idiota imbécil estúpido estúpida basura escoria asqueroso patético inútil payaso",
}
PATTERNS = {
    "threat": (1, r"\b(?:kill|hurt|beat|destroy|strangle)\s+(?:you|yourself|them|him|her)\b|\bgo\s+(?:and\s+)?die\b"),
    "address": (1, r"\byou(?:'re|\s+are)\s+(?:such\s+)?(?:an?\s+)?(?:\w+\s+)?(?:idiot|moron|loser|clown|fool|disgrace|joke)\b|\bshut\s+up\b"),
    "masked": (1, r"\b\p{L}+[*#@$]+\p{L}+\b"),
    "bangs": (1, r"!{2,}"),
    "courtesy": (-1, r"\b(?:please|thanks|thank\s+you|bitte|danke|merci|gracias|por\s+favor)\b"),
}
LEARNED = tuple(f"{kind}_{fold}" for kind in ("words", "beginnings") for fold in range(FOLDS))
VOTERS = ("annotator", *LISTS, *PATTERNS, "shouting", *LEARNED)


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted term hashes with their weights, and what the label model found: accuracy by voter, dependent pairs with their strength."""

    terms: np.ndarray
    weight: np.ndarray
    bias: float
    accuracy: dict[str, float] = field(default_factory=dict)
    pairs: tuple[tuple[str, str, float], ...] = ()


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(P.letters()).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


@lru_cache(maxsize=1)
def _unparted() -> np.ndarray:
    """Letters of scripts without blanks between words."""
    out = np.zeros(0x110000, bool)
    for a, b in ((0x0E00, 0x10A0), (0x1780, 0x1800), (0x3040, 0xA000), (0x20000, 0x40000)):
        out[a:b] = True
    return out & P.letters()


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all occurrences of words and beginnings, the text of each, whether it is a whole word, and the number of words of each text.

    Words are runs of letters of whatever case; in scripts that don't part words each letter begins one.
    """
    data, at = P.column_codes(texts)
    data = _lower()[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(len(texts))
    inside, alone = P.letters()[data], _unparted()[data]
    kind = inside.astype(np.int8) + alone
    edge = np.zeros(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[at] = True
    bounds = np.flatnonzero(edge)
    end_of = np.repeat(bounds[1:], np.diff(bounds))
    begin = inside & (edge[:-1] | alone)
    start = np.flatnonzero(begin)
    end, dense = end_of[start], alone[start]
    text = np.searchsorted(at, start, side="right") - 1
    prefix = P.code_sums(data)
    whole = np.flatnonzero(~dense & (end - start >= BEGINNINGS[0]))
    hashes, of = [B.mix(B.spans(prefix, start[whole], end[whole]) ^ _WHOLE)], [text[whole]]
    for lengths, these in ((BEGINNINGS, ~dense), (LETTERS, dense)):
        for k in lengths:
            long = np.flatnonzero(these & (end - start >= k))
            hashes.append(B.spans(prefix, start[long], start[long] + k))
            of.append(text[long])
    size = len(whole)
    hashes, of = np.concatenate(hashes), np.concatenate(of)
    return hashes, of, np.arange(len(hashes)) < size, np.bincount(text, minlength=len(texts)).astype(float)


def _find(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes among the sorted ``known``, -1 where they aren't there."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return np.where(known[at] == hashes, at, -1)


def _word_hashes(words: list[str]) -> np.ndarray:
    data, at = P.codes([w.lower() for w in words])
    return np.sort(B.mix(B.spans(P.code_sums(data), at[:-1], at[1:]) ^ _WHOLE))


def votes(texts: pa.Array, labels: np.ndarray, folds: np.ndarray, learned: dict[str, np.ndarray]) -> np.ndarray:
    """A row of VOTERS per text: 1 toxic, -1 clean, 0 nothing. Without a learned list its voter says nothing."""
    hashes, of, whole, _ = terms(texts)
    out = np.zeros((len(texts), len(VOTERS)), np.int8)
    out[:, 0] = np.where(labels > 0, 1, -1)
    for name, words in LISTS.items():
        hit = of[whole][_find(_word_hashes(words.split()), hashes[whole]) >= 0]
        out[hit, VOTERS.index(name)] = 1
    plain = [t or "" for t in texts.to_pylist()]
    for name, (vote, pattern) in PATTERNS.items():
        found = regex.compile(pattern, regex.IGNORECASE)
        out[[i for i, t in enumerate(plain) if found.search(t)], VOTERS.index(name)] = vote
    upper = np.array([sum(map(str.isupper, t)) for t in plain])
    out[upper > 0.5 * np.array([max(20, sum(map(str.isalpha, t))) for t in plain]), VOTERS.index("shouting")] = 1
    for name in LEARNED:
        if len(learned.get(name, ())):
            kind, fold = name.split("_")
            mine = whole if kind == "words" else ~whole
            hits = np.bincount(of[mine][_find(learned[name], hashes[mine]) >= 0], minlength=len(texts))
            out[:, VOTERS.index(name)] = np.where(folds == int(fold), 0, np.where(hits > 0, 1, -1))
    return out


def _outcomes(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)


def _dependence(left: np.ndarray, right: np.ndarray, post: np.ndarray, weight: np.ndarray) -> float:
    """Mutual information of two voters' outcomes, given the class."""
    out = 0.0
    for p in (1 - post, post):
        joint = (left * (weight * p)[:, None]).T @ right / weight.sum()
        apart = np.outer(joint.sum(axis=1), joint.sum(axis=0)) / max(joint.sum(), 1e-300)
        out += float((joint[joint > 0] * np.log(joint[joint > 0] / apart[joint > 0])).sum())
    return out


def _parents(pairs: list[tuple[int, int, float]], width: int) -> list[int]:
    """The voter on which each one depends, -1 for none: every tree of the forest hangs from its first voter."""
    parent, seen = [-1] * width, set()
    for root in range(width):
        open_ = [] if root in seen else [root]
        while open_:
            j = open_.pop()
            seen.add(j)
            for a, b, _ in pairs:
                for up, down in ((a, b), (b, a)):
                    if up == j and down not in seen:
                        parent[down] = j
                        open_.append(down)
    return parent


def label_model(patterns: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """Posterior of toxic for each distinct row of votes (``weight`` documents each), accuracy of each voter where it votes, dependent pairs.

    The first column is the annotator, which starts the expectation maximisation and depends on the class only.
    """
    one = _outcomes(patterns)
    total, width = weight.sum(), patterns.shape[1]
    start = np.where(patterns[:, 0] > 0, 0.9, 0.1)
    parent = [-1] * width

    def step(post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logs, tables = [], []
        for y, p in enumerate((1 - post, post)):
            w = weight * p
            log = np.full(len(weight), math.log((w.sum() + 1) / (total + 2)))
            rates = []
            for j in range(width):
                alone = (w @ one[:, j] + 1) / (w.sum() + 3)
                rates.append(alone)
                if parent[j] < 0:
                    log = log + np.log(one[:, j] @ alone)
                else:
                    joint = (one[:, parent[j]] * w[:, None]).T @ one[:, j] + alone  # a parent's vote without data tells nothing
                    log = log + np.log(np.einsum("np,po,no->n", one[:, parent[j]], joint / joint.sum(axis=1, keepdims=True), one[:, j]))
            logs.append(log)
            tables.append(rates)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))), np.array(tables)

    pairs: list[tuple[int, int, float]] = []
    tree = list(range(width))
    while True:
        post = start
        for _ in range(rounds if pairs else 2):  # without pairs the class would soon be the agreement of the strongest one
            post, rates = step(post)
        strength = {(j, k): _dependence(one[:, j], one[:, k], post, weight) for j in range(1, width) for k in range(j + 1, width) if tree[j] != tree[k]}
        j, k = max(strength, key=strength.get, default=(0, 0))
        if 2 * total * strength.get((j, k), 0) <= EVIDENCE:
            break
        pairs.append((j, k, strength[j, k]))
        tree = [tree[j] if t == tree[k] else t for t in tree]
        parent[:] = _parents(pairs, width)
    for _ in range(rounds):
        post, rates = step(post)
    share = float((weight * post).sum() / total)
    right = share * rates[1][:, 2] + (1 - share) * rates[0][:, 0]
    spoken = right + share * rates[1][:, 0] + (1 - share) * rates[0][:, 2]
    return post, right / np.maximum(spoken, 1e-12), pairs


def logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray, weight: np.ndarray, width: int, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the weighted mean logistic loss against soft targets + PENALTY |w|^2 / 2; Newton steps by conjugate gradients."""
    n, mean = len(target), weight / weight.sum()

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * w[column], n) + w[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(column, value * r[row], width), r.sum()]

    small = np.r_[np.full(width, PENALTY), 1e-9]

    def loss(w: np.ndarray) -> float:
        z = times(w)
        return float((mean * (np.logaddexp(0, z) - target * z)).sum() + (small * w * w).sum() / 2)

    w = np.zeros(width + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -500, 500)))
        slope = back(mean * (p - target)) + small * w
        curve = mean * np.maximum(p * (1 - p), 1e-12)
        move, rest = np.zeros_like(w), -slope
        way, size = rest.copy(), rest @ rest
        for _ in range(60):
            if size < 1e-18:
                break
            bent = back(curve * times(way)) + small * way
            rate = size / (way @ bent)
            move, rest = move + rate * way, rest - rate * bent
            size, before = rest @ rest, size
            way = rest + size / before * way
        scale, now = 1.0, loss(w)
        while loss(w + scale * move) > now and scale > 1e-4:
            scale /= 2
        w = w + scale * move
        if np.abs(scale * move).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def _told(learned: dict[str, np.ndarray], post: dict[bytes, float] | None):
    """For each text its votes; with posteriors, counts of its terms weighted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            got = votes(batch.column("text"), batch.column("label").to_numpy(), batch.column("fold").to_numpy(), learned)
            if post is None:
                yield pa.RecordBatch.from_arrays([batch.column("weight"), pa.array([v.tobytes() for v in got], pa.binary())], ["weight", "votes"])
                continue
            yield from _tallied(batch.column("text"), np.array([post[v.tobytes()] for v in got]), batch.column("weight").to_numpy(), np.zeros(len(got), np.int32))

    return run


def _tallied(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (term, whole, fold, toxic, clean): documents that hold a term, by their weight as toxic and as clean."""
    hashes, of, whole, _ = terms(texts)
    held, place = np.unique(np.rec.fromarrays([of, hashes], names="of,hash"), return_index=True)
    if not len(held):
        return
    key, first, back = np.unique(np.rec.fromarrays([held.hash, fold[held.of]], names="hash,fold"), return_index=True, return_inverse=True)
    bad = np.bincount(back, (weight * toxic)[held.of])
    good = np.bincount(back, (weight * (1 - toxic))[held.of])
    yield pa.RecordBatch.from_arrays(
        [pa.array(key.hash.view(np.int64)), pa.array(whole[place[first]]), pa.array(key.fold.astype(np.int32)), pa.array(bad), pa.array(good)],
        ["term", "whole", "fold", "toxic", "clean"],
    )


def _by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in B.slices(batches, "text"):
        yield from _tallied(batch.column("text"), batch.column("label").to_numpy().astype(float), batch.column("weight").to_numpy(), batch.column("fold").to_numpy())


_TALLY = "term long, whole boolean, fold int, toxic double, clean double"


def _telling(tally: DataFrame, toxic: Column, clean: Column) -> DataFrame:
    """The sums of a tally by term and fold with their evidence: twice the log likelihood ratio of a term that goes with toxic documents."""
    sums = tally.groupBy("term", "whole", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    both = F.col("toxic") + F.col("clean")

    def part(seen: Column, rate: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (both * rate))).otherwise(0.0)

    evidence = 2 * (part(F.col("toxic"), toxic / (toxic + clean)) + part(F.col("clean"), clean / (toxic + clean)))
    return sums.withColumn("evidence", evidence).filter((F.col("toxic") * (toxic + clean) > 2 * both * toxic) & (F.col("evidence") > EVIDENCE))


def _features(known: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term place, value): ten times the root of the share of the text's words that have the term."""
    hashes, of, _, words = terms(texts)
    at = _find(known, hashes)
    held = at >= 0
    key, count = np.unique(of[held] * max(1, len(known)) + at[held], return_counts=True)
    row = key // max(1, len(known))
    return row, key % max(1, len(known)), 10 * np.sqrt(count / np.maximum(words[row], 1))


def _featured(known: np.ndarray, learned: dict[str, np.ndarray], post: dict[bytes, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            got = votes(batch.column("text"), batch.column("label").to_numpy(), batch.column("fold").to_numpy(), learned)
            row, at, value = _features(known, batch.column("text"))
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), x) for x in (pa.array(at.astype(np.int32)), pa.array(value.astype(np.float32)))]
            yield pa.RecordBatch.from_arrays([pa.array([post[v.tobytes()] for v in got]), batch.column("weight"), *lists], ["target", "weight", "at", "value"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000) -> ToxicityModel:
    """A model from the rows of ``labels`` (doc_id, toxic) whose documents are in ``docs`` (doc_id, text).

    Of each class a hash of doc_id picks about ``most_rows`` labels (at most twice as many); classes count by their true share. Equal texts teach once,
    null labels nothing. Without labels of both classes every text has the score of the one class there is; without labels or labelled documents about 0.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    sizes = dict(known.groupBy("label").count().collect())
    if len(sizes) < 2:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 20.0 if 1 in sizes else -20.0)
    rates = {y: min(1.0, most_rows / n) for y, n in sizes.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    picked = [known.filter((F.col("label") == y) & (place < math.ceil(r * (1 << 20)))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most_rows) for y, r in rates.items()]
    chosen = picked[0].unionByName(picked[1]).withColumn("weight", F.when(F.col("label") == 1, F.lit(1 / rates[1])).otherwise(F.lit(1 / rates[0])))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 4 * most_rows labels
    once = joined.withColumn("same", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["same", "label"])
    rows = cut(once.select("text", "label", "weight", F.pmod(F.xxhash64("same"), F.lit(FOLDS)).cast("int").alias("fold")))

    clean, toxic = F.lit(float(sizes[0]) / FOLDS), F.lit(float(sizes[1]) / FOLDS)
    told = _telling(mapped(rows, _by_label, _TALLY), toxic, clean)
    learned = {}
    for name in LEARNED:
        kind, fold = name.split("_")
        best = told.filter((F.col("fold") == int(fold)) & (F.col("whole") == (kind == "words"))).filter("toxic > clean").orderBy(F.desc("evidence"), "term").limit(TERMS)
        learned[name] = np.sort(np.array([r[0] for r in best.select("term").collect()], np.int64).view(np.uint64))

    ballots = mapped(rows, _told(learned, None), "weight double, votes binary").groupBy("votes").agg(F.sum("weight").alias("weight")).orderBy("votes").collect()  # at most a row per picked label
    if not ballots:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    patterns = np.array([np.frombuffer(r["votes"], np.int8) for r in ballots])
    post, accuracy, pairs = label_model(patterns, np.array([r["weight"] for r in ballots]))
    by_votes = {bytes(r["votes"]): float(p) for r, p in zip(ballots, post, strict=True)}

    told = _telling(mapped(rows, _told(learned, by_votes), _TALLY), F.lit(float(sizes[1])), F.lit(float(sizes[0])))
    best = told.orderBy(F.desc("evidence"), "term").limit(TERMS).select("term").collect()
    chosen_terms = np.sort(np.array([r[0] for r in best], np.int64).view(np.uint64))
    found = mapped(rows, _featured(chosen_terms, learned, by_votes), "target double, weight double, at array<int>, value array<float>").orderBy("target", "weight", "at", "value").toArrow()
    lengths = np.array([len(x) for x in found["at"].to_pylist()], np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = found["at"].combine_chunks().flatten().to_numpy()
    value = found["value"].combine_chunks().flatten().to_numpy().astype(float)
    weight, bias = logistic(row, column, value, found["target"].to_numpy(), found["weight"].to_numpy(), len(chosen_terms))
    names = tuple((VOTERS[j], VOTERS[k], s) for j, k, s in pairs)
    return ToxicityModel(chosen_terms, weight, bias, dict(zip(VOTERS, accuracy.tolist(), strict=True)), names)


def _scored(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            row, at, value = _features(model.terms, batch.column("text"))
            sums = model.bias + np.bincount(row, value * model.weight[at], batch.num_rows) if len(row) else np.full(batch.num_rows, model.bias)
            score = 1 / (1 + np.exp(-np.clip(sums, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(score), pa.array((score >= CUT).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return run


def rate(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score (0 to 1, from the whole text) and predicted (1 if score >= CUT).

    Null, empty and blank texts, and texts without a known term, have the score of the bias alone. Equal texts have equal scores, repeated rows stay, long texts
    are read whole, an empty table gives no rows. Columns of ``docs`` with the two names are replaced; others stay.
    """
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return mapped(docs, _scored(model), schema)


def held_out() -> Column:
    """Whether a row of the query is held out: crc32 of doc_id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
