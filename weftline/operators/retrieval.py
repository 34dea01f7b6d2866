"""Keyword retrieval over tokens: seed, expand, rank, order, assemble."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.arrays import array_runs, let
from weftline.operators.lineage import cut

# fixed values: how eagerly a relation is followed, and what a content type adds to a score
EXPANSION_PRIORITY = {
    "HIERARCHY": 1.0, "NEXT_SIBLING": 0.5, "EXAMPLE_OF": 0.9, "CALLOUT_NOTE": 0.7, "CALLOUT_TIP": 0.7, "CALLOUT_IMPORTANT": 0.95,
    "CALLOUT_CRITICAL": 1.0, "CROSS_REFERENCE": 0.4, "CROSS_MODULE": 0.3, "FUNCTION_OF": 0.6,
}
CONTENT_PRIORITY = {
    "IMPORTANT": 1.0, "VERY_IMPORTANT": 1.0, "SIGNATURE": 0.9, "CODE_EXAMPLE": 0.8, "PROSE": 0.7, "NOTE": 0.6, "PRO_TIP": 0.6, "TABLE_ROW": 0.4,
}
OTHER_RELATION, OTHER_TYPE = 0.2, 0.5
# a block of word sets has about so many words or rows; sets of so many words are looked up whole; pairs that are given out at once; frequent words of a block
BLOCK_WORDS, BLOCK_ROWS, DENSE, CELLS, FREQUENT = 1 << 23, 1 << 17, 40, 1 << 17, 1 << 11


def _looked_up(values: dict, key: Column, other: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key), F.lit(other))


def seeds_like(tokens: DataFrame, query: str, module: str | None = None, most: int = 30) -> DataFrame:
    """Tokens that hold any of the query's words (ignoring ASCII case), in reading order; rank i scores 1 / i."""
    hit = reduce(lambda a, b: a | b, (F.contains(F.lower("content"), F.lit(w.lower())) for w in query.split()), F.lit(False))
    found = tokens.filter(hit if module is None else hit & (F.col("module") == module))
    top = found.orderBy("module", "page_url", "paragraph", "token_sha").limit(most)
    rank = F.row_number().over(Window.orderBy("module", "page_url", "paragraph", "token_sha"))  # at most ``most`` rows
    return top.withColumn("position", rank).withColumn("seed_rank", 1 / F.col("position"))


def terms_of(tokens: DataFrame, *columns: str) -> DataFrame:
    """term, columns: a row per term of each content, repeated ones too. Terms are runs of letters and digits in lower case."""
    return tokens.select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("term"), *columns)


def term_counts(tokens: DataFrame) -> DataFrame:
    """token_sha, counts: the terms of each token with their number (term, tf), counted within its row, so that contents are shuffled and not their terms.

    Rows of one token count together. Terms are as ``terms_of`` has them.
    """
    one = Window.partitionBy("token_sha")
    once = tokens.select("token_sha", F.collect_list("content").over(one).alias("_all"), F.row_number().over(one.orderBy("token_sha")).alias("_k")).filter("_k = 1")
    found = F.sort_array(F.regexp_extract_all(F.lower(F.array_join("_all", " ")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    return once.select("token_sha", let(found, lambda t: array_runs(t, lambda x: x, lambda i, n: F.struct(t[i].alias("term"), n.cast("long").alias("tf")))).alias("counts"))


def postings(counts: DataFrame) -> DataFrame:
    """The inverted index of ``term_counts``: term, token_sha, tf."""
    return counts.select("token_sha", F.inline("counts")).select("term", "token_sha", "tf")


def bm25(tokens: DataFrame, query: str, most: int = 30, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """token_sha, score, position, seed_rank of the ``most`` best tokens by BM25 over any of the query's terms.

    The query is cut into terms as ``postings`` cuts content. Only the asked terms are counted, in one pass without a
    shuffle of the index; a blank query gives no rows.
    """
    terms = F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    split = tokens.select("token_sha", terms.alias("terms")).filter(F.size("terms") > 0)
    asked_terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))  # as the index cuts them

    def times(word: str) -> Column:
        return F.size(F.filter("terms", lambda t: t == word))

    lengths = split.select("token_sha", F.size("terms").alias("length"), *(times(w).alias(f"tf_{i}") for i, w in enumerate(asked_terms)))
    whole = tokens.agg(F.count("*").alias("n")).crossJoin(lengths.agg(F.sum("length").alias("total")))  # one row
    counted = F.array(*(F.struct(F.lit(w).alias("term"), F.col(f"tf_{i}").alias("tf")) for i, w in enumerate(asked_terms)))
    asked = lengths.select("token_sha", "length", F.inline(F.filter(counted, lambda x: x["tf"] > 0))) if asked_terms else lengths.select("token_sha", "length", F.lit("").alias("term"), F.lit(0).alias("tf")).filter("false")
    seen = asked.groupBy("term").agg(F.count("*").alias("df"))
    rows = asked.join(F.broadcast(seen), "term").crossJoin(F.broadcast(whole))  # a row per asked term; one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") * F.col("n") / F.col("total")))
    top = rows.groupBy("token_sha").agg(F.round(F.sum(part), 9).alias("score")).orderBy(F.desc("score"), "token_sha").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "token_sha"))  # at most ``most`` rows
    return top.withColumn("position", rank).withColumn("seed_rank", 1 / F.col("position"))


def expand(seeds: DataFrame, edges: DataFrame, depth: int = 2, most: int = 150) -> DataFrame:
    """token_sha, edge_weight, depth, position of tokens reached from seeds (token_sha, position, seed_rank) in both directions.

    A level's candidates score parent score * relation priority * weight; the parent earliest in line wins a token, a
    parent's candidates come by falling score (ties by sha), and the first ``most`` in line stay.
    """
    both = edges.select(F.col("source_sha").alias("from_sha"), F.col("target_sha").alias("to_sha"), "rel_type", "weight").unionByName(
        edges.select(F.col("target_sha").alias("from_sha"), F.col("source_sha").alias("to_sha"), "rel_type", "weight")
    )
    front = seeds.select(F.col("token_sha").alias("from_sha"), F.col("position").alias("parent"), F.col("seed_rank").alias("score"))
    seen = seeds.select(F.col("token_sha").alias("to_sha"))
    levels = []
    for level in range(1, depth + 1):
        reached = front.join(both, "from_sha").join(seen, "to_sha", "left_anti")
        scored = reached.withColumn("score", F.col("score") * _looked_up(EXPANSION_PRIORITY, F.col("rel_type"), OTHER_RELATION) * F.col("weight"))
        first = F.row_number().over(Window.partitionBy("to_sha").orderBy("parent", F.desc("score"), F.desc("weight"), "rel_type"))
        won = scored.withColumn("k", first).filter("k = 1").orderBy("parent", F.desc("score"), "to_sha").limit(most)
        place = F.row_number().over(Window.orderBy("parent", F.desc("score"), "to_sha"))  # at most ``most`` rows
        won = cut(won.withColumn("place", place))
        levels.append(won.select(F.col("to_sha").alias("token_sha"), F.col("weight").alias("edge_weight"), F.lit(level).alias("depth"), "place"))
        seen = seen.unionByName(won.select("to_sha"))
        front = won.select(F.col("to_sha").alias("from_sha"), F.col("place").alias("parent"), "score")
    out = reduce(DataFrame.unionByName, levels).orderBy("depth", "place").limit(most)
    return out.withColumn("position", F.row_number().over(Window.orderBy("depth", "place"))).drop("place")


def score(seed_rank: Column, edge_weight: Column, content_type: Column, content: Column, depth: Column) -> Column:
    bonus = F.least(F.length(content) / 500, F.lit(1.0)) * 0.3
    return (3 * seed_rank + 1.5 * edge_weight + _looked_up(CONTENT_PRIORITY, content_type, OTHER_TYPE) + bonus) / (1 + 0.5 * depth)


def ranked(tokens: DataFrame, seeds: DataFrame, expanded: DataFrame) -> DataFrame:
    """The tokens of both with their scores, seeds first in line."""
    zero = F.lit(0.0)
    line = seeds.select("token_sha", "seed_rank", zero.alias("edge_weight"), F.lit(0).alias("depth"), F.col("position").cast("long").alias("line")).unionByName(
        expanded.select("token_sha", zero.alias("seed_rank"), "edge_weight", "depth", (F.col("position") + 1_000_000).cast("long").alias("line"))
    )
    named = tokens.join(F.broadcast(line), "token_sha")  # as many rows as seeds and expansion allow
    return named.withColumn("score", F.round(score(F.col("seed_rank"), F.col("edge_weight"), F.col("content_type"), F.col("content"), F.col("depth")), 9))


def within_budget(rows: DataFrame, most_words: int) -> DataFrame:
    """Rows by falling score until the next would pass the budget of words; the first always stays. For ranked results, whose number is bounded."""
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    order = Window.orderBy(F.desc("score"), "line", "token_sha")
    rows = rows.withColumn("words", words)
    run = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("total", run).withColumn("k", F.row_number().over(order)).filter((F.col("total") <= most_words) | (F.col("k") == 1)).drop("k")


def assembled(rows: DataFrame) -> DataFrame:
    """markdown, n_tokens: the rows in reading order under module, page and section headings, callouts and code marked."""
    order = Window.orderBy("module", "page_url", "section", "paragraph", "token_sha")  # ranked results are bounded

    def new(*names: str) -> Column:
        changed = [~F.col(n).eqNullSafe(F.lag(n).over(order)) for n in names]
        return reduce(lambda a, b: a | b, changed) | (F.row_number().over(order) == 1)

    section = F.trim(F.regexp_replace("section", r"[\[\]()]", ""))
    text = F.trim("content")
    kind = F.col("content_type")
    # fixed values: how the assembled text marks callouts, code and headings
    body = (
        F.when(kind == "NOTE", F.concat(F.lit("> **Note:** "), text, F.lit("\n")))
        .when(kind == "IMPORTANT", F.concat(F.lit("> **Important:** "), text, F.lit("\n")))
        .when(kind == "VERY_IMPORTANT", F.concat(F.lit("> **Critical:** "), text, F.lit("\n")))
        .when(kind == "PRO_TIP", F.concat(F.lit("> **Tip:** "), text, F.lit("\n")))
        .when((kind == "CODE_EXAMPLE") & ~text.startswith("```"), F.concat(F.lit("```\n"), text, F.lit("\n```\n")))
        .otherwise(F.concat(text, F.lit("\n")))
    )
    parts = F.array(
        F.when(new("module"), F.concat(F.lit("\n## ["), "module", F.lit("]\n"))),
        F.when(new("module", "page_url"), F.concat(F.lit("\n### "), "page_url", F.lit("\n"))),
        F.when(new("module", "page_url", "section") & (section != ""), F.concat(F.lit("\n#### "), section, F.lit("\n"))),
        body,
    )
    lines = rows.select(F.row_number().over(order).alias("k"), F.array_join(parts, "\n").alias("part"))
    return lines.agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda r: r["part"]), "\n")).alias("markdown"), F.count("*").alias("n_tokens"))


def words(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def _needed(sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of sets of these sizes: how many of their rarest words are looked up in a larger set, and how many of those it must have to share more than ``least``.

    A set that has to share k of n words may miss n - k, so of any n - k + t words at least t are met. Sets of up to ``DENSE`` words are looked up whole.
    """
    shared = np.floor(least * sizes).astype(np.int64) + 1
    shared -= (shared - 1) / sizes > least
    shared += shared / sizes <= least
    looked = np.where(sizes <= DENSE, sizes, np.minimum(sizes, sizes - shared + 1 + sizes // 8))
    return looked, looked - (sizes - shared)


def _gathered(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The stretches ``begin`` to ``end`` of ``values``, one behind the other."""
    many = end - begin
    ends = np.cumsum(many)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + many, many)]


def _added(rows: np.ndarray, which: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The sums of some rows of a 0/1 matrix of bytes, from a column to another."""
    out = np.zeros(max(0, end - begin), np.int64)
    for lo in range(0, len(which), 255):
        out += np.add.reduce(rows[which[lo : lo + 255], begin:end], axis=0, dtype=np.uint8)
    return out


def _block(least: float):
    """A partition's word sets (id, words joined by blanks) as one row, the smallest first: a dictionary, each set's words from the rarest on, each word's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [b.filter(pc.not_equal(b.column("words"), "")) for b in batches]
        if not sum(b.num_rows for b in sets):
            return
        table = pa.Table.from_batches(sets).combine_chunks()
        split = pc.split_pattern(table["words"].combine_chunks(), " ")
        order = np.argsort(np.diff(split.offsets.to_numpy()), kind="stable")
        split = split.take(pa.array(order))
        sizes = np.diff(split.offsets.to_numpy())
        words = split.flatten().dictionary_encode()
        codes, at = words.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        codes = codes[np.lexsort((np.bincount(codes)[codes], at))]
        early = np.arange(len(codes)) < np.repeat(np.cumsum(sizes) - sizes + _needed(sizes, least)[0], sizes)
        by_word = np.argsort(codes, kind="stable")
        row = {
            "id": table["id"].combine_chunks().take(pa.array(order)), "size": pa.array(sizes, pa.int32()), "word": words.dictionary.cast(pa.string()), "code": pa.array(codes, pa.int32()),
            "sets": pa.array(at[by_word], pa.int32()), "early": pa.array(early[by_word]),
        }
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row.values()], list(row))

    return run


def _counted(a: dict, b: dict, least: float, once: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each set of the block ``a`` that has some: its place, and places in ``b`` and shares of the sets that share more than ``least`` of the smaller set.

    Of two sets the smaller one's rarest words are looked up in the larger one; where enough are met, all words decide. With ``once`` two found sets
    of different ids are enough, and sets of one size with the same words of ``b`` are looked up once.
    """
    code, size_a, size_b, sets = b["code"].to_numpy(), *(x["size"].to_numpy().astype(np.int64) for x in (a, b)), b["sets"].to_numpy().astype(np.intp)
    n, whole = len(size_b), int(np.searchsorted(size_b, DENSE, "right"))
    many = np.bincount(code, minlength=len(b["word"]))
    begin = np.r_[0, np.cumsum(many)]
    # frequent words have a row of bytes, one for each set; in it the first sets, which are looked up whole, are counted for the other words alone
    frequent = np.argsort(-many, kind="stable")[: min(FREQUENT, (1 << 25) // n)]
    frequent = frequent[many[frequent] * 64 > n]
    place = np.full(len(many), -1)
    place[frequent] = np.arange(len(frequent))
    rows = np.zeros((len(frequent), n), np.uint8)
    rows[np.repeat(np.arange(len(frequent)), many[frequent]), _gathered(sets, begin[frequent], begin[frequent + 1])] = 1
    early = b["early"].to_numpy(zero_copy_only=False) & ((sets >= whole) | np.repeat(place < 0, many))
    begin_early, early = np.r_[0, np.cumsum(early)][begin], sets[early]
    known = pc.index_in(a["word"], value_set=b["word"]).fill_null(-1).to_numpy()[a["code"].to_numpy()]
    (looked, _), (least_a, least_b) = _needed(size_a, least), (_needed(x, least)[1] for x in (size_a, size_b))
    at_a, at_b = np.r_[0, np.cumsum(size_a)], np.r_[0, np.cumsum(size_b)]
    larger = np.searchsorted(size_b, size_a)  # from here on sets of b are as large or larger
    mark = np.zeros(len(many), bool)
    of = np.repeat(np.arange(n), size_b)
    is_early = (np.arange(len(code)) < np.repeat(at_b[:-1] + _needed(size_b, least)[0], size_b)) & ((of >= whole) | (place[code] < 0))
    seen = {}
    split, split_early, before = begin[:-1].copy(), begin_early[:-1].copy(), 0  # where each word's larger sets begin: both sides go by size
    for i in range(len(size_a)):
        words, k = known[at_a[i] : at_a[i + 1]], int(larger[i])
        all_words = words[words >= 0]
        if once:
            key = int(size_a[i]), np.sort(all_words).tobytes()
            if key in seen:
                if seen[key] is not None:
                    yield i, *seen[key]
                continue
            seen[key] = None
        if k > before:
            passed = slice(at_b[before], at_b[k])
            np.add.at(split, code[passed], 1)
            np.add.at(split_early, code[passed][is_early[passed]], 1)
            before = k
        found, shared = [], []
        if k:  # smaller sets of b: their early words among all of this one
            hits = np.bincount(_gathered(early, begin_early[all_words], split_early[all_words]), minlength=n)[:k]
            in_rows = place[all_words]
            hits[:whole] += _added(rows, in_rows[in_rows >= 0], 0, min(k, whole))
            j = np.flatnonzero(hits >= least_b[:k])
            found.append(j), shared.append(np.where(j < whole, hits[j], -1))
        if k < n:
            rare = words[: looked[i]]
            rare = rare[rare >= 0]
            in_rows = place[rare]
            rare = rare[in_rows < 0]
            hits = np.bincount(_gathered(sets, split[rare], begin[rare + 1]), minlength=n)[k:] + _added(rows, in_rows[in_rows >= 0], k, n)
            j = np.flatnonzero(hits >= least_a[i])
            found.append(j + k), shared.append(hits[j] if size_a[i] <= DENSE else np.full(len(j), -1))
        j, both = np.concatenate(found), np.concatenate(shared)
        open_ = np.flatnonzero(both < 0)
        if len(open_):
            mark[all_words] = True
            some = j[open_]
            both[open_] = np.add.reduceat(mark[_gathered(code, at_b[some], at_b[some + 1])], np.cumsum(size_b[some]) - size_b[some], dtype=np.int64)
            mark[all_words] = False
        share = both / np.minimum(size_a[i], size_b[j])
        kept = share > least
        if kept.any():
            j, share = j[kept], share[kept]
            if once:
                ids = b["id"]
                other = next((k for k in range(1, len(j)) if ids[int(j[k])] != ids[int(j[0])]), 0)
                j, share = j[[0, other]], share[[0, other]]
                seen[key] = j, share
            yield i, j, share


def _met(least: float, once: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = ({name: batch.column(side).field(name)[k].values for name in (f.name for f in batch.column(side).type)} for side in "ab")

                def pairs(found: list, a=a, b=b) -> pa.RecordBatch:
                    i = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
                    left, right = a["id"].take(pa.array(i)), b["id"].take(pa.array(np.concatenate([x[1] for x in found])))
                    out = pa.RecordBatch.from_arrays([left, right, pa.array(np.concatenate([x[2] for x in found]))], ["left_id", "right_id", "share"])
                    return out.filter(pc.not_equal(left, right))

                kept, n = [], 0
                for found in _counted(a, b, least, once):
                    kept.append(found)
                    n += len(found[1])
                    if n >= CELLS:
                        yield pairs(kept)
                        kept, n = [], 0
                if kept:
                    yield pairs(kept)

    return run


def _number(sets: DataFrame) -> int:
    """How many blocks texts (text) need; a word of a set stands for about eight letters of its text."""
    size = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    return 1 + max(size["n"] // BLOCK_ROWS, size["chars"] // (8 * BLOCK_WORDS))


def _pairs(cases: DataFrame, known: DataFrame, least: float, once: bool = False) -> DataFrame:
    """left_id, right_id, share as ``near_cases`` has them; with ``once`` one or two of a case and a block of known ones."""
    lists = {"size": T.IntegerType(), "word": T.StringType(), "code": T.IntegerType(), "sets": T.IntegerType(), "early": T.BooleanType()}

    def blocks(df: DataFrame, name: str, fields: list[str], n: int) -> DataFrame:
        dealt = df.select("id", F.array_join(words(F.col("text")), " ").alias("words"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")).repartitionById(n, "block")
        schema = T.StructType([T.StructField(k, T.ArrayType(v)) for k, v in ({"id": df.schema["id"].dataType} | lists).items()])
        return cut(dealt.select("id", "words").mapInArrow(_block(least), schema).select(F.struct(*fields).alias(name)))

    cases, known = (df.filter("id is not null and text is not null").select("id", "text") for df in (cases, known))
    n = _number(known)
    b = blocks(known, "b", ["id", *lists], n)
    a = blocks(cases, "a", ["id", "size", "word", "code"], max(_number(cases), -(-cases.sparkSession.sparkContext.defaultParallelism // n)))  # no core stays idle where there are few blocks
    left, right = (df.schema["id"].dataType for df in (cases, known))
    schema = T.StructType([T.StructField("left_id", left), T.StructField("right_id", right), T.StructField("share", T.DoubleType())])
    return a.crossJoin(b).mapInArrow(_met(least, once), schema)


def near_cases(cases: DataFrame, known: DataFrame, least: float = 0.6) -> DataFrame:
    """left_id, right_id, share of each case (id, text) and each known one of another id whose shared words are more than ``least`` of the smaller word set.

    Exact, and by nature a look at every case and known one: a set may lie inside any larger one. Both sides are dealt to blocks of at most about
    ``BLOCK_WORDS`` words or ``BLOCK_ROWS`` rows, written once; every pair of blocks is a task that counts shared words in bounded memory, so what is
    shuffled and written grows with the texts, not with the pairs.
    """
    return _pairs(cases, known, least)


def near_ids(cases: DataFrame, known: DataFrame, least: float = 0.6) -> DataFrame:
    """id of the cases that ``near_cases`` has pairs of, without making all pairs: most are found among a block of the known ones, only the others meet the rest."""
    n = _number(known)
    drawn = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)) == 0
    found, left = [], cut(cases.select("id", "text"))
    for some in [known.filter(drawn), known.filter(~drawn)] if n > 4 else [known]:
        met = cut(_pairs(left, some, least, once=True).select(F.col("left_id").alias("id")).distinct())
        found.append(met)
        left = left.join(met, "id", "left_anti")
    return reduce(DataFrame.unionByName, found)
