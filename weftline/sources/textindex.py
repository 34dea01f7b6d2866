"""A stored positional index over token contents: built once, kept up by batches or a stream, searched by phrases.

An index is a folder of Parquet tables in generations (``g0``, ``g1``, ...). Each table is partitioned by segment, the number of the
batch that wrote it:

- ``tokens``: token_sha, module, id (its number in the segment), length, terms, of every token; whole reads and compactions take the terms from here;
- ``postings`` (also by bucket, the hash of the term): term, base, ids, ends, places: a row per term and block of tokens, whose kth token is base + ids[k] and has
  places[ends[k - 1]:ends[k]] as positions. So keys of tokens stand in ``tokens`` only, and a search joins its few postings with them;
- ``deleted``: token_sha of tokens whose rows in earlier segments no longer count;
- ``segments``: a row per segment that is complete, written last; readers take in no others.

A batch that is run again overwrites its own partitions only. Compaction writes what still counts as the one segment of the next generation.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions.arrays import array_runs, let

TERM = r"([\p{L}\p{N}\p{Co}]+)"
BUCKETS = 64
SPLITS = 8  # files of a bucket and segment, so that a frequent term isn't one task's
LEAST_IDF = 1e-6


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters that are a base letter with marks, and their base letters."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and all(unicodedata.combining(m) for m in base[1:]):
            pairs.append((c, base[0]))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), *_accents()), r"\p{Mn}+", "")


def terms(text: Column) -> Column:
    """The terms of a text in order: runs of letters and digits, folded."""
    return F.regexp_extract_all(folded(text), F.lit(TERM), F.lit(1))


def phrases(query: str) -> list[list[str]]:
    """The words of a query, each as the terms that have to follow one another: ``fn1(x)`` is fn1 and then x. Words without a letter or digit drop out."""
    cut = (re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c))) for w in query.split())
    return [p for p in cut if p]


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def cut_terms(tokens: DataFrame) -> DataFrame:
    """token_sha, module, terms of tokens (token_sha, module, content): the terms in order. Repeated keys count once; null and empty contents have no terms."""
    found = F.coalesce(terms(F.col("content")), F.array().cast("array<string>"))
    return tokens.dropDuplicates(["token_sha"]).select("token_sha", "module", found.alias("terms"))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of tokens (id, terms), a row per term of each batch (blocks of one task's numbers, so that what is added to base stays small)."""
    for batch in batches:
        lists = batch.column("terms")
        size = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(batch.column("id").to_numpy(), size)
        place = np.arange(len(owner), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.lexsort((code, owner >> 33))  # stable: tokens and places stay in order
        code, owner, place = code[order], owner[order], place[order].astype(np.int32)
        row = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (owner[1:] >> 33 != owner[:-1] >> 33)][: len(code)])  # where each term begins
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])][: len(code)])  # where each token of a term begins
        per_row = np.searchsorted(first, np.r_[row, len(code)]).astype(np.int32)
        begin = np.repeat(row, np.diff(per_row))
        ids = (owner[first] - owner[begin]).astype(np.int32)
        ends = (np.r_[first[1:], len(code)][: len(first)] - begin).astype(np.int32)
        bounds = np.r_[row, len(code)].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(code[row])), pa.array(owner[row]), *(pa.ListArray.from_arrays(pa.array(o), pa.array(v)) for o, v in ((per_row, ids), (per_row, ends), (bounds, place)))],
            ["term", "base", "ids", "ends", "places"],
        )


def _each_term(found: Column) -> Column:
    """Structs of term and its positions (rising from 0), of an array of terms: sorted, then cut where the term changes."""

    def runs(pairs: Column) -> Column:
        return array_runs(pairs, lambda x: x["t"], lambda i, n: F.struct(pairs[i]["t"].alias("term"), F.transform(F.slice(pairs, i + 1, n), lambda x: x["i"]).alias("positions")))

    return let(F.sort_array(F.transform(found, lambda t, i: F.struct(t.alias("t"), i.alias("i")))), runs)


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the generations that are complete, falling; listed by the store's own file system."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/g*/segments/segment=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted({int(re.search(r"/g(\d+)/segments/", s.getPath().toString())[1]) for s in found}, reverse=True)


def _newest(spark: SparkSession, path: str) -> str:
    found = _generations(spark, path)
    if not found:
        raise ValueError(f"no index at {path}")
    return f"{path}/g{found[0]}"


def _write(df: DataFrame, folder: str, segment: int, *parts: str) -> None:
    df.write.mode("overwrite").partitionBy(*parts).parquet(f"{folder}/segment={segment}") if parts else df.write.mode("overwrite").parquet(f"{folder}/segment={segment}")


def _write_segment(at: str, segment: int, buckets: int, tokens: DataFrame, gone: DataFrame) -> None:
    """Writes ``tokens`` (token_sha, module, terms) with their postings; ids are read back from the file, so both tables have the same."""
    spark = tokens.sparkSession
    _write(gone, f"{at}/deleted", segment)
    _write(tokens.select("token_sha", "module", F.monotonically_increasing_id().alias("id"), F.size("terms").alias("length"), "terms"), f"{at}/tokens", segment)
    written = spark.read.schema("id long, terms array<string>").parquet(f"{at}/tokens/segment={segment}")
    postings = written.mapInArrow(_inverted, "term string, base long, ids array<int>, ends array<int>, places array<int>")
    dealt = postings.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition("bucket", F.pmod(F.xxhash64("base"), F.lit(SPLITS)))
    _write(dealt.sortWithinPartitions("bucket", "term", "base"), f"{at}/postings", segment, "bucket")
    _write(spark.createDataFrame([(buckets,)], "buckets int"), f"{at}/segments", segment)


def build(tokens: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes the index of ``tokens`` (token_sha, module, content) as segment 0; batches have the numbers behind it. An empty table gives an index without postings."""
    none = tokens.select("token_sha").filter("false")
    _write_segment(f"{path}/g0", 0, buckets, cut_terms(tokens), none)


POSTINGS = "term string, base long, ids array<int>, ends array<int>, places array<int>, segment int, bucket int"
TOKENS = "token_sha string, module string, id long, length int, terms array<string>, segment int"


def _table(spark: SparkSession, at: str, name: str, schema: str) -> DataFrame:
    """The rows of complete segments of a table."""
    done = spark.read.schema("buckets int, segment int").parquet(f"{at}/segments").select("segment")
    return spark.read.schema(schema).parquet(f"{at}/{name}").join(F.broadcast(done), "segment", "left_semi")  # a row per batch since the last compaction


def _live(rows: DataFrame, at: str) -> DataFrame:
    """``rows`` without those that a later segment has deleted."""
    gone = _table(rows.sparkSession, at, "deleted", "token_sha string, segment int").groupBy("token_sha").agg(F.max("segment").alias("_gone"))
    return rows.join(gone, "token_sha", "left").filter("_gone is null or _gone <= segment").drop("_gone")


def _whole(spark: SparkSession, at: str) -> DataFrame:
    """The tokens that count, with their terms; these are moved as one text, since an array takes twice its room in a shuffle."""
    rows = _table(spark, at, "tokens", TOKENS).withColumn("terms", F.array_join("terms", " "))  # a term holds no space
    return _live(rows, at).withColumn("terms", F.filter(F.split("terms", " "), lambda t: t != ""))


def buckets_of(spark: SparkSession, path: str) -> int:
    return spark.read.schema("buckets int, segment int").parquet(f"{_newest(spark, path)}/segments").agg(F.max("buckets")).first()[0]


def read(spark: SparkSession, path: str, asked: list[str] | None = None) -> DataFrame:
    """term, token_sha, module, length, positions of all terms, or of the ``asked`` ones, whose buckets alone are read."""
    at = _newest(spark, path)
    if asked is None:
        return _whole(spark, at).select("token_sha", "module", "length", F.inline(_each_term(F.col("terms")))).select("term", "token_sha", "module", "length", "positions")
    known = spark.range(1).select(F.explode(F.array(*(_bucket(F.lit(t), buckets_of(spark, path)) for t in asked)))).collect() if asked else []  # a row per asked term
    rows = _table(spark, at, "postings", POSTINGS).filter(F.col("bucket").isin([b[0] for b in known]) & F.col("term").isin(asked))

    def one(x: Column, k: Column) -> Column:
        start = F.coalesce(F.get("ends", k - 1), F.lit(0))
        return F.struct((F.col("base") + x).alias("id"), F.slice("places", start + 1, F.get("ends", k) - start).alias("positions"))

    each = rows.select("segment", "term", F.inline(F.transform("ids", one)))
    tokens = _live(_table(spark, at, "tokens", TOKENS), at)
    return each.join(tokens, ["segment", "id"]).select("term", "token_sha", "module", "length", "positions")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """n, total: tokens and terms of the index, in one row."""
    at = _newest(spark, path)
    return _live(_table(spark, at, "tokens", "token_sha string, length int, segment int"), at).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"))


def matches(spark: SparkSession, path: str, asked: list[list[str]]) -> DataFrame:
    """phrase (its number), token_sha, module, length, tf: how often each phrase stands in each token that has it."""
    places: dict[str, list[tuple[int, int]]] = {}
    for number, words in enumerate(asked):
        for k, word in enumerate(words):
            places.setdefault(word, []).append((number, k))
    if not places:
        return read(spark, path, []).select(F.lit(0).alias("phrase"), "token_sha", "module", "length", F.lit(0).alias("tf"))
    where = F.create_map(*(x for t, at in sorted(places.items()) for x in (F.lit(t), F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(k).alias("k")) for p, k in at)))))
    each = read(spark, path, sorted(places)).select("token_sha", "module", "length", "positions", F.inline(F.try_element_at(where, F.col("term"))))
    begins = F.transform("positions", lambda p: p - F.col("k")).alias("begins")
    met = each.select("phrase", "token_sha", "module", "length", begins).groupBy("phrase", "token_sha", "module", "length").agg(F.collect_list("begins").alias("all"))  # an array per term of the phrase
    common = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.col("all")[0], F.array_intersect)
    sizes = F.array(*(F.lit(len(p)) for p in asked))
    return met.filter(F.size("all") == sizes[F.col("phrase")]).select("phrase", "token_sha", "module", "length", F.size(common).alias("tf")).filter("tf > 0")


def search(spark: SparkSession, path: str, query: str, module: str | None = None, most: int = 30, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """token_sha, module, score, position, seed_rank of the ``most`` best tokens that have any of the query's words, each word a phrase of its terms.

    BM25 over phrases, whose inverse frequency is at least LEAST_IDF; frequencies and lengths are those of the whole index, whatever the module.
    Ties go to the smaller token_sha. A query without terms gives no rows. Only the buckets of the asked terms and the keys and lengths of tokens are read.
    """
    found = matches(spark, path, phrases(query))
    seen = found.groupBy("phrase").agg(F.count("*").alias("df"))
    rows = found.join(F.broadcast(seen), "phrase").crossJoin(F.broadcast(totals(spark, path)))  # a row per asked phrase; one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") * F.col("n") / F.col("total")))
    chosen = rows if module is None else rows.filter(F.col("module") == module)
    top = chosen.groupBy("token_sha", "module").agg(F.round(F.sum(part), 9).alias("score")).orderBy(F.desc("score"), "token_sha").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "token_sha"))  # at most ``most`` rows
    return top.withColumn("position", rank).withColumn("seed_rank", 1 / F.col("position"))


def apply_batch(path: str, changes: DataFrame, number: int) -> bool:
    """Takes changes (token_sha, module, content, deleted, version) into the index as segment ``number`` (from 1); whether it did so.

    Of a token's changes the greatest version counts; its earlier postings go, and unless it is deleted its new ones come. A number that is run again writes the
    same segment again; one that a compaction has taken in already changes nothing. A token that was never there may be deleted.
    """
    spark = changes.sparkSession
    at = _newest(spark, path)
    first = spark.read.schema("buckets int, segment int").parquet(f"{at}/segments").agg(F.min("segment"), F.max("buckets")).first()
    if number <= first[0]:
        return False
    last = changes.groupBy("token_sha").agg(F.max(F.struct("version", "deleted", "module", "content")).alias("c")).select("token_sha", "c.*").persist()
    new = last.filter("not coalesce(deleted, false)")
    _write_segment(at, number, first[1], cut_terms(new), last.select("token_sha"))
    last.unpersist()
    return True


def compact(spark: SparkSession, path: str) -> int:
    """Writes what counts now as the one segment of the next generation, under the number of the last one merged; that number.

    Until its last table is written readers keep the old generation. Run it between batches.
    """
    number = _generations(spark, path)[0]
    at = f"{path}/g{number}"
    last, buckets = spark.read.schema("buckets int, segment int").parquet(f"{at}/segments").agg(F.max("segment"), F.max("buckets")).first()
    tokens = _whole(spark, at)
    _write_segment(f"{path}/g{number + 1}", last, buckets, tokens, tokens.select("token_sha").filter("false"))
    return last


def keep_up(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Applies a stream of changes, as ``apply_batch`` takes them, to the index: a segment per micro-batch, so that a batch that is run again doubles nothing."""

    def one(batch: DataFrame, number: int) -> None:
        apply_batch(path, batch, number + 1)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
