"""Form queries, reports, joins by foreign key, DML as new DataFrames, and aggregates over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.store import numbered


def form_query(form: DataFrame, criteria: Column | None = None) -> DataFrame:
    """``Form[criteria]``: the records that meet it; a null criterion is not met."""
    return form if criteria is None else form.filter(criteria)


def report(form: DataFrame, columns: dict[str, str], criteria: Column | None = None) -> DataFrame:
    """``show all rows``: field -> label."""
    return form_query(form, criteria).select(*(F.col(c).alias(label) for c, label in columns.items()))


def kanban(form: DataFrame, field: str) -> DataFrame:
    """Records per value of the board's field, null among them."""
    return form.groupBy(field).agg(F.count("*").alias("n_records"))


def dereferenced(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """The child's records with the parent's columns; a key without a parent gives nulls."""
    return child.join(parent, child[key] == parent[parent_key], "left")


def duplicates(form: DataFrame, name: str, key: str) -> DataFrame:
    """Records for which ``name == x && key != y`` finds another record. A shared name is counted once per name, not joined pair by pair."""
    seen = form.groupBy(name).agg(F.count_distinct(key).alias("n_same")).filter("n_same > 1")
    return form.join(seen, name)


def inserted(form: DataFrame, rows: DataFrame) -> DataFrame:
    return form.unionByName(rows, allowMissingColumns=True)


def deleted(form: DataFrame, where: Column) -> DataFrame:
    """Without the records that meet the criterion; those for which it is null stay."""
    return form.filter(~F.coalesce(where, F.lit(False)))


def updated(form: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return form.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def effects(rows: DataFrame, action: str, params: dict[str, Column], order: list[str], first: int = 1000) -> DataFrame:
    """The side effects of a loop over rows: seq, action, params. Nothing is performed. seq numbers all rows in order, range by range."""
    pairs = F.create_map(*(x for k, v in params.items() for x in (F.lit(k), v.cast("string"))))
    return numbered(rows.select(*order, pairs.alias("params")), order, "_i").select((F.col("_i") + first).cast("int").alias("seq"), F.lit(action).alias("action"), "params")


def domain(form: DataFrame, aggregate: Column, criteria: Column | None = None) -> DataFrame:
    """A domain aggregate (DSum, DCount, ...): one row, one value."""
    return form_query(form, criteria).agg(aggregate.alias("value"))


def statistics(form: DataFrame, by: list[str], value: str) -> DataFrame:
    """The catalogued statistics of a column per group."""
    v = F.col(value)
    return form.groupBy(*by).agg(
        F.count("*").alias("n_all"), F.sum(v).alias("total"), F.avg(v).alias("average"), F.median(v).alias("median"), F.min(v).alias("smallest"), F.max(v).alias("largest"),
        F.stddev_samp(v).alias("stdev"), F.stddev_pop(v).alias("stdevp"), F.var_samp(v).alias("var"), F.var_pop(v).alias("varp"),
    )


def first_last(form: DataFrame, by: list[str], value: str, order: Column) -> DataFrame:
    """First and Last of a column per group in the order of the records."""
    return form.groupBy(*by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def closest_name(names: DataFrame, catalog: list[str]) -> DataFrame:
    """name, suggestion: equal but for case, else the one catalogue name that holds or is held by it (both of 4 characters or more)."""
    known = F.array(*map(F.lit, catalog))
    low = F.lower("name")
    equal = F.get(F.filter(known, lambda k: F.lower(k) == low), F.lit(0))
    part = F.filter(known, lambda k: (F.length(k) >= 4) & (F.length(low) >= 4) & (F.contains(F.lower(k), low) | F.contains(low, F.lower(k))))
    return names.select("name", F.coalesce(equal, F.when(F.size(part) == 1, part[0])).alias("suggestion"))


def fuzzy_score(text: Column, query: str) -> Column:
    """Score of ``query`` as a subsequence of the text (ignoring case): 1 a character, 5 more if it follows the last match at once, 3 more at a word's start; null if it isn't one."""
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"), F.lit(True).alias("ok"), F.lit(-1).alias("last"))

    def step(acc: Column, c: Column) -> Column:
        found = F.call_function("locate", c, F.lower(text), acc["at"] + 1)
        before = F.substring(text, found - 1, F.lit(1))
        start = (found == 1) | before.rlike(r"[\s_\-./]")
        gain = F.lit(1) + F.when(found - 1 == acc["last"] + 1, 5).otherwise(0) + F.when(start, 3).otherwise(0)
        return F.struct(
            F.when(found > 0, found).otherwise(acc["at"]).alias("at"),
            (acc["score"] + F.when(found > 0, gain).otherwise(0)).alias("score"),
            (acc["ok"] & (found > 0)).alias("ok"),
            F.when(found > 0, found - 1).otherwise(acc["last"]).alias("last"),
        )

    end = F.aggregate(F.array(*(F.lit(c) for c in query.lower())), state, step)
    return F.when(end["ok"], end["score"])
