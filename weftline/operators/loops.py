"""Loops, attempts and cancellation of scripts over rows: bounded repetition, results apart from rejected rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.lineage import cut

MOST = 10_000  # fixed value: repetitions of a loop


def repeat_while(rows: DataFrame, state: list[str], going: Callable[[Column], Column], step: Callable[[Column], dict[str, Column]], most: int = MOST) -> DataFrame:
    """``rows`` with the columns of ``state`` as a loop leaves them, steps, and outcome: done, limit where the condition still holds after ``most`` steps, failed where it became null.

    ``going`` tells from the state, a struct, whether the loop goes on, ``step`` gives the state's new values. Rows are folded over a first step, then two, four and
    so on; only those that go on enter the next fold, so a loop of n steps takes log n passes and a row that ends early costs little. Other columns stay; columns named steps and outcome are replaced.
    """
    others = [c for c in rows.columns if c not in (*state, "steps", "outcome")]
    types = {f.name: f.dataType for f in rows.schema.fields}
    now = rows.select(*others, F.struct(F.struct(*state).alias("s"), F.lit(0).alias("n")).alias("_loop"))

    def once(loop: Column, _: Column) -> Column:
        new = step(loop["s"])
        moved = F.struct(F.struct(*(F.coalesce(new[c].cast(types[c]), F.lit(None)).alias(c) if c in new else loop["s"][c].alias(c) for c in state)).alias("s"), (loop["n"] + 1).alias("n"))
        return F.when(F.coalesce(going(loop["s"]), F.lit(False)), moved).otherwise(loop)

    parts, taken, size = [], 0, 1
    while taken < most:
        width = min(size, most - taken)
        now = now.withColumn("_loop", F.aggregate(F.sequence(F.lit(1), F.lit(width)), F.col("_loop"), once)).withColumn("_on", going(F.col("_loop.s")))
        now = cut(now)
        taken, size = taken + width, size * 2
        parts.append(now.filter("not coalesce(_on, false)"))
        now = now.filter("_on").drop("_on")
        if now.isEmpty():
            break
    out = now.withColumn("_on", F.lit(True))
    for part in parts:
        out = out.unionByName(part)
    outcome = F.when(F.col("_on"), "limit").when(F.col("_on").isNull(), "failed").otherwise("done")
    return out.select(*others, *(F.col(f"_loop.s.{c}").alias(c) for c in state), F.col("_loop.n").alias("steps"), outcome.alias("outcome"))


def tried(rows: DataFrame, attempt: dict[str, Column], reason: str) -> tuple[DataFrame, DataFrame]:
    """(results, rejected): rows with the attempted columns where all of them have a value, and the rows as they came, with ``reason``, where one failed.

    Attempts are expressions that give null where they fail (``try_divide``, ``try_cast`` and the like); both parts read them from one projection.
    """
    done = rows.withColumns({f"_try_{c}": v for c, v in attempt.items()})
    good = F.lit(True)
    for c in attempt:
        good = good & F.col(f"_try_{c}").isNotNull()
    plain = [c for c in rows.columns if c not in attempt]
    return done.filter(good).select(*plain, *(F.col(f"_try_{c}").alias(c) for c in attempt)), done.filter(~good).select(*rows.columns, F.lit(reason).alias("reason"))


def cancelled(rows: DataFrame, when: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rows that a script cancels are rejected with ``reason``; a condition that is null cancels nothing."""
    hit = F.coalesce(when, F.lit(False))
    return rows.filter(~hit), rows.filter(hit).withColumn("reason", F.lit(reason))
