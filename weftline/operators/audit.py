"""Self-checks of a token store, and projections of what an app lacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphan_tokens(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """Tokens at neither end of a hierarchy edge."""
    ends = edges.filter("rel_type = 'HIERARCHY'")
    known = ends.select(F.col("source_sha").alias("token_sha")).union(ends.select("target_sha")).distinct()
    return tokens.join(known, "token_sha", "left_anti")


def broken_references(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    asked = edges.filter(F.col("rel_type").isin("CROSS_REFERENCE", "CROSS_MODULE"))
    return asked.join(tokens.select(F.col("token_sha").alias("target_sha")), "target_sha", "left_anti")


def uncovered_names(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """Catalogued names (name) that stand as a word in no content, ignoring case."""
    words = tokens.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(\w+)"), F.lit(1)))).alias("word")).distinct()
    return names.join(words, F.lower("name") == F.col("word"), "left_anti").select("name")


def signatures(tokens: DataFrame) -> DataFrame:
    """token_sha, function, n_params of the first ``name(params)`` of each signature token."""
    found = tokens.filter("content_type = 'SIGNATURE'").select(
        "token_sha", F.lower(F.regexp_extract("content", r"(\w+)\s*\(([^)]*)\)", 1)).alias("function"), F.regexp_extract("content", r"(\w+)\s*\(([^)]*)\)", 2).alias("params")
    )
    return found.filter("function <> ''").select("token_sha", "function", F.size(F.filter(F.split("params", ","), lambda p: F.trim(p) != "")).alias("n_params"))


def inconsistent_signatures(tokens: DataFrame) -> DataFrame:
    """Functions with more than one number of parameters."""
    found = signatures(tokens).groupBy("function").agg(F.array_sort(F.collect_set("n_params")).alias("counts"), F.count("*").alias("n_tokens"))
    return found.filter(F.size("counts") > 1).select("function", F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"), "n_tokens")


def widest_overloads(tokens: DataFrame) -> DataFrame:
    return signatures(tokens).groupBy("function").agg(F.max("n_params").alias("n_params"))


# fixed values: what a transition's name says of its weight, and words of financial and approval apps
_GRAVE, _SERIOUS = r"approve|reject|escalate|payment|invoice|process", r"submit|close|cancel|return"
_MONEY, _APPROVAL = ("expense", "invoice", "payment", "amount", "currency"), ("approval", "approve", "blueprint")


def _any(column: str, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(column), F.lit(w)) for w in words))


def _gap(projection: str, severity: float, entity: Column, cond: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(projection).alias("projection"), entity.cast("string").alias("entity"), F.lit(severity).alias("severity")))


def _gaps(rows: DataFrame, gaps: list[Column]) -> DataFrame:
    return rows.select("app", F.explode(F.filter(F.array(*gaps), lambda g: g.isNotNull())).alias("g")).select("app", "g.*")


def app_gaps(apps: DataFrame, forms: DataFrame, transitions: DataFrame, scripts: DataFrame) -> DataFrame:
    """app, projection, entity, severity of what apps lack.

    apps: app, overview, n_pages, n_blueprints; forms: app, form, fields; transitions: app, transition; scripts: app,
    script, code. Flags are gathered once per app, so each rule is a column.
    """
    code = scripts.groupBy("app").agg(
        *(F.max(F.contains(F.lower("code"), F.lit(text))).alias(flag) for flag, text in (("on_validate", "on validate"), ("cancels", "cancel submit"), ("duplicate", "duplicate"), ("popia", "popia"), ("consent", "consent"))),
        F.max(_any("code", ("receipt", "document"))).alias("receipt"),
        F.max(_any("code", ("self", "same", "segregation"))).alias("segregated"),
        F.count("*").alias("n_scripts"),
    )
    stateful = forms.groupBy("app").agg(F.max(_any("fields", ("status",)) & _any("fields", ("picklist", "dropdown"))).alias("stateful"))
    whole = apps.join(code, "app", "left").join(stateful, "app", "left")

    def absent(flag: str) -> Column:
        return ~F.coalesce(F.col(flag), F.lit(False))

    money, approval = _any("overview", _MONEY), _any("overview", _APPROVAL)
    none = F.coalesce("n_scripts", F.lit(0)) == 0
    of_app = _gaps(whole, [
        _gap("structural_completeness", 2.0, F.col("app"), F.col("stateful") & (F.col("n_blueprints") == 0)),
        _gap("structural_completeness", 1.5, F.col("app"), (F.col("n_pages") == 0) & ~_any("overview", ("page", "dashboard"))),
        _gap("audit_trail", 2.0, F.col("app"), none & (F.col("n_blueprints") > 0)),
        _gap("notification", 1.5, F.col("app"), none & (F.col("n_blueprints") > 0)),
        _gap("compliance", 1.5, F.lit("receipt"), money & absent("receipt")),
        _gap("compliance", 1.0, F.lit("duplicate"), money & absent("duplicate")),
        _gap("compliance", 1.5, F.lit("segregation"), (approval | (F.col("n_blueprints") > 0)) & absent("segregated")),
        _gap("compliance", 0.5, F.lit("consent"), (approval | (F.col("n_blueprints") > 0)) & absent("popia") & absent("consent")),
    ])
    named = forms.join(scripts.select("app", "code"), "app", "left").groupBy("app", "form").agg(F.coalesce(F.max(F.contains("code", F.col("form"))), F.lit(False)).alias("named"))
    checked = named.join(code.select("app", "on_validate", "cancels"), "app", "left")
    valid = ~absent("on_validate") & F.col("named")
    of_form = _gaps(checked, [_gap("form_validation", 2.0, F.col("form"), ~valid), _gap("form_validation", 1.0, F.col("form"), valid & absent("cancels"))])
    done = transitions.join(scripts.select("app", "code"), "app", "left").groupBy("app", "transition").agg(F.coalesce(F.max(F.contains("code", F.col("transition"))), F.lit(False)).alias("done"))
    name = F.lower("transition")
    of_transition = _gaps(done, [
        _gap("transition_logic", 2.0, F.col("transition"), ~F.col("done") & name.rlike(_GRAVE)),
        _gap("transition_logic", 1.5, F.col("transition"), ~F.col("done") & ~name.rlike(_GRAVE) & name.rlike(_SERIOUS)),
        _gap("transition_logic", 1.0, F.col("transition"), ~F.col("done") & ~name.rlike(_GRAVE) & ~name.rlike(_SERIOUS)),
    ])
    low = F.lower("code")
    moves = F.contains(low, F.lit("input.status")) | F.contains(low, F.lit(".status ="))
    logged = F.contains(low, F.lit("insert into")) & _any("code", ("approval_history", "audit", "history"))
    mails = F.contains(low, F.lit("sendmail"))
    of_script = _gaps(scripts, [
        _gap("audit_trail", 1.5, F.col("script"), moves & ~logged),
        _gap("notification", 1.0, F.col("script"), moves & ~(mails | _any("code", ("cliq", "pushnotify")))),
        _gap("error_handling", 1.0, F.col("script"), F.col("code").rlike(r"\w+\[.+==.+\]") & ~F.col("code").rlike(r"!= null|ifnull|!= void")),
        _gap("error_handling", 0.5, F.col("script"), mails & ~F.contains(low, F.lit("zoho.adminuser"))),
    ])
    return reduce(DataFrame.unionByName, (of_app, of_form, of_transition, of_script))


def app_residual(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("app").agg(F.count("*").alias("n_gaps"), F.round(F.sum("severity"), 6).alias("residual"))
