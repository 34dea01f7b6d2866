"""Script rules that look beyond a line: blocks of tasks, bound variables, calls, files; and rules over apps' entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what the rules ask for
REQUIRED = {"sendmail": ("from", "to", "subject", "message"), "invokeurl": ("url", "type")}
ADDED_USERS = ("zoho.loginuser", "zoho.adminuser")
THRESHOLDS = (999.99, 5000.0)
AUDIT_FORM, AUDIT_WORDS = "approval_history", "history|audit|log"
NO_CALLS = ("if", "else", "for", "while", "info", "alert", "return", "insert", "sendmail", "invokeurl", "openurl", "each")
RESPONSE_LINES = 10


def stripped(text: Column) -> Column:
    """A line without its ``//`` comment; slashes between double quotes stay."""
    return F.when(F.contains(text, F.lit("//")), F.regexp_extract(text, r'^((?:[^"/]|"[^"]*"|/(?!/)|"[^"]*$)*)', 1)).otherwise(text)


def _found(df: DataFrame, rule: str, severity: str, message: Column, line: Column | None = None) -> DataFrame:
    return df.select("file", (F.col("line") if line is None else line).cast("int").alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def blocks(lines: DataFrame) -> DataFrame:
    """file, block, kind (insert, sendmail, invokeurl), target, first, last, fields (name, value, mark, line), raw, answered of the blocks of tasks.

    A block goes from its opening line to the next line with ``]``; it is answered if one of the next ``RESPONSE_LINES`` lines looks at a
    response code. Lines (file, line, text) of a file are windows, all over one shuffle by file.
    """
    text = stripped(F.col("text"))
    kind = F.lower(F.regexp_extract(text, r"(?i)^\s*(insert(?=\s+into\s+\w)|sendmail\b|invokeurl\b)", 1))
    file = Window.partitionBy("file").orderBy("line")
    answered = F.coalesce(F.max(F.contains(F.lower("said"), F.lit("responsecode"))).over(file.rowsBetween(1, RESPONSE_LINES)), F.lit(False))
    rows = lines.select("file", "line", text.alias("text"), F.col("text").alias("said"), kind.alias("kind")).withColumns({"block": F.sum((F.col("kind") != "").cast("int")).over(file), "answered": answered}).filter("block > 0")
    inside = Window.partitionBy("file", "block").orderBy("line")
    ends = F.sum(F.contains("text", F.lit("]")).cast("int"))
    rows = rows.withColumn("closed", F.coalesce(ends.over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("closed = 0")
    parts = [F.regexp_extract("text", r'^\s*"?([\w\-]+)"?\s*([=:])\s*(.*?)[,;]?\s*$', i) for i in (1, 3, 2)]
    field = F.when((F.col("kind") == "") & (parts[0] != ""), F.struct(parts[0].alias("name"), F.trim(parts[1]).alias("value"), parts[2].alias("mark"), F.col("line").cast("int").alias("line")))
    return rows.groupBy("file", "block").agg(
        F.max("kind").alias("kind"), F.max(F.regexp_extract("text", r"(?i)^\s*insert\s+into\s+(\w+)", 1)).alias("target"), F.min("line").alias("first"), F.max("line").alias("last"),
        F.array_sort(F.collect_list(field)).alias("fields"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), "\n").alias("raw"),
        F.max_by("answered", "line").alias("answered"),
    )


def _value(name: str) -> Column:
    """The value of a block's field, null without it."""
    return F.get(F.filter("fields", lambda f: F.lower(f["name"]) == name.lower()), F.lit(0))["value"]


def _line(name: str) -> Column:
    return F.get(F.filter("fields", lambda f: F.lower(f["name"]) == name.lower()), F.lit(0))["line"]


def block_rules(lines: DataFrame, forms: DataFrame, actions: list[str]) -> DataFrame:
    """DG006, DG007, DG009, DG010, DG012, DG022, DG026 and DG027 over the blocks of ``lines``; ``forms`` (form) are the known ones.

    Lines are shuffled once, by file; a block's diagnostics are one array, so the blocks are computed once for all rules.
    """
    known = forms.select(F.lower("form").alias("key")).distinct().withColumn("is_known", F.lit(True))
    b = blocks(lines).withColumn("key", F.lower("target")).join(known, "key", "left")
    b = b.withColumns({"added": _value("Added_User"), "action": _value("action_1"), "sender": _value("from")})
    first, last = F.col("first"), F.col("last")
    insert, web = F.col("kind") == "insert", F.col("kind") == "invokeurl"
    audit = insert & (F.col("target") == AUDIT_FORM)
    logs = insert & F.col("key").rlike(AUDIT_WORDS)
    action = F.regexp_replace("action", '^"|"$', "")

    def one(rule: str, severity: str, cond: Column, message: Column, line: Column) -> Column:
        found = F.struct(line.cast("int").alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))
        return F.when(F.coalesce(cond, F.lit(False)), F.array(found)).otherwise(F.array().cast("array<struct<line:int,rule:string,severity:string,message:string>>"))

    def colon(f: Column) -> Column:
        return F.struct(f["line"].alias("line"), F.lit("DG009").alias("rule"), F.lit("ERROR").alias("severity"), F.concat(F.lit("colon after "), f["name"]).alias("message"))

    found = F.concat(
        one("DG006", "ERROR", audit & F.col("added").isNull(), F.lit("no Added_User"), first),
        one("DG007", "ERROR", audit & ~F.col("added").isin(*ADDED_USERS), F.concat(F.lit("Added_User is "), "added"), _line("Added_User")),
        F.transform(F.filter("fields", lambda f: insert & (f["mark"] == ":")), colon),
        *(one("DG010", "ERROR", (F.col("kind") == kind) & _line(want).isNull(), F.lit(f"{kind} without {want}"), first) for kind, wanted in REQUIRED.items() for want in wanted),
        one("DG012", "WARNING", audit & ~F.contains("action", F.lit("+")) & ~action.isin(*actions), F.concat(F.lit("unknown action "), action), _line("action_1")),
        one("DG022", "WARNING", insert & F.col("is_known").isNull(), F.concat(F.lit("unknown form "), "target"), first),
        one("DG026", "WARNING", (F.col("kind") == "sendmail") & ~F.contains(F.lower("sender"), F.lit("zoho.adminuserid")), F.lit("sender"), first),
        one("DG026", "WARNING", logs & _value("actor").isNull() & F.col("added").isNull(), F.lit("no actor"), first),
        one("DG026", "INFO", logs & _value("timestamp").isNull(), F.lit("no timestamp"), first),
        one("DG027", "INFO", web & ~F.lower("raw").rlike("content[-_]type"), F.lit("no content type"), first),
        one("DG027", "WARNING", web & ~F.col("answered"), F.lit("response not checked"), last),
    )
    return b.select("file", F.inline(found))


def bindings(lines: DataFrame) -> DataFrame:
    """file, variable, form, line of each first ``variable = Form[...]``."""
    text = stripped(F.col("text"))
    found = lines.select("file", "line", F.regexp_extract(text, r"^\s*(\w+)\s*=\s*(\w+)\s*\[.*\]", 1).alias("variable"), F.regexp_extract(text, r"^\s*(\w+)\s*=\s*(\w+)\s*\[.*\]", 2).alias("form"))
    return found.filter("variable <> ''").groupBy("file", "variable").agg(F.min("line").alias("bound"), F.min_by("form", "line").alias("form"))


def guards(lines: DataFrame) -> DataFrame:
    """file, variable, line, end of every ``v == null`` or ``v != null``: the guard holds from its line up to ``end``, the first later line that ends less deep in braces; null: to the end of the file.

    A line whose depth falls from p to q closes the levels q + 1 to p, so a guard's end is the next close of its own level: an as-of join by file and level.
    """
    deep = _deep(lines).select("file", "line", "text", "braces")
    fell = deep.withColumn("before", F.lag("braces", 1, 0).over(Window.partitionBy("file").orderBy("line"))).filter("braces < before")
    closed = fell.select("file", F.explode(F.sequence(F.col("braces") + 1, F.col("before"))).alias("level"), "line", F.lit(None).cast("string").alias("variable"), F.col("line").alias("close"))
    variables = F.array_distinct(F.regexp_extract_all(stripped(F.col("text")), F.lit(r"\b(\w+)\s*[!=]=\s*null\b"), F.lit(1)))
    opened = deep.select("file", F.col("braces").alias("level"), "line", F.explode(variables).alias("variable"), F.lit(None).cast(closed.schema["close"].dataType).alias("close"))
    later = Window.partitionBy("file", "level").orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    ends = opened.unionByName(closed).withColumn("end", F.min("close").over(later))
    return ends.filter("variable is not null").select("file", "variable", "line", "end")


def unguarded(lines: DataFrame, bound: DataFrame, uses: DataFrame) -> DataFrame:
    """The ``uses`` (file, variable, line) that no guard's scope encloses; guards count from the line on which their variable is bound (file, variable, bound).

    The farthest end of the guards up to a use is a running maximum by file and variable: a scope encloses the use if that lies behind it.
    """
    far = F.lit(1 << 40)
    spans = guards(lines).join(bound.hint("merge"), ["file", "variable"]).filter("line >= bound").select("file", "variable", "line", F.coalesce("end", far).cast("long").alias("end"), F.lit(False).alias("use"))
    both = uses.select("file", "variable", "line").distinct().select("*", F.lit(None).cast("long").alias("end"), F.lit(True).alias("use")).unionByName(spans)
    reach = F.max("end").over(Window.partitionBy("file", "variable").orderBy("line"))  # with equal lines: a use on the guard's own line is inside
    return both.withColumn("reach", F.coalesce(reach, F.lit(0))).filter("use and reach <= line").select("file", "variable", "line")


def variable_rules(lines: DataFrame, fields: DataFrame, keys: DataFrame) -> DataFrame:
    """DG005, DG023 and DG024 over variables bound to form queries.

    DG005: used as ``v.field`` outside the scope of every guard, as ``unguarded`` has them, once per variable. DG023: an insert gives a foreign key (keys: form, field, parent) the
    ID of a record of another form. DG024: a field that the form (fields: form, field) hasn't; forms without known fields pass.
    """
    text = stripped(F.col("text"))
    uses = lines.select("file", "line", F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(r"\b(\w+)\.(\w+)"), F.lit(1)).alias("variable"), F.regexp_extract_all(text, F.lit(r"\b(\w+)\.(\w+)"), F.lit(2)).alias("field"))).alias("u")).select("file", "line", "u.variable", "u.field")
    bound = bindings(lines)
    bound = bound.hint("merge")  # grows with the lines, which Spark takes for far fewer: never sent to the driver
    used = uses.join(bound, ["file", "variable"]).filter("line > bound")
    bare = unguarded(lines, bound, used).groupBy("file", "variable").agg(F.min("line").alias("line"))
    known = fields.select(F.lower("form").alias("f"), F.lower("field").alias("k")).distinct()
    # forms' fields and keys are a schema, and few forms have most lines
    lost = used.withColumns({"f": F.lower("form"), "k": F.lower("field")}).join(F.broadcast(known.select("f").distinct()), "f", "left_semi").join(F.broadcast(known), ["f", "k"], "left_anti").filter("k <> 'id'")
    given = blocks(lines).filter("kind = 'insert'").select("file", F.lower("target").alias("f"), F.explode("fields").alias("x")).select("file", "f", F.lower("x.name").alias("k"), F.regexp_extract("x.value", r"^(\w+)\.ID$", 1).alias("variable"), F.col("x.line").alias("line"))
    wanted = keys.select(F.lower("form").alias("f"), F.lower("field").alias("k"), "parent")
    wrong = given.filter("variable <> ''").join(F.broadcast(wanted), ["f", "k"]).join(bound, ["file", "variable"]).filter(F.lower("parent") != F.lower("form"))
    return _all([
        _found(bare, "DG005", "ERROR", F.concat(F.lit("no null check of "), F.col("variable"))),
        _found(wrong, "DG023", "WARNING", F.concat_ws(" ", F.col("k"), F.lit("wants"), "parent", F.lit("not"), "form")),
        _found(lost, "DG024", "WARNING", F.concat_ws(".", "form", "field")),
    ])


_TOKEN = r'("[^"]*"|[A-Za-z_]\w*\s*\(|[(\[{]|[)\]}]|,|[^"A-Za-z_()\[\]{},]+|[A-Za-z_]\w*|")'


def calls_of(text: Column) -> Column:
    """The calls of a line as an array of (name, args), inner calls before outer ones: names in lower case, arguments as they are written.

    A fold over the line's tokens keeps a stack of what is open, so commas in brackets, inner calls and strings part no arguments. Calls that don't close on the line drop out.
    """
    frame, call = "struct<name:string,args:array<string>,cur:string>", "struct<name:string,args:array<string>>"
    start = F.struct(F.array().cast(f"array<{frame}>").alias("open"), F.array().cast(f"array<{call}>").alias("done"))

    def grown(frames: Column, token: Column) -> Column:
        return F.transform(frames, lambda f: F.struct(f["name"].alias("name"), f["args"].alias("args"), F.concat(f["cur"], token).alias("cur")))

    def step(state: Column, token: Column) -> Column:
        open_, done = state["open"], state["done"]
        empty = F.size(open_) == 0
        top = F.element_at(open_, -1)
        below = grown(F.slice(open_, 1, F.greatest(F.size(open_) - 1, F.lit(0))), token)
        last = F.trim(top["cur"])
        args = F.when((F.size(top["args"]) == 0) & (last == ""), top["args"]).otherwise(F.concat(top["args"], F.array(last)))
        name = F.when(token.endswith("(") & (F.length(token) > 1), F.lower(F.regexp_extract(token, r"^\w+", 0))).otherwise("")
        pushed = F.concat(grown(open_, token), F.array(F.struct(name.alias("name"), F.array().cast("array<string>").alias("args"), F.lit("").alias("cur"))))
        parted = F.concat(below, F.array(F.struct(top["name"].alias("name"), F.concat(top["args"], F.array(last)).alias("args"), F.lit("").alias("cur"))))
        closes = token.isin(")", "]", "}")
        next_open = F.when(token.rlike(r"[(\[{]$") & ~token.startswith('"'), pushed).when(empty, open_).when(closes, below).when(token == ",", parted).otherwise(grown(open_, token))
        found = F.concat(done, F.array(F.struct(top["name"].alias("name"), args.alias("args"))))
        return F.struct(next_open.alias("open"), F.when(closes & ~empty & (top["name"] != ""), found).otherwise(done).alias("done"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1)), start, step, lambda state: state["done"])


def file_rules(lines: DataFrame, variables: list[str], banned: list[str], signatures: DataFrame) -> DataFrame:
    """DG002, DG014, DG018, DG020, DG021 and DG025 line by line and file by file; signatures: function, n_params (the widest)."""
    rows = lines.select("file", "line", stripped(F.col("text")).alias("text"))
    names = F.regexp_extract_all("text", F.lit(r"\b(zoho\.\w+(?:\.\w+)*)"), F.lit(1))
    sides = F.split("text", "=", 2)
    left, right = F.lower(F.trim(F.get(sides, F.lit(0)))), F.trim(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    assigned = F.when(F.element_at(F.split(left, r"\W+"), -1).startswith("threshold"), F.regexp_extract(right, r"^[0-9][0-9.]*", 0))
    low = F.lower("text")
    # calls are read where a function name stands before a bracket only, and fallbacks where a threshold is named
    second = F.transform(F.filter(calls_of(F.col("text")), lambda c: (c["name"] == "ifnull") & (F.size(c["args"]) == 2)), lambda c: F.get(c["args"], F.lit(1)))
    fallbacks = F.when(F.contains(low, F.lit("ifnull")), second).otherwise(F.array().cast("array<string>"))
    numbers = F.array_distinct(F.filter(F.transform(F.concat(F.array(assigned), fallbacks), lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~x.isin(*THRESHOLDS)))
    api = F.contains("file", F.lit("custom_api"))
    task = F.regexp_extract("text", r"(?i)\b(alert\b|cancel\s+submit\b)", 1)

    def one(rule: str, severity: str, message: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))

    def named(rule: str, severity: str, cond, said: str) -> Column:
        return F.transform(F.filter(names, cond), lambda x: one(rule, severity, F.concat(F.lit(said), x)))

    by_line = F.concat(
        named("DG002", "ERROR", lambda x: x.isin(*banned), "banned "), named("DG018", "WARNING", lambda x: ~x.isin(*variables, *banned), "unknown "),
        F.when(api & (task != ""), F.array(one("DG021", "ERROR", F.concat(F.lit("form task "), F.regexp_replace(task, r"\s+", " "))))).otherwise(F.array()),
    )
    thresholds = rows.filter(F.contains(low, F.lit("threshold"))).select("file", "line", F.explode(numbers).alias("x")).distinct()
    maps = rows.filter(api).groupBy("file").agg(F.max(F.col("text").rlike(r"\bMap\s*\(\s*\)|\.put\s*\(")).alias("has"))
    n = F.size("args")
    called = rows.filter(F.col("text").rlike(r"\w\s*\(")).select("file", "line", F.inline(calls_of(F.col("text")))).withColumnRenamed("name", "function")
    arity = called.filter(~F.col("function").isin(*NO_CALLS)).join(F.broadcast(signatures), "function").withColumn("n", n).filter("n > n_params")  # a row per known function
    return _all([
        rows.select("file", F.col("line").cast("int").alias("line"), F.inline(by_line)),
        _found(thresholds, "DG014", "WARNING", F.concat(F.lit("threshold "), F.col("x").cast("string"))),
        _found(maps.filter(~F.col("has")), "DG020", "WARNING", F.lit("no response map"), F.lit(1)),
        _found(arity, "DG025", "WARNING", F.concat_ws(" ", "function", F.col("n").cast("string"), F.lit("of"), F.col("n_params").cast("string"))),
    ])


def _deep(lines: DataFrame) -> DataFrame:
    """file, line, text, braces, parens of each line."""
    text = F.regexp_replace(stripped(F.col("text")), r'"[^"]*"', "")

    def net(opens: str, closes: str) -> Column:
        return F.length(F.regexp_replace(text, rf"[^\{opens}]", "")) - F.length(F.regexp_replace(text, rf"[^\{closes}]", ""))

    order = Window.partitionBy("file").orderBy("line")
    return lines.select("file", "line", "text", F.sum(net("{", "}")).over(order).alias("braces"), F.sum(net("(", ")")).over(order).alias("parens"))


def depths(lines: DataFrame) -> DataFrame:
    """file, line, braces, parens: how deep each line ends, strings and comments apart."""
    return _deep(lines).drop("text")


def builder_rules(lines: DataFrame, fields: DataFrame, forms: DataFrame) -> DataFrame:
    """DS001 and DS002: braces and parentheses of a file that don't close; DS003: a script's insert names no form; DS004: a form has a field twice; DS005: a choice field without choices.

    fields: form, field, kind, choices; forms: form.
    """
    deep = depths(lines).groupBy("file").agg(F.max_by("braces", "line").alias("braces"), F.max_by("parens", "line").alias("parens"), F.max("line").alias("line"))
    known = F.broadcast(forms.select(F.col("form").alias("target")).distinct())  # a schema's forms: most inserts name few of them, so a shuffle by target would be one task's
    unknown = blocks(lines).filter("kind = 'insert'").join(known, "target", "left_anti")
    twice = fields.groupBy("form", "field").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("form").alias("file"), F.lit(0).alias("line"), "field")
    bare = fields.filter((F.col("kind").isin("picklist", "radio", "dropdown")) & (F.coalesce(F.col("choices"), F.lit("")) == "")).select(F.col("form").alias("file"), F.lit(0).alias("line"), "field")
    return _all([
        _found(deep.filter("braces <> 0"), "DS001", "ERROR", F.concat(F.lit("braces "), F.col("braces").cast("string"))),
        _found(deep.filter("parens <> 0"), "DS002", "ERROR", F.concat(F.lit("parentheses "), F.col("parens").cast("string"))),
        _found(unknown, "DS003", "ERROR", F.concat(F.lit("unknown form "), F.col("target")), F.col("first")),
        _found(twice, "DS004", "ERROR", F.concat(F.lit("field twice: "), F.col("field"))),
        _found(bare, "DS005", "WARNING", F.concat(F.lit("no choices: "), F.col("field"))),
    ])


def export_rules(forms: DataFrame, fields: DataFrame, reports: DataFrame, columns: DataFrame, workflows: DataFrame, menus: DataFrame, references: DataFrame) -> DataFrame:
    """DS201 to DS210, DS301 and DS304 over an app's entities, as anti-joins.

    forms: form; fields: form, field; reports: report, form, kind, options; columns: report, field; workflows: workflow, form; menus: device
    (web, phone, tablet), kind (form, report), name; references: script, form, field of script lines.
    """
    file, line = F.lit("app").alias("file"), F.lit(0).alias("line")
    known, have = forms.select("form").distinct(), fields.select("form", "field").distinct()

    def lost(df: DataFrame, rule: str, severity: str, message: Column) -> DataFrame:
        return _found(df.select(file, line, message.alias("m")), rule, severity, F.col("m"))

    shown = columns.join(reports.select("report", "form"), "report")
    names = known.select(F.lit("form").alias("kind"), F.col("form").alias("name")).unionByName(reports.select(F.lit("report").alias("kind"), F.col("report").alias("name"))).distinct()
    bad_menu = menus.join(names, ["kind", "name"], "left_anti")
    listed = names.select("*", F.explode(F.array(F.lit("web"), F.lit("phone"), F.lit("tablet"))).alias("device"))
    absent = listed.join(menus.select("device", "kind", "name"), ["device", "kind", "name"], "left_anti")
    asked = references.join(known, "form", "left_semi").join(have, ["form", "field"], "left_anti")
    near = have.select("form", F.lower("field").alias("low")).distinct()
    cased = asked.withColumn("low", F.lower("field"))
    both = F.concat_ws(".", "form", "field")
    return _all([
        lost(reports.join(known, "form", "left_anti"), "DS201", "ERROR", F.concat_ws(" -> ", "report", "form")),
        lost(workflows.join(known, "form", "left_anti"), "DS202", "ERROR", F.concat_ws(" -> ", "workflow", "form")),
        lost(bad_menu.filter("device = 'web'"), "DS203", "ERROR", F.concat_ws(" ", "kind", "name")),
        lost(bad_menu.filter("device <> 'web'"), "DS204", "ERROR", F.concat_ws(" ", "device", "kind", "name")),
        lost(reports.filter("kind = 'kanban' and coalesce(options, '') = ''"), "DS205", "WARNING", F.col("report")),
        lost(shown.join(have, ["form", "field"], "left_anti"), "DS206", "ERROR", F.concat_ws(".", "report", "field")),
        lost(absent.filter("device = 'web' and kind = 'form'"), "DS207", "WARNING", F.col("name")),
        lost(absent.filter("device = 'web' and kind = 'report'"), "DS208", "WARNING", F.col("name")),
        lost(absent.filter("device = 'phone'"), "DS209", "INFO", F.concat_ws(" ", "kind", "name")),
        lost(absent.filter("device = 'tablet'"), "DS210", "INFO", F.concat_ws(" ", "kind", "name")),
        lost(cased.join(near, ["form", "low"], "left_anti"), "DS301", "ERROR", F.concat_ws(" ", "script", both)),
        lost(cased.join(near, ["form", "low"], "left_semi"), "DS304", "WARNING", F.concat_ws(" ", "script", both)),
    ])


# fixed values: rules that triage knows, and words that make a message lintable
KNOWN_RULES = ("single-quote-string", "missing-null-guard", "loginuserrole-usage", "missing-added-user", "lpad-usage", "hoursBetween-usage", "threshold-value", "esg-missing", "carbon-factor-guard")
LINTABLE = ("ifnull", "zoho.", "input.", "insert into", "sendmail", "alert")


def triage(errors: DataFrame) -> DataFrame:
    """Errors (rule, message, ...) with is_new_pattern, category and confidence."""
    known = F.coalesce(F.col("rule").isin(*KNOWN_RULES), F.lit(False))
    low = F.lower(F.coalesce(F.col("message"), F.lit("")))
    lintable = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in LINTABLE))
    return errors.select(
        "*", (~known & lintable).alias("is_new_pattern"), F.when(known, "known_lint_rule").when(lintable, "potential_lint_rule").otherwise("generic_error").alias("category"), F.when(known, 1.0).when(lintable, 0.6).otherwise(0.3).alias("confidence")
    )


# fixed values: type pairs that lose something
MISMATCHES = {("CURRENCY", "Decimal"): "precision", ("BOOLEAN", "Checkbox"): "value mapping", ("DATETIME", "DateTime"): "time zone"}


def column_mapping(source: DataFrame, target: DataFrame) -> DataFrame:
    """table_name, column, field, mismatch: for each source column (table_name, column, type) the first target field (table_name, field, kind, place) whose name holds the column's without ID and _; null without one.

    Columns and fields meet within their table, so the join is on it.
    """
    plain = F.lower(F.replace(F.replace(F.col("column"), F.lit("ID"), F.lit("")), F.lit("_"), F.lit("")))
    name = F.lower(F.replace(F.col("field"), F.lit("_"), F.lit("")))
    met = source.join(target, "table_name").filter(F.contains(name, plain)).groupBy("table_name", "column").agg(F.min_by(F.struct("field", "kind"), "place").alias("best"))
    rows = source.join(met, ["table_name", "column"], "left").select("table_name", "column", "type", "best.field", "best.kind")
    out = F.lit(None).cast("string")
    for (a, b), what in MISMATCHES.items():
        out = F.when((F.col("type") == a) & (F.col("kind") == b), what).otherwise(out)
    return rows.select("table_name", "column", "field", out.alias("mismatch"))


def key_targets(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """AV006: columns X_ID (file, line, column) for which none of the tables (table_name) is X, Xs or Xes, ignoring case."""
    asked = columns.filter(F.upper("column").endswith("_ID") & (F.length("column") > 3)).withColumn("stem", F.substring(F.upper("column"), F.lit(1), F.length("column") - 3))
    known = tables.select(F.upper("table_name").alias("t")).distinct().select(F.explode(F.array_distinct(F.array("t", F.regexp_replace("t", "S$", ""), F.regexp_replace("t", "ES$", "")))).alias("stem")).distinct()
    return _found(asked.join(known, "stem", "left_anti"), "AV006", "ERROR", F.concat(F.lit("no table for "), F.col("column")))
