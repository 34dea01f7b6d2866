"""Rules that turn records, schemas and scripts into diagnostics: file, line, rule, severity, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.scripts import stripped

SCHEMA = "file string, line int, rule string, severity string, message string"
# fixed values: severities as numbers for totals, and longest values
SEVERITY = {"ERROR": 2.0, "WARNING": 1.0, "INFO": 0.2}
TEXT_MOST, MEMO_MOST = 255, 50_000


def diagnosed(rows: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """One row per rule (code, severity, condition, message) that holds on a row with file and line; all rules in one pass."""
    hits = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))) for code, severity, cond, message in rules))
    return rows.select("file", "line", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("file", "line", "h.rule", "h.severity", "h.message")


def cells(table: DataFrame, file: str, line: Column, types: dict[str, str]) -> DataFrame:
    """file, line, column, value, type: a table of text unpivoted to its typed columns."""
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.lit(t).alias("type")) for c, t in types.items()))
    return table.select(F.lit(file).alias("file"), line.cast("int").alias("line"), F.explode(parts).alias("x")).select("file", "line", "x.*")


def value_rules(values: DataFrame, statuses: list[str] = (), actions: list[str] = ()) -> DataFrame:
    """VD010 to VD021 over ``cells``; null and empty values never fire. VD013 needs VD012 not to, and VD015 VD014."""
    v, t = F.col("value"), F.upper("type")
    low = F.lower(v)
    money = F.trim(F.replace(v, F.lit(","), F.lit("")))
    symbol = money.rlike("[R$]")
    boolean = low.isin("true", "false", "0", "1", "-1")

    def says(text: str) -> Column:
        return F.concat(F.col("column"), F.lit(": " + text))

    rules = [
        ("VD010", "ERROR", F.contains(t, F.lit("TEXT")) & (F.length(v) > TEXT_MOST), says("text is too long")),
        ("VD011", "WARNING", (t == "MEMO") & (F.length(v) > MEMO_MOST), says("memo is too long")),
        ("VD012", "ERROR", (t == "BIT") & ~boolean, says("not a boolean")),
        ("VD013", "WARNING", (t == "BIT") & v.isin("-1", "0", "1"), says("numeric boolean")),
        ("VD014", "WARNING", (t == "CURRENCY") & symbol, says("currency symbol")),
        ("VD015", "ERROR", (t == "CURRENCY") & ~symbol & money.try_cast("double").isNull(), says("not a number")),
    ]
    if statuses:
        rules.append(("VD020", "WARNING", (F.col("column") == "Status") & ~v.isin(*statuses), says("unknown status")))
    if actions:
        rules.append(("VD021", "WARNING", (F.col("column") == "Action_Type") & ~v.isin(*actions), says("unknown action")))
    return diagnosed(values.filter("value is not null and value <> ''"), rules)


def picklist(rows: DataFrame, column: str, allowed: list[str], rule: str, severity: str = "WARNING") -> DataFrame:
    """Values of any configured picklist column outside their set (rows: file, line and the column)."""
    v = F.col(column)
    return diagnosed(rows, [(rule, severity, v.isNotNull() & (v != "") & ~v.isin(*allowed), F.concat(F.lit(f"{column}: "), v))])


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows (file, line, key) whose non-empty key no parent has."""
    asked = child.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    keys = parent.select(F.col(parent_key).alias(key)).filter(F.col(key).isNotNull()).distinct()
    lost = asked.join(keys, key, "left_anti")
    return lost.select("file", "line", F.lit("VD030").alias("rule"), F.lit("ERROR").alias("severity"), F.concat(F.lit(f"{key}: no parent "), F.col(key).cast("string")).alias("message"))


def schema_rules(fields: DataFrame, mappings: DataFrame, types: DataFrame, target: DataFrame, keys: DataFrame, mandatory: DataFrame) -> DataFrame:
    """HY001 to HY010 and HY013 over a migration's catalogue (small tables).

    fields: table_name, field_name, source_type; mappings: table_name, field_name, form, field; types: source_type,
    target_type; target: form, field, field_type; keys: table_name, field_name; mandatory: form, field.
    """
    base = F.upper(F.trim(F.regexp_replace("source_type", r"\(.*\)", "")))
    f = fields.withColumn("base", base)
    m = mappings.select("table_name", "field_name", F.col("form").alias("to_form"), F.col("field").alias("to_field"))
    known = types.select(F.upper("source_type").alias("base"), "target_type").filter("target_type is not null and target_type <> ''")

    def out(df: DataFrame, rule: str, severity: str, message: Column) -> DataFrame:
        return df.select(F.lit("schema").alias("file"), F.lit(0).alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))

    name = F.concat_ws(".", "table_name", "field_name")
    size = F.regexp_extract("source_type", r"(?i)TEXT\((\d+)\)", 1)
    mapped = f.join(m, ["table_name", "field_name"], "left")
    reached = mapped.join(target.select(F.col("form").alias("to_form"), F.col("field").alias("to_field"), "field_type"), ["to_form", "to_field"], "left")
    identifier = F.upper("field_name").isin("ID")
    first = F.row_number().over(Window.partitionBy("base").orderBy("table_name", "field_name"))
    fk = keys.join(reached, ["table_name", "field_name"], "left")
    return reduce(
        DataFrame.unionByName,
        [
            out(f.join(known, "base", "left_anti").withColumn("k", first).filter("k = 1"), "HY001", "ERROR", F.col("base")),
            out(f.filter("base = 'CURRENCY'"), "HY002", "WARNING", name),
            out(f.filter("base = 'MEMO'"), "HY003", "WARNING", name),
            out(reached.filter(~identifier & F.col("field_type").isNull()), "HY004", "ERROR", name),
            out(m.filter(F.lower(F.replace("field_name", F.lit("_"), F.lit(""))) != F.lower(F.replace("to_field", F.lit("_"), F.lit("")))), "HY005", "WARNING", F.concat(name, F.lit(" -> "), "to_field")),
            out(fk.filter("to_field is null or (field_type is not null and field_type <> 'list')"), "HY006", "ERROR", name),
            out(f.filter(size.try_cast("int") > TEXT_MOST), "HY007", "WARNING", name),
            out(mandatory.join(m.select(F.col("to_form").alias("form"), F.col("to_field").alias("field")), ["form", "field"], "left_anti"), "HY008", "ERROR", F.concat_ws(".", "form", "field")),
            out(f.select("table_name").distinct().join(m.select("table_name"), "table_name", "left_anti"), "HY009", "INFO", F.col("table_name")),
            out(target.select("form").distinct().join(m.select(F.col("to_form").alias("form")), "form", "left_anti"), "HY010", "INFO", F.col("form")),
            out(f.filter("base = 'BIT'"), "HY013", "WARNING", name),
        ],
    )


def input_references(lines: DataFrame) -> DataFrame:
    """file, line, field of each ``input.X`` in script lines (file, line, text)."""
    return lines.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\binput\.(\w+)"), F.lit(1))).alias("field"))


def reference_rules(references: DataFrame, target: DataFrame, mappings: DataFrame) -> DataFrame:
    """HY014: references to known fields that nothing maps to. HY015: mapped fields that no script refers to."""
    mapped = mappings.select("field").distinct()
    # fields are a schema, and few of them have most references: a shuffle by field would be one task's
    lost = references.join(F.broadcast(target.select("field").distinct()), "field", "left_semi").join(F.broadcast(mapped), "field", "left_anti")
    unused = mapped.join(references.select("field").distinct(), "field", "left_anti")
    return lost.select("file", "line", F.lit("HY014").alias("rule"), F.lit("WARNING").alias("severity"), F.col("field").alias("message")).unionByName(
        unused.select(F.lit("scripts").alias("file"), F.lit(0).alias("line"), F.lit("HY015").alias("rule"), F.lit("INFO").alias("severity"), F.col("field").alias("message"))
    )


# fixed values: words that the desktop database reserves, and its types
RESERVED = ("date", "time", "name", "value", "order", "group", "table", "user", "index", "key", "level", "note", "number", "text", "type", "currency", "password", "position", "section", "year", "month", "day")
DDL_TYPES = "TEXT|MEMO|LONG|INTEGER|SINGLE|DOUBLE|CURRENCY|BIT|DATETIME|BYTE|GUID|BINARY|AUTOINCREMENT|COUNTER"


def ddl_rules(lines: DataFrame) -> DataFrame:
    """AV001 to AV005, AV007 and AV008 over lines (file, line, text) of SQL DDL, comments gone."""
    text = F.regexp_extract("text", r"^((?:[^'\-]|'[^']*'|-(?!-)|'[^']*$)*)", 1)
    column = F.lower(F.regexp_extract(text, rf"(?i)^\s*(\w+)\s+(?:{DDL_TYPES})\b", 1))
    table = F.regexp_extract(text, r"(?i)\bCREATE\s+TABLE\s+\[?(\w+)", 1)
    segments = F.filter(F.split(table, "_"), lambda s: ~s.rlike("^[A-Z][A-Za-z0-9]*$"))
    opens = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    closes = F.length(text) - F.length(F.replace(text, F.lit(")"), F.lit("")))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    starts = text.rlike(r"(?i)^\s*(?:CREATE|ALTER|DROP|INSERT|UPDATE|DELETE|SELECT)\b")
    rules = [
        ("AV001", "ERROR", column.isin(*RESERVED) | F.lower(table).isin(*RESERVED), F.concat(F.lit("reserved word "), F.when(table != "", table).otherwise(column))),
        ("AV002", "WARNING", text.rlike(r"(?i)\bSINGLE\b"), F.lit("single precision")),
        ("AV002", "ERROR", text.rlike(r"(?i)\bBINARY\b"), F.lit("binary")),
        ("AV003", "WARNING", text.rlike(r"\[[^\]]* [^\]]*\]"), F.lit("space in a name")),
        ("AV004", "ERROR", starts & (opens <= closes) & ~F.rtrim(text).endswith(";") & (words >= 3), F.lit("no semicolon")),
        ("AV005", "WARNING", text.rlike(r"(?i)\bSELECT\s+\*"), F.lit("SELECT *")),
        ("AV007", "WARNING", (table != "") & (F.size(segments) > 0), F.concat(F.lit("not PascalCase: "), table)),
        ("AV008", "ERROR", text.rlike(r"(?i)\bAUTOINCREMENT\b") & ~text.rlike(r"(?i)\b(?:LONG|COUNTER)\b"), F.lit("AUTOINCREMENT without LONG")),
    ]
    return diagnosed(lines, rules)


def script_rules(lines: DataFrame, fields: DataFrame, banned: list[str], statuses: list[str], demo_domains: list[str]) -> DataFrame:
    """DG001, DG003, DG008, DG011, DG013, DG015, DG016, DG017 and DG019 line by line, and DG004 against the known ``fields`` (field)."""
    text = stripped(F.col("text"))
    call = F.regexp_extract(text, rf"\b({'|'.join(banned)})\s*\(", 1)
    address = F.lower(F.regexp_extract(text, r"[\w.+-]+@([\w-]+(?:\.[\w-]+)+)", 1))
    quoted = F.regexp_extract(text, r"'([^']*)'", 1)
    status = F.regexp_extract(text, r'(?i)\bstatus\s*=\s*"([^"]*)"', 1)
    scheduled = F.contains(F.col("file"), F.lit("scheduled"))
    rules = [
        ("DG001", "ERROR", call != "", F.concat(F.lit("banned function "), call)),
        ("DG003", "ERROR", scheduled & text.rlike(r"\bhoursBetween\b"), F.lit("hoursBetween in a schedule")),
        ("DG008", "ERROR", (quoted != "") & ~quoted.rlike(r"^\d{1,4}[-/:]\d{1,2}"), F.concat(F.lit("single quotes: "), quoted)),
        ("DG011", "WARNING", (status != "") & ~status.isin(*statuses), F.concat(F.lit("unknown status "), status)),
        ("DG013", "WARNING", text.rlike(r"&&") & text.rlike(r"\|\|") & ~text.rlike(r"\([^)]*&&[^)]*\)\s*\|\||\|\|\s*\([^)]*&&[^)]*\)"), F.lit("mixed AND and OR")),
        ("DG015", "WARNING", address.isin(*demo_domains), F.concat(F.lit("demo address at "), address)),
        ("DG016", "INFO", (address != "") & ~address.isin(*demo_domains), F.concat(F.lit("address at "), address)),
        ("DG017", "ERROR", text.rlike(r"^\s*(?:return|if|else|for|while|true|false|null|input)\s*=(?!=)"), F.lit("assignment to a reserved word")),
        ("DG019", "ERROR", text.rlike(r"\bAdded_User\s*=\s*zoho\.adminuserid\b"), F.lit("Added_User from an admin id")),
    ]
    unknown = input_references(lines).join(fields.select("field").distinct(), "field", "left_anti")
    return diagnosed(lines, rules).unionByName(
        unknown.select("file", "line", F.lit("DG004").alias("rule"), F.lit("ERROR").alias("severity"), F.concat(F.lit("unknown field "), F.col("field")).alias("message"))
    )


def rolled_up(diagnostics: DataFrame, by: list[str]) -> DataFrame:
    """Count and total severity by the columns, by the first of them alone, and in all (null stands for all)."""
    return diagnostics.rollup(*by).agg(F.count("*").alias("n_gaps"), F.round(F.sum(_weight()), 6).alias("residual"))


def at_least(rows: DataFrame, severity: float) -> DataFrame:
    return rows.filter(F.col("severity") >= severity)


def in_order(diagnostics: DataFrame) -> DataFrame:
    """By file, line and rule."""
    return diagnostics.orderBy("file", "line", "rule")


def coverage(rows: DataFrame, by: str, covered: Column) -> DataFrame:
    """Share of a group's rows that are covered, in whole per cent rounded down."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(covered).alias("n_covered"), F.floor(100 * F.count_if(covered) / F.count("*")).cast("int").alias("percent"))


def knowledge_rules(mappings: DataFrame, mentioned: DataFrame) -> DataFrame:
    """HY017: mappings (table_name, field_name, field, risk) of high or medium risk whose type the knowledge base doesn't mention; HY018: fields that aren't lower-case and don't start with ID where it says nothing of camel case.

    mentioned: word, of the knowledge base in lower case.
    """
    words = mentioned.select("word").distinct()
    risky = mappings.filter(F.lower("risk").isin("high", "medium")).withColumn("word", F.lower("field"))
    mixed = mappings.filter((F.col("field") != F.lower("field")) & ~F.col("field").startswith("ID")).withColumn("word", F.lit("camelcase"))
    name = F.concat_ws(".", "table_name", "field_name")

    def out(df: DataFrame, rule: str) -> DataFrame:
        return df.join(words, "word", "left_anti").select(F.lit("schema").alias("file"), F.lit(0).alias("line"), F.lit(rule).alias("rule"), F.lit("INFO").alias("severity"), name.alias("message"))

    return out(risky, "HY017").unionByName(out(mixed, "HY018"))


def by_severity(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("severity").agg(F.count("*").alias("n"))


def exit_code(diagnostics: DataFrame) -> DataFrame:
    """2 with errors, 1 with warnings only, else 0."""
    worst = F.max(F.when(F.col("severity") == "ERROR", 2).when(F.col("severity") == "WARNING", 1).otherwise(0))
    return diagnostics.agg(F.coalesce(worst, F.lit(0)).alias("exit_code"))


def residual(diagnostics: DataFrame, by: list[str]) -> DataFrame:
    """Count and total severity per group."""
    return diagnostics.groupBy(*by).agg(F.count("*").alias("n_gaps"), F.round(F.sum(_weight()), 6).alias("residual"))


def _weight() -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair)), F.col("severity"))


def hotspots(totals: DataFrame, most: int = 10) -> DataFrame:
    return totals.orderBy(F.desc("residual"), *[c for c in totals.columns if c not in ("residual", "n_gaps")]).limit(most)
