"""Queries of the rules over scripts, SQL definitions, app exports and apps.

Their inputs are made from the driver's tables with faults by the key, so that SQL knows from the key what is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import audit, relational, rules, scripts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- scripts: one per customer, 28 lines, with a fault wherever the key is divisible by the line's number

# (line, text, divisor, text of the fault)
_LINES = [
    (1, "rec = Depts[ID == input.dept];", 67, "rec = Clients[ID == input.dept];"),
    (2, "if (rec != null) {", 3, "x = 1; // if (rec != null)"),
    (3, "name = rec.Title;", 5, "name = rec.Nope;"),
    (4, "insert into approval_history [", 7, "insert into unknown_form ["),
    (5, '  action_1 = "Approved"', 11, '  action_1 = "Bogus"'),
    (6, "  Added_User = zoho.loginuser", 13, "  Added_User : zoho.adminuserid"),
    (7, "  timestamp = zoho.currenttime", 23, "  actor = input.who"),
    (8, "]", 0, ""),
    (9, "sendmail [", 0, ""),
    (10, "  from : zoho.adminuserid", 29, '  from : "me"'),
    (11, "  to : input.mail", 0, ""),
    (12, '  subject : "s // no comment"', 0, ""),
    (13, '  message : "m"', 31, '  cc : "x"'),
    (14, "]", 0, ""),
    (15, "threshold_value = 999.99;", 37, "threshold_value = 500;"),
    (16, "y = zoho.loginuser;", 41, "y = zoho.unknownvar;"),
    (17, "resp = Map();", 43, 'alert "x";'),
    (18, "z = fn1(a);", 47, "z = fn1(a, b, c);"),
    (19, "invokeUrl [", 0, ""),
    (20, '  url : "u"', 0, ""),
    (21, "  type : GET", 53, "  content-type : json"),
    (22, "]", 0, ""),
    (23, "if (r.responseCode == 200) {", 59, "q = 1;"),
    (24, "u = zoho.loginuser;", 61, "u = zoho.banned_var;"),
    (25, "insert into Claims [", 0, ""),
    (26, "  dept = rec.ID", 0, ""),
    (27, "]", 0, ""),
]
_VARIABLES = ["zoho.loginuser", "zoho.adminuser", "zoho.adminuserid", "zoho.currenttime"]


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    parts = [F.struct(F.lit(n).alias("line"), (F.when(k % d == 0, bad).otherwise(text) if d else F.lit(text)).alias("text")) for n, text, d, bad in _LINES]
    return _t(spark, sf_dir, "customer").select(F.concat(F.lit("custom_api/"), k.cast("string")).alias("file"), F.inline(F.array(*parts)))


def _expected(*found: tuple[int | str, str, str, str, str]) -> str:
    """SQL of the diagnostics: line, rule, severity, message (SQL), and when (SQL over the key k)."""
    return " UNION ALL ".join(f"SELECT 'custom_api/' || k AS file, CAST({line} AS INTEGER) AS line, '{rule}' AS rule, '{severity}' AS severity, {message} AS message FROM c WHERE {cond}" for line, rule, severity, message, cond in found)


_KEYS = "WITH c AS (SELECT c_custkey AS k FROM customer) "
# an insert into another form isn't checked as an audit
_AUDIT = "k % 7 <> 0"


@query(_KEYS + _expected(
    (6, "DG007", "ERROR", "'Added_User is zoho.adminuserid'", f"k % 13 = 0 AND {_AUDIT}"), (6, "DG009", "ERROR", "'colon after Added_User'", "k % 13 = 0"), (9, "DG010", "ERROR", "'sendmail without message'", "k % 31 = 0"),
    (19, "DG010", "ERROR", "'invokeurl without type'", "k % 53 = 0"), (5, "DG012", "WARNING", "'unknown action Bogus'", f"k % 11 = 0 AND {_AUDIT}"), (4, "DG022", "WARNING", "'unknown form unknown_form'", "k % 7 = 0"),
    (9, "DG026", "WARNING", "'sender'", "k % 29 = 0"), (4, "DG026", "INFO", "'no timestamp'", f"k % 23 = 0 AND {_AUDIT}"), (19, "DG027", "INFO", "'no content type'", "k % 53 <> 0"), (22, "DG027", "WARNING", "'response not checked'", "k % 59 = 0"),
))
def script_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.block_rules(_scripts(spark, sf_dir), _rows(spark, [("approval_history",), ("Claims",)], "form string"), ["Approved", "Rejected"])


@query(_KEYS + _expected(
    (3, "DG005", "ERROR", "'no null check of rec'", "k % 3 = 0"), (26, "DG023", "WARNING", "'dept wants Depts not Clients'", "k % 67 = 0"), (3, "DG024", "WARNING", "'Depts.Nope'", "k % 5 = 0 AND k % 67 <> 0"),
))
def script_variable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.variable_rules(_scripts(spark, sf_dir), _rows(spark, [("Depts", "Title"), ("Claims", "dept")], "form string, field string"), _rows(spark, [("Claims", "dept", "Depts")], "form string, field string, parent string"))


@query(_KEYS + _expected(
    (24, "DG002", "ERROR", "'banned zoho.banned_var'", "k % 61 = 0"), (15, "DG014", "WARNING", "'threshold 500.0'", "k % 37 = 0"), (16, "DG018", "WARNING", "'unknown zoho.unknownvar'", "k % 41 = 0"), (1, "DG020", "WARNING", "'no response map'", "k % 43 = 0"),
    (17, "DG021", "ERROR", "'form task alert'", "k % 43 = 0"), (18, "DG025", "WARNING", "'fn1 3 of 2'", "k % 47 = 0"),
))
def script_file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.file_rules(_scripts(spark, sf_dir), _VARIABLES, ["zoho.banned_var"], _rows(spark, [("fn1", 2)], "function string, n_params int"))


# (divisor, text) of lines that break a rule each; the rest is plain
_LINE_FAULTS = [
    (2, "x = lpad(input.code, 3);"), (3, 'status = "Unknown";'), (5, "n = 'hello';"), (7, "if (a == 1 && b == 2 || c == 3) {"), (11, 'to : "ann@demo.example.com"'), (13, 'to : "bob@corp.example.org"'), (17, "return = 3;"),
    (19, "Added_User = zoho.adminuserid"), (23, "h = hoursBetween(a, b);"), (29, "ok = '2024-01-01'; // lpad(x, 1)"), (31, 'u = "http://x.org/lpad(y)"; lpad(z, 1);'),
]


def _which(faults: list[tuple[int, str]]) -> Column:
    out = F.lit("ok = 1;")
    for d, text in reversed(faults):
        out = F.when(F.col("o_orderkey") % d == 0, text).otherwise(out)
    return out


def _first(divisor: int) -> str:
    """SQL: the key is divisible by this and by no earlier fault's number."""
    earlier = [d for d, _ in _LINE_FAULTS if d < divisor]
    return " AND ".join([f"k % {divisor} = 0", *(f"k % {d} <> 0" for d in earlier)])


def _line_sql(found: list[tuple[int, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT 'scheduled/' || k % 7 AS file, CAST(k AS INTEGER) AS line, '{rule}' AS rule, '{severity}' AS severity, '{message}' AS message FROM o WHERE {_first(d)}" for d, rule, severity, message in found)


@query("WITH o AS (SELECT o_orderkey AS k FROM orders) " + _line_sql([
    (2, "DG001", "ERROR", "banned function lpad"), (2, "DG004", "ERROR", "unknown field code"), (3, "DG011", "WARNING", "unknown status Unknown"), (5, "DG008", "ERROR", "single quotes: hello"), (7, "DG013", "WARNING", "mixed AND and OR"), (11, "DG015", "WARNING", "demo address at demo.example.com"),
    (13, "DG016", "INFO", "address at corp.example.org"), (17, "DG017", "ERROR", "assignment to a reserved word"), (19, "DG019", "ERROR", "Added_User from an admin id"), (23, "DG003", "ERROR", "hoursBetween in a schedule"), (31, "DG001", "ERROR", "banned function lpad"),
]))
def script_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lines = _t(spark, sf_dir, "orders").select(F.concat(F.lit("scheduled/"), (k % 7).cast("string")).alias("file"), k.cast("int").alias("line"), _which(_LINE_FAULTS).alias("text"))
    return rules.script_rules(lines, _rows(spark, [("amount",)], "field string"), ["lpad", "rpad"], ["Open", "Closed"], ["demo.example.com"])


_DDL = ["CREATE TABLE Claims (", "  Date DATETIME,", "  Rate SINGLE,", "  Photo BINARY,", "  [Full Name] TEXT(80), -- SINGLE", "  No AUTOINCREMENT", ");", "SELECT * FROM Claims", "CREATE TABLE bad_name (", "INSERT INTO Claims VALUES ('a -- b')", "DROP TABLE Old;"]
# place in _DDL and what is found there
_DDL_FOUND = [
    (1, "AV001", "ERROR", "reserved word date"), (2, "AV002", "WARNING", "single precision"), (3, "AV002", "ERROR", "binary"), (4, "AV003", "WARNING", "space in a name"), (5, "AV008", "ERROR", "AUTOINCREMENT without LONG"), (7, "AV004", "ERROR", "no semicolon"),
    (7, "AV005", "WARNING", "SELECT *"), (8, "AV007", "WARNING", "not PascalCase: bad_name"), (9, "AV004", "ERROR", "no semicolon"),
]


@query(" UNION ALL ".join(f"SELECT 'schema.sql' AS file, CAST(p_partkey AS INTEGER) AS line, '{r}' AS rule, '{s}' AS severity, '{m}' AS message FROM part WHERE p_partkey % {len(_DDL)} = {i}" for i, r, s, m in _DDL_FOUND))
def ddl_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, _DDL)), (F.col("p_partkey") % len(_DDL) + 1).cast("int"))
    return rules.ddl_rules(_t(spark, sf_dir, "part").select(F.lit("schema.sql").alias("file"), F.col("p_partkey").cast("int").alias("line"), text.alias("text")))


_STEMS = ["Orders", "Part", "Boss", "GL_Account", "Nothing"]


@query("SELECT 'schema.sql' AS file, CAST(p_partkey AS INTEGER) AS line, 'AV006' AS rule, 'ERROR' AS severity, 'no table for ' || (['Order_ID', 'Part_ID', 'Boss_id', 'GL_Account_ID', 'Nothing_ID', 'Title'])[p_partkey % 6 + 1] AS message FROM part WHERE p_partkey % 6 = 4")
def key_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Order_ID", "Part_ID", "Boss_id", "GL_Account_ID", "Nothing_ID", "Title"]
    column = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = _t(spark, sf_dir, "part").select(F.lit("schema.sql").alias("file"), F.col("p_partkey").cast("int").alias("line"), column.alias("column"))
    return scripts.key_targets(rows, _rows(spark, [("ORDERS",), ("part",), ("Bosses",), ("gl_accounts",)], "table_name string"))


# --- what apps lack: one app per supplier


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), g AS (
    SELECT k, 'structural_completeness' AS p, 2.0 AS v FROM s WHERE k % 2 = 0 AND k % 3 = 0 UNION ALL SELECT k, 'structural_completeness', 1.5 FROM s WHERE k % 5 = 0 AND k % 7 <> 0
    UNION ALL SELECT k, 'audit_trail', 2.0 FROM s WHERE k % 11 = 0 AND k % 3 <> 0 UNION ALL SELECT k, 'notification', 1.5 FROM s WHERE k % 11 = 0 AND k % 3 <> 0
    UNION ALL SELECT k, 'compliance', 1.5 FROM s WHERE k % 13 = 0 AND k % 11 = 0 UNION ALL SELECT k, 'compliance', 1.0 FROM s WHERE k % 13 = 0 UNION ALL SELECT k, 'compliance', 1.5 FROM s WHERE k % 3 <> 0 UNION ALL SELECT k, 'compliance', 0.5 FROM s WHERE k % 3 <> 0 AND (k % 17 <> 0 OR k % 11 = 0)
    UNION ALL SELECT k, 'form_validation', 2.0 FROM s WHERE k % 11 = 0 OR k % 19 <> 0 UNION ALL SELECT k, 'form_validation', 1.0 FROM s WHERE k % 11 <> 0 AND k % 19 = 0
    UNION ALL SELECT k, 'transition_logic', CASE k % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 ELSE 1.0 END FROM s
    UNION ALL SELECT k, 'audit_trail', 1.5 FROM s WHERE k % 11 <> 0 AND k % 23 <> 0 UNION ALL SELECT k, 'notification', 1.0 FROM s WHERE k % 11 <> 0
    UNION ALL SELECT k, 'error_handling', 1.0 FROM s WHERE k % 11 <> 0 AND k % 29 = 0)
    SELECT 'app' || k AS app, p AS projection, count(*) AS n_gaps, CAST(round(sum(v), 6) AS DOUBLE) AS residual FROM g GROUP BY ALL""")
def app_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = _t(spark, sf_dir, "supplier").select(k, F.concat(F.lit("app"), k.cast("string")).alias("app"))
    overview = F.concat(F.when(k % 13 == 0, "expense app").otherwise("app"), F.when(k % 7 == 0, " with a dashboard").otherwise(""))
    apps = s.select("app", overview.alias("overview"), F.when(k % 5 == 0, 0).otherwise(2).alias("n_pages"), F.when(k % 3 == 0, 0).otherwise(1).alias("n_blueprints"))
    forms = s.select("app", F.lit("Claim").alias("form"), F.when(k % 2 == 0, "status picklist").otherwise("title text").alias("fields"))
    moves = s.select("app", F.when(k % 3 == 0, "Approve_it").when(k % 3 == 1, "Close_it").otherwise("Look_at").alias("transition"))
    code = F.concat(
        F.lit("input.status = 1; receipt "), F.when(k % 17 == 0, "popia ").otherwise(""), F.when(k % 19 == 0, "on validate Claim ").otherwise(""), F.when(k % 23 == 0, "insert into audit_trail ").otherwise(""), F.when(k % 29 == 0, "x = Claims[ID == 1] ").otherwise("")
    )
    written = s.filter(k % 11 != 0).select("app", F.lit("on_add").alias("script"), code.alias("code"))
    return audit.app_gaps(apps, forms, moves, written).groupBy("app", "projection").agg(F.count("*").alias("n_gaps"), F.round(F.sum("severity"), 6).alias("residual"))


# --- app exports and builder input: one app whose forms are parts


@query("""WITH p AS (SELECT p_partkey AS k FROM part), f AS (SELECT k FROM p WHERE k % 10 <> 0), o AS (
    SELECT 'DS201' AS rule, 'ERROR' AS severity, 'r' || k || ' -> f' || k AS message FROM p WHERE k % 10 = 0 UNION ALL SELECT 'DS202', 'ERROR', 'w' || k || ' -> f' || k FROM p WHERE k % 10 = 0
    UNION ALL SELECT 'DS203', 'ERROR', 'form f' || k FROM p WHERE k % 10 = 0 UNION ALL SELECT 'DS204', 'ERROR', 'phone form f' || k FROM p WHERE k % 10 = 0 UNION ALL SELECT 'DS205', 'WARNING', 'r' || k FROM p WHERE k % 9 = 0
    UNION ALL SELECT 'DS206', 'ERROR', 'r' || k || '.Lost' FROM p WHERE k % 4 = 0 UNION ALL SELECT 'DS206', 'ERROR', 'r' || k || '.Title' FROM p WHERE k % 4 <> 0 AND k % 10 = 0
    UNION ALL SELECT 'DS208', 'WARNING', 'r' || k FROM p UNION ALL SELECT 'DS209', 'INFO', 'report r' || k FROM p UNION ALL SELECT 'DS210', 'INFO', 'report r' || k FROM p UNION ALL SELECT 'DS210', 'INFO', 'form f' || k FROM f
    UNION ALL SELECT 'DS301', 'ERROR', 's' || k || ' f' || k || '.Gone' FROM f WHERE k % 6 = 0 UNION ALL SELECT 'DS304', 'WARNING', 's' || k || ' f' || k || '.title' FROM f WHERE k % 6 = 1)
    SELECT 'app' AS file, 0 AS line, * FROM o""")
def export_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))

    def name(letter: str) -> Column:
        return F.concat(F.lit(letter), k.cast("string"))

    forms = p.filter("k % 10 <> 0").select(name("f").alias("form"))
    fields = forms.select("form", F.lit("Title").alias("field"))
    reports = p.select(name("r").alias("report"), name("f").alias("form"), F.when(k % 9 == 0, "kanban").otherwise("list").alias("kind"), F.lit("").alias("options"))
    columns = p.select(name("r").alias("report"), F.when(k % 4 == 0, "Lost").otherwise("Title").alias("field"))
    workflows = p.select(name("w").alias("workflow"), name("f").alias("form"))
    menus = p.select(F.explode(F.array(F.lit("web"), F.lit("phone"))).alias("device"), F.lit("form").alias("kind"), name("f").alias("name"))
    references = p.select(name("s").alias("script"), name("f").alias("form"), F.when(k % 6 == 0, "Gone").when(k % 6 == 1, "title").otherwise("Title").alias("field"))
    return scripts.export_rules(forms, fields, reports, columns, workflows, menus, references)


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders), r AS (
    SELECT 'b' || k AS file, 2 AS line, 'DS001' AS rule, 'ERROR' AS severity, 'braces 1' AS message FROM o WHERE k % 3 = 0 UNION ALL SELECT 'b' || k, 2, 'DS002', 'ERROR', 'parentheses -1' FROM o WHERE k % 5 = 0
    UNION ALL SELECT 'b' || k, 1, 'DS003', 'ERROR', 'unknown form Lost' FROM o WHERE k % 7 = 0 UNION ALL SELECT 'F' || k, 0, 'DS004', 'ERROR', 'field twice: A' FROM o WHERE k % 11 = 0 UNION ALL SELECT 'F' || k, 0, 'DS005', 'WARNING', 'no choices: A' FROM o WHERE k % 13 = 0
    UNION ALL SELECT 'F' || k, 0, 'DS005', 'WARNING', 'no choices: A' FROM o WHERE k % 13 = 0 AND k % 11 = 0) SELECT * FROM r""")
def builder_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = _t(spark, sf_dir, "orders")
    one, two = F.when(k % 7 == 0, 'insert into Lost [ "{" ] {').otherwise("insert into Known [ x ] {"), F.concat(F.when(k % 3 == 0, "f()").otherwise("f() }"), F.when(k % 5 == 0, ") // (").otherwise(""))
    lines = o.select(F.concat(F.lit("b"), k.cast("string")).alias("file"), F.posexplode(F.array(one, two)).alias("line", "text")).withColumn("line", F.col("line") + 1)
    choices = F.when(k % 13 == 0, "").otherwise("a,b")
    field = F.struct(F.lit("A").alias("field"), F.lit("picklist").alias("kind"), choices.alias("choices"))
    fields = o.select(F.concat(F.lit("F"), k.cast("string")).alias("form"), F.inline(F.when(k % 11 == 0, F.array(field, field)).otherwise(F.array(field))))
    return scripts.builder_rules(lines, fields, _rows(spark, [("Known",)], "form string"))


@query("""SELECT event_id, event_type = 'click' AS is_new_pattern, CASE event_type WHEN 'view' THEN 'known_lint_rule' WHEN 'click' THEN 'potential_lint_rule' ELSE 'generic_error' END AS category, CAST(CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.6 ELSE 0.3 END AS DOUBLE) AS confidence FROM events""")
def error_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "lpad-usage").otherwise("other").alias("rule"), F.when(F.col("event_type") == "click", "bad Input.x").otherwise("no words").alias("message"))
    return scripts.triage(e).drop("rule", "message")


@query("""WITH t AS (SELECT s_suppkey AS k FROM supplier), c AS (SELECT k, unnest(['Amount_ID', 'Due', 'Active', 'Lost_Col']) AS col FROM t)
    SELECT 't' || k AS table_name, col AS "column", CASE col WHEN 'Amount_ID' THEN 'Total_Amount' WHEN 'Due' THEN 'Due_Date' WHEN 'Active' THEN 'Is_Active' END AS field, CASE col WHEN 'Amount_ID' THEN 'precision' WHEN 'Due' THEN 'time zone' WHEN 'Active' THEN CASE WHEN k % 2 = 0 THEN 'value mapping' END END AS mismatch FROM c""")
def column_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("table_name"), F.col("s_suppkey").alias("k"))
    source = t.select("table_name", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(x).alias("type")) for c, x in (("Amount_ID", "CURRENCY"), ("Due", "DATETIME"), ("Active", "BOOLEAN"), ("Lost_Col", "TEXT"))))))
    box = F.when(F.col("k") % 2 == 0, "Checkbox").otherwise("Text")
    target = t.select("table_name", F.inline(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind")) for i, (f, kind) in enumerate((("Total_Amount", "Decimal"), ("Due_Date", "DateTime"), ("Is_Active", box), ("Amount_2", "Text")))))))
    return scripts.column_mapping(source, target)


# --- names, totals and thresholds


@query("""WITH n AS (SELECT p_partkey, lower(p_name) AS s FROM part), a AS (SELECT *, strpos(s, 'r') AS r FROM n WHERE contains(s, 'r')), b AS (SELECT *, r + strpos(substr(s, r + 1), 'w') AS w FROM a WHERE contains(substr(s, r + 1), 'w'))
    SELECT p_partkey, (2 + CASE WHEN r = 1 THEN 5 ELSE 0 END + CASE WHEN r = 1 OR regexp_matches(substr(s, r - 1, 1), '[\\s_\\-./]') THEN 3 ELSE 0 END + CASE WHEN w = r + 1 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(substr(s, w - 1, 1), '[\\s_\\-./]') THEN 3 ELSE 0 END)::INTEGER AS score FROM b""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", relational.fuzzy_score(F.col("p_name"), "rw").alias("score")).filter("score is not null")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "ERROR").when(F.col("o_orderpriority") == "2-HIGH", "WARNING").otherwise("INFO")
    return _t(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 9).cast("string")).alias("file"), F.col("o_orderkey").cast("int").alias("line"), F.col("o_orderstatus").alias("rule"), severity.alias("severity"), F.lit("m").alias("message"))


_FACTS = "WITH d AS (SELECT 'f' || o_custkey % 9 AS file, CAST(o_orderkey AS INTEGER) AS line, o_orderstatus AS rule, CASE o_orderpriority WHEN '1-URGENT' THEN 'ERROR' WHEN '2-HIGH' THEN 'WARNING' ELSE 'INFO' END AS severity FROM orders)"


@query(_FACTS + " SELECT file, rule, count(*) AS n_gaps, CAST(round(sum(CASE severity WHEN 'ERROR' THEN 2.0 WHEN 'WARNING' THEN 1.0 ELSE 0.2 END), 6) AS DOUBLE) AS residual FROM d GROUP BY ROLLUP (file, rule)")
def residual_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rolled_up(_facts(spark, sf_dir), ["file", "rule"])


@query(_FACTS + " SELECT severity, count(*) AS n FROM d GROUP BY severity")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.by_severity(_facts(spark, sf_dir))


@query(_FACTS + " SELECT file, line, rule, severity, 'm' AS message FROM d ORDER BY file, line, rule")
def diagnostics_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.in_order(_facts(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_tax AS severity FROM lineitem WHERE l_tax >= 0.05")
def severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.at_least(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("severity")), 0.05)


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS n_covered, CAST(floor(100 * count(*) FILTER (WHERE o_totalprice > 100000) / count(*)) AS INTEGER) AS percent FROM orders GROUP BY o_orderstatus")
def coverage_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.coverage(_t(spark, sf_dir, "orders"), "o_orderstatus", F.col("o_totalprice") > 100000)


@query("""WITH m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'Mixed' || p_partkey % 10 ELSE 'low' || p_partkey % 10 END AS field, CASE p_partkey % 3 WHEN 0 THEN 'HIGH' ELSE 'low' END AS risk FROM part)
    SELECT 'schema' AS file, 0 AS line, 'HY017' AS rule, 'INFO' AS severity, 't.c' || k AS message FROM m WHERE risk = 'HIGH' AND lower(field) NOT IN ('low1', 'mixed2') UNION ALL SELECT 'schema', 0, 'HY018', 'INFO', 't.c' || k FROM m WHERE k % 4 = 0""")
def knowledge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    digit = (k % 10).cast("string")
    m = _t(spark, sf_dir, "part").select(F.lit("t").alias("table_name"), F.concat(F.lit("c"), k.cast("string")).alias("field_name"), F.when(k % 4 == 0, F.concat(F.lit("Mixed"), digit)).otherwise(F.concat(F.lit("low"), digit)).alias("field"), F.when(k % 3 == 0, "HIGH").otherwise("low").alias("risk"))
    return rules.knowledge_rules(m, _rows(spark, [("low1",), ("mixed2",)], "word string"))


@query("SELECT 'b' || o_orderkey % 3 AS file, CAST(o_orderkey AS INTEGER) AS line, CAST(sum(CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER w AS BIGINT) AS braces, CAST(sum(CASE o_orderkey % 7 WHEN 0 THEN 2 WHEN 1 THEN -2 ELSE 0 END) OVER w AS BIGINT) AS parens FROM orders WINDOW w AS (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey)")
def line_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.when(k % 5 == 0, 'a { "}"').when(k % 5 == 1, "} // {").otherwise("x"))
    text = F.concat(F.when(k % 7 == 0, "((").when(k % 7 == 1, "))").otherwise(""), text)
    return scripts.depths(_t(spark, sf_dir, "orders").select(F.concat(F.lit("b"), (k % 3).cast("string")).alias("file"), k.cast("int").alias("line"), text.alias("text")))


@query("""WITH raw AS (SELECT 's' || l_orderkey AS file, l_linenumber + 1 AS line, (l_suppkey + l_linenumber) % 5 AS k FROM lineitem),
        l AS (SELECT file, line, k, sum(CASE k WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line) AS depth FROM raw),
        g AS (SELECT file, line, (SELECT min(x.line) FROM l x WHERE x.file = l.file AND x.line > l.line AND x.depth < l.depth) AS ends FROM l WHERE k = 0),
        u AS (SELECT file, line FROM l WHERE k IN (2, 3) AND NOT EXISTS (SELECT 1 FROM g WHERE g.file = l.file AND g.line <= l.line AND (g.ends IS NULL OR g.ends > l.line)))
    SELECT file, CAST(min(line) AS INTEGER) AS line, 'DG005' AS rule, 'ERROR' AS severity, 'no null check of v' AS message FROM u GROUP BY file""")
def guard_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script per order whose lines guard, use and close blocks in many orders: guards that close before the use don't count."""
    k = (F.col("l_suppkey") + F.col("l_linenumber")) % 5
    text = F.when(k == 0, "if (v != null) {").when(k == 1, "}").when(k.isin(2, 3), "x = v.total;").otherwise("y = 1;")
    body = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("file"), (F.col("l_linenumber") + 1).cast("int").alias("line"), text.alias("text"))
    heads = body.select("file").distinct().select("file", F.lit(1).alias("line"), F.lit("v = orders[ID == 1];").alias("text"))
    none = spark.createDataFrame([], "form string, field string, parent string")
    found = scripts.variable_rules(body.unionByName(heads), none.select("form", "field"), none)
    return found.filter("rule = 'DG005'").select("file", "line", "rule", "severity", "message")
