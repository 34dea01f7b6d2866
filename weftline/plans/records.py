"""Queries over records: form queries, joins, aggregates, scalar families, rules and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as C
from weftline.functions import script as S
from weftline.operators import edges, relational, rules
from weftline.sources import store
from weftline.streaming import events as stream

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


# --- form queries, reports, joins


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'O' AND o_totalprice > 300000")
def form_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = S.same(F.col("o_orderstatus"), F.lit("O")) & (S.number(F.col("o_totalprice")) > 300000)
    return relational.form_query(_t(spark, sf_dir, "orders"), criteria).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey AS order_no, l_linenumber AS line_no, l_extendedprice AS price FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def report_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.report(_t(spark, sf_dir, "lineitem"), {"l_orderkey": "order_no", "l_linenumber": "line_no", "l_extendedprice": "price"}, (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45))


@query("SELECT o_orderpriority, count(*) AS n_records FROM orders GROUP BY o_orderpriority")
def kanban_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.kanban(_t(spark, sf_dir, "orders"), "o_orderpriority")


@query("""SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def lookup_deref(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    for key, name, parent in (("l_orderkey", "orders", "o_orderkey"), ("o_custkey", "customer", "c_custkey"), ("c_nationkey", "nation", "n_nationkey"), ("n_regionkey", "region", "r_regionkey")):
        out = relational.dereferenced(out, key, _t(spark, sf_dir, name), parent)
    return out.groupBy("r_name", "n_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT p_partkey, p.p_name, n_same FROM part p JOIN (SELECT p_name, count(DISTINCT p_partkey) AS n_same FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1) s ON s.p_name = p.p_name")
def duplicate_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicates(_t(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "p_name", "n_same")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity + 5, 6) AS a, round(l_extendedprice * l_discount, 6) AS b, round(CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END, 6) AS c,
    round(CASE WHEN l_discount = 0 THEN 0 ELSE -l_quantity - l_discount * floor(-l_quantity / l_discount) END, 4) AS d FROM lineitem""")
def compound_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, price, d, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(S.assigned(q, "+=", F.lit(5)), 6).alias("a"), F.round(S.assigned(price, "*=", d), 6).alias("b"),
        F.round(S.assigned(d, "/=", t), 6).alias("c"), F.round(S.assigned(-q, "%=", d), 4).alias("d"),
    )


@query("""WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS s, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END AS n FROM customer)
    SELECT c_custkey, CASE WHEN coalesce(length(s) > 0, false) THEN s ELSE 'none' END AS named, CASE WHEN n <> 0 THEN s ELSE NULL END AS guarded_s,
    s IS NOT DISTINCT FROM NULL AS is_null, coalesce(TRY_CAST(s AS DOUBLE), 0) < n AS smaller, coalesce(s, '') || c_custkey AS text, round(n - (-7) * floor(n / (-7)), 6) AS remainder, CASE WHEN n > 0 THEN 'credit' ELSE 'debit' END AS kind FROM v""")
def script_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("s"), F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("n"))
    s, n = F.col("s"), F.col("n")
    return v.select(
        "c_custkey", S.either(s, F.lit("none"), "text").alias("named"), F.when(S.truthy(n, "number"), s).alias("guarded_s"), S.same(s, F.lit(None)).alias("is_null"), S.less(s, n).alias("smaller"),
        S.joined(s, F.col("c_custkey")).alias("text"), F.round(S.modulo(n, F.lit(-7)), 6).alias("remainder"), F.when(n > 0, "credit").otherwise("debit").alias("kind"),
    )


@query("SELECT c_custkey, [c_mktsegment, c_name] AS pair, MAP {'segment': c_mktsegment, 'name': c_name}['segment'] AS segment, MAP {'segment': c_mktsegment}['missing'] AS missing FROM customer")
def constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name")
    return _t(spark, sf_dir, "customer").select("c_custkey", F.array("c_mktsegment", "c_name").alias("pair"), F.try_element_at(m, F.lit("segment")).alias("segment"), F.try_element_at(m, F.lit("missing")).alias("missing"))


@query("SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%thanedble%' OR lower(text) LIKE '%idiot%'")
def keyword_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return relational.form_query(_t(spark, sf_dir, "documents"), F.contains(low, F.lit("thanedble")) | F.contains(low, F.lit("idiot"))).select("doc_id", "source")


@query("SELECT page_id, url FROM pages WHERE url LIKE '%/en/%' AND NOT contains(url, '?')")
def path_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").filter(F.col("url").like("%/en/%") & ~F.contains("url", F.lit("?"))).select("page_id", "url")


@query("""SELECT (999 + row_number() OVER (ORDER BY o_orderkey))::INTEGER AS seq, 'insert' AS action, o_orderkey::VARCHAR AS "order", 'late' AS note FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000""")
def foreach_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = relational.form_query(_t(spark, sf_dir, "orders"), (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000))
    log = relational.effects(late, "insert", {"order": F.col("o_orderkey"), "note": F.lit("late")}, ["o_orderkey"])
    return log.select("seq", "action", F.col("params")["order"].alias("order"), F.col("params")["note"].alias("note"))


@query("""SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01')::INTEGER AS days_open,
    CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'ESCALATED' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F')""")
def overdue_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = relational.deleted(_t(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")
    moved = relational.updated(live, (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")), {"o_orderstatus": F.lit("ESCALATED")})
    return moved.select("o_orderkey", F.datediff(F.lit("1998-08-01").cast("date"), F.col("o_orderdate")).alias("days_open"), "o_orderstatus")


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), k AS (SELECT unnest(['RED WIDGET', 'small', 'ring bolt', 'blue']) AS cat)
    SELECT name, coalesce((SELECT min(cat) FROM k WHERE lower(cat) = lower(name)),
        CASE WHEN (SELECT count(*) FROM k WHERE length(cat) >= 4 AND length(name) >= 4 AND (contains(lower(cat), lower(name)) OR contains(lower(name), lower(cat)))) = 1
             THEN (SELECT min(cat) FROM k WHERE length(cat) >= 4 AND length(name) >= 4 AND (contains(lower(cat), lower(name)) OR contains(lower(name), lower(cat)))) END) AS suggestion FROM n""")
def closest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.closest_name(_t(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct(), ["RED WIDGET", "small", "ring bolt", "blue"])


# --- aggregates


@query("""SELECT l_returnflag, count(*) AS n_all, round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 6) AS average, median(l_quantity) AS median, min(l_quantity) AS smallest, max(l_quantity) AS largest,
    round(stddev_samp(l_quantity), 6) AS stdev, round(stddev_pop(l_quantity), 6) AS stdevp, round(var_samp(l_quantity), 6) AS var, round(var_pop(l_quantity), 6) AS varp FROM lineitem GROUP BY l_returnflag""")
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.statistics(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.select("l_returnflag", "n_all", F.round("total", 4).alias("total"), F.round("average", 6).alias("average"), "median", "smallest", "largest", *(F.round(c, 6).alias(c) for c in ("stdev", "stdevp", "var", "varp")))


@query("SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05")
def domain_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.domain(_t(spark, sf_dir, "lineitem"), F.round(F.sum("l_extendedprice"), 2), (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05))


@query("SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END), 6) AS long_share FROM documents")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.round(F.avg(F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0)), 6)
    return _t(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs"), share.alias("long_share"))


@query("""WITH d AS (SELECT regexp_extract(url, '^https?://(?:www\\.|m\\.)?([^/?#]+)', 1) AS host, sha256(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS h FROM pages), c AS (SELECT h, count(DISTINCT host) AS hosts FROM d GROUP BY h)
    SELECT host, count(*) AS n_pages, round(avg(CASE WHEN hosts > 1 THEN 1.0 ELSE 0.0 END), 6) AS shared, avg(CASE WHEN hosts > 1 THEN 1.0 ELSE 0.0 END) >= 0.8 AS equivalent FROM d JOIN c USING (h) GROUP BY host""")
def domain_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.tokens import content_hash

    d = _t(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://(?:www\.|m\.)?([^/?#]+)", 1).alias("host"), content_hash(F.col("html")).alias("h"))
    c = d.groupBy("h").agg(F.count_distinct("host").alias("hosts"))
    share = F.avg(F.when(F.col("hosts") > 1, 1.0).otherwise(0.0))
    return d.join(c, "h").groupBy("host").agg(F.count("*").alias("n_pages"), F.round(share, 6).alias("shared"), (share >= 0.8).alias("equivalent"))


# --- windows and as-of


@query("SELECT conv_id, turn, lead(turn) OVER w AS next_turn, first_value(turn) OVER w AS anchor, row_number() OVER w AS k, role IS DISTINCT FROM lag(role) OVER w AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)")
def turn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    return _t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.lead("turn").over(w).alias("next_turn"), F.first("turn").over(w).alias("anchor"), F.row_number().over(w).cast("long").alias("k"), (~F.col("role").eqNullSafe(F.lag("role").over(w))).alias("changed")
    )


@query("SELECT event_id, (SELECT max(s.event_id) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts = (SELECT max(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'signup' AND x.ts < e.ts)) AS before_id FROM events e WHERE event_type = 'error'")
def asof_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return edges.preceding(ev, ["user_id"], "at", "event_id", F.col("event_type") == "signup", "before_id").filter("event_type = 'error'").select("event_id", "before_id")


@query("SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 200) AS BIGINT) AS batch, o_orderkey FROM orders QUALIFY true")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.batches(_t(spark, sf_dir, "orders"), ["o_orderkey"], F.col("o_orderkey"))
    return out.select("batch", F.explode(F.from_json("payload", "array<long>")).alias("o_orderkey"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(_t(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(_t(spark, sf_dir, "events"), "6 hours")


# --- scalar families


def _family(base: DataFrame, key: str, columns: dict) -> DataFrame:
    return base.select(key, *(c.alias(n) for n, c in columns.items()))


@query(r"""SELECT p_partkey, contains(p_name, 'ring') AS contains, NOT contains(p_name, 'ring') AS not_contains, starts_with(p_name, 'red') AS starts, ends_with(p_name, 'ing') AS ends, lower(p_name) = 'red widget' AS equals,
    regexp_full_match(p_name, '[a-z]+ [a-z]+') AS matches, regexp_replace(p_brand, '[^A-Za-z]', '', 'g') AS alpha, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS alnum, split_part(p_brand, '#', 1) AS prefix, string_split(p_brand, '#')[-1] AS suffix,
    ((length(p_name) - length(replace(p_name, 'e', ''))))::INTEGER AS occurs, substr(p_name, 1, 3) AS left3, right(p_name, 3) AS right3, substr(p_name, 3, 4) AS mid, strpos(p_name, 'e') - 1 AS find,
    CASE WHEN contains(p_name, 'e') THEN length(p_name) - strpos(reverse(p_name), 'e') ELSE -1 END AS find_last, upper(p_name) AS upper, reverse(p_name) AS reversed, lpad(p_name, 12, ' ') AS padded, replace(p_name, 'e', '') AS removed,
    regexp_replace(p_name, 'e', '') AS removed_first, p_name || '!' AS joined, repeat(p_type, 2) AS repeated, hex(p_brand) AS hexed, string_split(p_name, ' ') AS words, length(p_name)::INTEGER AS length, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS number FROM part""")
def fn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b, f = F.col("p_name"), F.col("p_brand"), C.TEXT
    return _family(_t(spark, sf_dir, "part"), "p_partkey", {
        "contains": f["contains"](n, "ring"), "not_contains": f["notContains"](n, "ring"), "starts": f["startsWith"](n, "red"), "ends": f["endsWith"](n, "ing"), "equals": f["equalsIgnoreCase"](n, "red widget"),
        "matches": f["matches"](n, "[a-z]+ [a-z]+"), "alpha": f["getAlpha"](b), "alnum": f["getAlphaNumeric"](b), "prefix": f["getPrefix"](b, "#"), "suffix": f["getSuffix"](b, "#"), "occurs": f["getOccurenceCount"](n, "e"),
        "left3": f["left"](n, 3), "right3": f["right"](n, 3), "mid": f["mid"](n, 2, 4), "find": f["indexOf"](n, "e").cast("long"), "find_last": f["lastIndexOf"](n, "e").cast("long"), "upper": f["toUpperCase"](n), "reversed": f["reverse"](n),
        "padded": f["leftpad"](n, 12), "removed": f["remove"](n, "e"), "removed_first": f["removeFirstOccurence"](n, "e"), "joined": f["concat"](n, "!"), "repeated": f["repeat"](F.col("p_type"), 2), "hexed": f["textToHex"](b),
        "words": f["toList"](n, " "), "length": f["length"](n), "number": f["toNumber"](f["getSuffix"](b, "#")),
    })


@query("""SELECT p_partkey, abs(p_size - 20) AS a, ceil(p_retailprice / 7)::BIGINT AS b, floor(p_retailprice / 7)::BIGINT AS c, round(sqrt(p_size), 6) AS d, round(power(p_size, 2), 6) AS e, round(ln(p_size), 6) AS f, round(log10(p_size), 6) AS g,
    round(p_retailprice - trunc(p_retailprice), 6) AS h, round(sin(p_size), 6) AS i, round(atan2(p_size, 3), 6) AS j, round(tanh(p_size), 6) AS k, round(asinh(p_size), 6) AS l, p_size % 2 = 0 AS m, trunc(-p_retailprice / 7)::BIGINT AS n FROM part""")
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p, f = F.col("p_size"), F.col("p_retailprice"), C.MATH
    r = lambda c: F.round(c, 6)
    return _family(_t(spark, sf_dir, "part"), "p_partkey", {
        "a": f["abs"](s - 20), "b": f["ceil"](p / 7), "c": f["floor"](p / 7), "d": r(f["sqrt"](s)), "e": r(f["power"](s, F.lit(2))), "f": r(f["log"](s)), "g": r(f["log10"](s)), "h": r(f["frac"](p)), "i": r(f["sin"](s)),
        "j": r(f["atan2"](s, F.lit(3))), "k": r(f["tanh"](s)), "l": r(f["asinh"](s)), "m": f["isEven"](s), "n": f["Fix"](-p / 7),
    })


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS a, CAST(o_orderdate + INTERVAL 2 MONTH AS DATE) AS b, year(o_orderdate)::INTEGER AS c, month(o_orderdate)::INTEGER AS d, dayofyear(o_orderdate)::INTEGER AS e, weekofyear(o_orderdate)::INTEGER AS f,
    (dayofweek(o_orderdate) + 1)::INTEGER AS g, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01')::INTEGER AS h, CAST(date_trunc('month', o_orderdate) AS DATE) AS i, last_day(CAST(o_orderdate AS DATE)) AS j,
    strftime(o_orderdate, '%Y/%m/%d') AS k, CAST(date_trunc('week', o_orderdate) AS DATE) AS l,
    CAST(o_orderdate AS DATE) + (CASE isodow(o_orderdate) WHEN 3 THEN 5 WHEN 4 THEN 5 WHEN 5 THEN 5 WHEN 6 THEN 4 ELSE 3 END)::INTEGER AS m FROM orders""")
def fn_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, f = F.col("o_orderdate"), C.DATE
    return _family(_t(spark, sf_dir, "orders"), "o_orderkey", {
        "a": f["addDay"](d, 10), "b": f["addMonth"](d, 2), "c": f["getYear"](d), "d": f["month"](d), "e": f["getDayOfYear"](d), "f": f["getWeekOfYear"](d), "g": f["weekday"](d), "h": f["daysBetween"](d, F.lit("2000-01-01").cast("date")),
        "i": f["toStartOfMonth"](d), "j": f["eomonth"](d), "k": f["toString"](d, "yyyy/MM/dd"), "l": f["toStartOfWeek"](d), "m": f["addBusinessDay"](d, 3),
    })


@query("""WITH l AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, list_append(q, 0.0) AS a, list_distinct(q) IS NOT NULL AS b, len(list_distinct(q))::INTEGER AS c, q[2:3] AS d, list_contains(q, 10.0) AS e, q[1] AS f, list_max(q) AS g, CASE WHEN len(q) > 1 THEN q[len(q) - 1] END AS h, len(q)::INTEGER AS i,
    round(list_avg(q), 6) AS j, list_filter(q, lambda x: x NOT IN (1.0, 2.0)) AS k FROM l""")
def fn_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("q"))
    q, f = F.col("q"), C.LIST
    return _family(rows, "l_orderkey", {
        "a": f["add"](q, 0.0), "b": f["distinct"](q).isNotNull(), "c": f["size"](f["distinct"](q)), "d": f["subList"](q, 1, 3), "e": f["contains"](q, 10.0), "f": f["get"](q, 0), "g": f["largest"](q), "h": f["nthLargest"](q, 2),
        "i": f["size"](q), "j": F.round(f["average"](q), 6), "k": f["removeAll"](q, F.array(F.lit(1.0), F.lit(2.0))),
    })


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS type, NULL::VARCHAR AS missing, 3 AS n, ['k', 'type', 'user'] AS keys, true AS has FROM events""")
def fn_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.MAP
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    m = f["put"](m, "k", F.get_json_object("props", "$.k"))
    return _family(_t(spark, sf_dir, "events"), "event_id", {"k": f["get"](m, "k"), "type": f["get"](m, "type"), "missing": f["get"](m, "none"), "n": f["size"](m), "keys": f["keys"](m), "has": f["containKey"](m, "user")})


@query("""SELECT p_partkey, substr(p_name, 2, 3) AS mid, strpos(p_name, 'e') AS instr, regexp_full_match(p_name, 's.*i.g') AS likes, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS iif, sign(p_size - 20)::DOUBLE AS sgn,
    make_date(1998, 2, 3) AS d, (p_size > 10) <> (p_size > 20) AS x FROM part""")
def fn_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, f = F.col("p_name"), F.col("p_size"), C.ACCESS
    return _family(_t(spark, sf_dir, "part"), "p_partkey", {
        "mid": f["Mid"](n, 2, 3), "instr": f["InStr"](n, "e").cast("long"), "likes": f["Like"](n, "s*i?g"), "iif": f["IIf"](s > 25, "big", "small"), "sgn": f["Sgn"](s - 20), "d": f["DateSerial"](1998, 2, 3), "x": f["Xor"](s > 10, s > 20),
    })


@query(r"""SELECT l_orderkey, l_linenumber, regexp_replace(printf('%.4f', l_extendedprice), '\.?0+$', '') AS price, CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END AS returned, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS shipped FROM lineitem""")
def serialize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", S.exported(F.col("l_extendedprice"), "decimal").alias("price"), S.exported(F.col("l_returnflag") == "R", "boolean").alias("returned"), S.exported(F.col("l_shipdate"), "time").alias("shipped")
    )


# --- rules


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as text with faults by the key."""
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(
        k.alias("line"), F.when(k % 50 == 0, F.repeat("c_name", F.lit(20))).otherwise(F.col("c_name")).alias("Name"),
        F.when(k % 7 == 0, "maybe").when(k % 5 == 0, "-1").otherwise("true").alias("Active"),
        F.when(k % 11 == 0, F.concat(F.lit("R"), k.cast("string"))).when(k % 13 == 0, "12x").when(k % 17 == 0, "").otherwise(F.concat(k.cast("string"), F.lit(",500"))).alias("Amount"),
        F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise("Open").alias("Status"),
    )


_STATUSES = ["Open", "BUILDING", "MACHINERY"]
_VALUES_SQL = """WITH d AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN repeat(c_name, 20) ELSE c_name END AS "Name", CASE WHEN c_custkey % 7 = 0 THEN 'maybe' WHEN c_custkey % 5 = 0 THEN '-1' ELSE 'true' END AS a,
        CASE WHEN c_custkey % 11 = 0 THEN 'R' || c_custkey WHEN c_custkey % 13 = 0 THEN '12x' WHEN c_custkey % 17 = 0 THEN '' ELSE c_custkey || ',500' END AS m, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'Open' END AS s FROM customer),
    r AS (SELECT k, 'VD010' AS rule, 'ERROR' AS severity, 'Name: text is too long' AS message FROM d WHERE length("Name") > 255
    UNION ALL SELECT k, 'VD012', 'ERROR', 'Active: not a boolean' FROM d WHERE a NOT IN ('true', 'false', '0', '1', '-1')
    UNION ALL SELECT k, 'VD013', 'WARNING', 'Active: numeric boolean' FROM d WHERE a IN ('0', '1', '-1')
    UNION ALL SELECT k, 'VD014', 'WARNING', 'Amount: currency symbol' FROM d WHERE regexp_matches(m, '[R$]')
    UNION ALL SELECT k, 'VD015', 'ERROR', 'Amount: not a number' FROM d WHERE m <> '' AND NOT regexp_matches(m, '[R$]') AND TRY_CAST(replace(m, ',', '') AS DOUBLE) IS NULL
    UNION ALL SELECT k, 'VD020', 'WARNING', 'Status: unknown status' FROM d WHERE s NOT IN ('Open', 'BUILDING', 'MACHINERY')),
    diagnostics AS (SELECT 'customers.csv' AS file, CAST(k AS INTEGER) AS line, rule, severity, message FROM r)"""


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = {"Name": "TEXT(255)", "Active": "BIT", "Amount": "CURRENCY", "Status": "TEXT"}
    return rules.value_rules(rules.cells(_damaged(spark, sf_dir), "customers.csv", F.col("line"), types), _STATUSES)


@query(_VALUES_SQL + " SELECT * FROM diagnostics")
def value_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnostics(spark, sf_dir)


@query(_VALUES_SQL + " SELECT rule, severity, count(*) AS n_gaps, CAST(round(sum(CASE severity WHEN 'ERROR' THEN 2.0 WHEN 'WARNING' THEN 1.0 ELSE 0.2 END), 6) AS DOUBLE) AS residual FROM diagnostics GROUP BY rule, severity")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.residual(_diagnostics(spark, sf_dir), ["rule", "severity"])


@query(_VALUES_SQL + " SELECT rule, count(*) AS n_gaps, CAST(round(sum(CASE severity WHEN 'ERROR' THEN 2.0 WHEN 'WARNING' THEN 1.0 ELSE 0.2 END), 6) AS DOUBLE) AS residual FROM diagnostics GROUP BY rule ORDER BY residual DESC, rule LIMIT 3")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.hotspots(rules.residual(_diagnostics(spark, sf_dir), ["rule"]), 3)


@query(_VALUES_SQL + " SELECT CAST(max(CASE severity WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS INTEGER) AS exit_code FROM diagnostics")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.exit_code(_diagnostics(spark, sf_dir))


@query("SELECT 'orders.csv' AS file, CAST(o_orderkey AS INTEGER) AS line, 'VD030' AS rule, 'ERROR' AS severity, 'o_custkey: no parent ' || o_custkey AS message FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 10 <> 0)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = _t(spark, sf_dir, "orders").select(F.lit("orders.csv").alias("file"), F.col("o_orderkey").cast("int").alias("line"), "o_custkey")
    return rules.orphans(child, "o_custkey", _t(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0"), "c_custkey")


@query("SELECT 'orders.csv' AS file, CAST(o_orderkey AS INTEGER) AS line, 'HY016' AS rule, 'WARNING' AS severity, 'o_orderpriority: ' || o_orderpriority AS message FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def picklist_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select(F.lit("orders.csv").alias("file"), F.col("o_orderkey").cast("int").alias("line"), "o_orderpriority")
    return rules.picklist(rows, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "HY016")


_FIELDS = [("Claims", "ID", "AUTOINCREMENT"), ("Claims", "Amount", "CURRENCY"), ("Claims", "Notes", "MEMO"), ("Claims", "Dept_ID", "LONG"), ("Claims", "Title", "TEXT(300)"), ("Claims", "Paid", "BIT"), ("Blobs", "Data", "BINARY"), ("Depts", "ID", "LONG"), ("Depts", "Dept_Name", "TEXT(80)")]
_MAPPINGS = [("Claims", "Amount", "claims", "amount_zar"), ("Claims", "Notes", "claims", "notes"), ("Claims", "Dept_ID", "claims", "department"), ("Claims", "Title", "claims", "title"), ("Depts", "Dept_Name", "departments", "name")]
_TYPES = [("AUTOINCREMENT", "autonumber"), ("CURRENCY", "currency"), ("MEMO", "textarea"), ("LONG", "number"), ("TEXT", "text"), ("BIT", "checkbox"), ("BINARY", "")]
_TARGET = [("claims", "amount_zar", "currency"), ("claims", "notes", "textarea"), ("claims", "department", "text"), ("departments", "name", "text"), ("audit", "actor", "text")]
_MANDATORY = [("claims", "amount_zar"), ("claims", "consent")]


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) v({names})"


@query(f"""WITH f AS (SELECT *, upper(trim(regexp_replace(source_type, '\\(.*\\)', ''))) AS base FROM {_values(_FIELDS, 'table_name, field_name, source_type')}), m AS (SELECT * FROM {_values(_MAPPINGS, 'table_name, field_name, form, field')}),
    y AS (SELECT * FROM {_values(_TYPES, 'source_type, target_type')} WHERE target_type <> ''), g AS (SELECT * FROM {_values(_TARGET, 'form, field, field_type')}), n AS (SELECT * FROM {_values(_MANDATORY, 'form, field')}),
    r AS (SELECT f.*, g.field_type, m.field AS to_field FROM f LEFT JOIN m USING (table_name, field_name) LEFT JOIN g ON g.form = m.form AND g.field = m.field),
    o AS (SELECT 'HY001' AS rule, 'ERROR' AS severity, base AS message FROM (SELECT DISTINCT base FROM f WHERE base NOT IN (SELECT source_type FROM y))
    UNION ALL SELECT 'HY002', 'WARNING', table_name || '.' || field_name FROM f WHERE base = 'CURRENCY' UNION ALL SELECT 'HY003', 'WARNING', table_name || '.' || field_name FROM f WHERE base = 'MEMO'
    UNION ALL SELECT 'HY004', 'ERROR', table_name || '.' || field_name FROM r WHERE upper(field_name) <> 'ID' AND field_type IS NULL
    UNION ALL SELECT 'HY005', 'WARNING', table_name || '.' || field_name || ' -> ' || field FROM m WHERE lower(replace(field_name, '_', '')) <> lower(replace(field, '_', ''))
    UNION ALL SELECT 'HY006', 'ERROR', table_name || '.' || field_name FROM r WHERE field_name = 'Dept_ID' AND (to_field IS NULL OR (field_type IS NOT NULL AND field_type <> 'list'))
    UNION ALL SELECT 'HY007', 'WARNING', table_name || '.' || field_name FROM f WHERE TRY_CAST(regexp_extract(source_type, 'TEXT\\((\\d+)\\)', 1) AS INTEGER) > 255
    UNION ALL SELECT 'HY008', 'ERROR', form || '.' || field FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.form = n.form AND m.field = n.field)
    UNION ALL SELECT DISTINCT 'HY009', 'INFO', table_name FROM f WHERE table_name NOT IN (SELECT table_name FROM m) UNION ALL SELECT DISTINCT 'HY010', 'INFO', form FROM g WHERE form NOT IN (SELECT form FROM m)
    UNION ALL SELECT 'HY013', 'WARNING', table_name || '.' || field_name FROM f WHERE base = 'BIT') SELECT 'schema' AS file, 0 AS line, * FROM o""")
def schema_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = spark.createDataFrame
    return rules.schema_rules(
        make(_FIELDS, "table_name string, field_name string, source_type string"), make(_MAPPINGS, "table_name string, field_name string, form string, field string"), make(_TYPES, "source_type string, target_type string"),
        make(_TARGET, "form string, field string, field_type string"), make([("Claims", "Dept_ID")], "table_name string, field_name string"), make(_MANDATORY, "form string, field string"),
    )


@query(r"""WITH l AS (SELECT 'script' || o_orderkey % 5 AS file, CAST(o_orderkey AS INTEGER) AS line, CASE o_orderkey % 4 WHEN 0 THEN 'if (input.status == 1) input.note' WHEN 1 THEN 'x = input.amount' WHEN 2 THEN 'info y' ELSE 'z = input.lost' END AS text FROM orders),
    r AS (SELECT file, line, unnest(regexp_extract_all(text, '\binput\.(\w+)', 1)) AS field FROM l)
    SELECT file, line, 'HY014' AS rule, 'WARNING' AS severity, field AS message FROM r WHERE field IN ('status', 'note', 'amount', 'unused') AND field NOT IN ('amount', 'unused')
    UNION ALL SELECT 'scripts', 0, 'HY015', 'INFO', field FROM (VALUES ('amount'), ('unused')) v(field) WHERE field NOT IN (SELECT field FROM r)""")
def reference_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, "if (input.status == 1) input.note").when(k % 4 == 1, "x = input.amount").when(k % 4 == 2, "info y").otherwise("z = input.lost")
    lines = _t(spark, sf_dir, "orders").select(F.concat(F.lit("script"), (k % 5).cast("string")).alias("file"), k.cast("int").alias("line"), text.alias("text"))
    known, mapped = (spark.createDataFrame([(x,) for x in xs], "field string") for xs in (("status", "note", "amount", "unused"), ("amount", "unused")))
    return rules.reference_rules(rules.input_references(lines), known, mapped)


# --- token store


_TOKENS = "SELECT 't' || doc_id AS token_sha, source AS module, CAST(n_chars AS DOUBLE) AS weight FROM documents"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("token_sha"), F.col("source").alias("module"), F.col("n_chars").cast("double").alias("weight"))


@query(f"WITH t AS ({_TOKENS}) SELECT token_sha, module, weight FROM t")
def token_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens are inserted, of which the store has the short ones already."""
    t = _store(spark, sf_dir)
    return store.insert_tokens(t.filter("weight < 1000"), t)[0]


@query(f"WITH t AS ({_TOKENS}) SELECT token_sha, module, CASE WHEN module = 'src1' THEN 9.0::DOUBLE ELSE weight END AS weight FROM t WHERE module <> 'src2'")
def token_delete_and_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _store(spark, sf_dir)
    none = spark.createDataFrame([], "source_sha string, target_sha string, rel_type string, weight double")
    kept, _ = store.delete_tokens(t, none, t.filter("module = 'src2'"))
    return store.update_weights(kept, kept.filter("module = 'src1'").select("token_sha", F.lit(9.0).alias("weight")))


@query("SELECT source AS module, count(*) AS page_count FROM documents GROUP BY source")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page_counts(_t(spark, sf_dir, "documents").select(F.col("source").alias("module")))


@query(f"WITH t AS ({_TOKENS}) SELECT token_sha, module, weight FROM t WHERE module <> 'src3' UNION ALL SELECT token_sha || 'x', 'src3', 1.0 FROM t WHERE module = 'src4'")
def replace_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _store(spark, sf_dir)
    new = t.filter("module = 'src4'").select(F.concat("token_sha", F.lit("x")).alias("token_sha"), F.lit("src3").alias("module"), F.lit(1.0).alias("weight"))
    return store.replace_module(t, new, "src3")


@query("""SELECT count(*) AS n, count(DISTINCT k) AS n_keys FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    both = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(c.filter("k % 2 = 0")).distinct()
    return both.join(c.filter("k % 5 = 0"), "k", "left_anti").agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_keys"))
