"""Queries over the catalogued scalar functions that the families of ``records`` leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as C
from weftline.operators import relational

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


def _family(base: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    return base.select(key, *(c.alias(n) for n, c in columns.items()))


def _r(c: Column) -> Column:
    return F.round(c, 6)


@query(r"""SELECT p_partkey, contains(lower(p_brand), 'rand#1') AS a, starts_with(lower(p_brand), 'bra') AS b, ends_with(lower(p_brand), '1') AS c, p_name = '' AS d, trim(p_name) = '' AS e, regexp_replace(p_brand, '[A-Za-z]', '', 'g') AS f,
    regexp_replace(p_brand, '[A-Za-z0-9]', '', 'g') AS g, substr(p_name, 2, 3) AS h, lower(p_brand) AS i, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS j,
    p_name AS k, p_name || ' ' AS l, '  ' || p_name AS m, rpad(p_name, 12, ' ') AS n, regexp_replace(p_name, '^(.*)e', '\1') AS o, replace(p_name, 'e', '3') AS p, replace(p_name, 'e', '3') AS q, p_name AS r, p_brand AS s, replace(p_name, ' ', '+') AS t,
    TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) IS NOT NULL AS u, 'B' AS v, split_part(p_brand, '#', 2) AS w, regexp_replace(p_name, 'e', '$3') AS x, regexp_replace(p_name, 'e', '3') AS y, p_name IS NOT DISTINCT FROM 'red widget' AS z FROM part""")
def fn_text_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b, f = F.col("p_name"), F.col("p_brand"), C.TEXT
    wide = F.concat(F.lit("  "), n, F.lit(" "))
    return _family(_t(spark, sf_dir, "part"), "p_partkey", {
        "a": f["containsIgnoreCase"](b, "RAND#1"), "b": f["startsWithIgnoreCase"](b, "BRA"), "c": f["endsWithIgnoreCase"](b, "1"), "d": f["isEmpty"](n), "e": f["isBlank"](n), "f": f["removeAllAlpha"](b), "g": f["removeAllAlphaNumeric"](b), "h": f["subText"](n, 1, 4),
        "i": f["toLowerCase"](b), "j": f["proper"](n), "k": f["trim"](wide), "l": f["ltrim"](wide), "m": f["rtrim"](wide), "n": f["rightpad"](n, 12), "o": f["removeLastOccurence"](n, "e"), "p": f["replaceAll"](n, "e", "3"), "q": f["replaceAllIgnoreCase"](n, "E", "3"),
        "r": f["toString"](n), "s": f["hexToText"](f["textToHex"](b)), "t": f["encodeUrl"](n), "u": f["isNumber"](f["getSuffix"](b, "#")), "v": f["getPrefixIgnoreCase"](b, "RAND"), "w": f["getSuffixIgnoreCase"](b, "RAND#"), "x": f["replaceFirst"](n, "e", "$3"),
        "y": f["replaceFirstIgnoreCase"](n, "E", "3"), "z": f["equals"](n, "red widget"),
    })


@query(r"""SELECT p_partkey, coalesce(CAST(split_part(p_brand, '#', 2) AS BIGINT), 0) AS a, 0::BIGINT AS b, 'x' AS c, ['a', p_name] AS d, DATE '1998-02-03' AS e, NULL::DATE AS f, TIMESTAMP '1998-02-03 04:05:06' AS g, true AS h, false AS i, 'None' AS j, '<' || p_name || '>' AS k,
    regexp_full_match(p_name, '[\x00-\x7F]*') AS l, 'none' AS m, true AS n, true AS o, CAST(p_retailprice AS DOUBLE) AS p FROM part""")
def fn_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b, f, none = F.col("p_name"), F.col("p_brand"), C.TEXT, F.lit(None).cast("string")
    return _family(_t(spark, sf_dir, "part"), "p_partkey", {
        "a": f["toLong"](f["getSuffix"](b, "#")), "b": f["toLong"](n), "c": C.MAP["get"](f["toMap"](F.lit('{"k": "x"}')), "k"), "d": f["toJSONList"](F.concat(F.lit('["a", "'), n, F.lit('"]'))), "e": f["toDate"](F.lit("1998-02-03"), "yyyy-MM-dd"), "f": f["toDate"](n, "yyyy-MM-dd"),
        "g": f["toTime"](F.lit("1998-02-03 04:05:06"), "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz"), "h": f["isFile"](F.concat(n, F.lit(".txt"))), "i": f["isFile"](n), "j": f["methodToString"](none), "k": f["text"](n, "<%s>"), "l": f["isAscii"](n), "m": f["ifnull"](none, "none"), "n": f["isnull"](none),
        "o": f["isText"](n), "p": F.col("p_retailprice").cast("string").try_cast("double"),
    })


_ONES = str(C.ONES)
_TENS = str(C.TENS)


@query(f"""SELECT p_partkey, round(p_retailprice / 7, 2) AS a, round(exp(p_size / 50.0::DOUBLE), 6) AS b, round(cos(p_size), 6) AS c, round(tan(p_size), 6) AS d, round(asin(p_size / 100.0::DOUBLE), 6) AS e, round(acos(p_size / 100.0::DOUBLE), 6) AS f, round(atan(p_size), 6) AS g, round(sinh(p_size / 10.0::DOUBLE), 6) AS h,
    round(cosh(p_size / 10.0::DOUBLE), 6) AS i, round(acosh(p_size + 1), 6) AS j, round(atanh(p_size / 100.0::DOUBLE), 6) AS k, p_size % 2 = 1 AS l, hex(p_size) AS m, CAST(sign(p_size - 20) AS DOUBLE) AS n, CAST(floor(-p_retailprice / 7) AS BIGINT) AS o, CAST(p_size % 7 AS INTEGER) AS p, CAST(p_size AS BIGINT) AS q,
    CASE WHEN p_size < 20 THEN ({_ONES})[p_size + 1] ELSE ({_TENS})[p_size // 10 + 1] || CASE WHEN p_size % 10 > 0 THEN '-' || ({_ONES})[p_size % 10 + 1] ELSE '' END END AS r,
    'minus one million two hundred three thousand ' || ({_ONES})[p_size % 9 + 2] AS s FROM part""")
def fn_math_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p, f = F.col("p_size"), F.col("p_retailprice"), C.MATH
    return _family(_t(spark, sf_dir, "part"), "p_partkey", {
        "a": f["round"](p / 7, 2), "b": _r(f["exp"](s / 50)), "c": _r(f["cos"](s)), "d": _r(f["tan"](s)), "e": _r(f["asin"](s / 100)), "f": _r(f["acos"](s / 100)), "g": _r(f["atan"](s)), "h": _r(f["sinh"](s / 10)), "i": _r(f["cosh"](s / 10)), "j": _r(f["acosh"](s + 1)), "k": _r(f["atanh"](s / 100)),
        "l": f["isOdd"](s), "m": f["toHex"](s), "n": f["sign"](s - 20), "o": f["Int"](-p / 7), "p": f["Mod"](s, F.lit(7)).cast("int"), "q": f["toLong"](s), "r": f["toWords"](s), "s": f["toWords"](-(F.lit(1_203_001) + s % 9)),
    })


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS TIMESTAMP) AS t FROM orders)
    SELECT o_orderkey, d - 10 AS a, d + 14 AS b, CAST(t + INTERVAL 2 YEAR AS DATE) AS c, t + INTERVAL 5 HOUR AS d, t + INTERVAL 7 MINUTE AS e, t + INTERVAL 9 SECOND AS f, d - 14 AS g, CAST(t - INTERVAL 2 MONTH AS DATE) AS h, CAST(t - INTERVAL 1 YEAR AS DATE) AS i, t - INTERVAL 5 HOUR AS j, t - INTERVAL 7 MINUTE AS k,
    t - INTERVAL 9 SECOND AS l, day(t)::INTEGER AS m, hour(t + INTERVAL 5 HOUR)::INTEGER AS n, minute(t + INTERVAL 7 MINUTE)::INTEGER AS o, second(t + INTERVAL 9 SECOND)::INTEGER AS p, 53::BIGINT AS q, 3187::BIGINT AS r,
    ((1999 - year(d)) * 12 + 6 - month(d))::INTEGER AS s, (1999 - year(d))::INTEGER AS u, ((1999 - year(d)) * 360 + (6 - month(d)) * 30 + 15 - least(day(d), 30))::INTEGER AS v, (d + (8 - isodow(d))::INTEGER)::DATE AS w, (d - (isodow(d) - 1)::INTEGER)::DATE AS x, CAST(t + INTERVAL 3 MONTH AS DATE) AS y,
    CAST(epoch(t) AS BIGINT) AS z, strftime(t, '%Y-%m-%d %H:%M:%S') AS aa, d - (CASE isodow(d) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END)::INTEGER AS bb, d + (CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::INTEGER AS cc FROM o""")
def fn_date_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f = F.col("o_orderdate").cast("timestamp_ntz"), C.DATE
    d, end = F.col("o_orderdate").cast("date"), F.lit("1999-06-15").cast("date")
    return _family(_t(spark, sf_dir, "orders"), "o_orderkey", {
        "a": f["subDay"](d, 10), "b": f["addWeek"](d, 2), "c": f["addYear"](d, 2), "d": f["addHour"](t, 5), "e": f["addMinutes"](t, 7), "f": f["addSeconds"](t, 9), "g": f["subWeek"](d, 2), "h": f["subMonth"](d, 2), "i": f["subYear"](d, 1), "j": f["subHour"](t, 5), "k": f["subMinutes"](t, 7), "l": f["subSeconds"](t, 9),
        "m": f["getDay"](t), "n": f["getHour"](f["addHour"](t, 5)), "o": f["getMinutes"](f["addMinutes"](t, 7)), "p": f["getSeconds"](f["addSeconds"](t, 9)), "q": f["hoursBetween"](t, f["addMinutes"](t, 3187)), "r": f["minutesBetween"](t, f["addMinutes"](t, 3187)), "s": f["totalMonth"](d, end), "u": f["totalYear"](d, end),
        "v": f["days360"](d, end), "w": f["nextWeekDay"](d, "MON"), "x": f["previousWeekDay"](f["addDay"](d, 1), "MON"), "y": f["edate"](d, 3), "z": f["unixEpoch"](t), "aa": f["toDateTimeString"](t), "bb": f["subBusinessDay"](d, 1), "cc": f["workday"](d, 1),
    })


@query("""WITH l AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS q, list_sort(list(CAST(l_linenumber AS INTEGER))) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, list_concat(q, q) AS a, q[2:] AS b, list_concat([0.5], q) AS c, list_reverse_sort(q)[1] AS d, coalesce(list_position(n, 2), 0) - 1 AS e, list_sort(list_intersect(n, [1, 2, 9])) AS f, list_min(q) AS g, q[1] AS h, array_to_string(n, '-') AS i, '[' || array_to_string(n, ',') || ']' AS j, false AS k,
    NOT list_contains(n, 3) AS l, CASE WHEN list_contains(n, 1) THEN len(n) - list_position(list_reverse(n), 1) ELSE -1 END AS m, median_ AS o, CASE WHEN list_contains(n, 1) THEN list_concat(n[: list_position(n, 1) - 1], n[list_position(n, 1) + 1 :]) ELSE n END AS p, 0 AS r, len(list_filter(list_distinct(q), lambda x: len(list_filter(q, lambda y: y = x)) > 1))::INTEGER AS s FROM (SELECT *, round(list_aggregate(q, 'median'), 6) AS median_ FROM l)""")
def fn_list_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("q"), F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("n"))
    q, n, f = F.col("q"), F.col("n"), C.LIST
    return _family(rows, "l_orderkey", {
        "a": f["addAll"](q, q), "b": f["remove"](q, 0), "c": f["insert"](q, 0, 0.5), "d": F.get(F.reverse(f["sort"](q)), F.lit(0)), "e": f["indexOf"](n, 2).cast("long"), "f": f["sort"](f["intersect"](n, F.array(F.lit(1), F.lit(2), F.lit(9)))), "g": f["smallest"](q), "h": f["nthSmallest"](q, 1),
        "i": f["toListString"](n, "-"), "j": f["toJSONList"](n), "k": f["isEmpty"](q), "l": f["notContains"](n, 3), "m": f["lastIndexOf"](n, 1), "o": F.round(f["median"](q), 6), "p": f["removeElement"](n, 1), "r": f["size"](f["clear"](q)), "s": f["size"](f["duplicate"](q)),
    })


@query("""SELECT event_id, event_type AS a, 2 AS b, true AS c, ['k', 'type'] AS d, ['k', 'type'] AS e, false AS f, true AS g, 0 AS h, '{"k":"v"}' AS i, ['k', 'type'] AS j, json_extract_string(props, '$.k') AS l, event_type AS m, 'type' AS n, 'type' AS o, true AS p, ['k'] AS q, ['type'] AS r, ['type'] AS s,
    ['k'] AS u, ['new'] AS w, list_sort(['v', event_type]) AS x, ['v', event_type] AS y, ['v'] AS z FROM events""")
def fn_map_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, g = C.MAP, C.COLLECTION
    kind = F.col("event_type")
    m, v = F.create_map(F.lit("type"), kind), F.create_map(F.lit("k"), F.lit("v"))
    both = f["putAll"](v, m)
    return _family(_t(spark, sf_dir, "events"), "event_id", {
        "a": f["get"](both, "type"), "b": f["size"](both), "c": f["containValue"](both, kind), "d": f["keys"](both), "e": F.map_keys(f["sortKey"](both)), "f": f["isEmpty"](both), "g": f["notContains"](both, "none"), "h": f["size"](f["clear"](both)), "i": f["toJSONList"](v), "j": f["toList"](both), "l": f["getJSON"](F.col("props"), "$.k"),
        "m": g["get"](g["insertAll"](v, m), "type"), "n": g["getKey"](both, kind), "o": g["getLastKey"](both, kind), "p": g["containsValue"](both, kind) & g["containsKey"](both, "k") & ~g["notContains"](both, kind), "q": g["keys"](g["deleteKey"](both, "type")), "r": g["keys"](g["deleteKeys"](both, F.array(F.lit("k")))), "s": g["keys"](g["delete"](both, F.lit("v"))),
        "u": g["sortKey"](g["deleteAll"](both, F.array(kind))), "w": g["values"](g["update"](v, "k", F.lit("new"))), "x": g["sort"](both), "y": g["values"](both), "z": g["distinct"](g["intersect"](both, v)),
    })


@query(r"""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS dt FROM orders) SELECT o_orderkey, o_orderpriority[1:2] AS a, right(o_orderpriority, 3) AS b, length(o_orderpriority)::INTEGER AS c, o_orderstatus AS d, lower(o_orderpriority) AS e, upper(o_orderpriority) AS f, replace(o_orderpriority, '-', '+') AS g, '   ' AS h, reverse(o_orderpriority) AS i,
    'none' AS j, round(sqrt(o_totalprice), 6) AS k, CAST(round_even(o_totalprice / 1000, 0) AS INTEGER) AS l, CAST(round_even(o_totalprice, 0) AS BIGINT) AS m, CAST(o_orderkey AS VARCHAR) AS n, CAST(o_orderkey AS DOUBLE) AS o, o_orderkey <> 0 AS p, CAST(regexp_extract(o_orderpriority, '^\d', 0) AS DOUBLE) AS q, year(dt)::INTEGER AS r, month(dt)::INTEGER AS s, day(dt)::INTEGER AS t,
    (o_orderkey % 2 = 0) = (o_orderkey % 3 = 0) AS u, NOT (o_orderkey % 2 = 0) OR (o_orderkey % 3 = 0) AS v, CAST(floor(o_orderkey / 7) AS BIGINT) AS w, 'xxx' AS x, CASE WHEN lower(o_orderpriority) < '3' THEN -1 ELSE 1 END AS y, 2 AS z, string_split(o_orderpriority, '-') AS aa, hex(o_orderkey) AS bb, chr((65 + o_orderkey % 26)::INTEGER) AS cc,
    ascii(o_orderpriority)::INTEGER AS dd, strftime(dt, '%B') AS ee, strftime(dt, '%A') AS ff, false AS gg, dt + 5 AS hh, CAST(dt + INTERVAL 1 MONTH AS DATE) AS ii, date_diff('day', dt, DATE '2000-01-01')::INTEGER AS jj, quarter(dt)::INTEGER AS kk, ' ' || o_orderkey AS ll FROM o""")
def fn_access_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, p, f = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_totalprice"), C.ACCESS
    d = F.col("o_orderdate").cast("date")
    even, third = k % 2 == 0, k % 3 == 0
    return _family(_t(spark, sf_dir, "orders"), "o_orderkey", {
        "a": f["Left"](n, 2), "b": f["Right"](n, 3), "c": f["Len"](n), "d": f["Trim"](F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" "))), "e": f["LCase"](n), "f": f["UCase"](n), "g": f["Replace"](n, "-", "+"), "h": f["Space"](3), "i": f["StrReverse"](n), "j": f["Nz"](F.lit(None).cast("string"), "none"), "k": _r(f["Sqr"](p)),
        "l": f["CInt"](p / 1000), "m": f["CLng"](p), "n": f["CStr"](k), "o": f["CDbl"](k), "p": f["CBool"](k), "q": f["Val"](f["Left"](n, 1)), "r": f["Year"](d), "s": f["Month"](d), "t": f["Day"](d), "u": f["Eqv"](even, third), "v": f["Imp"](even, third), "w": f["IntDiv"](k, F.lit(7)), "x": f["String"](3, "x"),
        "y": f["StrComp"](n, F.lit("3")), "z": f["InStrRev"](n, "-").cast("int"), "aa": f["Split"](n, "-"), "bb": f["Hex"](k), "cc": f["Chr"](F.lit(65) + k % 26), "dd": f["Asc"](n), "ee": f["MonthName"](d), "ff": f["WeekdayName"](d), "gg": f["IsNumeric"](n) | f["IsDate"](n) | f["IsNull"](n), "hh": f["DateAdd"]("d", 5, d),
        "ii": f["DateAdd"]("m", 1, d), "jj": f["DateDiff"]("d", d, F.lit("2000-01-01").cast("date")), "kk": f["DatePart"]("q", d), "ll": f["Str"](k),
    })


@query("SELECT l_orderkey, regexp_replace(printf('%.4f', l_extendedprice), '\\.?0+$', '') AS printed, l_linenumber % 2 = 0 AS even, round(l_extendedprice - trunc(l_extendedprice), 6) AS frac FROM lineitem")
def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.registered(spark)
    _t(spark, sf_dir, "lineitem").createOrReplaceTempView("wl_lines")
    return spark.sql("SELECT l_orderkey, wl_printed(l_extendedprice) AS printed, wl_is_even(l_linenumber) AS even, round(wl_frac(l_extendedprice), 6) AS frac FROM wl_lines")


@query("SELECT l_returnflag, arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS first, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS last FROM lineitem GROUP BY l_returnflag")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    return relational.first_last(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", at)


@query("SELECT * FROM (SELECT 'DLookup' AS fn, (SELECT min(c_acctbal) FROM customer WHERE c_custkey = 7) AS value UNION ALL SELECT 'DCount', (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING')::DOUBLE UNION ALL SELECT 'DAvg', round((SELECT avg(c_acctbal) FROM customer WHERE c_mktsegment = 'BUILDING'), 6) UNION ALL SELECT 'DMin', (SELECT min(c_acctbal) FROM customer) UNION ALL SELECT 'DMax', (SELECT max(c_acctbal) FROM customer))")
def domain_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, v = _t(spark, sf_dir, "customer"), F.col("c_acctbal")
    building = F.col("c_mktsegment") == "BUILDING"
    parts = [("DLookup", F.min(v), F.col("c_custkey") == 7), ("DCount", F.count("*").cast("double"), building), ("DAvg", F.round(F.avg(v), 6), building), ("DMin", F.min(v), None), ("DMax", F.max(v), None)]
    out = [relational.domain(c, a, w).select(F.lit(n).alias("fn"), "value") for n, a, w in parts]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3]).unionAll(out[4])
