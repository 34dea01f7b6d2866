"""The catalogued scalar functions by name: each takes and gives Columns. Places in text count from 0."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weftline.functions import script as S

L = F.lit
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()


def _find(s: Column, x: Column) -> Column:
    return F.instr(s, x) - 1 if isinstance(x, str) else F.locate(x, s) - 1


def _literal(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def _nth(values: Column, n: int, falling: bool) -> Column:
    return F.get(F.sort_array(values, asc=not falling), L(n - 1))


def _business(start: Column, days: int) -> Column:
    """The date ``days`` working days after (before, if negative) a date."""
    step = 1 if days >= 0 else -1
    reach = F.sequence(L(1), L(abs(days) * 7 // 5 + 7))
    dates = F.filter(F.transform(reach, lambda i: F.date_add(start, (i * step).cast("int"))), lambda d: F.weekday(d) < 5)
    return F.get(dates, L(abs(days) - 1)) if days else start.cast("date")


def _workday(start: Column, days: int) -> Column:
    return _business(start, days)


def _in_words(n: Column) -> Column:
    """A whole number below a million million in English words."""
    ones = F.array(*(L(w) for w in ONES))
    tens = F.array(*(L(w) for w in TENS))

    def below_thousand(x: Column) -> Column:
        rest = x % 100
        small = F.when(rest < 20, F.when(rest > 0, F.get(ones, rest))).otherwise(F.concat_ws("-", F.get(tens, F.floor(rest / 10).cast("int")), F.when(rest % 10 > 0, F.get(ones, rest % 10))))
        return F.concat_ws(" ", F.when(x >= 100, F.concat(F.get(ones, F.floor(x / 100).cast("int")), L(" hundred"))), small)

    size = F.abs(n.cast("long"))
    parts = [F.when(F.floor(size / scale) % 1000 > 0, F.concat_ws(" ", below_thousand((F.floor(size / scale) % 1000).cast("int")), L(name) if name else L(None).cast("string"))) for scale, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (1, ""))]
    return F.concat_ws(" ", F.when(n < 0, "minus"), F.when(size == 0, "zero").otherwise(F.concat_ws(" ", *parts)))


def _days360(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + (F.least(F.dayofmonth(b), L(30)) - F.least(F.dayofmonth(a), L(30)))


TEXT: dict[str, Callable[..., Column]] = {
    "contains": lambda s, x: F.coalesce(F.contains(s, L(x)), L(False)),
    "notContains": lambda s, x: ~F.coalesce(F.contains(s, L(x)), L(False)),
    "containsIgnoreCase": lambda s, x: F.coalesce(F.contains(F.lower(s), L(x.lower())), L(False)),
    "startsWith": lambda s, x: F.coalesce(s.startswith(x), L(False)),
    "endsWith": lambda s, x: F.coalesce(s.endswith(x), L(False)),
    "startsWithIgnoreCase": lambda s, x: F.coalesce(F.lower(s).startswith(x.lower()), L(False)),
    "endsWithIgnoreCase": lambda s, x: F.coalesce(F.lower(s).endswith(x.lower()), L(False)),
    "equalsIgnoreCase": lambda s, x: F.lower(s) == x.lower(),
    "matches": lambda s, p: s.rlike(f"^(?:{p})$"),
    "isEmpty": lambda s: F.coalesce(F.length(s) == 0, L(True)),
    "isBlank": lambda s: S.trimmed(s) == "",
    "getAlpha": lambda s: F.regexp_replace(s, "[^A-Za-z]", ""),
    "getAlphaNumeric": lambda s: F.regexp_replace(s, "[^A-Za-z0-9]", ""),
    "removeAllAlpha": lambda s: F.regexp_replace(s, "[A-Za-z]", ""),
    "removeAllAlphaNumeric": lambda s: F.regexp_replace(s, "[A-Za-z0-9]", ""),
    "getPrefix": S.prefix,
    "getSuffix": S.suffix,
    "getOccurenceCount": lambda s, x: ((F.length(s) - F.length(F.replace(s, L(x), L("")))) / len(x)).cast("int"),
    "left": lambda s, n: F.substring(s, 1, n),
    "right": lambda s, n: F.right(s, L(n)),
    "mid": lambda s, start, n: F.substring(s, start + 1, n),
    "subText": lambda s, a, b: F.substring(s, a + 1, b - a),
    "indexOf": lambda s, x: F.locate(x, s) - 1,
    "lastIndexOf": lambda s, x: F.when(F.contains(s, L(x)), F.length(s) - F.locate(x[::-1], F.reverse(s)) - len(x) + 1).otherwise(-1),
    "toUpperCase": F.upper,
    "toLowerCase": F.lower,
    "proper": F.initcap,
    "trim": S.trimmed,
    "ltrim": lambda s: F.regexp_replace(s, r"(?U)^\s+", ""),
    "rtrim": lambda s: F.regexp_replace(s, r"(?U)\s+$", ""),
    "reverse": F.reverse,
    "leftpad": lambda s, n: F.lpad(s, n, " "),
    "rightpad": lambda s, n: F.rpad(s, n, " "),
    "concat": lambda s, x: S.joined(s, L(x)),
    "repeat": lambda s, n: F.repeat(s, L(n)),
    "remove": lambda s, x: F.replace(s, L(x), L("")),
    "removeFirstOccurence": lambda s, x: F.regexp_replace(s, f"^(.*?){_literal(x)}", "$1"),
    "removeLastOccurence": lambda s, x: F.regexp_replace(s, f"^(.*){_literal(x)}", "$1"),
    "replaceAll": lambda s, x, y: F.replace(s, L(x), L(y)),
    "replaceAllIgnoreCase": lambda s, x, y: F.regexp_replace(s, f"(?i){_literal(x)}", y),
    "toList": lambda s, d: F.split(s, _literal(d)),
    "toNumber": S.to_number,
    "toString": S.to_text,
    "length": lambda s: F.coalesce(F.length(s), L(0)),
    "isAscii": lambda s: s.rlike(r"^[\x00-\x7F]*$"),
    "textToHex": lambda s: F.hex(s),
    "hexToText": lambda s: F.decode(F.unhex(s), "UTF-8"),
    "encodeUrl": F.url_encode,
    "isNumber": lambda s: s.try_cast("double").isNotNull(),
    "ifnull": lambda s, x: F.coalesce(s, L(x)),
    "isnull": lambda s: s.isNull(),
    "getPrefixIgnoreCase": lambda s, x: F.when(F.contains(F.lower(s), L(x.lower())), F.substring(s, L(1), F.locate(x.lower(), F.lower(s)) - 1)).otherwise(s),
    "getSuffixIgnoreCase": lambda s, x: F.when(F.contains(F.lower(s), L(x.lower())), F.right(s, F.locate(x[::-1].lower(), F.reverse(F.lower(s))) - 1)).otherwise(s),
    "replaceFirst": lambda s, x, y: F.regexp_replace(s, f"^((?s:.*?)){_literal(x)}", "$1" + re.sub(r"([\\\\$])", r"\\\1", y)),
    "replaceFirstIgnoreCase": lambda s, x, y: F.regexp_replace(s, f"(?i)^((?s:.*?)){_literal(x)}", "$1" + re.sub(r"([\\\\$])", r"\\\1", y)),
    "equals": lambda s, x: s.eqNullSafe(L(x)),
    "text": lambda s, pattern: F.format_string(pattern, s),
    "toMap": lambda s: F.from_json(s, "map<string,string>"),
    "toLong": lambda s: F.coalesce(F.regexp_replace(s, r"^\s+|\s+$", "").try_cast("long"), L(0)),
    "toDecimal": lambda s: s.try_cast("decimal(38,10)"),
    "toJSONList": lambda s: F.from_json(s, "array<string>"),
    "toDate": lambda s, pattern: F.try_to_date(s, pattern),
    "toTime": lambda s, pattern: F.try_to_timestamp(s, L(pattern)),
    "isText": lambda s: s.isNotNull(),
    "isFile": lambda s: F.coalesce(s.rlike(r"^[^\x00]*[^/\\\x00]+\.[A-Za-z0-9]{1,8}$"), L(False)),
    "methodToString": lambda s: F.coalesce(s.cast("string"), L("None")),
}

MATH: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round, "sqrt": F.sqrt, "power": F.pow, "exp": F.exp, "log": F.ln, "log10": F.log10,
    "frac": lambda x: x - F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "isEven": lambda x: F.pmod(x, L(2)) == 0, "isOdd": lambda x: F.pmod(x, L(2)) == 1, "toHex": F.hex, "sign": F.signum,
    "Int": F.floor, "Fix": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)), "Mod": lambda x, y: x % y,
    "toWords": _in_words, "toLong": lambda x: x.cast("long"), "toDecimal": lambda x: x.cast("decimal(38,10)"), "isNumber": lambda x: x.try_cast("double").isNotNull(), "randomNumber": lambda seed: F.rand(seed),
}

DATE: dict[str, Callable[..., Column]] = {
    "addDay": lambda d, n: F.date_add(d, n),
    "subDay": lambda d, n: F.date_sub(d, n),
    "addWeek": lambda d, n: F.date_add(d, 7 * n),
    "addMonth": lambda d, n: F.add_months(d, n),
    "addYear": lambda d, n: F.add_months(d, 12 * n),
    "addHour": lambda t, n: F.timestamp_add("HOUR", L(n), t),
    "addMinutes": lambda t, n: F.timestamp_add("MINUTE", L(n), t),
    "addSeconds": lambda t, n: F.timestamp_add("SECOND", L(n), t),
    "addBusinessDay": _business,
    "day": F.dayofmonth, "getDayOfYear": F.dayofyear, "hour": F.hour, "minute": F.minute, "month": F.month, "second": F.second, "getWeekOfYear": F.weekofyear, "getYear": F.year,
    "weekday": F.dayofweek,
    "daysBetween": lambda a, b: F.datediff(b, a),
    "hoursBetween": lambda a, b: F.timestamp_diff("HOUR", a, b),
    "minutesBetween": lambda a, b: F.timestamp_diff("MINUTE", a, b),
    "monthsBetween": lambda a, b: F.timestamp_diff("MONTH", a, b),
    "yearsBetween": lambda a, b: F.timestamp_diff("YEAR", a, b),
    "days360": _days360,
    "toStartOfMonth": lambda d: F.trunc(d, "month"),
    "toStartOfWeek": lambda d: F.trunc(d, "week"),
    "nextWeekDay": lambda d, name: F.next_day(d, name),
    "edate": lambda d, n: F.add_months(d, n),
    "eomonth": F.last_day,
    "toString": lambda t, pattern: F.date_format(t, pattern),
    "isDate": lambda s: F.try_to_date(s, "yyyy-MM-dd").isNotNull(),
    "subWeek": lambda d, n: F.date_sub(d, 7 * n), "subMonth": lambda d, n: F.add_months(d, -n), "subYear": lambda d, n: F.add_months(d, -12 * n),
    "subHour": lambda t, n: F.timestamp_add("HOUR", L(-n), t), "subMinutes": lambda t, n: F.timestamp_add("MINUTE", L(-n), t), "subSeconds": lambda t, n: F.timestamp_add("SECOND", L(-n), t),
    "subBusinessDay": lambda d, n: _business(d, -n), "workday": _workday, "getDay": F.dayofmonth, "getHour": F.hour, "getMinutes": F.minute, "getMonth": F.month, "getSeconds": F.second,
    "totalMonth": lambda a, b: (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a), "totalYear": lambda a, b: F.year(b) - F.year(a),
    "previousWeekDay": lambda d, name: F.date_sub(F.next_day(F.date_sub(d, 1), name), 7), "now": F.current_timestamp, "today": F.current_date, "unixEpoch": lambda t: F.unix_seconds(t.cast("timestamp")),
    "toDateTimeString": lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss"), "toDate": lambda t: t.cast("date"), "toTime": lambda s, pattern: F.try_to_timestamp(s, L(pattern)),
}

LIST: dict[str, Callable[..., Column]] = {
    "add": lambda a, x: F.array_append(a, L(x)),
    "addAll": F.concat,
    "remove": lambda a, n: F.filter(a, lambda _, i: i != n),
    "removeAll": lambda a, b: F.filter(a, lambda x: ~F.array_contains(b, x)),
    "insert": lambda a, n, x: F.array_insert(a, n + 1, L(x)),
    "sort": F.array_sort,
    "distinct": F.array_distinct,
    "subList": lambda a, x, y: F.slice(a, x + 1, y - x),
    "contains": lambda a, x: F.array_contains(a, x),
    "get": lambda a, n: F.get(a, L(n)),
    "indexOf": lambda a, x: F.array_position(a, x) - 1,
    "size": lambda a: F.coalesce(F.size(a), L(0)),
    "intersect": F.array_intersect,
    "largest": F.array_max,
    "smallest": F.array_min,
    "nthLargest": lambda a, n: _nth(a, n, True),
    "nthSmallest": lambda a, n: _nth(a, n, False),
    "average": lambda a: F.aggregate(a, L(0.0), lambda s, x: s + x, lambda s: F.try_divide(s, F.size(a))),
    "toListString": lambda a, d: F.array_join(a, d),
    "toJSONList": F.to_json,
    "isEmpty": lambda a: F.coalesce(F.size(a) == 0, L(True)),
    "notContains": lambda a, x: ~F.array_contains(a, x),
    "lastIndexOf": lambda a, x: F.when(F.array_contains(a, x), F.size(a) - F.array_position(F.reverse(a), x)).otherwise(-1).cast("long"),
    "median": lambda a: (F.get(F.array_sort(a), F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))) / 2,
    "removeElement": lambda a, x: F.filter(a, lambda _, i: i != F.array_position(a, x).cast("int") - 1),
    "clear": lambda a: F.slice(a, 1, 0),
    "duplicate": lambda a: F.array_distinct(F.filter(a, lambda x: F.size(F.filter(a, lambda y: y == x)) > 1)),
}

MAP: dict[str, Callable[..., Column]] = {
    "put": lambda m, k, v: F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(L(k), v)),
    "putAll": lambda m, n: F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(n, k)), n),
    "remove": lambda m, k: F.map_filter(m, lambda x, _: x != k),
    "get": lambda m, k: F.try_element_at(m, L(k)),
    "containKey": lambda m, k: F.map_contains_key(m, k),
    "containValue": lambda m, v: F.array_contains(F.map_values(m), v),
    "size": lambda m: F.coalesce(F.size(m), L(0)),
    "keys": lambda m: F.array_sort(F.map_keys(m)),
    "values": F.map_values,
    "sortKey": lambda m: F.map_from_entries(F.array_sort(F.map_entries(m))),
    "isEmpty": lambda m: F.coalesce(F.size(m) == 0, L(True)),
    "getJSON": F.get_json_object,
    "notContains": lambda m, k: ~F.map_contains_key(m, k),
    "clear": lambda m: F.map_filter(m, lambda k, _: k.isNull()),
    "toJSONList": F.to_json,
    "toList": lambda m: F.array_sort(F.map_keys(m)),
}


def _entries(c: Column) -> Column:
    return F.array_sort(F.map_entries(c))


# a collection is a map from keys (places, where none are given) to values
COLLECTION: dict[str, Callable[..., Column]] = {
    "insert": MAP["put"], "insertAll": MAP["putAll"], "update": lambda m, k, v: F.transform_values(m, lambda x, y: F.when(x == k, v).otherwise(y)),
    "get": MAP["get"], "getKey": lambda m, v: F.get(F.array_sort(F.map_keys(F.map_filter(m, lambda _, y: y == v))), L(0)), "getLastKey": lambda m, v: F.array_max(F.map_keys(F.map_filter(m, lambda _, y: y == v))),
    "containsKey": MAP["containKey"], "containsValue": MAP["containValue"], "notContains": lambda m, v: ~F.array_contains(F.map_values(m), v),
    "deleteKey": MAP["remove"], "deleteKeys": lambda m, keys: F.map_filter(m, lambda k, _: ~F.array_contains(keys, k)), "delete": lambda m, v: F.map_filter(m, lambda _, y: y != v), "deleteAll": lambda m, values: F.map_filter(m, lambda _, y: ~F.array_contains(values, y)),
    "clear": MAP["clear"], "isEmpty": MAP["isEmpty"], "size": MAP["size"], "keys": MAP["keys"], "values": lambda m: F.transform(_entries(m), lambda e: e["value"]),
    "distinct": lambda m: F.array_sort(F.array_distinct(F.map_values(m))), "duplicate": lambda m: F.array_sort(LIST["duplicate"](F.map_values(m))), "intersect": lambda m, n: F.map_filter(m, lambda k, v: F.map_contains_key(n, k) & (F.try_element_at(n, k) == v)),
    "sortKey": lambda m: F.transform(_entries(m), lambda e: e["key"]), "sort": lambda m: F.array_sort(F.map_values(m)),
}


def system_variables(app: str, login: str, admin: str, address: str = "", device: str = "") -> dict[str, Column]:
    """The script's system variables: the clock from the session, the rest as the caller knows them."""
    return {
        "currentdate": F.current_date(), "currenttime": F.current_timestamp(), "loginuser": L(login), "loginuserid": L(login), "adminuser": L(admin), "adminuserid": L(admin),
        "appname": L(app), "appuri": L("/" + app), "ipaddress": L(address), "device.type": L(device), "timezone": F.current_timezone(),
    }

# the desktop database's SQL dialect
ACCESS: dict[str, Callable[..., Column]] = {
    "Left": TEXT["left"], "Right": TEXT["right"], "Mid": lambda s, a, n: F.substring(s, a, n), "Len": F.length, "Trim": F.trim, "LCase": F.lower, "UCase": F.upper,
    "InStr": lambda s, x: F.locate(x, s), "Replace": TEXT["replaceAll"], "Space": lambda n: F.repeat(L(" "), L(n)), "StrReverse": F.reverse,
    "Nz": lambda c, x: F.coalesce(c, L(x)), "IIf": lambda c, a, b: F.when(c, a).otherwise(b), "Sgn": F.signum, "Sqr": F.sqrt, "CInt": lambda c: F.bround(c).cast("int"), "CLng": lambda c: F.bround(c).cast("long"),
    "CStr": lambda c: c.cast("string"), "CDbl": lambda c: c.cast("double"), "CBool": lambda c: c != 0, "Val": S.to_number, "Year": F.year, "Month": F.month, "Day": F.dayofmonth,
    "DateSerial": lambda y, m, d: F.make_date(L(y), L(m), L(d)), "Like": lambda s, p: s.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else r"\d" if c == "#" else _literal(c) for c in p) + "$"),
    "Xor": lambda a, b: a != b, "Eqv": lambda a, b: a == b, "Imp": lambda a, b: ~a | b, "IntDiv": lambda a, b: F.floor(F.bround(a) / F.bround(b)),
    "StrConv": F.initcap, "String": lambda n, x: F.repeat(L(x), L(n)), "Str": lambda c: F.concat(F.when(c < 0, "").otherwise(" "), c.cast("string")), "Format": lambda c, pattern: F.format_string(pattern, c), "Abs": F.abs, "Int": F.floor, "Fix": MATH["Fix"], "Round": F.bround,
    "DateAdd": lambda unit, n, d: {"d": lambda: F.date_add(d, n), "m": lambda: F.add_months(d, n), "yyyy": lambda: F.add_months(d, 12 * n), "ww": lambda: F.date_add(d, 7 * n)}[unit](),
    "DateDiff": lambda unit, a, b: {"d": lambda: F.datediff(b, a), "m": lambda: DATE["totalMonth"](a, b), "yyyy": lambda: DATE["totalYear"](a, b)}[unit](),
    "DatePart": lambda unit, d: {"d": F.dayofmonth, "m": F.month, "yyyy": F.year, "q": F.quarter, "ww": F.weekofyear, "w": F.dayofweek, "y": F.dayofyear, "h": F.hour}[unit](d),
    "Hour": F.hour, "Minute": F.minute, "Second": F.second, "Weekday": F.dayofweek, "CSng": lambda c: c.cast("float"), "CCur": lambda c: F.bround(c, 4), "Pow": F.pow, "Concat": S.joined,
    "StrComp": lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0), "InStrRev": lambda s, x: TEXT["lastIndexOf"](s, x) + 1, "Split": TEXT["toList"], "Join": lambda a, d: F.array_join(a, d), "Hex": F.hex, "Oct": lambda c: F.conv(c.cast("string"), 10, 8),
    "Chr": lambda c: F.char(c), "Asc": F.ascii, "Sin": F.sin, "Cos": F.cos, "Tan": F.tan, "Atn": F.atan, "Exp": F.exp, "Log": F.ln, "MonthName": lambda d: F.date_format(d, "MMMM"), "WeekdayName": lambda d: F.date_format(d, "EEEE"),
    "IsNull": lambda c: c.isNull(), "IsNumeric": lambda c: c.try_cast("double").isNotNull(), "IsDate": lambda c: F.try_to_date(c, "yyyy-MM-dd").isNotNull(), "LTrim": F.ltrim, "RTrim": F.rtrim,
}

# SQL functions that a session can register: argument type and body over x
REGISTERED = {
    "trimmed": ("STRING", r"coalesce(regexp_replace(x, r'(?U)^\s+|\s+$', ''), '')"), "get_alpha": ("STRING", "regexp_replace(x, '[^A-Za-z]', '')"), "is_ascii": ("STRING", r"x rlike r'^[\x00-\x7F]*$'"),
    "frac": ("DOUBLE", "x - if(x < 0, ceil(x), floor(x))"), "is_even": ("BIGINT", "pmod(x, 2) = 0"), "to_number": ("STRING", r"if(trim(x) rlike r'^[+-]?(\d+|\d*\.\d+|\d+\.)$', try_cast(trim(x) AS DOUBLE), 0D)"),
    "eomonth": ("DATE", "last_day(x)"), "printed": ("DOUBLE", r"regexp_replace(format_string('%.4f', x), r'\.?0+$', '')"),
}


def registered(spark: SparkSession, prefix: str = "wl_") -> list[str]:
    """Registers REGISTERED as temporary functions for SQL texts of the session, which Catalyst sees through; returns their names."""
    for name, (kind, body) in REGISTERED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x {kind}) RETURN {body}")
    return [prefix + name for name in REGISTERED]
