"""Scans of delimited, JSON and markdown files, and of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import script as S
from weftline.operators.traverse import load_order


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header as text columns; types are the rules' concern."""
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def numbered_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``csv`` with file (its name) and line, the record's number from 2 in its file: a file with quoted line breaks is read by one task, in order."""
    rows = csv(spark, path, columns).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.monotonically_increasing_id().alias("_id"))
    return rows.withColumn("line", (F.row_number().over(Window.partitionBy("file").orderBy("_id")) + 1).cast("int")).drop("_id")


def preview(spark: SparkSession, path: str, columns: list[str], most: int = 50) -> DataFrame:
    """The first records of a CSV."""
    return csv(spark, path, columns).limit(most)


def file_rules(files: DataFrame, tables: list[str]) -> DataFrame:
    """Diagnostics of files (file, header): VD001 where the stem is no known table, VD002 where a known table's header is empty."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    known = stem.isin(*tables)
    found = F.when(~known, F.struct(F.lit("VD001").alias("rule"), F.lit("INFO").alias("severity"), F.concat(F.lit("unknown table "), stem).alias("message"))).when(
        F.trim(F.coalesce("header", F.lit(""))) == "", F.struct(F.lit("VD002").alias("rule"), F.lit("ERROR").alias("severity"), F.lit("no header").alias("message"))
    )
    return files.select("file", F.lit(1).alias("line"), found.alias("f")).filter("f is not null").select("file", "line", "f.rule", "f.severity", "f.message")


def export_tables(tables: dict[str, DataFrame], keys: list[tuple[str, str]], folder: str) -> list[str]:
    """Writes each table as CSV with a header under folder/name, as the exporter prints values: parents before children (keys: child, parent), then the rest by name.

    System tables (MSys*) are left out. Returns the names in order; only names are looped over here.
    """
    named = {n: df for n, df in tables.items() if not n.startswith("MSys")}
    first = [n for n in load_order([k for k in keys if k[0] in named and k[1] in named]) if n in named]
    order = first + sorted(set(named) - set(first))
    kinds = {"string": "text", "boolean": "boolean", "timestamp": "time", "timestamp_ntz": "time", "date": "time", "double": "decimal", "float": "decimal"}
    for n in order:
        df = named[n]
        printed = [S.exported(F.col(c), kinds.get(t, "decimal" if t.startswith("decimal") else "integer")).alias(c) for c, t in df.dtypes]
        df.select(printed).write.option("header", True).option("emptyValue", "").mode("overwrite").csv(f"{folder}/{n}")
    return order


def for_upload(rows: DataFrame, excluded: list[str]) -> DataFrame:
    """record: a map of the non-empty values of the other columns; records without any drop out."""
    kept = [c for c in rows.columns if c not in excluded]
    pairs = F.map_filter(F.create_map(*(x for c in kept for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull() & (v != ""))
    return rows.select(pairs.alias("record")).filter(F.size("record") > 0)


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keys(rows: DataFrame, column: str) -> DataFrame:
    """The set of non-empty keys."""
    return rows.select(column).filter(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).distinct()


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, front (a map of the front matter) and body of each markdown file under a folder."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return front_matter(files)


def front_matter(files: DataFrame) -> DataFrame:
    """Splits ``value`` at a leading ``---`` block of ``key: value`` lines; without one the map is empty."""
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    pair = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r'^"|"$', "").alias("value")))
    return files.select("path", F.map_from_entries(pair).alias("front"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?", "").alias("body"))


def database(spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None) -> DataFrame:
    """A table over JDBC, for migration sources whose driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()


CELLS = 1000  # in which the keys of a scanned table are counted


def key_ranges(spark: SparkSession, url: str, table: str, key: str, parts: int, options: dict[str, str] | None = None) -> list[str]:
    """Conditions that part the rows of a database table by a numeric key into about ``parts`` ranges of like numbers of rows; together they hold every row once.

    The database is asked for the key's bounds and then for the counts of CELLS equal cells between them, so that a gap or a crowd of keys makes
    ranges wider or narrower. One cell isn't parted further. Null keys go with the first range; an empty table is one range.
    """
    def asked(query: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, query=query, **(options or {})).load()

    low, high = asked(f"select min({key}) as low, max({key}) as high from {table}").first()
    if low is None:
        return ["1 = 1"]
    width = max(1, -(-(int(high) - int(low) + 1) // CELLS))
    cell = f"({key} - ({int(low)})) / {width}"
    counts = sorted((int(c), int(n)) for c, n in asked(f"select c, count(*) as n from (select cast({cell} as bigint) as c from {table} where {key} is not null) t group by c").collect())  # at most CELLS rows
    goal, held, cuts = sum(n for _, n in counts) / max(1, parts), 0, []
    for c, n in counts[:-1]:
        held += n
        if held >= goal:
            cuts.append(int(low) + (c + 1) * width)
            held = 0
    bounds = [None, *cuts, None]
    return [
        " and ".join([*([f"{key} >= {a}"] if a is not None else []), *([f"{key} < {b}"] if b is not None else [])]) + (f" or {key} is null" if a is None and b is not None else "") or "1 = 1"
        for a, b in zip(bounds, bounds[1:], strict=False)
    ]


def database_ranges(spark: SparkSession, url: str, table: str, key: str, parts: int, options: dict[str, str] | None = None) -> DataFrame:
    """A database table read by ``parts`` tasks or so, each a range of a numeric key; filters and columns go to the database with it."""
    return spark.read.jdbc(url, table, predicates=[f"({r})" for r in key_ranges(spark, url, table, key, parts, options)], properties=options or {})


def import_order(spark: SparkSession, url: str, schema: str, options: dict[str, str] | None = None) -> list[str]:
    """Tables of a database schema so that those a foreign key points to come first, by the database's own catalogue; ties by name. A cycle raises, a key to itself doesn't count."""
    jvm = spark.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for k, v in (options or {}).items():
        properties.setProperty(k, v)
    if options and "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        catalogue = connection.getMetaData()
        found = catalogue.getTables(None, schema, "%", None)
        names = []
        while found.next():
            if found.getString("TABLE_TYPE") == "TABLE":
                names.append(found.getString("TABLE_NAME"))
        pairs = []
        for name in names:
            keys = catalogue.getImportedKeys(None, schema, name)
            while keys.next():
                pairs.append((name, keys.getString("PKTABLE_NAME")))
    finally:
        connection.close()
    ordered = load_order([p for p in pairs if p[0] != p[1]])
    return ordered + sorted(set(names) - set(ordered))
