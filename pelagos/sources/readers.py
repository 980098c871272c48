"""Files as the feeds deliver them: CSV with a row of units, quoted CSV with a byte order mark, JSON records, flat coordinate arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_with_units(spark: SparkSession, path: str, schema: str, units: str, names: str | None = None) -> DataFrame:
    """CSV with a line of names and one of units in any of its files. A value that does not read as its column's type is null; its row stays.

    The two lines are known by what they say: ``units``, and ``names`` (those of ``schema`` where none are given).
    """
    lines = spark.read.text(path)
    parsed = lines.select(F.col("value").alias("_line"), F.from_csv("value", schema, {"mode": "PERMISSIVE"}).alias("_x"))
    said = F.trim(F.regexp_replace("_line", "^\ufeff", ""))
    head = names or ",".join(parsed.schema["_x"].dataType.names)
    return parsed.where(~said.isin(head, units) & (said != "")).select("_x.*")


def quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with quoted fields, doubled quotes, line ends inside quotes and a byte order mark before the names. A row that says all names is that of the names."""
    out = spark.read.csv(path, schema=schema, header=False, quote='"', escape='"', multiLine=True)
    first = out.columns[0]
    out = out.withColumn(first, F.regexp_replace(F.col(first).cast("string"), "^\ufeff", "").cast(out.schema[first].dataType))
    names = reduce(lambda a, c: a & F.col(c).cast("string").eqNullSafe(F.lit(c)), out.columns, F.lit(True))
    return out.where(~names)


def json_records(spark: SparkSession, path: str, record: str, broken: str | None = None) -> DataFrame:
    """One JSON document a line, ``{"recordsets": [[row, ...], ...]}``: a row for each record of any set.

    A document that does not parse has no records; with ``broken`` it has a row of nulls and its text in a column of that name.
    """
    sets = f"recordsets array<array<{record}>>, _broken string"
    raw = spark.read.text(path).select(F.from_json("value", sets, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("x"))
    rows = raw.select(F.explode(F.flatten("x.recordsets")).alias("r"), F.lit(None).cast("string").alias("b"))
    if broken is None:
        return rows.select("r.*")
    bad = raw.where("x._broken is not null").select(F.lit(None).cast(rows.schema["r"].dataType).alias("r"), F.col("x._broken").alias("b"))
    return rows.union(bad).select("r.*", F.col("b").alias(broken))


# How an entry of a catalogue of places stands in source code, its key alone and whole.
_KEY = r"(?m)^\s*(\d+)\s*:"
_ENTRY = r"""(?m)^\s*(\d+)\s*:\s*\{\s*lat:\s*(-?[\d.]+)\s*,\s*lng:\s*(-?[\d.]+)\s*,\s*nombre:\s*(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)")"""


def literal_entries(sources: DataFrame, name: str) -> DataFrame:
    """``file``, ``key``, ``lat``, ``lng``, ``name``, ``problem``: the entries of a constant ``name`` that source code (``file``, ``text``) writes out as a literal.

    A row with a ``problem`` stands for what makes a file's catalogue incomplete: the constant is not declared, not
    closed or empty, a key is repeated, or is there without a readable entry. Whoever needs whole catalogues takes
    files without such rows. A null text declares nothing.
    """
    start = F.instr(F.coalesce("text", F.lit("")), f"const {name} = {{")
    rest = sources.select("file", F.when(start > 0, F.expr("substring(text, {})".format(f"instr(text, 'const {name} = {{')"))).alias("rest"))
    end = F.instr("rest", "\n};")
    cut = rest.select("file", "rest", F.when(end > 0, F.substring("rest", F.lit(1), end)).alias("block"))
    cut = cut.withColumn("keys", F.regexp_extract_all("block", F.lit(_KEY), 1)).withColumn("problem", F.when(F.col("rest").isNull(), "not declared").when(F.col("block").isNull(), "not closed").when(F.size("keys") == 0, "no entries"))
    whole = cut.where("problem is not null").select("file", F.lit(None).cast("long").alias("key"), *(F.lit(None).cast(t).alias(n) for n, t in (("lat", "double"), ("lng", "double"), ("name", "string"))), "problem")
    part = lambda i: F.regexp_extract(F.col("entry"), _ENTRY, i)
    read = cut.where("problem is null").select("file", F.explode(F.regexp_extract_all("block", F.lit(_ENTRY), 0)).alias("entry"))
    read = read.select("file", part(1).cast("long").alias("key"), part(2).try_cast("double").alias("lat"), part(3).try_cast("double").alias("lng"), F.concat(part(4), part(5)).alias("name"))
    keys = cut.where("problem is null").select("file", F.explode("keys").alias("key")).groupBy("file", F.col("key").cast("long").alias("key")).agg(F.count("*").alias("n"))
    met = keys.join(read, ["file", "key"], "left")
    problem = F.when(F.col("n") > 1, "repeated key").when(F.col("lat").isNull() | F.col("lng").isNull() | F.col("name").isNull(), "unreadable")
    return met.select("file", "key", "lat", "lng", "name", problem.alias("problem")).distinct().union(whole)


def first_readable(sources: Iterable[tuple[str, Callable[[], DataFrame]]]) -> tuple[str | None, DataFrame | None, dict[str, str]]:
    """The name and rows of the first source that can be read and has rows, and why those before it were passed over.

    A source is read for one row to see that it opens; what cannot be found or parsed is passed over, an empty one
    too. Without any the name and the rows are None: whoever asks then lets everything pass.
    """
    failed = {}
    for name, read in sources:
        try:
            rows = read()
            if not rows.isEmpty():
                return name, rows, failed
            failed[name] = "empty"
        except PySparkException as e:
            failed[name] = e.getCondition() or type(e).__name__
        except Py4JJavaError as e:  # what a task met
            failed[name] = e.java_exception.getClass().getSimpleName()
    return None, None, failed


def points_of(flat: Column) -> Column:
    """Points of a flat array of longitudes and latitudes in turn; an odd one out at the end goes, and null stands for none."""
    point = lambda i: F.struct(F.element_at(flat, (2 * i - 1).cast("int")).alias("lng"), F.element_at(flat, (2 * i).cast("int")).alias("lat"))
    return F.when(F.size(flat) >= 2, F.transform(F.sequence(F.lit(1), F.floor(F.size(flat) / 2)), point))


def west(lng: Column) -> Column:
    """Longitudes of 0 to 360 degrees as -180 to 180."""
    return F.when(lng > 180, lng - 360).otherwise(lng)
