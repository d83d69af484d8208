"""Export of results: texts as Markdown files, JSON as sheets with typed columns, JSON without tables as lines.

Below the folder of an export lie

* ``markdown/``: one ``.md`` file a text, written by the tasks, and ``markdown_index`` with their keys;
* ``sheets/<number>``: one Parquet table for each table that ``json_views.tables`` finds, its columns typed by
  all values of a field; ``sheets_rest``: cells of tables beyond ``SHEETS`` and of those with more than ``FIELDS`` fields, in long form;
* ``json/``: values that have no table, one a line;
* ``catalogue``: what columns the sheets have.  It is written last; without it an export isn't finished.

Null results are left out, and equal results of an equal key are one.
"""

from __future__ import annotations

import posixpath
import uuid

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import tables
from corpusloom.operators import json_views as J
from corpusloom.sources import envelopes as N

#: Sheets of an export and columns of a sheet: only these are known to the driver; all else is exported in long form.
SHEETS, FIELDS = 100, 300
#: Whole numbers up to this are the same as floating-point numbers.
_EXACT = 2**53
_CATALOGUE = "sheet int, t string, position int, field string, column string, kind string"
_CELLS = ["key", "__id", "t", "row"]


def safe_name(name: Column) -> Column:
    """A name as a file's: marks that paths can't have become dashes, blanks one space, 80 characters at most."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|]', "-"), r"(?U)\s+", " ")
    cut = F.substring(F.trim(plain), 1, 80)
    return F.when(cut == "", "analysis-result").otherwise(cut)


def _put(folder: str):
    """Write each row's body to its file, which appears under its name only when complete; a repeated attempt replaces it by an equal one."""

    def run(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            sizes = []
            for file, body in zip(batch["file"], batch["body"]):
                path, data = posixpath.join(base, file), body.encode()
                if (parent := posixpath.dirname(path)) not in made:
                    files.create_dir(parent, recursive=True)
                    made.add(parent)
                draft = f"{path}.{uuid.uuid4().hex}.draft"
                with files.open_output_stream(draft) as out:
                    out.write(data)
                files.move(draft, path)
                sizes.append(len(data))
            yield pd.DataFrame({"__id": batch["__id"], "name": batch["name"], "file": batch["file"], "bytes": pd.Series(sizes, dtype="int64")})

    return run


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getRawPath()}"


def _write_texts(rows: DataFrame, folder: str) -> None:
    """``markdown``: file names have the result's name and a hash of key and text, in 256 folders by the hash."""
    spark = rows.sparkSession
    file = F.concat(F.lit("markdown/"), F.substring("__id", 1, 2), F.lit("/"), safe_name(F.col("name")), F.lit("-"), F.substring("__id", 1, 24), F.lit(".md"))
    named = rows.select("__id", F.coalesce("name", F.lit("")).alias("name"), file.alias("file"), F.col("result").alias("body"))
    index = named.mapInPandas(_put(_qualified(spark, folder)), "__id string, name string, file string, bytes bigint")
    # Keys have any type, so they don't go through Python but are joined to what was written.
    tables.staged(index, "markdown").join(rows.select("__id", "key"), "__id").write.parquet(f"{folder}/markdown_index")


def _kind(v: Column) -> Column:
    """The type that keeps every value of a field: texts that a number or a boolean gives back as they are; blanks tell nothing."""
    said = F.when(v != "", v)
    whole = said.try_cast("bigint")
    is_whole = F.coalesce(whole.cast("string") == said, F.lit(False))
    is_number = F.coalesce(said.try_cast("double").cast("string") == said, F.lit(False)) | (is_whole & F.coalesce(F.abs(whole.cast("decimal(20,0)")) <= _EXACT, F.lit(False)))
    blank = said.isNull()
    return F.when(F.count(said) == 0, "string").when(F.bool_and(blank | is_whole), "bigint").when(F.bool_and(blank | is_number), "double").when(F.bool_and(blank | said.isin("true", "false")), "boolean").otherwise("string")


def _catalogue(cells: DataFrame) -> list[tuple]:
    """Columns of the sheets: the table items first, then those with the most rows; a sheet's fields by how often they are there."""
    fields = cells.groupBy("t", "field").agg(_kind(F.col("value")).alias("kind"), F.count(F.lit(1)).alias("n"))
    fields = tables.staged(fields, "fields")
    most = F.max("n").alias("rows")
    chosen = fields.groupBy("t").agg(F.count(F.lit(1)).alias("fields"), most).where(F.col("fields") <= FIELDS).orderBy(F.col("t") != "items", F.desc("rows"), "t").limit(SHEETS)
    numbers = {r.t: i for i, r in enumerate(chosen.collect())}
    if not numbers:
        return []
    found = fields.where(F.col("t").isin(list(numbers))).collect()
    out, by_sheet = [], {}
    for r in found:
        by_sheet.setdefault(r.t, []).append(r)
    for t, rows in by_sheet.items():
        taken = {"key", "row", "__id"}
        for i, r in enumerate(sorted(rows, key=lambda r: (-r.n, r.field))):
            column, again = r.field or "field", 2
            while column.lower() in taken:
                column, again = f"{r.field or 'field'} {again}", again + 1
            taken.add(column.lower())
            out.append((numbers[t], t, i, r.field, column, r.kind))
    return out


def _write_sheets(cells: DataFrame, folder: str) -> list[tuple]:
    spark, found = cells.sparkSession, _catalogue(cells)
    places = spark.createDataFrame(found, _CATALOGUE).select("sheet", "t", "position", "field")
    placed = cells.join(places, ["t", "field"], "left").withColumn("sheet", F.coalesce("sheet", F.lit(-1)))
    work = tables.new_folder(spark, "cells")
    placed.hint("rebalance", "sheet").write.partitionBy("sheet").parquet(work)
    every = spark.read.schema(placed.schema).parquet(work)
    every.where("sheet = -1").select("key", "t", "row", "field", "value").write.parquet(f"{folder}/sheets_rest")
    columns: dict[int, list[tuple]] = {}
    for c in found:
        columns.setdefault(c[0], []).append(c)
    for sheet, own in columns.items():
        wide = every.where(F.col("sheet") == sheet).groupBy("key", "__id", "row").pivot("position", [c[2] for c in own]).agg(F.max("value"))
        typed = [(F.col(f"`{p}`") if kind == "string" else F.nullif(F.col(f"`{p}`"), F.lit("")).cast(kind)).alias(column) for _, _, p, _, column, kind in own]
        wide.select("key", "row", *typed).write.parquet(f"{folder}/sheets/{sheet}")
    return found


def write(results: DataFrame, folder: str) -> None:
    """Export key (any type that can be compared), name and result (text) below ``folder``, which mustn't exist."""
    spark = results.sparkSession
    identity = F.sha2(F.concat_ws("\n", F.to_json(F.struct("key")), F.col("name"), F.col("result")), 256)
    rows = results.where("result is not null").select("key", "name", "result", identity.alias("__id")).dropDuplicates(["__id"])
    rows = tables.staged(rows, "export")
    v = F.col("__v")
    parsed = rows.withColumn("__v", F.try_parse_json("result")).withColumn("__json", N.is_a(v, "OBJECT") | N.is_a(v, "ARRAY"))
    _write_texts(parsed.where("not __json").select(*rows.columns), folder)
    values = parsed.where("__json").select("key", "__id", "__v")
    # Two ways to one field of a row ("a / b" as a key, and b under a) are one cell with both values.
    cells = J.tables(values, ["key", "__id"], "__v").groupBy(*_CELLS, "field").agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("value"))
    cells = tables.staged(cells, "cells")
    values.join(cells.select("__id").distinct(), "__id", "left_anti").select("key", F.to_json("__v").alias("body")).write.json(f"{folder}/json")
    found = _write_sheets(cells, folder)
    spark.createDataFrame(found, _CATALOGUE).coalesce(1).write.parquet(f"{folder}/catalogue")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """sheet, t, position, field, column and kind of every column of a finished export."""
    return spark.read.schema(_CATALOGUE).parquet(f"{folder}/catalogue")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """key, name, file and body of the Markdown files that the export lists."""
    index = spark.read.parquet(f"{folder}/markdown_index")
    if not index.take(1):
        return index.select("key", "name", "file", F.lit("").alias("body"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(f"{folder}/markdown")
    # Names may have marks that a path escapes; the hash before the suffix has none.
    hashed = files.select(F.regexp_extract("path", r"-([0-9a-f]{24})\.md$", 1).alias("__h"), F.col("content").cast("string").alias("body"))
    # Spark's reader gives no row for an empty file; a null body is a file that is gone.
    body = F.when(F.col("bytes") == 0, "").otherwise(F.col("body"))
    return index.withColumn("__h", F.substring("__id", 1, 24)).join(hashed, "__h", "left").select("key", "name", "file", body.alias("body"))


def sheet(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """key, row and the typed columns of a sheet."""
    return spark.read.parquet(f"{folder}/sheets/{number}")


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """All sheets as key, t, row, field and value (as text), read from their typed columns; also those in long form."""
    found = spark.read.parquet(f"{folder}/sheets_rest")
    by_sheet: dict[tuple, list] = {}
    for r in catalogue(spark, folder).orderBy("sheet", "position").collect():
        by_sheet.setdefault((r.sheet, r.t), []).append(r)
    for (number, t), columns in by_sheet.items():
        rows = sheet(spark, folder, number)
        rows = rows.toDF("key", "row", *[f"c{i}" for i in range(len(columns))])
        each = F.explode(F.array(*[F.struct(F.lit(c.field).alias("field"), F.col(f"c{i}").cast("string").alias("value")) for i, c in enumerate(columns)]))
        found = found.unionByName(rows.select("key", F.lit(t).alias("t"), "row", each.alias("__c")).select("key", "t", "row", "__c.field", "__c.value").where("value is not null"))
    return found


def untabled(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """key and body of the JSON values without tables; ``key`` is the key's type."""
    return spark.read.schema(f"key {key}, body string").json(f"{folder}/json")
