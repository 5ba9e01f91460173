"""Writers: named documents, versioned tables, appends of unseen keys, writes of what changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cluemill.operators.snapshots import append_unseen


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def write_documents(docs: DataFrame, path: str, key: str, series: str) -> None:
    """JSON documents by series; fails before writing where a key is not of its series."""
    wrong = docs.where(~F.col(key).startswith(F.concat(F.col(series), F.lit("-"))) | F.col(key).isNull())
    if not wrong.isEmpty():
        raise ValueError("a document's name must begin with its series")
    docs.write.mode("overwrite").partitionBy(series).json(path)


def versioned(spark: SparkSession, path: str, version: int, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of this version: read if it is there, else built and written; other versions stay."""
    at = f"{path}/version={version}"
    if not exists(spark, at):
        build().write.mode("errorifexists").parquet(at)
    return spark.read.parquet(at)


def append_new(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Append the rows whose keys are not there yet, each key once."""
    spark = batch.sparkSession
    new = append_unseen(batch, spark.read.schema(batch.schema).json(path), keys, order) if exists(spark, path) else append_unseen(batch, batch.limit(0), keys, order)
    new.write.mode("append").json(path)


def _switch(spark: SparkSession, written: str, path: str) -> None:
    """Put the folder written in the place of path: the old one is moved aside, and goes only when the new one stands."""
    jvm = spark.sparkContext._jvm
    old = f"{path}.old-{uuid.uuid4().hex}"
    new_path, at, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (written, path, old))
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    was = files.exists(at) and files.rename(at, aside)
    if not files.rename(new_path, at):
        if was:
            files.rename(aside, at)
        raise OSError(f"{path} could not be replaced")
    if was:
        files.delete(aside, True)


def replace(new: DataFrame, path: str) -> None:
    """Write new beside path and switch: new may read path itself, and a reader finds the old rows or the new ones."""
    written = f"{path}.new-{uuid.uuid4().hex}"
    new.write.parquet(written)
    _switch(new.sparkSession, written, path)


def replace_unless_empty(new: DataFrame, path: str) -> bool:
    """Replace the snapshot unless the new one is empty; whether it was written."""
    if new.isEmpty():
        return False
    replace(new, path)
    return True


def content_id(rows: DataFrame) -> str:
    """A number for what rows hold, whatever their order: their count and a sum of their hashes."""
    n, h = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return f"{n}-{abs(int(h or 0)):x}"


def write_if_changed(new: DataFrame, path: str) -> bool:
    """Replace only where rows differ, by content_id; whether it was written."""
    spark = new.sparkSession
    if exists(spark, path):
        old = spark.read.parquet(path)
        if old.columns == new.columns and content_id(old) == content_id(new):
            return False
    replace(new, path)
    return True


def write_round(packets: DataFrame, path: str, run: str) -> str:
    """The current round of packets in path/current, replaced as a whole, and a copy by run and content in path/archive; the copy's name."""
    spark = packets.sparkSession
    name = f"{run}-{content_id(packets)}"
    if not exists(spark, f"{path}/archive/{name}"):
        packets.write.parquet(f"{path}/archive/{name}")
    replace(packets, f"{path}/current")
    return name


def write_index(index: DataFrame, path: str, order: Sequence[Column], variable: str | None = None) -> None:
    """The index as one JSON document in one file, a puzzle a line in the given order; with a variable's name as a script.

    One writer, which streams its lines: an index is a file that is read as a whole.
    """
    n = index.count()
    begin, end = f'{f"{variable} = " if variable else ""}{{"puzzles": [', f"]}}{';' if variable else ''}"
    if not n:
        index.sparkSession.createDataFrame([(begin + end,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    at = F.monotonically_increasing_id()
    lines = index.orderBy(*order).select(F.to_json(F.struct(*index.columns)).alias("line")).coalesce(1).select(at.alias("at"), "line")
    value = F.concat(F.when(F.col("at") == 0, begin).otherwise(","), "line", F.when(F.col("at") == n - 1, end).otherwise(""))
    lines.select(value.alias("value")).write.mode("overwrite").text(path)


def write_counts(counts: DataFrame, path: str, field: str, key: str, n: str) -> None:
    """(field, key, n) as one JSON object of a field a line: from field to object from key to count. Counts of a field are as many as it has keys."""
    objects = counts.groupBy(field).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, n)))).alias("m")).orderBy(field)
    objects.select(F.to_json(F.map_from_arrays(F.array(field), F.array("m"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def stale_pages(pages: DataFrame, folder: str, name: str, body: str) -> DataFrame:
    """(file_name) of the pages that the folder lacks or holds with other content, and of those it holds beyond them."""
    spark = pages.sparkSession
    there = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), F.md5("content").alias("stamp"))
    wanted = pages.select(F.col(name).alias("file_name"), F.md5(F.encode(body, "UTF-8")).alias("stamp"))
    return wanted.join(there, ["file_name", "stamp"], "left_anti").unionByName(there.join(wanted.select("file_name"), "file_name", "left_anti")).select("file_name").distinct()


def content_stamps(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file_name, stamp): first 8 digits of the md5 of each file's content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), F.substring(F.md5("content"), 1, 8).alias("stamp"))


def site_rows(index: DataFrame, base: str, fixed: Sequence[str]) -> DataFrame:
    """(line) of a site map: the fixed pages and one per puzzle."""
    spark = index.sparkSession
    pages = spark.createDataFrame([(p,) for p in fixed], "page string").unionByName(index.select(F.concat(F.lit("puzzle/"), "puzzle_id").alias("page")))
    return pages.select(F.format_string("<url><loc>%s/%s</loc></url>", F.lit(base), "page").alias("line"))


def bars(counts: DataFrame, name: str, n: str, width: int = 24) -> DataFrame:
    """(line) of a console table: name, count and a bar as long as its share of the greatest count."""
    top = counts.agg(F.max(n).alias("t")).scalar()
    return counts.select(F.concat(F.rpad(name, 20, " "), F.lpad(F.col(n).cast("string"), 8, " "), F.lit(" "), F.repeat(F.lit("#"), F.bround(width * F.col(n) / top, 0).cast("int"))).alias("line"))
