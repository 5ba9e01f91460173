"""Readers of the file shapes that documents, word lists, feeds and saves come in; each gives a DataFrame of fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "/*JSON-START*/", "/*JSON-END*/"


def between_markers(body: Column, start: str = START, end: str = END) -> Column:
    """Text between the first start and the last end marker; the whole text without a start marker, null without an end."""
    inner = F.regexp_extract(body, f"(?s)\\Q{start}\\E(.*)\\Q{end}\\E", 1)
    return F.when(~F.contains(body, F.lit(start)), body).when(F.instr(body, end) > 0, F.nullif(inner, F.lit("")))


def marked_documents(spark: SparkSession, folder: str, pattern: str = "*-[0-9]*.js") -> DataFrame:
    """(file_name, body) of the files whose names match; body is null where a file is torn."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("file_name"), between_markers(F.col("value")).alias("body"))


def find_one(ids: DataFrame, key: str, wanted: str) -> DataFrame:
    """The row of an id, else of the only id that ends in -wanted; fails where several do, and gives no row where none does."""
    place = F.when(F.col(key) == wanted, 0).when(F.col(key).endswith(f"-{wanted}"), 1)
    both = ids.withColumn("_p", place).where("_p IS NOT NULL")
    best = both.groupBy("_p").agg(F.count_distinct(key).alias("n"), F.min(key).alias("least"), F.max(key).alias("most")).orderBy("_p").limit(1).collect()
    if best and best[0].n > 1:
        raise ValueError(f"{wanted} is ambiguous: {best[0].n} ids from {best[0].least} to {best[0].most}")
    return both.where((F.col("_p") == best[0]["_p"]) if best else F.lit(False)).drop("_p")


def index_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The puzzles listed in an index, a JSON object with the member puzzles."""
    return spark.read.schema(f"puzzles array<struct<{schema}>>").option("multiLine", True).json(path).select(F.explode("puzzles").alias("p")).select("p.*")


LEXICON_SCHEMA = "word string, rank int, gb int, family int, phone string"


def lexicon(spark: SparkSession, path: str, home_only: bool = False) -> DataFrame:
    """Tab-separated words with rank, home flag, family size and phone key; comment lines and short lines are skipped."""
    rows = spark.read.schema(LEXICON_SCHEMA).option("sep", "\t").option("comment", "#").option("mode", "PERMISSIVE").csv(path).where(F.col("family").isNotNull() & F.col("word").rlike("^[a-z]{2,15}$"))
    return rows.where("gb = 1") if home_only else rows


def rank_file(spark: SparkSession, path: str) -> DataFrame:
    """(word, rank) of lines of a word and its rank; lines that start with # and those without a rank are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#"))
    return rows.select(F.get(parts, F.lit(0)).alias("word"), F.get(parts, F.lit(1)).try_cast("int").alias("rank")).where("word <> '' AND rank IS NOT NULL")


def first_word_file(spark: SparkSession, *paths: str) -> DataFrame:
    """word_file of the first path that is there; no words where none is."""
    from cluemill.sources.sinks import exists

    found = next((p for p in paths if exists(spark, p)), None)
    return word_file(spark, found) if found else spark.createDataFrame([], "word string")


def pair_map(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(key, word) of a JSON object from key to list of words."""
    rows = spark.read.schema(f"{field} map<string,array<string>>").option("multiLine", True).json(path)
    return rows.select(F.explode(field).alias("key", "words")).select("key", F.explode("words").alias("word"))


def nested_counts(spark: SparkSession, path: str) -> DataFrame:
    """(field, id, n) of a JSON object from field to object from id to count; fields that start with _ are left out."""
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    fields = body.select(F.explode("m").alias("field", "v")).where(~F.col("field").startswith("_"))
    return fields.select("field", F.explode(F.from_json("v", "map<string,bigint>")).alias("id", "n"))


def tolerant_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; torn ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def word_file(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case words, a line each; blank lines are left out."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def grid_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, r, c, is_block) of text grids of # and other signs."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("r", "line"))
    return rows.select("file_name", "r", F.posexplode(F.split("line", "")).alias("c", "sign")).select("file_name", "r", "c", (F.col("sign") == "#").alias("is_block"))


def event_keys(keys: DataFrame, name: str) -> DataFrame:
    """(day, event) of keys of four parts, e, a day, an event's name and the rest; others are left out."""
    parts = F.split(name, ":")
    part = lambda n: F.get(parts, F.lit(n))
    parsed = keys.where((part(0) == "e") & (F.size(parts) >= 4) & (part(2) != "")).select(F.try_to_date(part(1), "yyyy-MM-dd").alias("day"), part(2).alias("event"))
    return parsed.where("day IS NOT NULL")


def key_listing(listings: DataFrame, text: str) -> DataFrame:
    """(name) of saved listings: the JSON list that begins at the first bracket, whatever stands before it; torn ones give none."""
    start = F.instr(text, "[")
    body = F.when(start > 0, F.expr(f"substring({text}, instr({text}, '['))"))
    return listings.select(F.explode(F.from_json(body, "array<struct<name: string>>")).alias("k")).select("k.name")


#: What local keys of puzzles begin with, and keys that are no puzzles.
LOCAL_PREFIX, RESERVED = "ct:", ("ct:prefs", "ct:sync", "ct:last")


def local_store(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(puzzle_id, save) of a browser's store; keys without the prefix, reserved ones and torn values give no rows."""
    kept = rows.where(F.col(key).startswith(LOCAL_PREFIX) & ~F.col(key).isin(*RESERVED))
    save = F.from_json(value, SAVE_SCHEMA.replace(":", " "))
    return kept.select(F.expr(f"substring({key}, {len(LOCAL_PREFIX) + 1})").alias("puzzle_id"), save.alias("save"), F.col(value).alias("_v")).where(F.get_json_object("_v", "$").isNotNull()).drop("_v")


SAVE_SCHEMA = "letters:map<string,string>,letterAt:map<string,bigint>,hintsShown:map<string,array<string>>,revealsUsed:map<string,int>,clearedAt:bigint,updated:bigint"


def save_envelopes(rows: DataFrame, code: str, body: str) -> DataFrame:
    """(code, puzzle_id, save) of JSON envelopes; torn ones and those without puzzles give no rows."""
    envelope = F.from_json(body, f"puzzles map<string,struct<{SAVE_SCHEMA}>>")
    return rows.select(code, F.explode(envelope["puzzles"]).alias("puzzle_id", "save"))


FEED_SCHEMA = "metadata struct<title:string>, grid struct<cell:array<struct<_x:int,_y:int,_solution:string>>>, word array<struct<_id:int,_x:string,_y:string>>, clues array<struct<clue:array<struct<_word:int,_number:string,_format:string,_VALUE:string>>>>"


def xml_feed(spark: SparkSession, path: str, row_tag: str = "crossword") -> DataFrame:
    """(file_name, title, word, number, format, clue, x, y, cells) of XML puzzles: each clue with its word's run and its cells
    (from 0). Runs are looked up inside their own puzzle; run_missing marks a clue without one (see require)."""
    docs = spark.read.format("xml").schema(FEED_SCHEMA).option("rowTag", row_tag).load(path)
    run_of = lambda c: F.get(F.filter("word", lambda w: w["_id"] == c["_word"]), F.lit(0))
    paired = F.transform(F.flatten("clues.clue"), lambda c: F.struct(c.alias("c"), run_of(c).alias("w")))
    rows = docs.select(F.col("_metadata.file_name").alias("file_name"), F.col("metadata.title").alias("title"), F.explode(paired).alias("p")).select("file_name", "title", "p.c", "p.w")
    named = rows.select("file_name", "title", F.col("c._word").alias("word"), F.col("c._number").alias("number"), F.col("c._format").alias("format"), F.col("c._VALUE").alias("clue"), F.col("w._x").alias("x"), F.col("w._y").alias("y"))
    return named.withColumn("cells", run_cells(F.col("x"), F.col("y"))).withColumn("run_missing", F.col("x").isNull() | F.col("y").isNull())


def require(rows: DataFrame, holds: Column, message: str) -> DataFrame:
    """rows, failing with the message as soon as one is read for which holds is not true."""
    return rows.where(F.assert_true(F.coalesce(holds, F.lit(False)), F.lit(message)).isNull())


def span_ends(c: Column) -> tuple[Column, Column]:
    """(first, last) of "a-b"; a single number is both."""
    parts = F.split(c, "-")
    return F.get(parts, F.lit(0)).cast("int"), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))).cast("int")


def run_cells(x: Column, y: Column) -> Column:
    """Cells (x, y) from 0 of a run whose columns and rows are given as "a-b" or "a", from 1."""
    across, down = span_ends(x), span_ends(y)
    row = lambda j: F.transform(F.sequence(across[0] - 1, across[1] - 1), lambda i: F.struct(i.alias("x"), j.alias("y")))
    return F.flatten(F.transform(F.sequence(down[0] - 1, down[1] - 1), row))


def inner_markup(c: Column) -> Column:
    """What stands inside the outermost element of a text, tags included; null where there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)^\s*<[^>]*>(.*)</[^>]*>\s*$", 1), F.lit(""))


def plain_text(c: Column) -> Column:
    """Text of simple markup: tags dropped, the common entities decoded, white space collapsed; text without either stays as it is."""
    bare = F.regexp_replace(c, "<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.when(F.contains(c, F.lit("<")) | F.contains(c, F.lit("&")), F.trim(F.regexp_replace(bare, r"\s+", " "))).otherwise(c)


def latest_number(pages: DataFrame, text: str, series: str) -> DataFrame:
    """One row: the greatest number in links to a series."""
    found = F.explode(F.regexp_extract_all(text, F.lit(f"/{series}/([0-9]+)"), F.lit(1)))
    return pages.select(found.alias("n")).agg(F.max(F.col("n").cast("bigint")).alias("latest"))


def dates_back(spark: SparkSession, last: str, n: int, step_days: int = 1) -> DataFrame:
    """(day): n dates back from last, newest first in value."""
    return spark.range(n).select(F.date_sub(F.lit(last).cast("date"), (F.col("id") * step_days).cast("int")).alias("day"))


def unescaped(c: Column) -> Column:
    for entity, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def escaped(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def embedded_json(pages: DataFrame, html: str, attribute: str, schema: str) -> DataFrame:
    """pages with data: the JSON in the first attribute of that name; null where there is none or it is torn."""
    found = F.nullif(F.regexp_extract(html, f'{attribute}="([^"]*)"', 1), F.lit(""))
    return pages.withColumn("data", F.from_json(unescaped(found), schema))


def family_roots(swaps: DataFrame) -> DataFrame:
    """(word, root) of pairs of words that are forms of each other: the first word, by the alphabet, that a word is joined to."""
    from cluemill.operators.geometry import components

    words = swaps.select(F.col("word").alias("id")).union(swaps.select("other")).distinct()
    return components(words, swaps.select(F.col("word").alias("a"), F.col("other").alias("b"))).select(F.col("id").alias("word"), F.col("component").alias("root"))


def build_lexicon(words: DataFrame, abroad: DataFrame, families: DataFrame) -> DataFrame:
    """(word, rank, gb, family, phone) of raw (word, rank, phone): only words of 2 to 15 letters; gb 0 for words of
    abroad; family: words of the same root; phone without stress marks."""
    roots = families.groupBy("root").agg(F.count(F.lit(1)).alias("family"))
    sized = families.join(roots, "root").select("word", "family")
    rows = words.where(F.col("word").rlike("^[a-z]{2,15}$")).join(abroad.select("word").distinct().withColumn("_a", F.lit(0)), "word", "left").join(sized, "word", "left")
    return rows.select("word", "rank", F.coalesce("_a", F.lit(1)).alias("gb"), F.coalesce("family", F.lit(1)).alias("family"), F.regexp_replace("phone", "[0-9]", "").alias("phone"))


def judge_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of the score files, with the judge: the file's name without judge and ending."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "judge*.json").json(folder)
    return rows.withColumn("judge", F.regexp_extract(F.col("_metadata.file_name"), r"^judge(.*)\.json$", 1))


def single_run(packets: DataFrame, run: str = "run") -> str:
    """The one run id of all packets; fails where there is none or several."""
    found = [r[0] for r in packets.select(run).distinct().limit(2).collect()]
    if len(found) != 1 or found[0] is None:
        raise ValueError("packets must be of one run")
    return found[0]
