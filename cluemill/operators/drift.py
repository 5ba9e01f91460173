"""Schemas that drift between files (problem 3).

Files come in series (table and feed) and are ordered by their export time. ``records`` parses each body once and gives
a row per record: its fields and values as hashes, and, where a task meets a field or kind in a file for the first
time, its name and kinds. Everything after that is relational:

* ``fingerprints``: the versioned schema of each file, a row per field with the set of its kinds;
* ``changes``: each file's fingerprint against that of the file before it. Renames are found without comparing fields
  in pairs: the values that the records common to both files hold under a field are folded into two 64-bit
  exclusive-ors and a count, and a removed and an added field with the same parent and the same fold are one field.
  Only files between which one field went and another came are looked at again, and only those fields of theirs;
* ``field_rules``: for each file and field the name the field had first in its series, through the chained renames, and
  whether its values become text;
* ``unified``: every record routed through its file's rules, with all values under first names.

Defined results: torn lines and documents are ignored, and so are rows without feed, file name, export time or body. A
null value is no value. A file delivered again adds nothing. The first file of a series has no changes. Where a removed
field matches several added ones, each match comes out. A record that stands in a file with several values of a field
is compared by the least and the greatest hash of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cluemill.session import materialize

#: Bits of the JSON kinds; the kinds of an allowance's counts are shifted by COUNT_SHIFT.
KINDS = {"string": 1, "number": 2, "boolean": 4, "list": 8, "object": 16}
COUNT_SHIFT = 5
FILE = ["series", "feed", "file_name", "exported_at"]
RECORDS_SCHEMA = "series string, feed string, file_name string, exported_at timestamp_ntz, record bigint, keys string, fields array<bigint>, hashes array<bigint>, values array<string>, fresh array<struct<f: string, p: string, k: int>>"
#: Fixed value: the seed of Spark's xxhash64, for which a field's name has the same hash in both.
FIELD_SEED = 42
#: Fields and kinds by file that a task remembers as met; when full, it starts anew.
REMEMBERED = 200_000


def _kind(value: object) -> int:
    if isinstance(value, str):
        return 1
    if isinstance(value, bool):
        return 4
    if isinstance(value, (int, float)):
        return 2
    return 8 if isinstance(value, list) else 16


class _Number(float):
    """A number that keeps the text it was written as."""

    __slots__ = ("text",)

    def __new__(cls, text: str) -> _Number:
        self = super().__new__(cls, text)
        self.text = text
        return self


def _canonical(value: object) -> str:
    return value.text if isinstance(value, _Number) else json.dumps(value, sort_keys=True, ensure_ascii=False)


def _written(value: object) -> str:
    """_canonical, with the numbers in lists and objects as they were written too."""
    if isinstance(value, list):
        return f"[{', '.join(map(_written, value))}]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {_written(v)}" for k, v in sorted(value.items())) + "}"
    return _canonical(value)


#: (key, fields) of a record: its key as text, None for what belongs to no record; a field is (name, parent, kinds, value).
Record = tuple[str | None, list[tuple[str, str, int, object]]]


def line_records(body: str) -> Iterator[Record]:
    """The record of one line with id, entry, fields and an annotation."""
    line = json.loads(body)
    if not isinstance(line, dict):
        return
    fields = [(name, "", _kind(value), value) for name, value in line.items() if value is not None and name not in ("id", "entry", "annotation")]
    annotation = line.get("annotation")
    if isinstance(annotation, dict):
        fields += [(f"annotation.{name}", "annotation", _kind(value), value) for name, value in annotation.items() if value is not None and name != "blocks"]
        blocks = annotation.get("blocks")
        blocks = [b for b in (blocks if isinstance(blocks, list) else [blocks]) if isinstance(b, dict)]
        for name in dict.fromkeys(n for b in blocks for n in b):
            values = [b.get(name) for b in blocks]
            kinds = 0
            for value in values:
                kinds |= 0 if value is None else _kind(value)
            if kinds:
                fields.append((f"annotation.blocks.{name}", "annotation.blocks", kinds, values))
    yield json.dumps({"id": line.get("id"), "entry": line.get("entry")}), fields


def allowance_records(body: str) -> Iterator[Record]:
    """The records of one allowance: each puzzle with its counts; a field's counts stand in an object or in a list of
    puzzle and count. The fields themselves, and values that are neither, belong to no puzzle."""
    document = json.loads(body, parse_int=_Number, parse_float=_Number)
    if not isinstance(document, dict):
        return
    own: list[tuple[str, str, int, object]] = []
    puzzles: dict[str, list[tuple[str, str, int, object]]] = {}
    for name, value in document.items():
        if value is None or name.startswith("_"):
            continue
        counts = list(value.items()) if isinstance(value, dict) else [(str(x.get("puzzle")), x.get("count")) for x in value if isinstance(x, dict)] if isinstance(value, list) else []
        plain = None if isinstance(value, dict) else [x for x in value if not isinstance(x, dict)] or None if isinstance(value, list) and counts else value
        own.append((name, "", _kind(value), plain))
        for puzzle, count in counts:
            fields = puzzles.setdefault(puzzle, [])
            if count is not None:
                fields.append((name, "", _kind(count) << COUNT_SHIFT, count))
    yield None, own
    for puzzle, fields in puzzles.items():
        yield json.dumps({"puzzle": puzzle}), fields


READERS: dict[str, Callable[[str], Iterator[Record]]] = {"lines": line_records, "allowances": allowance_records}


def records(files: DataFrame, series: str, reader: str, values: bool = False) -> DataFrame:
    """Records of files (feed, file_name, exported_at, body): fields holds the hashes of their fields' names, hashes those
    of the values, fresh what the task had not met in the file before. values: also their keys and values, as JSON text."""
    names = [x.split()[0] for x in RECORDS_SCHEMA.replace("struct<f: string, p: string, k: int>", "x").split(", ")]
    fresh_type = pa.list_(pa.struct([("f", pa.string()), ("p", pa.string()), ("k", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        break_up, digest = READERS[reader], xxhash.xxh64_intdigest
        ids: dict[str, int] = {}
        met: dict[tuple, set[tuple[str, str, int]]] = {}
        remembered = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                own = batch.slice(start, 512)
                source, record, keys, fields, hashes, ends, kept, fresh = [], [], [], [], [], [0], [], []
                of_file = list(zip(own.column(0).to_pylist(), own.column(1).to_pylist(), own.column(2).cast(pa.int64()).to_pylist()))
                for n, body in enumerate(own.column(3).to_pylist()):
                    try:
                        found = list(break_up(body)) if body else []
                    except (ValueError, RecursionError):
                        continue
                    if remembered > REMEMBERED:
                        met.clear()
                        remembered = 0
                    file = of_file[n]
                    for key, cells in found:
                        known, new = met.get(file), []
                        if known is None:
                            known = met[file] = set()
                        first = not known
                        for name, parent, kinds, value in cells:
                            if (name, parent, kinds) not in known:
                                known.add((name, parent, kinds))
                                new.append({"f": name, "p": parent, "k": kinds})
                            number = ids.get(name)
                            if number is None:
                                number = ids[name] = digest(name, FIELD_SEED)
                            fields.append(number)
                            hashes.append(0 if value is None else digest('"' + value if isinstance(value, str) else _canonical(value)))
                        if values:
                            kept += [None if c[3] is None else _written(c[3]) for c in cells]
                        remembered += len(new)
                        source.append(n)
                        record.append(None if key is None else digest(key))
                        keys.append(key if values else None)
                        ends.append(len(hashes))
                        fresh.append(new if new or first else None)
                if source:
                    take = own.take(pa.array(source, pa.int64()))
                    offsets = pa.array(ends, pa.int32())
                    signed = lambda x, **o: pa.array(np.array(x, np.uint64).view(np.int64), **o)
                    lists = [pa.ListArray.from_arrays(offsets, signed(x)) for x in (fields, hashes)]
                    texts = pa.ListArray.from_arrays(offsets, pa.array(kept, pa.string())) if values else pa.nulls(len(source), pa.list_(pa.string()))
                    number = signed([r or 0 for r in record], mask=np.array([r is None for r in record]))
                    yield pa.RecordBatch.from_arrays([pa.array([series] * len(source)), take.column(0), take.column(1), take.column(2), number, pa.array(keys, pa.string()), *lists, texts, pa.array(fresh, fresh_type)], names=names)

    named = files.select("feed", "file_name", "exported_at", "body").dropna(subset=["feed", "file_name", "exported_at", "body"])
    return named.mapInArrow(run, RECORDS_SCHEMA)


def field_id(name: Column) -> Column:
    """The hash that stands for a field's name in records."""
    return F.xxhash64(name)


def fingerprints(rows: DataFrame) -> DataFrame:
    """A row per file and field with its kinds; a file without fields has one row with a null field."""
    fields = rows.where(F.col("fresh").isNotNull()).select(*FILE, F.explode_outer("fresh").alias("x"))
    return fields.groupBy(*FILE, F.col("x.f").alias("field_name"), F.col("x.p").alias("parent")).agg(F.bit_or("x.k").alias("kinds"))


def file_chain(prints: DataFrame) -> DataFrame:
    """Every file with its version and the names of the files before and after it in its series.

    One row per file, so the window per feed sorts files, not records.
    """
    order = Window.partitionBy("series", "feed").orderBy("exported_at", "file_name")
    names = [F.lag("file_name").over(order).alias("before_name"), F.lead("file_name").over(order).alias("after_name")]
    return prints.select(*FILE).distinct().select(*FILE, *names, F.row_number().over(order).alias("version"))


def changes(rows: DataFrame) -> DataFrame:
    """(series, feed, file_name, exported_at, version, field_name, change_kind, old_name): each change of a file against the one before.

    rows: records, which are read twice: for the fingerprints and, where a field went and another came, for the hashes of
    those fields. Fingerprints and the fields that only one file of a pair has are file metadata, written once.
    """
    prints = materialize(fingerprints(rows))
    chain = materialize(file_chain(prints))
    key = ["series", "feed", "pair"]
    roles = F.array(
        F.struct(F.col("file_name").alias("pair"), F.lit(True).alias("is_new"), F.col("before_name").isNotNull().alias("real")),
        F.struct(F.col("after_name").alias("pair"), F.lit(False).alias("is_new"), F.col("after_name").isNotNull().alias("real")),
    )
    # each fingerprint once as part of its own file's pair and once as part of the pair of the file after it
    both = prints.where(F.col("field_name").isNotNull()).join(chain, FILE).withColumn("role", F.explode(F.filter(roles, lambda r: r["real"]))).select(*FILE, "field_name", "parent", "kinds", "role.pair", "role.is_new")
    sides = materialize(
        both.groupBy(*key, "field_name", "parent")
        .agg(F.max(F.when(F.col("is_new"), F.col("kinds"))).alias("new_kinds"), F.max(F.when(~F.col("is_new"), F.col("kinds"))).alias("old_kinds"))
        .where(~F.col("new_kinds").eqNullSafe(F.col("old_kinds")))
    )
    single = sides.where(F.col("new_kinds").isNull() | F.col("old_kinds").isNull()).select(*key, "field_name", "parent", F.col("old_kinds").isNull().alias("is_new"))
    renamed = _renames(rows, single, chain, key)

    gone = renamed.select(*key, "field_name", F.lit(True).alias("is_new")).union(renamed.select(*key, "old_name", F.lit(False))).distinct()
    plain = single.join(gone, [*key, "field_name", "is_new"], "left_anti").select(*key, "field_name", F.when(F.col("is_new"), "added").otherwise("removed").alias("change_kind"), F.lit("").alias("old_name"))
    retyped = sides.where(F.col("new_kinds").isNotNull() & F.col("old_kinds").isNotNull()).select(*key, "field_name", F.lit("retyped").alias("change_kind"), F.lit("").alias("old_name"))
    every = plain.unionByName(retyped).unionByName(renamed.select(*key, "field_name", F.lit("renamed").alias("change_kind"), "old_name"))
    return every.withColumnRenamed("pair", "file_name").join(chain.select(*FILE, "version"), ["series", "feed", "file_name"])


def _renames(rows: DataFrame, single: DataFrame, chain: DataFrame, key: list[str]) -> DataFrame:
    """(key, field_name, old_name): fields of single whose values on the records of both files of a pair are the same.

    Per pair, record and field the hashes of the values come down to a least and a greatest one before anything else, so
    a repeated record travels once per task; then a pair's records that stand in both files fold into one row a field.
    """
    names = ["series", "feed"]
    open_parents = single.groupBy(*key, "parent").agg(F.count_if("is_new").alias("_new"), F.count_if(~F.col("is_new")).alias("_old")).where("_new > 0 AND _old > 0").select(*key, "parent")
    before = chain.select(*names, F.col("file_name").alias("pair"), "before_name")
    holder = F.when(F.col("is_new"), F.col("pair")).otherwise(F.col("before_name")).alias("file_name")
    pair_id = F.xxhash64(*key).alias("pair_id")
    wanted = single.join(open_parents, [*key, "parent"], "left_semi").join(before, key).select(*names, holder, pair_id, "is_new", F.struct("field_name", "parent").alias("field"))
    # by file: its one or two pairs with the fields wanted for each
    by_file = materialize(
        wanted.groupBy(*names, "file_name", "pair_id", "is_new").agg(F.collect_list(F.struct(field_id(F.col("field.field_name")).alias("id"), "field")).alias("fields"))
        .groupBy(*names, "file_name").agg(F.collect_list(F.struct("pair_id", "is_new", "fields")).alias("roles")).join(chain.select(*FILE), [*names, "file_name"])
    )
    touched = rows.where(F.col("record").isNotNull()).select(*FILE, "record", F.col("fields").alias("ids"), "hashes").join(by_file, FILE)
    # a record counts as there even where it holds none of the fields
    nothing = F.array(F.struct(F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("struct<field_name: string, parent: string>").alias("field")))
    held = touched.select("record", "ids", "hashes", F.explode("roles").alias("r")).select("record", "ids", "hashes", "r.pair_id", "r.is_new", F.explode(F.concat(nothing, "r.fields")).alias("x"))
    place = F.array_position("ids", F.col("x.id"))
    held = held.where(F.col("x.id").isNull() | (place > 0)).select("pair_id", "is_new", "record", "x.field", F.when(F.col("x.id").isNotNull(), F.get("hashes", (place - 1).cast("int"))).alias("h"))
    least = held.groupBy("pair_id", "record", "is_new", "field").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    # a record's rows are as many as the wanted fields of two files
    common = least.groupBy("pair_id", "record").agg(F.count_distinct("is_new").alias("sides"), F.collect_list(F.struct("is_new", "field", "lo", "hi")).alias("held")).where("sides = 2")
    cells = common.select("pair_id", "record", F.explode("held").alias("c")).select("pair_id", "record", "c.*").where(F.col("field").isNotNull())
    fold = [F.bit_xor(F.xxhash64("record", "lo", "hi")).alias("x1"), F.bit_xor(F.xxhash64("hi", "lo", "record", F.lit(7))).alias("x2"), F.count(F.lit(1)).alias("n")]
    folds = materialize(cells.groupBy("pair_id", "is_new", "field").agg(*fold).select("pair_id", "is_new", "field.field_name", "field.parent", "x1", "x2", "n"))
    same = ["pair_id", "parent", "x1", "x2", "n"]
    pairs = folds.where("is_new").select(*same, "field_name").join(folds.where("NOT is_new").select(*same, F.col("field_name").alias("old_name")), same)
    numbered = chain.select(*names, F.col("file_name").alias("pair")).select(*key, pair_id)
    return pairs.join(numbered, "pair_id").select(*key, "field_name", "old_name")


def migrations(change_rows: DataFrame) -> DataFrame:
    """(series, feed, from_version, field_name, first_name): from this version of the series on, the field is the one first called first_name.

    The renames of one series are chained in the order of its files. A name that comes back while its first bearer goes
    on under another name begins a field of its own, called name#version. A series' changes are file metadata: at most
    one row per field and file, whatever the number of records.
    """
    def chain(pdf):
        import pandas as pd

        now: dict[str, str] = {}  # names in use that are not their own first name, and names that were reset
        out = []
        steps = {"renamed": 0, "removed": 1, "added": 2}
        pdf = pdf.assign(step=pdf["change_kind"].map(steps)).sort_values(["version", "step", "field_name", "old_name"])
        for version, rows in pdf.groupby("version", sort=True):
            renamed = rows[rows["step"] == 0]
            first = {r.field_name: now.get(r.old_name, r.old_name) for r in renamed.itertuples()}
            for name in [*renamed["old_name"], *rows[rows["step"] == 1]["field_name"]]:
                now.pop(name, None)
            now.update(first)
            for name in rows[rows["step"] == 2]["field_name"]:
                taken = any(f == name and n != name for n, f in now.items())
                first[name] = now[name] = f"{name}#{version}" if taken else name
            out += [(*rows.iloc[0][["series", "feed"]], version, n, f) for n, f in first.items()]
        return pd.DataFrame(out, columns=["series", "feed", "from_version", "field_name", "first_name"])

    steps = change_rows.where("change_kind IN ('renamed', 'removed', 'added')").select("series", "feed", "version", "field_name", "change_kind", "old_name")
    return steps.groupBy("series", "feed").applyInPandas(chain, "series string, feed string, from_version int, field_name string, first_name string")


def field_rules(prints: DataFrame, change_rows: DataFrame) -> DataFrame:
    """(FILE, version, field_name, first_name, as_text): the rules of every file and field; a row with a null field for a
    file without fields. File metadata: a row per file and field.

    as_text: the field's kind changes somewhere in its series, so all its values become text.
    """
    columns = [*FILE, "version", "field_name", "kinds"]
    fields = prints.join(file_chain(prints).select(*FILE, "version"), FILE).select(*columns)
    ruled = fields.join(materialize(migrations(change_rows)), ["series", "feed", "field_name"], "left")
    holds = F.col("from_version") <= F.col("version")
    chosen = F.max_by(F.when(holds, F.col("first_name")), F.when(holds, F.col("from_version")))
    named = materialize(ruled.groupBy(*columns).agg(chosen.alias("_first")).select(*columns, F.coalesce("_first", "field_name").alias("first_name")))
    retyped = change_rows.where("change_kind = 'retyped'").select("series", "feed", "version", "field_name")
    texts = named.join(retyped, ["series", "feed", "version", "field_name"], "left_semi").select("series", "feed", "first_name").distinct().withColumn("_text", F.lit(True))
    return named.join(texts, ["series", "feed", "first_name"], "left").select(*FILE, "version", "field_name", "first_name", F.coalesce("_text", F.lit(False)).alias("as_text"))


def unified(rows: DataFrame, change_rows: DataFrame) -> DataFrame:
    """One row per file and record, with its keys (id and entry of a line, puzzle of an allowance's count) and fields: a map
    from first name to value (JSON text), and conflicts: how many fields have several values in the record's repetitions.

    rows: records with values. A record without values has a row too. Values of an allowance that belong to no puzzle
    stand in a row of the file without keys. Each file's values go through the rules of its version: rename to the first
    name, cast to text where the field's kind changes anywhere in the series (text loses its quotes, other values keep
    how they are written), and the default, null, for every field of the series that the record lacks. Of several
    values of a field in a record's repetitions the least is kept.

    A file's rules are carried to its records, whose values are renamed where they stand. Hashes of the records tell
    whose repetitions differ; only those records are broken into fields. The values of the others are shuffled once, to
    bring repetitions together.
    """
    rules = field_rules(materialize(fingerprints(rows)), change_rows)
    vocabulary = rules.where("first_name IS NOT NULL").groupBy("series", "feed").agg(F.array_sort(F.collect_set("first_name")).alias("names"))
    by_field = F.map_from_entries(F.collect_list(F.when(F.col("field_name").isNotNull(), F.struct(field_id(F.col("field_name")), F.struct("first_name", "as_text")))))
    by_file = materialize(rules.groupBy(*FILE, "version").agg(by_field.alias("rules")).join(vocabulary, ["series", "feed"], "left"))
    record = [*FILE, "record"]
    bare = lambda v: F.when(F.startswith(v, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)
    paired = F.filter(F.zip_with("ids", "values", lambda x, v: F.struct(x.alias("id"), v.alias("v"))), lambda x: x["v"].isNotNull())
    named = F.transform(paired, lambda x: F.struct(F.col("rules")[x["id"]]["first_name"].alias("f"), F.when(F.col("rules")[x["id"]]["as_text"], bare(x["v"])).otherwise(x["v"]).alias("v")))
    ready = rows.withColumnRenamed("fields", "ids").join(by_file.select(*FILE, "rules"), FILE).select(*record, "keys", named.alias("cells"))
    whole, twice = F.xxhash64("cells"), F.size(F.array_distinct("cells.f")) < F.size("cells")
    apart = ready.select(*record, whole.alias("_h"), twice.alias("_twice")).groupBy(*record).agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi"), F.max("_twice").alias("_twice"))
    doubtful = materialize(apart.where((F.col("_lo") != F.col("_hi")) | F.col("_twice")).select(*[F.col(c).alias(f"_{c}") for c in record]))
    mine = None
    for c in record:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        mine = same if mine is None else mine & same
    whole_ones = ready.join(doubtful, mine, "left_anti").groupBy(*record).agg(F.first("keys").alias("keys"), F.first("cells").alias("cells"))
    fields = ready.join(doubtful, mine, "left_semi").select(*record, "keys", F.explode_outer("cells").alias("c")).groupBy(*record, "c.f").agg(F.first("keys").alias("keys"), F.min("c.v").alias("v"), (F.min("c.v") != F.max("c.v")).alias("several"))
    mended = fields.groupBy(*record).agg(
        F.first("keys").alias("keys"), F.collect_list(F.when(F.col("f").isNotNull(), F.struct("f", "v"))).alias("cells"), F.count_if("several").alias("conflicts")
    )
    every = whole_ones.select(*record, "keys", "cells", F.lit(0).cast("bigint").alias("conflicts")).unionByName(mended)
    held = F.map_from_entries("cells")
    values = F.map_from_entries(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.struct(n, F.col("held")[n])))
    keys = [F.get_json_object("keys", f"$.{name}").alias(name) for name in ("id", "entry", "puzzle")]
    out = every.join(by_file.select(*FILE, "version", "names"), FILE).withColumn("held", held)
    return out.select(*FILE, "version", "record", *keys, values.alias("fields"), "conflicts")
