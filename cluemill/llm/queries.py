"""Queries of the corpus problems 4 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cluemill.llm import counting, frequency, looks, packing, quality, tokens
from cluemill.operators.snapshots import latest_rows
from cluemill.session import materialize, table

RARE_BELOW = 3
COMMON_PERCENT = 3


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the newest row of each annotated entry, with their frequencies and marks."""
    rows = table(spark, sf_dir, "clue_entry").select("puzzle_id", "entry_id", "loaded_at", "clue_id", "clue_type", "indicators")
    annotated = latest_rows(rows, ["puzzle_id", "entry_id"], ["loaded_at", "clue_id"]).where(F.col("clue_type").isNotNull())
    counts = frequency.term_counts(annotated, {"indicators": F.col("indicators"), "clue_type": F.split("clue_type", r"\+")})
    return frequency.mark_terms(counts, RARE_BELOW, COMMON_PERCENT)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), F.lit("rare")), F.when(F.col("is_common"), F.lit("common"))))
    return p4_terms(spark, sf_dir).select("field_name", "term", F.explode(marks).alias("mark"))


def _clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clue_entry").select("clue_id", "clue").unionByName(table(spark, sf_dir, "authored_clue").select("clue_id", "clue"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.same_looks(_clues(spark, sf_dir), "clue_id", "clue").select(F.col("first_key").alias("clue_id_a"), F.col("key").alias("clue_id_b"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct clue with its number of rows, what it looks like and the form to compare it by."""
    texts = _clues(spark, sf_dir).where(F.col("clue").isNotNull()).groupBy("clue").agg(F.count(F.lit(1)).alias("n_rows"))
    return looks.with_forms(texts, "clue")


TOKENIZER = "byte_bpe_50k.tiktoken"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(_texts(spark, sf_dir), "doc_id", "text", TOKENIZER)


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and whether its decoded ids are its text; a null text comes back empty."""
    ids = p6_ids(spark, sf_dir)
    decoded = tokens.decode(ids, "doc_id", "ids", TOKENIZER).withColumnRenamed("text", "decoded")
    return _texts(spark, sf_dir).join(decoded, "doc_id").select("doc_id", F.length("decoded").alias("n_chars_decoded"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _budgets(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, int]]:
    return [(r.budget_id, r.tokenizer, r.capacity_tokens) for r in table(spark, sf_dir, "packet_budget").where("tokenizer is not null").collect()]  # a fixed table


def _sizes(spark: SparkSession, sf_dir: str, budgets: list[tuple[int, str, int]]) -> DataFrame:
    return counting.token_counts(_texts(spark, sf_dir), "doc_id", "text", sorted({t for _, t, _ in budgets}))


def p7_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = _budgets(spark, sf_dir)
    return packing.packets(_sizes(spark, sf_dir, budgets), "doc_id", budgets, _texts(spark, sf_dir).count())


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per budget: packets used by the online rule alone and after its last windows were dissolved, the fewest that the tokens
    could fill, and the share of unused space."""
    budgets = _budgets(spark, sf_dir)
    sizes, n = materialize(_sizes(spark, sf_dir, budgets)), _texts(spark, sf_dir).count()
    full = lambda repair: packing.packets(sizes, "doc_id", budgets, n, repair=repair).groupBy("budget_id", "packet_no").agg(F.sum("n_tokens").alias("n"))
    online = full(False).groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_online"))
    used = full(True).groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_packets"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    named = table(spark, sf_dir, "packet_budget").select("budget_id", "packet_name", "capacity_tokens")
    return used.join(online, "budget_id").join(F.broadcast(named), "budget_id").select(
        "budget_id", "packet_name", "capacity_tokens", "n_online", "n_packets", "n_tokens", "fullest",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("fewest"), (1 - F.col("n_tokens") / (F.col("n_packets") * F.col("capacity_tokens"))).alias("unused"),
    )


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [r.word for r in table(spark, sf_dir, "common_word").select("word").where(F.col("word").isNotNull()).distinct().collect()]  # a fixed list
    return quality.text_quality(_texts(spark, sf_dir), "doc_id", "text", words)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_quality(spark, sf_dir).where("doc_kind <> 'prose'").select("doc_id", "doc_kind")


#: Fixed values for the SQL, which shares no table with the operator: letters and signs drawn as others, and code points that are not drawn.
_DRAWN = dict(zip(
    "АВЕЅІЈКМНОРСТУХҮԚԜѴ" "аеѕіјорсухһԁԛԝѵӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "οϳ" "‐‑⁃" "ʼ" "⁄∕" "ꓸ",
    "ABESIJKMHOPCTYXYQWV" "aesijopcyxhdqwvl" "ABEZHIKMNOPTYX" "oj" "---" "’" "//" ".",
    strict=True,
))
_UNDRAWN = r"\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}"


def _look_sql(clue: str) -> str:
    """The look of a clue in SQL, for the kinds of characters that clues hold."""
    from_, to = "".join(_DRAWN), "".join(_DRAWN.values())
    wide = "".join(chr(0xFF01 + n) for n in range(94))
    narrow = "".join(chr(0x21 + n) for n in range(94))
    spaces = "\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
    out = f"regexp_replace({clue}, '[{_UNDRAWN}]', '', 'g')"
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = f"replace({out}, '{ligature}', '{letters}')"
    quote = lambda x: x.replace("'", "''")
    out = f"translate(translate({out}, '{quote(wide)}', '{quote(narrow)}'), '{quote(from_)}', '{quote(to)}')"
    return f"nfc_normalize(trim(regexp_replace({out}, '[{spaces}]+', ' ', 'g'), ' '))"


_TERMS = """e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY puzzle_id, entry_id ORDER BY loaded_at DESC, clue_id DESC) AS k FROM clue_entry) WHERE k = 1 AND clue_type IS NOT NULL),
x AS (SELECT clue_id, 'indicators' AS field_name, unnest(indicators) AS raw FROM e UNION ALL SELECT clue_id, 'clue_type', unnest(string_split(clue_type, '+')) FROM e),
y AS (SELECT clue_id, field_name, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS term FROM x),
c AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT clue_id) AS records, (SELECT count(*) FROM e) AS all_records FROM y WHERE term <> '' GROUP BY 1, 2),
m AS (SELECT *, records < 3 AS is_rare, records * 100 > all_records * 3 AS is_common FROM c)"""
#: Tokenizers, packing and the line model are not expressible in SQL.
SQL = {
    "p4_found": f"WITH {_TERMS} SELECT field_name, term, 'rare' AS mark FROM m WHERE is_rare UNION ALL SELECT field_name, term, 'common' FROM m WHERE is_common",
    "p4_terms": f"WITH {_TERMS} SELECT * FROM m",
    "p5_found": f"""WITH c AS (SELECT clue_id, clue FROM clue_entry WHERE clue IS NOT NULL UNION ALL SELECT clue_id, clue FROM authored_clue WHERE clue IS NOT NULL),
l AS (SELECT clue_id, clue, {_look_sql('clue')} AS look FROM c), f AS (SELECT look, min(clue_id) AS clue_id_a, arg_min(clue, clue_id) AS first FROM l WHERE look <> '' GROUP BY 1)
SELECT clue_id_a, clue_id AS clue_id_b FROM l JOIN f USING (look) WHERE clue <> first""",
}
QUERIES = {
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p5_found": p5_found,
    "p5_forms": p5_forms,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_packets": p7_packets,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_quality": p8_quality,
}
