"""One form for text that looks the same but differs in its characters (problem 5).

Each distinct text is normalised once, in Arrow batches: compatibility normalisation in composed form, every white
space mapped to one space, default-ignorable characters removed, look-alike letters of other scripts mapped to the
Latin letter they are drawn as. ``canonical_form`` also applies full case folding; ``look_key`` keeps what can be seen:
letter case, accents, the shape of quotation marks, the length of dashes, and letters that compatibility normalisation
would take out of a raised, lowered, circled, framed or mathematical shape. Texts of ASCII characters only go through
Arrow's vectorised functions.

The look-alike letters are not listed here: ``look_alikes`` asks the Unicode confusables data of the ICU library that
Spark brings along (under 500 letters), on the driver, for all letters and carries the answer with the tasks.

Defined results: null stays null; text without a visible character has the empty form and looks like nothing. Runs of
white space count as one space, at either end as none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cluemill.operators.skew import all_salts, heavy_keys, salt
from cluemill.session import materialize

#: Default-ignorable code points of the Unicode standard.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Signs drawn as others, and letters that the confusables data lacks or gives another letter for.
SIGNS = {"‐": "-", "‑": "-", "⁃": "-", "ʼ": "’", "⁄": "/", "∕": "/", "ꓸ": ".", "Ԛ": "Q", "ӏ": "l", "ɑ": "a", "ɡ": "g"}
#: Letters that can be taken for a Latin one but are drawn otherwise.
DRAWN_OTHERWISE = frozenset("гαγισ")
#: Kinds of compatibility characters whose difference can be seen.
SEEN = ("<super>", "<sub>", "<circle>", "<square>", "<font>", "<fraction>", "<vertical>")


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letter of another script -> the Latin letter of the same case that it is drawn as, with SIGNS.

    Left out are letters written from right to left, whose words look otherwise anyway. The data do not tell I from l:
    a capital letter drawn as a stroke is I, any other l.
    """
    letters = [chr(cp) for cp in range(0x80, 0x20000) if unicodedata.category(chr(cp)) in ("Lu", "Ll", "Lo")]
    letters = [c for c in letters if not unicodedata.decomposition(c) and not unicodedata.name(c, "").startswith("LATIN") and unicodedata.bidirectional(c) == "L"]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    found = {}
    for letter, latin in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True):
        kind = unicodedata.category(letter)
        latin = "I" if latin == "l" and kind == "Lu" else latin
        if len(latin) == 1 and latin.isascii() and latin.isalpha() and kind in ("Lo", unicodedata.category(latin)) and letter not in DRAWN_OTHERWISE:
            found[letter] = latin
    return found | SIGNS


class _Form(dict):
    """str.translate table, filled as characters come: code point -> its decomposed form."""

    def __init__(self, alike: Mapping[str, str], seen: tuple[str, ...]) -> None:
        super().__init__()
        self.alike, self.seen = alike, seen

    def __missing__(self, cp: int) -> str:
        ch, alike = chr(cp), self.alike
        if any(a <= cp <= b for a, b in IGNORABLE):
            form = ""
        elif ch.isspace():
            form = " "
        elif unicodedata.decomposition(ch).startswith(self.seen):
            form = ch
        else:
            form = "".join(alike.get(x, " " if x.isspace() else x) for x in unicodedata.normalize("NFKD", ch))
            form = "".join(alike.get(x, x) for x in form)
        self[cp] = form
        return form


class Looks:
    """Both forms of a text, by a table of look-alike letters."""

    def __init__(self, alike: Mapping[str, str]) -> None:
        self.look, self.full = _Form(alike, SEEN), _Form(alike, ("<none>",))

    def look_key(self, text: str) -> str:
        """Equal for texts that look the same on the page."""
        return " ".join(unicodedata.normalize("NFC", text.translate(self.look)).split())

    def canonical_form(self, text: str) -> str:
        """One form for comparison: as look_key, with full compatibility normalisation and case folding."""
        folded = unicodedata.normalize("NFKC", text.translate(self.full)).casefold()
        return " ".join(unicodedata.normalize("NFKC", folded.translate(self.full)).split())

    def column(self, values: pa.Array, form: str) -> pa.Array:
        """The form (look or form) of each value: those of ASCII characters by Arrow, the others one by one."""
        plain = pc.utf8_trim(pc.replace_substring_regex(values, "[\\x09-\\x0d\\x1c-\\x20]+", " "), " ")
        one = self.look_key
        if form == "form":
            plain, one = pc.ascii_lower(plain), self.canonical_form
        other = pc.fill_null(pc.invert(pc.string_is_ascii(values)), False)
        return pc.replace_with_mask(plain, other, pa.array([one(v) for v in values.filter(other).to_pylist()], pa.string()))


def with_forms(texts: DataFrame, text: str, forms: tuple[str, ...] = ("look", "form")) -> DataFrame:
    """texts with the columns look and form, or one of them. Give distinct texts, so that each is normalised once."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields], *[f"{f} string" for f in forms]])
    at, names = texts.columns.index(text), [*texts.columns, *forms]
    alike = look_alikes(texts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = Looks(alike)
        for batch in batches:
            values = batch.column(at).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[looks.column(values, f) for f in forms]], names=names)

    return texts.mapInArrow(run, schema)


def same_looks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(first_key, key) of each row whose text looks like that of the row with the smallest key, but differs from it.

    Works on distinct texts: each with its smallest key (a minimum combines before the shuffle), normalised once and
    written; each look with its smallest key; and only then the rows of texts that differ from their look's first text.
    Both joins are against one row per key; the rows of a text, and the texts of a look, that are a large share of all
    are spread over parts. Keys are unique; rows without a key or a text are left out.
    """
    rows = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text")).dropna()
    texts = rows.groupBy("_text").agg(F.min("_key").alias("_key"))
    looks = materialize(with_forms(texts, "_text", ("look",)).where("look <> ''"))
    alike, often = heavy_keys(looks, "look"), heavy_keys(rows, "_text")
    firsts = looks.groupBy("look").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("look", "_first", F.explode(all_salts(alike, ["look"])).alias("_part"))
    variants = looks.withColumn("_part", salt(alike, ["look"], ["_key"])).join(firsts, ["look", "_part"]).where("_key <> _first").select("_text", "_first", F.explode(all_salts(often, ["_text"])).alias("_part"))
    return rows.withColumn("_part", salt(often, ["_text"], ["_key"])).join(variants, ["_text", "_part"]).select(F.col("_first").alias("first_key"), F.col("_key").alias("key"))
