from collections import defaultdict

from pyspark.sql import functions as F

from cluemill.llm import frequency, queries


def brute(entries):
    last = {}
    for r in entries:
        k = (r["puzzle_id"], r["entry_id"])
        if k not in last or (r["loaded_at"], r["clue_id"]) > (last[k]["loaded_at"], last[k]["clue_id"]):
            last[k] = r
    rows = [r for r in last.values() if r["clue_type"] is not None]
    seen = defaultdict(int)
    for r in rows:
        terms = {("clue_type", t) for t in r["clue_type"].split("+")} | {("indicators", t) for t in (r["indicators"] if r["indicators"] is not None else []) if t is not None}
        for f, t in {(f, " ".join(t.lower().split())) for f, t in terms}:
            if t:
                seen[f, t] += 1
    return {(f, t, "rare") for (f, t), n in seen.items() if n < 3} | {(f, t, "common") for (f, t), n in seen.items() if 100 * n > 3 * len(rows)}


def test_query_is_brute_force(spark, data):
    got = [tuple(r) for r in queries.p4_found(spark, data).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute([r.asDict() for r in spark.read.parquet(f"{data}/clue_entry.parquet").collect()])


def test_terms_and_bounds(spark):
    data = [(n, [" In ", "in", None, "  "] if n < 4 else None, "a + b" if n % 2 else " A  b ") for n in range(10)]
    counts = frequency.term_counts(spark.createDataFrame(data, "id int, i array<string>, t string"), {"i": F.col("i"), "t": F.split("t", r"\+")})
    got = {(r.field_name, r.term): (r.occurrences, r.records, r.is_rare, r.is_common) for r in frequency.mark_terms(counts, 5, 45).collect()}
    assert got == {("i", "in"): (8, 4, True, False), ("t", "a"): (5, 5, False, True), ("t", "b"): (5, 5, False, True), ("t", "a b"): (5, 5, False, True)}


def test_no_records(spark):
    counts = frequency.term_counts(spark.createDataFrame([], "i array<string>"), {"i": F.col("i")})
    assert frequency.mark_terms(counts, 3, 3).count() == 0
