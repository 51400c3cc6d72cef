"""Benchmark passages against DuckDB SQL and made-up questions."""

from __future__ import annotations

import duckdb
import pytest
from check_oracle import compare, duck_tables
from odd_texts import ODD_TEXTS

from sievework.llm import decontaminate, queries

SF = "/root/testdata/sf0.01"
QUESTION = "Anna has 5 red apples and buys 7 more apples from Carl at the market, then Anna gives 5 apples away. How many are left?"


@pytest.fixture(scope="module")
def bench(spark):
    rows = [
        (1, QUESTION, "h"),
        (2, "a short one here", "h"),
        (3, None, "h"),
        (4, "", "h"),
        (5, "One Two Three Four 5 6 7 8 9 10 Eleven Twelve", "h"),
        (6, QUESTION, "h"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string, hash string")


def found(spark, bench, *texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slots string, at long").repartition(2)
    return sorted(tuple(r) for r in decontaminate.leaks(docs, bench).select("doc_id", "item_id", "changed_slots").collect())


def test_same_rows_as_sql(spark):
    problem = compare(queries.op7_decontamination(spark, SF), duck_tables(SF), queries.ORACLE["op7_decontamination"])
    assert problem is None, problem


def test_same_rows_as_sql_on_edited_copies(spark, tmp_path):
    """Copies with changed words, repeated variants of a template, items that are mostly slots and short ones."""
    plain = [f"w{'abcdefghijklmnopqrst'[k % 20]}{'xyz'[k // 20]}" for k in range(60)]
    long, other = plain[:35], plain[35:52]
    template = "if {} boxes hold {} pens then how many pens do {} boxes hold in all of them together"
    slots = "Anna 5 km Bob 7 kg Cara 9 km Dan 11 kg then plain words go on here for some while longer"
    items = [" ".join(long), " ".join(other), template.format(12, 30, 12), slots, "alpha beta gamma", " ".join(plain[:8] * 3)]
    edits = []
    for words in (long, other):
        for changed in ((), (9,), (9, 18), (9, 18, 27), (2, 5, 11, 14), tuple(range(0, 35, 4))):
            edits.append(" ".join("changed" if k in changed else w for k, w in enumerate(words)))
    variants = f"{template.format(4, 4, 5)} . {template.format(5, 7, 5)}"
    texts = [*edits, variants, template.format(3, 3, 4), slots.replace("Bob", "Eve"), slots.replace("Anna 5", "Eve 7"),
             "so alpha beta gamma it is", "ALPHA BETA GAMMA", " ".join(long).upper(), " ".join(plain[:8] * 2), None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[1]), (None, texts[0])], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    found = decontaminate.leaks(docs, spark.read.parquet(f"{tmp_path}/benchmark"))
    assert found.count() > 10
    problem = compare(found, db, queries.ORACLE["op7_decontamination"])
    assert problem is None, problem


def test_every_whole_item_is_found(spark):
    items = queries.table(spark, SF, "benchmark").collect()
    docs = queries.table(spark, SF, "documents").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, SF).collect()}
    assert want and want <= got


def test_copies_and_reparameterised_questions(spark, bench):
    other = QUESTION.replace("Anna", "Berta").replace("Carl", "Dora").replace("5", "12").replace("7", "30.5")
    inconsistent = other.replace("gives 12", "gives 13")
    assert found(
        spark, bench,
        "before " + QUESTION + " after",
        other,
        inconsistent,
        "nothing of the kind " * 30,
        QUESTION.replace(" ", "\n"),
        QUESTION.upper(),
        QUESTION.lower(),
    ) == [(k, item, 4 if k == 1 else 0) for k in (0, 1, 4, 5, 6) for item in (1, 6)]


def test_windows_on_both_sides_of_an_edit_count_together(spark, bench):
    words = QUESTION.split()
    edited = " ".join([*words[:11], "inserted", *words[11:]])
    assert [r[:2] for r in found(spark, bench, edited)] == [(0, 1), (0, 6)]
    assert found(spark, bench, " ".join(words[:10])) == []


@pytest.mark.parametrize(("length", "changed", "held"), [(17, [8], 16), (20, [9], 19), (35, [8, 17, 26], 32), (40, [8, 17, 26, 35], 32), (15, [7], None), (20, [8, 10], 17)])
def test_words_held_around_changed_words(spark, length, changed, held):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(length)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    near = " ".join("other" if k in changed else w for k, w in enumerate(words))
    docs = spark.createDataFrame([(1, f"before {near} after")], "doc_id long, text string")
    got = [r.words for r in decontaminate.leaks(docs, item).collect()]
    assert got == ([] if held is None else [held])


def test_every_variant_of_a_template_is_checked(spark):
    text = "a farmer sells {} eggs to his brother and then {} eggs to the old man who lives across the river"
    item = spark.createDataFrame([(1, text.format(5, 7))], "item_id long, text string")
    first, second = text.format(4, 4), text.format(12, 30)
    same = text.format(12, 12)  # shares the value of some windows with the consistent variant
    texts = [first, f"{first}. {second}.", f"{second}. {first}.", f"{same}. {second}.", f"{text[:60].format(12, 12)}. {second}."]
    assert found(spark, item, *texts) == [(k, 1, 2) for k in (1, 2, 3, 4)]


def test_items_with_windows_of_mostly_slots(spark):
    text = "what is the sum of {} and {} {} {} {}"
    item = spark.createDataFrame([(1, text.format(1, 2, 3, 4, 5))], "item_id long, text string")
    texts = [text.format(11, 12, 13, 14, 15), text.format(11, 11, 13, 14, 15), "what is the sum of it", "1 2 3 4 5 6 7 8 9"]
    assert found(spark, item, *texts) == [(0, 1, 4)]


def test_short_items_need_all_words_and_slots_alone_prove_nothing(spark, bench):
    assert found(spark, bench, "it is a short one here yes", "a short one there", "Uno Due Tre Quattro 1 2 3 4 5 6 Sette Otto") == [(0, 2, 0)]


def test_odd_rows(spark, odd_docs, no_docs, bench):
    assert decontaminate.leaks(odd_docs, bench).count() == 0
    assert decontaminate.leaks(no_docs, bench).count() == 0
    assert decontaminate.leaks(odd_docs, bench.limit(0)).count() == 0
    own = odd_docs.selectExpr("doc_id AS item_id", "text")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd_docs, own).collect()}
    plain = ODD_TEXTS[3][1]
    ids = [i for i, t in ODD_TEXTS if t == plain]
    assert {(a, b) for a in ids for b in ids} <= got and (7, 7) in got and (None, None) in got
