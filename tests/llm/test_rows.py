"""Stages of the pipeline decide by row: shared and null ids, odd columns, empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillsight.llm.common import join_rows, row_id, row_key, select_rows
from tillsight.llm.decontaminate import without_contaminated
from tillsight.llm.line_dedup import dedup_lines, without_shared_lines
from tillsight.llm.packing import pack
from tillsight.llm.quality_classifier import PREDICT_AT, _scored, without_rejected
from tillsight.llm.simhash import one_per_group, simhash_groups

SF = "/root/testdata/sf0.001"
CLEAN = "a quiet river ran past the old stone mill and the children walked along its bank until evening came"
PASSAGE = "seven copper kettles hang above the blue door while nobody counts the rainy minutes of an idle afternoon"
ROW = "doc_id long, text string, `odd.name` string, m map<string,int>, row_key int, row string"


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def odd(spark, pairs):
    return spark.createDataFrame([(i, t, "x", {"a": 1}, 3, "r") for i, t in pairs], ROW).repartition(4)


def test_join_rows(spark):
    d = odd(spark, [(None, "a"), (None, "b"), (0, "a"), (1, "a"), (1, "b"), (1, "b"), (2, None), (2, "")])
    gone = d.where("(doc_id is null and text = 'a') or text = 'b' and doc_id = 1 or text is null").select(
        row_key().alias("row")).distinct()
    left = join_rows(d, gone, "left_anti")
    assert left.columns == d.columns
    assert rows_of(left) == Counter([(None, "b"), (0, "a"), (1, "a")])  # a null text is an empty one
    once = join_rows(d, gone, "left_semi", once=True)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in once.collect()) == [(0, "a"), (1, "b"), (2, "")]


def test_one_row_of_each_group_stays(spark):
    texts = [CLEAN, PASSAGE, "other words altogether stand in this short line", "and nothing at all like them is here, or is it"]
    d = odd(spark, [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3])])
    assert rows_of(one_per_group(d)) == rows_of(d)
    again = d.union(d).union(odd(spark, [(9, texts[2]), (5, texts[2]), (0, texts[1])]))
    kept = one_per_group(again)
    assert kept.columns == d.columns
    assert rows_of(kept) == Counter([(1, texts[0]), (0, texts[1]), (5, texts[2]), (None, texts[3])])


def test_group_ids_of_many_null_ids(spark):
    d = odd(spark, [(None, CLEAN)] * 300 + [(4, CLEAN), (None, PASSAGE)])
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash_groups(d).collect())
    assert got == Counter({(None, 4): 300, (4, 4): 1, (None, None): 1})


def test_decontamination_by_row(spark):
    test = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    d = odd(spark, [(None, CLEAN), (None, f"so {PASSAGE} so"), (3, CLEAN), (3, PASSAGE), (None, None), (4, "")])
    assert rows_of(without_contaminated(d, test)) == Counter([(None, CLEAN), (3, CLEAN), (None, None), (4, "")])


def test_quality_by_row(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit(7)).otherwise(F.col("doc_id")))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {tuple(r["row"]): r["score"] for r in _scored(select_rows(d), row_id(), labels, 4, 2).collect()}
    keyed = d.select(row_key().alias("row"), "doc_id", "text").collect()
    want = Counter((r["doc_id"], r["text"]) for r in keyed if scores[tuple(r["row"])] >= PREDICT_AT)
    kept = without_rejected(d, labels)
    assert kept.columns == d.columns and rows_of(kept) == want
    for shared in (None, 7):  # some with that id stay and some go
        assert 0 < sum(n for (i, _), n in want.items() if i == shared) < sum(r["doc_id"] == shared for r in keyed)


def test_lines_with_odd_columns(spark):
    line = "this line is everywhere"
    d = odd(spark, [(i % 4 or None, f"{line}\n \nown line {i}") for i in range(12)] + [(3, f"{line}\n \nown line 3")] * 2)
    out = without_shared_lines(d)
    assert out.columns == d.columns and out.schema["m"].dataType == d.schema["m"].dataType
    assert rows_of(out) == Counter((i % 4 or None, f" \nown line {i}") for i in [*range(12), 3, 3])
    assert {(r["odd.name"], r["m"]["a"], r["row"]) for r in out.select("`odd.name`", "m", "row").collect()} == {("x", 1, "r")}


def test_blank_lines_are_never_shared(spark):
    d = odd(spark, [(i, "\n \n\t\n") for i in range(30)])
    assert {(r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup_lines(d).collect()} == {(4, 0, "\n \n\t\n")}


@pytest.mark.parametrize("stage", ["quality", "lines", "near_duplicates", "decontamination"])
def test_stages_of_empty_tables(spark, stage):
    import corpus_pipeline as P
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    out = dict(P.STAGES)[stage](spark, d, SF)
    assert out.count() == 0 and out.columns == d.columns


def test_packing_of_an_empty_table(spark):
    import public_tokenizers
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert pack(d, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1).count() == 0
