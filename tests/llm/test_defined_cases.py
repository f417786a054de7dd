"""Empty tables, clashing columns, rows whose order a shuffle decides, and bounds of shuffles."""

import pytest
from pyspark.sql import functions as F

from skein.llm import blocks, chat_format, decontaminate, ngram_join, substring_dedup, texts, token_counts
from skein.session import Scratch

DOCS = "doc_id long, text string, lang string, n_chars long, row string, n long, least long, kept string, component_id long, block long"


def _rows(*pairs):
    return [(i, t, "en", None if t is None else len(t), "r", 1, 2, "k", 3, 4) for i, t in pairs]


def test_rows_are_stored_only_where_a_shuffle_orders_them(spark, tmp_path):
    spark.range(100).withColumn("text", F.concat(F.lit("word "), "id")).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    scratch = Scratch(spark, "settled")
    for df in (read, read.where("id > 3").select("text"), read.union(read), read.select(F.explode(F.split("text", " ")))):
        assert blocks.settled(df, scratch, "x") is df
    for i, df in enumerate((read.repartition(3), read.groupBy("id").count(), read.orderBy("text"), read.distinct(), read.sample(0.5))):
        stored = blocks.settled(df, scratch, f"x{i}")
        assert stored is not df and stored.dtypes == df.dtypes
        assert stored.inputFiles() and all(f"/x{i}/" in f for f in stored.inputFiles())


def test_partitions_are_bounded(spark):
    assert texts.partitions_for(1, spark) == spark.sparkContext.defaultParallelism
    assert texts.partitions_for(500, spark) == 500
    assert texts.partitions_for(10**7, spark) == texts.MOST_PARTITIONS


def test_one_partition_may_hold_many_blocks(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(1, 40))) for i in range(60)] + [(7, "again " * 20), (None, "x y z")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted(map(tuple, substring_dedup.repeated_spans(df, window=5).select("doc_id", "kept").collect()), key=repr)
    monkeypatch.setattr(texts, "MOST_PARTITIONS", 2)
    packed, n = blocks.packed(df, Scratch(spark, "many"), each=256)
    assert n > 8 and packed.count() > 8
    sizes = packed.select(F.sum(F.octet_length("ids")) / 8).first()[0]
    assert sizes == len(rows)
    assert sorted(map(tuple, substring_dedup.repeated_spans(df, window=5, block_bytes=256).select("doc_id", "kept").collect()), key=repr) == whole


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "one two three four five six", "x")], "item_id long, text string, hash string")
    some = spark.createDataFrame(_rows((1, "one two three four five six")), DOCS)
    assert decontaminate.contained_items(none, items).count() == decontaminate.contained_items(some, items.limit(0)).count() == 0
    assert decontaminate.contained_items(some, items).count() == 1
    assert ngram_join.jaccard_components(none).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.recovered(chat_format.formatted(turns)).count() == 0


def test_token_counts_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    assert token_counts.token_counts(none, "piece_bpe_32k.model", str(tmp_path / "cache")).count() == 0


@pytest.mark.parametrize("rows", [[], _rows((5, None)), _rows((1, "a b c d e f g"), (1, "a b c d e f g"), (1, None), (2, "A b c d e f g"), (None, "a b c d e f g"), (None, None), (3, ""), (3, "z"), (4, "u v w x y"), (4, "k l m n o p"))])
def test_near_duplicates_keep_one_row_of_each_document(spark, rows):
    import corpus_pipeline as P

    out = P.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), "")
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    if not rows:
        assert got == []
    elif len(rows) == 1:
        assert got == [(5, None)]
    else:
        # of an id's rows the one with the smallest text stays, null before all; 2 is a near copy of 1
        assert got == sorted([(1, None), (3, ""), (4, "k l m n o p"), (None, "a b c d e f g"), (None, None)], key=repr)
    assert all(tuple(r)[2:] == ("en", None if r.text is None else len(r.text), "r", 1, 2, "k", 3, 4) for r in out.collect())
