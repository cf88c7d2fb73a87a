"""Stages of the corpus pipeline against brute force, and the registration of all queries."""

import brute
from conftest import SCHEMA, prose, rows_of

import __spark_entry__ as entry
import corpus_pipeline as cp
from pelage.llm.importance import Sampler

SF_DIR = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    sampler = Sampler(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    want = {r.id for r in sampler.decided().where("kept").collect()}
    docs = cp.stored(cp.quality(spark, docs, SF_DIR), "t")
    before = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and set(before) == want

    docs = cp.stored(cp.near_duplicates(spark, docs, SF_DIR), "t")
    after = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns
    assert set(after) == {i for i, (_, low) in brute.similar(list(before.items()), 5, 80).items() if i == low}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs = cp.stored(cp.decontaminate(spark, docs, SF_DIR), "t")
    clean = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and set(clean) == set(after) - {d for d, _ in brute.contained(list(after.items()), items)}

    docs = cp.stored(cp.secrets(spark, docs, SF_DIR), "t")
    redacted = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(redacted) == set(clean)
    for key, text in clean.items():
        assert redacted[key].n_chars == len(redacted[key].text)
        assert redacted[key].text == text or (brute.secrets(text) and "[SECRET]" in redacted[key].text)

    pieces = cp.packing(spark, docs, SF_DIR).toPandas()
    assert set(pieces["doc_id"]) == set(redacted) and pieces.groupby("sequence_id")["length"].sum().max() <= 1024


def test_stages_take_nulls_repeats_and_empty(spark, null_row_docs, no_docs):
    twice = spark.createDataFrame([*rows_of([prose(1, 60)]), *rows_of([prose(1, 60)])], SCHEMA)
    assert cp.near_duplicates(spark, twice, SF_DIR).count() == 1
    for docs in (null_row_docs, no_docs):
        for name, stage in cp.STAGES:
            assert stage(spark, docs, SF_DIR).count() <= 4, name
    assert cp.near_duplicates(spark, null_row_docs, SF_DIR).where("doc_id IS NOT NULL").count() == 1


def test_near_duplicates_keeps_rows_without_id_and_one_of_equal_texts(spark):
    text, near = prose(1, 60), prose(1, 60) + " more"
    rows = [(None, text, "b", 1), (None, text, "b", 1), (3, text, "b", 1), (3, text, "a", 2), (3, text, "a", 2), (7, prose(2, 60), "z", 3),
            (4, text, "c", 4), (5, near, "c", 5), (6, prose(5, 60), None, None), (6, prose(5, 60), "q", None), (7, prose(8, 60), "z", 3)]
    docs = spark.createDataFrame([(*r, "own", "own", "own", "own") for r in rows],
                                 "doc_id long, text string, lang string, n_chars long, source string, _gone string, _text_hash string, gone string")
    left = cp.near_duplicates(spark, docs, SF_DIR)
    assert left.columns == docs.columns
    kept = sorted(((r.doc_id, r.text, r.lang, r.n_chars) for r in left.collect()), key=str)
    # Of the equal texts of 6 the row whose JSON is the lesser one; its NULLs are left out.
    assert kept == sorted([rows[0], rows[1], rows[3], rows[5], rows[9], rows[10]], key=str)
    assert {r._gone for r in left.collect()} == {r._text_hash for r in left.collect()} == {"own"}
    for stage in (cp.decontaminate, cp.secrets):
        assert stage(spark, docs, SF_DIR).columns == docs.columns


def test_decontamination_takes_only_the_rows_that_hold_an_item(spark):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    bad = f"{prose(1, 30)} {item} {prose(2, 30)}"
    rows = rows_of([bad, prose(3, 60), prose(4, 60), None, bad])
    keys = [None, None, 7, None, 7]
    docs = spark.createDataFrame([(k, *row[1:]) for k, row in zip(keys, rows)], SCHEMA)
    left = [(r.doc_id, r.text) for r in cp.decontaminate(spark, docs, SF_DIR).collect()]
    assert sorted(left, key=str) == sorted([(None, rows[1][1]), (7, rows[2][1]), (None, None)], key=str)


def test_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
    assert [name for name, _ in cp.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
