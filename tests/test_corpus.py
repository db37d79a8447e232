"""Cleaning counts, first-row semantics, splits, files."""
from __future__ import annotations

import json
from types import SimpleNamespace

import pytest
from conftest import values
from pyspark.sql import functions as F

from credlake.config import Settings
from credlake.errors import DataValidationError, SharedFolderError
from credlake.operators import corpus
from credlake.operators.common import checkpoint_dir, first_rows, numbered, paged
from credlake.sources import news_files, registry, store


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, title string, text string, label int")


def test_clean_dataset_five_rows_to_two(spark):
    df = frame(spark, [("A", "same", 1), ("A", "same", 1), ("B", "unique", 0), ("", "   ", 1), ("D", "more", None)])
    assert corpus.clean_dataset(df, ["doc_id"]).count() == 2
    audit = corpus.cleaning_audit(df).first().asDict()
    assert audit == {"n_start": 5, "dropped_missing_label": 1, "dropped_empty": 1, "dropped_duplicates": 1, "n_final": 2}


def test_first_label_wins_on_conflict(spark):
    df = frame(spark, [("", "x", 0), ("", "x", 1), ("", "y", 1), ("", "y", 0)]).orderBy(F.desc("doc_id"))
    assert sorted(values(corpus.clean_dataset(df, ["doc_id"]), "text", "label")) == [("x", 0), ("y", 1)]


def test_everything_dropped_raises(spark):
    with pytest.raises(DataValidationError):
        corpus.clean_dataset(frame(spark, [("", "", 1), ("", "", 0)]), ["doc_id"], check=True)


def test_splits_are_disjoint_and_exact_quotas_hold(spark, tiny_news):
    rows = corpus.clean_dataset(tiny_news, ["doc_id"])
    assert corpus.split_overlap(corpus.with_split(rows)).first()["n_overlap"] == 0
    exact = corpus.with_exact_split(rows, settings=Settings(test_size=0.2, validation_size=0.2))
    counts = {(r["split"], r["label"]): r["count"] for r in exact.groupBy("split", "label").count().collect()}
    assert counts == {("test", 0): 8, ("test", 1): 8, ("validation", 0): 8, ("validation", 1): 8, ("train", 0): 24, ("train", 1): 24}


def test_length_histogram_keeps_every_row(spark, tiny_news):
    rows = corpus.clean_dataset(tiny_news, ["doc_id"])
    bins = corpus.length_histogram(rows)
    assert bins.agg(F.sum("n_rows")).first()[0] == rows.count()
    low, high = bins.agg(F.min("bin"), F.max("bin")).first()
    assert (low, high) == (1, 30)


def test_pages_are_numbered_alike(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "k string, item int")
    got = {(r["k"], r["item"]): r["page"] for r in paged(df, ["k"], "item", 2).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("a", 4): 2, ("b", 9): 0}


def test_first_rows_keep_texts_out_of_the_aggregation(spark, capsys):
    rows = [(i, i % 3, None if i % 4 == 0 else f"text {i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, part int, wide string")
    kept = first_rows(df, [F.md5("wide")], ["id"])
    assert kept.columns == df.columns
    first = {}
    for row in rows:
        first.setdefault(row[2], row)
    assert sorted(tuple(r) for r in kept.collect()) == sorted(first.values())
    kept.explain("formatted")
    plan = capsys.readouterr().out
    assert "SortAggregate" not in plan
    aggregates = [part for part in plan.split("\n\n") if "HashAggregate" in part.split("\n")[0] and "Input" in part]
    assert aggregates and not any("wide" in line for part in aggregates for line in part.split("\n") if line.startswith("Input"))
    two = first_rows(df.where("wide is not null"), ["wide"], ["part", "id"])
    assert sorted(values(two, "part", "id")) == [(0, 3), (1, 1), (2, 2)]
    assert first_rows(df.limit(0), ["wide"], ["id"]).collect() == []


def test_numbers_of_a_hot_and_a_null_key(spark):
    rows = [("hot", i) for i in range(200)] + [(None, i) for i in range(5)] + [("b", 7)]
    got = numbered(spark.createDataFrame(rows, "k string, item int"), ["k"], [F.desc("item")])
    assert got.columns == ["k", "item", "number"]
    assert {(r["k"], r["item"]): r["number"] for r in got.collect()} == {
        (k, i): ({"hot": 199, None: 4, "b": 7}[k] - i) for k, i in rows
    }


def test_a_thousand_files_of_one_header_are_one_scan(spark, tmp_path, capsys):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(40):
        (folder / f"f{i:04}.csv").write_text(f'title,text,label\nt{i},"one\ntwo",1\nu{i},x,0\n')
    (folder / "other.csv").write_text("label,headline\nreal,odd\n")
    rows = news_files.read_news(spark, str(folder))
    rows.explain("formatted")
    assert capsys.readouterr().out.count("\nLocation: ") == 2
    assert rows.count() == 81
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    orders = []
    for cut in (size, "64b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        try:
            orders.append(values(news_files.read_news(spark, str(folder)).orderBy("file", "row_no"), "title", "text"))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert orders[0] == orders[1]
    assert orders[0][:2] == [("t0", "one\ntwo"), ("u0", "x")]


def test_unset_shared_folder_is_an_error():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(SharedFolderError):
        checkpoint_dir(session)


def test_single_file_layout(spark, tmp_path):
    (tmp_path / "news.csv").write_text('Title,Text,Label\nA,"Body, ""quoted""\nsecond line",FAKE\nB,NA,real\n,x,odd\n')
    rows = sorted(values(news_files.read_news(spark, str(tmp_path)), "title", "text", "label"), key=str)
    assert rows == sorted([("A", 'Body, "quoted"\nsecond line', 1), ("B", "", 0), ("", "x", None)], key=str)


def test_paired_layout_and_tsv(spark, tmp_path):
    paired = tmp_path / "paired"
    paired.mkdir()
    (paired / "FAKE.csv").write_text("title,text\nF1,Fake body one.\nF2,Fake body two.\n")
    (paired / "True.csv").write_text("headline,article\nT1,Real body one.\n")
    rows = values(news_files.read_news(spark, str(paired)), "title", "label")
    assert sorted(rows) == [("F1", 1), ("F2", 1), ("T1", 0)]
    many = tmp_path / "many"
    many.mkdir()
    (many / "a.tsv").write_text("News Title\tclass\nx\t1\n")
    (many / "b.csv").write_text("body,news-type\ny,reliable\n")
    rows = values(news_files.read_news(spark, str(many)), "title", "text", "label")
    assert sorted(rows) == [("", "y", 0), ("x", "", 1)]


def test_layout_errors(spark, tmp_path):
    with pytest.raises(DataValidationError):
        news_files.read_news(spark, str(tmp_path / "missing"))
    with pytest.raises(DataValidationError):
        news_files.read_news(spark, str(tmp_path))
    (tmp_path / "weird.csv").write_text("foo,bar\n1,2\n")
    with pytest.raises(DataValidationError):
        news_files.read_news(spark, str(tmp_path))
    (tmp_path / "weird.csv").write_text("label,bar\n1,2\n")
    with pytest.raises(DataValidationError):
        news_files.read_news(spark, str(tmp_path))


def test_six_way_truth_labels(spark, tmp_path):
    lines = [f"{i}\t{label}\tclaim {i}" + "\t" * 11 for i, label in enumerate(["pants-fire", "false", "barely-true", "half-true", "mostly-true", "true"])]
    (tmp_path / "t.tsv").write_text("\n".join(lines) + "\n")
    rows = sorted(values(news_files.read_truth_labels(spark, str(tmp_path / "t.tsv")), "text", "label"))
    assert [label for _, label in rows] == [1, 1, 1, 0, 0, 0]


def test_registry_scan(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"news_sources": [{"name": "N", "url": "n.org", "language": "fr"}, {"name": "M", "url": "m.org"}]}))
    rows = sorted(values(registry.read_registry(spark, str(path)), "list_kind", "seq", "name", "source_url", "language"))
    assert rows == [("news", 0, "N", "n.org", "fr"), ("news", 1, "M", "m.org", None)]
    assert registry.read_registry(spark, str(tmp_path / "none.json")).count() == 0


def test_csv_and_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ' say "hi",\nthere ', 1)], "title string, text string, label int")
    store.write_csv(df, str(tmp_path / "out"))
    assert values(news_files.read_single(spark, str(tmp_path / "out")), "text") == [(' say "hi",\nthere ',)]
    claims = spark.createDataFrame([(1, "r1", "t"), (2, "r2", "u")], "claim_id long, request_id string, text string")
    store.append_table(claims, str(tmp_path / "db"), "claims")
    store.append_table(claims.limit(0), str(tmp_path / "db"), "claims")
    stored = store.read_table(spark, str(tmp_path / "db"), "claims").filter("request_id = 'r2'")
    assert values(stored, "claim_id", "text", "category") == [("2", "u", None)]
    store.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
