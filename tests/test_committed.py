"""The store of results: commits, look-ups, copy-on-write deletes."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from credlake.errors import DataValidationError
from credlake.plans.verification import Verification
from credlake.sources import committed
from conftest import values


@pytest.fixture()
def store(spark, tmp_path):
    root = str(tmp_path / "a store")
    claims = spark.range(300).select(
        F.col("id").alias("claim_id"), F.expr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END").alias("request_id"), F.lit("t").alias("text")
    )
    verdicts = spark.range(300).select(F.col("id").alias("request_id"), F.lit("true").alias("verdict"))
    assert committed.commit(spark, root, "first", {"claims": claims, "verdicts": verdicts}, buckets=4)
    return root, claims, verdicts


def files(spark, root):
    return set(values(committed.live_files(spark, root), "table", "file"))


def test_repeated_commit_adds_nothing(spark, store):
    root, claims, verdicts = store
    before = files(spark, root)
    assert not committed.commit(spark, root, "first", {"claims": claims, "verdicts": verdicts}, buckets=4)
    assert files(spark, root) == before
    assert committed.read_table(spark, root, "claims").count() == 300


def test_rows_without_a_commit_are_not_read_and_a_retry_replaces_them(spark, store):
    root, claims, _ = store
    committed._write(claims.limit(7), root, "claims", "second", 2)  # a run that ended before its commit
    assert committed.read_table(spark, root, "claims").count() == 300
    assert committed.commit(spark, root, "second", {"claims": claims.limit(5)}, buckets=2)
    assert committed.read_table(spark, root, "claims").count() == 305


def test_lookup_opens_one_bucket_and_pushes_the_id(spark, store, capsys):
    root, claims, _ = store
    found = committed.read_result(spark, root, 0)
    assert sorted(int(c) for (c,) in values(found["claims"], "claim_id")) == list(range(0, 300, 3))
    assert values(found["verdicts"], "request_id") == [("0",)]
    assert found["media_items"].collect() == []
    opened = {p.split("bucket=")[1].split("/")[0] for p in found["claims"].inputFiles()}
    assert len(opened) == 1 and len(found["verdicts"].inputFiles()) < len([f for t, f in files(spark, root) if t == "verdicts"])
    found["claims"].explain("formatted")
    assert "PushedFilters: [IsNotNull(request_id), EqualTo(request_id,0)]" in capsys.readouterr().out


def test_delete_rewrites_touched_files_only(spark, store):
    root, claims, verdicts = store
    before = files(spark, root)
    ids = spark.createDataFrame([(1,), (1,), (None,), (5000,)], "request_id long")
    held = committed.read_table(spark, root, "claims").where("request_id = '1'").select("_metadata.file_path").distinct()
    (touched,) = [p.rsplit("/", 1)[1] for (p,) in values(held, "file_path")]
    assert committed.delete_requests(spark, root, "out", ids, buckets=4)
    after = files(spark, root)
    assert [f.rsplit("/", 1)[1] for t, f in before - after if t == "claims"] == [touched]
    assert len(before - after) == 2
    for name, rows in (("claims", claims), ("verdicts", verdicts)):
        left = committed.read_table(spark, root, name).select("request_id")
        expected = rows.where("request_id <> 1").select(F.col("request_id").cast("string"))
        assert left.exceptAll(expected).isEmpty() and expected.exceptAll(left).isEmpty()
    assert not committed.delete_requests(spark, root, "out", ids, buckets=4)
    assert files(spark, root) == after


def test_delete_of_all_rows_and_of_none(spark, store):
    root, claims, _ = store
    before = files(spark, root)
    assert committed.delete_requests(spark, root, "none", claims.select("request_id").limit(0))
    assert files(spark, root) == before
    assert committed.delete_requests(spark, root, "all", spark.range(300).select(F.col("id").alias("request_id")))
    assert files(spark, root) == set()
    assert committed.read_table(spark, root, "verdicts").collect() == []


def test_empty_tables_null_requests_and_names(spark, tmp_path):
    root = str(tmp_path / "s")
    assert committed.read_table(spark, root, "claims").collect() == []
    empty = spark.createDataFrame([], "claim_id long, request_id long, bucket string")
    assert committed.commit(spark, root, "empty", {"claims": empty})
    assert not committed.commit(spark, root, "empty", {"claims": empty})
    rows = spark.createDataFrame([(1, None, "x")], "claim_id long, request_id long, run string")
    assert committed.commit(spark, root, "nulls", {"claims": rows})
    assert values(committed.read_table(spark, root, "claims"), "claim_id", "request_id") == [("1", None)]
    with pytest.raises(DataValidationError):
        committed.commit(spark, root, "a/b", {})


def test_verification_is_saved_once(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = spark.createDataFrame([(1, 9, "v")], "claim_id long, request_id long, verdict string")
    run = Verification(claims=rows, sources=rows, evidence=rows, fact_checks=rows.limit(0), verdicts=rows)
    assert run.save(root, "run-1") and not run.save(root, "run-1")
    stored = committed.read_result(spark, root, 9)
    assert {name: df.count() for name, df in stored.items() if name in ("claims", "fact_checks", "verdicts")} == {"claims": 1, "fact_checks": 0, "verdicts": 1}
