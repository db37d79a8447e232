"""Sharded learners against plain Python."""
from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from credlake.operators import linear, shards
from credlake.operators.shards import Config
from credlake.plans import training
from credlake.config import Settings

SIZE = 12
SCHEMA = "idx array<int>, val array<double>, label int, fold int"


def sparse_rows(n=300):
    rng = np.random.default_rng(7)
    truth, rows = rng.normal(size=SIZE), []
    for _ in range(n):
        at = np.sort(rng.choice(SIZE, rng.integers(0, 6), replace=False))
        value = rng.random(len(at))
        label = int(truth[at] @ value + rng.normal(scale=0.5) > 0.3)
        rows.append((at.tolist(), value.tolist(), label, int(rng.integers(0, 3))))
    return rows


ROWS = sparse_rows()


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def dense(config):
    kept = [r for r in ROWS if r[3] != config.fold]
    x = np.zeros((len(kept), SIZE + 1))
    for k, (at, value, *_) in enumerate(kept):
        x[k, at] = value
    x[:, -1] = 1.0
    label = np.array([r[2] for r in kept])
    s = np.full(len(kept), config.C)
    if config.class_weight == "balanced":
        s *= np.where(label == 1, len(kept) / (2 * label.sum()), len(kept) / (2 * (1 - label).sum()))
    return x, np.where(label == 1, 1.0, -1.0), s


@pytest.mark.parametrize("loss", ["squared_hinge", "logistic"])
def test_no_gradient_component_is_left(train, monkeypatch, loss):
    monkeypatch.setattr(shards, "ROWS_A_SHARD", 40)
    configs = [Config(1.0), Config(0.1, "balanced"), Config(10.0, None, 1), Config(1.0, "balanced", 2)]
    for config, w in zip(configs, shards.fit_smooth(shards.sharded(train, SIZE), loss, configs)):
        x, y, s = dense(config)
        margin = y * (x @ w)
        slope = -2 * s * np.maximum(0, 1 - margin) if loss == "squared_hinge" else -s / (1 + np.exp(margin))
        penalty = np.append(np.ones(SIZE), loss == "squared_hinge")
        assert np.abs(x.T @ (slope * y) + penalty * w).max() < 1e-4


def test_jobs_do_not_grow_with_the_grid(train, monkeypatch):
    passes = []
    run = shards._pass
    monkeypatch.setattr(shards, "_pass", lambda *a: passes.append(len(a[1])) or run(*a))
    packed = shards.sharded(train, SIZE)
    alone = []
    configs = [Config(c, None, fold) for c in (0.1, 1.0) for fold in (0, 1)]
    for config in configs:
        passes.clear()
        shards.fit_smooth(packed, "squared_hinge", [config])
        alone.append(len(passes))
    passes.clear()
    shards.fit_smooth(packed, "squared_hinge", configs)
    assert len(passes) == max(alone) and max(passes) == len(configs)


def test_passive_aggressive_does_not_depend_on_partitions(train, monkeypatch):
    monkeypatch.setattr(shards, "ROWS_A_SHARD", 40)
    configs = [Config(0.1), Config(1.0, None, 1)]
    found = [
        shards.fit_passive_aggressive(shards.sharded(train.repartition(n), SIZE), configs, 4, 1e-3, 5, 42)
        for n in (1, 4, 16)
    ]
    for other in found[1:]:
        assert all((a == b).all() for a, b in zip(found[0], other))


def test_one_shard_equals_a_plain_loop(train):
    packed = shards.sharded(train, SIZE)
    assert packed.table.count() == 1
    rows = packed.table.first()["rows"]
    config = Config(0.5, None, 2)
    w = np.zeros(SIZE + 1)
    for epoch in range(3):
        seen = 0
        for r in np.random.default_rng([42, epoch, 0]).permutation(len(rows)):
            row = rows[int(r)]
            if row["fold"] != 2:
                seen += 1
                x = np.zeros(SIZE + 1)
                x[row["idx"]] = row["val"]
                x[-1] = 1.0
                y = 1.0 if row["label"] == 1 else -1.0
                w = w + y * min(0.5, max(0.0, 1 - y * float(w @ x)) / float(x @ x)) * x
    got = shards.fit_passive_aggressive(packed, [config], 3, 0.0, 5, 42)[0]
    assert np.abs(got - w).max() < 1e-9


def test_search_over_smooth_models(train):
    space = SimpleNamespace(size=SIZE)
    settings = Settings(cv_folds=3)
    for name in ("LogisticRegression", "LinearSVC"):
        sets = [{"C": 1e-4, "class_weight": None}, {"C": 1.0, "class_weight": None}, {"C": 1.0, "class_weight": "balanced"}]
        models = linear.fit_smooth_folds(name, train, space, sets, 3)
        assert set(models) == {(fold, n) for fold in range(3) for n in range(3)}
        assert training.tune(name, train, space, sets, settings) in sets[1:]


def test_an_empty_training_table(train):
    packed = shards.sharded(train.limit(0), SIZE)
    assert not shards.fit_smooth(packed, "squared_hinge", [Config()])[0].any()
    assert not shards.fit_passive_aggressive(packed, [Config()], 5, 1e-3, 5, 1)[0].any()


def test_rows_of_a_key_are_numbered_across_ranges(spark):
    from credlake.operators.common import numbered

    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.pmod(F.col("id") * 7919, F.lit(1000)).alias("v"))
    rows = sorted((r["k"], r["number"], r["v"]) for r in numbered(df, ["k"], [F.col("v")]).collect())
    for k in (0, 1):
        mine = [r for r in rows if r[0] == k]
        assert [r[1] for r in mine] == list(range(len(mine))) and [r[2] for r in mine] == sorted(r[2] for r in mine)


@pytest.mark.parametrize("loss", ["squared_hinge", "logistic"])
def test_sums_of_shards_in_several_tasks(train, spark, monkeypatch, loss):
    """Each task's shards come in a bucket of their own; buckets of a model are summed, not chosen from."""
    monkeypatch.setattr(shards, "ROWS_A_SHARD", 40)
    dealt = shards.sharded(train, SIZE)
    assert dealt.packed.count() == 8
    dealt.packed = dealt.packed.repartitionByRange(8, "shard")
    assert dealt.packed.select(F.spark_partition_id()).distinct().count() > 1
    w = shards.fit_smooth(dealt, loss, [Config(1.0)])[0]
    x, y, s = dense(Config(1.0))
    margin = y * (x @ w)
    slope = -2 * s * np.maximum(0, 1 - margin) if loss == "squared_hinge" else -s / (1 + np.exp(margin))
    assert np.abs(x.T @ (slope * y) + np.append(np.ones(SIZE), loss == "squared_hinge") * w).max() < 1e-4


def test_a_pass_reads_bytes(train):
    """A pass reads flat columns, so Spark takes no nested array apart."""
    packed = shards.sharded(train, SIZE).packed
    assert {f.dataType.simpleString() for f in packed.schema} == {"bigint", "binary"}


def test_hessian_products_leave_out_rows_without_curvature(spark, monkeypatch):
    """A single model's products read only rows that add to them, and come to the same weights."""
    rng, rows = np.random.default_rng(7), []
    for k in range(200):
        rows.append(([1 - k % 2, *np.sort(rng.choice(np.arange(2, SIZE), 3, replace=False)).tolist()], [0.1 + 3 * rng.random(), *rng.random(3).tolist()], k % 2, 0))
    monkeypatch.setattr(shards, "ROWS_A_SHARD", 40)
    dealt = shards.sharded(spark.createDataFrame(rows, SCHEMA), SIZE)
    whole = shards.fit_smooth(dealt, "squared_hinge", [Config()])[0]
    monkeypatch.setattr(shards, "NARROW_ROWS", 1)
    seen, run = {}, shards._pass

    def watched(read, asked, answer):
        kind, w, _ = asked[0]
        if kind == "hessian" and w.tobytes() not in seen:
            seen[w.tobytes()] = sum(len(r["label"]) // 4 for r in read.packed.select("label").collect())
        return run(read, asked, answer)

    monkeypatch.setattr(shards, "_pass", watched)
    narrow = shards.fit_smooth(dealt, "squared_hinge", [Config()])[0]
    assert np.abs(narrow - whole).max() < 1e-9
    x = np.zeros((len(rows), SIZE + 1))
    for k, (at, value, *_) in enumerate(rows):
        x[k, at] = value
    x[:, -1] = 1.0
    y = np.array([1.0 if r[2] == 1 else -1.0 for r in rows])
    for w, n_rows in seen.items():
        curved = int((y * (x @ np.frombuffer(w)) < 1).sum())
        assert n_rows == (curved if curved <= len(rows) / 2 else len(rows))
    assert min(seen.values()) < len(rows) / 2
    margin = y * (x @ narrow)
    assert np.abs(narrow - 2 * x.T @ (y * np.maximum(0, 1 - margin))).max() < 1e-4


@pytest.mark.parametrize("many", [1, 512])
def test_vectors_of_few_shards_are_dealt_once(train, spark, monkeypatch, many):
    """Sums by bucket come first only where there are many shards; both ways give the same sums."""
    monkeypatch.setattr(shards, "ROWS_A_SHARD", 40)
    monkeypatch.setattr(shards, "MANY_SHARDS", many)
    dealt = shards.sharded(train, SIZE)
    assert len(dealt.packed.inputFiles()) == 8
    dealt.packed = dealt.packed.repartitionByRange(8, "shard")
    deals, repartition = [], type(train).repartition
    monkeypatch.setattr(type(train), "repartition", lambda df, *keys: deals.append(keys) or repartition(df, *keys))
    request = ("value", np.zeros(SIZE + 1), None)
    got = shards._pass(dealt, {0: request}, lambda shard, m, r: shards._loss(shard, "squared_hinge", Config(), (1.0, 1.0), r, SIZE))[0]
    x, y, _ = dense(Config())
    assert np.abs(got - np.append(-2 * x.T @ y, [len(y), len(y)])).max() < 1e-9
    assert len(deals) == (2 if many == 1 else 1)
