"""Typed objects in bundles, the ledger of noisy releases, and the side that an asset faces."""

import json

import pytest
from pyspark.sql import functions as F

from wardline.functions import is_private
from wardline.operators import behaviour, privacy, risk
from wardline.session import shared_dir


def test_nested_and_typed_properties_survive_a_round_trip(spark):
    objects = spark.createDataFrame(
        [
            (1, 1, "ip", 7, 0.5, True, ("x", [1, 2]), "a \"b\" {c}"), (1, 2, "url", None, None, None, None, None),
            (1, 3, None, 2**40, 1e-9, False, (None, []), ""),
        ],
        "k long, o long, kind string, n long, score double, flag boolean, nested struct<name:string,list:array<int>>, type_text string",
    )
    props = ["n", "score", "flag", "nested", "type_text"]
    bundles = behaviour.build_bundle(objects, "k", "kind", "o", props, F.col("o"), max_objects=2)
    assert [len(json.loads(r.bundle)["objects"]) for r in bundles.orderBy("part").collect()] == [2, 1]
    get = lambda path, kind: F.variant_get("props", path, kind)
    back = behaviour.flatten_bundle(bundles).select(
        F.col("id").cast("long").alias("o"), F.col("type").alias("kind"), get("$.n", "long").alias("n"), get("$.score", "double").alias("score"),
        get("$.flag", "boolean").alias("flag"), get("$.nested", "struct<name:string,list:array<int>>").alias("nested"),
        get("$.type_text", "string").alias("type_text"), get("$.nested.list[1]", "int").alias("second"),
    )
    assert sorted(map(str, back.drop("second").collect())) == sorted(map(str, objects.drop("k").select(*back.drop("second").columns).collect()))
    assert {r.o: r.second for r in back.collect()} == {1: 2, 2: None, 3: None}


def test_texts_that_are_no_bundle_give_no_rows(spark):
    texts = ["{", "", None, "[]", '{"id": "b"}', '{"id": "b", "objects": []}', '{"id": "c", "objects": [{"x": 1}]}']
    df = spark.createDataFrame([(t,) for t in texts], "bundle string")
    flat = behaviour.flatten_bundle(df)
    assert [(r.bundle_id, r.type, r.id) for r in flat.select("bundle_id", "type", "id").collect()] == [("c", None, None)]
    assert [tuple(r) for r in behaviour.bundle_types(flat).collect()] == [(None, 1, "OBJECT<x: BIGINT>")]


def release(spark, name, epsilon, ledger, dataset="people", budget=1.0):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "s int, k int")
    return privacy.dp_release(df, "s", ["k"], epsilon, "secret", name, ledger, dataset, budget)


def test_the_last_release_is_refused(spark):
    ledger = shared_dir(spark, "ledger")
    # Ten times a tenth are the budget, not a little more.
    for i in range(10):
        assert release(spark, f"r{i}", 0.1, ledger).count() == 2
    with pytest.raises(privacy.BudgetSpent):
        release(spark, "r10", 0.1, ledger)
    # Another dataset has a budget of its own.
    assert release(spark, "r0", 1.0, ledger, "hosts").count() == 2
    spent = {r.dataset: (r.spent, r.n_releases) for r in privacy.dp_spent(spark, ledger).collect()}
    assert spent == {"people": (1.0, 10), "hosts": (1.0, 1)}


def test_a_refusal_spends_nothing_and_a_name_counts_once(spark):
    ledger = shared_dir(spark, "ledger")
    with pytest.raises(privacy.BudgetSpent):
        release(spark, "large", 1.5, ledger)
    first = {tuple(r) for r in release(spark, "one", 0.5, ledger).collect()}
    with pytest.raises(privacy.BudgetSpent):
        release(spark, "one", 0.25, ledger)
    second = {tuple(r) for r in release(spark, "two", 0.5, ledger).collect()}
    assert first != second
    with pytest.raises(ValueError):
        release(spark, "none", 0.0, ledger)
    assert privacy.dp_spent(spark, ledger).first().spent == 1.0


@pytest.mark.parametrize(
    "ip, side",
    [
        ("9.255.255.255", "external"), ("10.0.0.0", "internal"), ("10.255.255.255", "internal"), ("11.0.0.0", "external"),
        ("127.0.0.1", "internal"), ("169.254.0.1", "internal"), ("172.15.255.255", "external"), ("172.16.0.0", "internal"),
        ("172.31.255.255", "internal"), ("172.32.0.0", "external"), ("192.168.1.1", "internal"), ("192.169.0.0", "external"),
        ("10.0.0.256", "unknown"), ("host", "unknown"), (None, "unknown"),
    ],
)
def test_sides_of_addresses(spark, ip, side):
    df = spark.createDataFrame([(ip,)], "ip string")
    got = df.select(risk.surface_side(F.col("ip")).alias("side"), is_private(F.col("ip")).alias("private")).first()
    assert got.side == side and got.private == {"internal": True, "external": False, "unknown": None}[side]
