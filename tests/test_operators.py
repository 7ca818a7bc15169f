"""Operators against brute force on small inputs, also with hot keys cut into slices."""

import datetime as dt
import random
from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelens.functions import text as X
from pricelens.operators.components import components
from pricelens.operators.ordered import carry_forward, with_previous
from pricelens.operators.similarity import similar_titles
from pricelens.plans import alerts as AL
from pricelens.plans import rules as RU


def history(spark, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        key = 1 if rnd.random() < 0.5 else rnd.randint(2, 30)
        rows.append((key, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 80)), rnd.choice([None, 1.0, 2.0, 3.0]), rnd.choice(["in_stock", "out_of_stock", None])))
    return spark.createDataFrame(rows, "listing_id bigint, snapshot_id bigint, scraped_at timestamp, price double, availability string").repartition(7)


def test_with_previous_equals_plain_window(spark):
    df = history(spark)
    w = Window.partitionBy("listing_id").orderBy("scraped_at", "snapshot_id")
    plain = {(r["snapshot_id"], r["p"], r["a"]) for r in df.withColumns({"p": F.lag("price").over(w), "a": F.lag("availability").over(w)}).collect()}
    for hot in (3, 20, 10_000):
        got = {(r["snapshot_id"], r["p"], r["a"]) for r in with_previous(df, {"p": "price", "a": "availability"}, hot_rows=hot).collect()}
        assert got == plain


def test_carry_forward_equals_plain_window(spark):
    df = history(spark, 2)
    w = Window.partitionBy("listing_id").orderBy("scraped_at", "snapshot_id").rowsBetween(Window.unboundedPreceding, -1)
    plain = {(r["snapshot_id"], r["p"]) for r in df.withColumn("p", F.last("price", ignorenulls=True).over(w)).collect()}
    for hot in (3, 10_000):
        assert {(r["snapshot_id"], r["p"]) for r in carry_forward(df, {"p": "price"}, hot_rows=hot).collect()} == plain


def test_change_detection_is_idempotent(spark):
    df = history(spark, 3).withColumns({"status": F.lit("ok"), "currency": F.lit("EUR")})
    once = AL.detect_changes(df)
    again = AL.detect_changes(once.select(*df.columns))
    assert {r["snapshot_id"] for r in once.collect()} == {r["snapshot_id"] for r in again.collect()}


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    rows = [(i, f"k{rnd.randint(0, 60)}") for i in range(60) for _ in range(2)] + [(i, "hot") for i in range(100, 140)]
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for r, k in rows:
        parent[find(("k", k))] = find(("r", r))
    groups = {}
    for r, _ in rows:
        groups.setdefault(find(("r", r)), set()).add(r)
    expected = {(r, min(g)) for g in groups.values() for r in g}
    assert {tuple(r) for r in components(spark.createDataFrame(rows, "row_id bigint, key string")).collect()} == expected


def test_similarity_join_equals_all_pairs(spark):
    rnd = random.Random(7)
    words = ["red", "small", "ring", "widget", "gear", "blue", "rod"]
    names = sorted({" ".join(rnd.sample(words, rnd.randint(1, 3))) for _ in range(40)})
    left, right = names[::2], names[1::2]
    frame = lambda xs: spark.createDataFrame([(1, x) for x in xs], "org_id bigint, title string")
    pairs = spark.createDataFrame(list(product(left, right)), "a string, b string").withColumn("s", X.trigram_similarity("a", "b"))
    for threshold in (0.3, 0.5, 0.8):
        expected = {(r["a"], r["b"]) for r in pairs.where(F.col("s") >= threshold).collect()}
        got = {(r["left_title"], r["right_title"]) for r in similar_titles(frame(left), frame(right), threshold).collect()}
        assert got == expected


def test_retention_keeps_newest(spark):
    rows = [(i, "shipment_tracking", "failed", "A" if i < 5 else None, '{"shipmentId":"A"}' if i < 5 else "{}", dt.datetime(2024, 1, i)) for i in range(1, 7)]
    items = spark.createDataFrame(rows, "id bigint, type string, status string, dedupe_key string, payload string, created_at timestamp")
    assert [r["id"] for r in RU.prunable(items, 3).collect()] == [1]
