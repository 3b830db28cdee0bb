"""Pinned shards, caches and feeds that are stopped and run again."""

import random

import pytest
from pyspark.sql import functions as F

from factmill.operators import mixture
from factmill.session import shared_folder
from factmill.sources import cache_build, files, shards
from factmill.streaming import feed, incremental, reservoir
from factmill.streaming.ledger import Ledger


@pytest.fixture
def folder(spark, tmp_path):
    shared_folder(spark)
    return str(tmp_path)


def written(spark, folder, n=100, files=5):
    spark.range(n).withColumn("x", F.col("id") * 2).repartitionByRange(files, "id").sortWithinPartitions("id").write.parquet(f"{folder}/shards")
    return shards.pin(spark, f"{folder}/shards")


def test_shards(spark, folder):
    pins = written(spark, folder)
    assert shards.write_pins(pins, f"{folder}/pins") == 5
    pins = shards.read_pins(spark, f"{folder}/pins")
    spark.range(7).withColumn("x", F.lit(-1).cast("long")).coalesce(1).write.mode("append").parquet(f"{folder}/shards")
    rows = shards.read_pinned(spark, f"{folder}/shards", pins)
    assert sorted((r["id"], r["source_row_index"]) for r in rows.collect()) == [(i, i) for i in range(100)]
    # the scan opens the pinned files only
    scans = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in line]
    assert len(rows.inputFiles()) == 5 + 1 and any("InMemoryFileIndex(5 paths)" in line for line in scans)  # and the one with the pins' starts


@pytest.mark.parametrize("change", ["missing", "other size", "other rows", "twice", "none"])
def test_shards_that_differ(spark, folder, change):
    pins = written(spark, folder)
    listed = pins.collect()
    if change == "missing":
        listed.append(("part-x.parquet", 5, 5))
    elif change == "other size":
        listed[0] = (listed[0]["name"], listed[0]["size"] + 1, listed[0]["rows"])
    elif change == "other rows":
        listed[0] = (listed[0]["name"], listed[0]["size"], listed[0]["rows"] - 1)
    elif change == "twice":
        listed.append(listed[0])
    else:
        listed = []
    changed = spark.createDataFrame(listed, shards.PINS)
    with pytest.raises(FileNotFoundError if change == "missing" else ValueError):
        shards.read_pinned(spark, f"{folder}/shards", changed)


BOX = "array<struct<x:double,y:double,w:double,h:double>>"
SOURCE = f"id string, image_hash string, width int, height int, query string, label string, type string, grounding_bboxes {BOX}, response string"
GOOD = [(1.0, 2.0, 30.0, 40.0)]
CASES = [
    ("a", "h1", 100, 100, "Q?", "5", "Human", [*GOOD, (200.0, 0.0, 5.0, 5.0)], None),  # a box off the canvas is left out
    ("b", None, None, None, "Q?", "5", "human", GOOD, None),
    ("c", "h2", 100, 100, "Q?", "5", "table", GOOD, None),
    ("d", "h3", 100, 100, "Q?", "5", None, GOOD, None),
    ("e", "h4", 100, 100, "Q?", "5", "pot", [(1.0, 2.0, -1.0, 4.0)], None),
    ("f", "h5", 100, 100, "Q?", "5", "pot", [(1.0, None, 1.0, 4.0)], None),
    ("g", "h6", 0, 100, "Q?", "5", "pot", GOOD, None),
    ("h", "h7", 100, 100, "Q?", "5", "pot", None, None),
    ("i", "h8", 0, 100, "Q?", "5", "pot", [], None),
    ("j", "h9", 100, 100, "Q?", "5", "pot", [(1.0, 1.0, 0.0, 4.0)], None),
    ("k", "gone", 100, 100, "Q?", "5", "pot", GOOD, None),
    (None, "h10", 100, 100, None, None, "machine", GOOD, "r"),
]
OUTCOMES = ["accepted", "missing_image", "malformed", "malformed", "malformed", "malformed", "malformed", "no_usable_box", "no_usable_box", "no_usable_box", "held_out_image", "accepted"]


def test_outcomes_and_records(spark):
    rows = spark.createDataFrame(CASES, SOURCE).withColumn("source_row_index", F.monotonically_increasing_id())
    held = spark.createDataFrame([("gone",), ("gone",), (None,)], "image_hash string")
    seen = cache_build.with_outcome(rows, held.where("image_hash IS NOT NULL").distinct())
    got = {r["image_hash"] or r["id"]: r["outcome"] for r in seen.collect()}
    assert got == {c[1] or c[0]: o for c, o in zip(CASES, OUTCOMES, strict=True)}
    first, last = seen.where("outcome = 'accepted'").select(*cache_build.record("img", "s", "train")).orderBy("source_row_index").collect()
    assert first["boxes"] == [[10.0, 20.0, 310.0, 420.0]] and first["evidence"] == [0] and first["meta"]["boxes_dropped_outside_image"] == 1 and first["question_kind"] == "human"
    assert first["elements"][0]["bbox"] == first["boxes"][0] and first["elements"][0]["grounding_provenance"] == "gold"
    assert last["question"] == "None" and last["answer"] is None and last["source_id"] is None and last["image_path"].endswith("_no-id.png") and last["image_path"].startswith("img/")


def test_cache_stopped_anywhere(spark, folder, monkeypatch):
    """A build that is stopped before an entry, behind one, and half-way, ends like one that isn't."""
    random.seed(1)
    rows = [random.choice(CASES) for _ in range(60)]
    source = spark.createDataFrame([(f"{i:03d}", *r[1:]) for i, r in enumerate(rows)], SOURCE)
    source.repartitionByRange(6, "id").sortWithinPartitions("id").write.parquet(f"{folder}/shards")
    pins = shards.pin(spark, f"{folder}/shards")
    held = spark.createDataFrame([("gone",)], "image_hash string")
    build = lambda to: cache_build.build(shards.stream_pinned(spark, f"{folder}/shards", pins, 2), held, f"{folder}/{to}")
    build("whole")
    add = Ledger.add
    stops = {0: "before", 1: "behind"}

    def stopped(self, batch, counts):
        stop = stops.pop(batch, None)
        if stop != "before":
            add(self, batch, counts)
        if stop:
            raise RuntimeError("stopped")

    monkeypatch.setattr(Ledger, "add", stopped)
    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            build("parts")
        assert cache_build.outcomes(spark, f"{folder}/parts").count() in (0, 5)
    build("parts")
    build("parts")
    shown = lambda to: sorted(map(str, cache_build.records(spark, f"{folder}/{to}").drop("batch").collect()))
    assert shown("parts") == shown("whole") and len(shown("whole")) == sum(r[1] in ("h1", "h10") for r in rows)
    counts = {r["outcome"]: r["n"] for r in cache_build.outcomes(spark, f"{folder}/parts").collect()}
    expected = [OUTCOMES[CASES.index(r)] for r in rows]
    assert counts == {o: expected.count(o) for o in set(expected)}
    assert {r["outcome"]: r["n"] for r in cache_build.outcomes(spark, f"{folder}/whole").collect()} == counts


def by_hand(n, seed, places, shuffle=True):
    """The row at each place."""
    out = []
    for place in places:
        epoch, x = divmod(place, n)
        for pivot, a, b in feed.round_keys(n, seed, epoch) if shuffle else ():
            mirror = (pivot + n - x) % n
            chosen = (max(x, mirror) + a) % (2**31 - 1)
            if (chosen * chosen + b) % (2**31 - 1) >> 10 & 1:
                x = mirror
        out.append(x)
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_every_epoch_is_an_order_of_all_rows(spark, n):
    places = spark.range(3 * n).select((F.col("id") % n).alias("position"), F.floor(F.col("id") / n).cast("long").alias("epoch"), "id")
    got = [r["row"] for r in places.select(feed.row_at(F.col("position"), F.col("epoch"), n, 5, range(3)).alias("row"), "id").orderBy("id").collect()]
    assert got == by_hand(n, 5, range(3 * n))
    epochs = [got[i * n : i * n + n] for i in range(3)]
    assert all(sorted(e) == list(range(n)) for e in epochs)
    if n == 1000:
        assert epochs[0] != epochs[1] and sum(abs(a - b) for a, b in zip(epochs[0][1:], epochs[0][:-1], strict=True)) / n > 250  # a third of n on average


@pytest.mark.parametrize("shuffle", [True, False])
def test_feed_stopped_and_resumed(spark, folder, monkeypatch, shuffle):
    n, size, seed = 50, 30, 3
    rows = spark.range(n).withColumnRenamed("id", "row").withColumn("target", F.when(F.col("row") % 4 != 0, F.col("row")))
    usable = F.col("target") > 2
    go = lambda to, until: feed.run(rows, usable, f"{folder}/{to}", size, until, seed, shuffle)
    go("whole", 4)
    assert feed.state(spark, f"{folder}/none") == {"epoch": 0, "position": 0, "refused": 0}
    add, stops = Ledger.add, [1, 2]

    def stopped(self, batch, counts):
        if batch == 2 and 2 in stops:
            add(self, batch, counts)
        if batch in stops:
            stops.remove(batch)
            raise RuntimeError("stopped")
        add(self, batch, counts)

    monkeypatch.setattr(Ledger, "add", stopped)
    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            go("parts", 4)
    go("parts", 4)
    ok = lambda x: x is not None and x % 4 != 0 and x > 2
    fed = by_hand(n, seed, range(4 * size), shuffle)
    want = [(place, x) for place, x in enumerate(fed) if ok(x)]
    for to in ("whole", "parts"):
        got = feed.training_batches(spark, f"{folder}/{to}", 8).where("batch < 4").orderBy("place").collect()
        assert [(r["place"], r["row"]) for r in got] == want
        assert [r["number"] for r in got] == [i // 8 for i in range(len(want))]
        assert all(r["epoch"] == r["place"] // n and r["position"] == r["place"] % n for r in got)
        batches = Ledger(spark, f"{folder}/{to}").entries().count()
        state = feed.state(spark, f"{folder}/{to}")
        assert (state["epoch"], state["position"]) == divmod(batches * size, n)
        assert state["refused"] == sum(not ok(x) for x in by_hand(n, seed, range(batches * size), shuffle))
    with pytest.raises(ValueError, match="begun with"):
        feed.run(rows, usable, f"{folder}/parts", size, 5, seed + 1, shuffle)
    with pytest.raises(ValueError):
        feed.run(rows.where("false"), usable, f"{folder}/empty", size, 1, seed)


def test_feed_sorts_nothing(spark):
    rows = spark.range(100).withColumnRenamed("id", "row")
    places = feed._places(spark.range(40).withColumnRenamed("id", "value"), 100, 1, True)
    for side in (F.broadcast(places), places.hint("shuffle_hash")):
        assert "Sort" not in rows.join(side, "row")._jdf.queryExecution().executedPlan().toString()


def test_manifests(spark, folder, monkeypatch):
    """Counts are those of the rows; a manifest that was stopped before its summary isn't there, and is written again."""
    rows = spark.createDataFrame([(i, ["L1", "L2", None, "odd"][i % 4]) for i in range(10)], "i int, level string")
    write = lambda: files.write_manifest(rows, f"{folder}/m", 7, {"level": ("L1", "L2", "L3")})
    with monkeypatch.context() as m:
        m.setattr(Ledger, "add", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            write()
    with pytest.raises(FileNotFoundError):
        files.manifest_examples(spark, f"{folder}/m")
    for _ in range(2):
        write()
        assert files.manifest_examples(spark, f"{folder}/m").count() == 10
        got = {(r["name"], r["value"]): r["n"] for r in files.manifest_histograms(spark, f"{folder}/m").collect()}
        assert got == {("level", "L1"): 3, ("level", "L2"): 3, ("level", "null"): 2, ("level", "other"): 2}
    assert {r["name"]: r["n"] for r in Ledger(spark, f"{folder}/m").totals().collect()}["generation_seed"] == 7


def test_metrics(spark, folder):
    for step, loss in ((5, 2.0), (10, None), (5, 1.0)):
        files.log_metrics(spark.createDataFrame([(loss,)], "loss double"), f"{folder}/log", step)
    assert sorted((r["step"], r["loss"]) for r in files.read_metrics(spark, f"{folder}/log", "loss double").collect()) == [(5, 1.0), (10, None)]


def test_reservoirs(spark, folder, monkeypatch):
    """The sample of a stream is that of a table, whatever the batches and wherever it was stopped."""
    rows = spark.createDataFrame([(i, ["a", "b", None][i % 7 % 3]) for i in range(300)], "i long, kind string")
    want = sorted(map(tuple, mixture.sample_per_kind(rows, "kind", 9, 5, "i").collect()), key=str)
    rows.repartition(6).write.parquet(f"{folder}/rows")
    add, stops = Ledger.add, {1: "before", 3: "behind"}

    def stopped(self, batch, counts):
        stop = stops.pop(batch, None)
        if stop != "before":
            add(self, batch, counts)
        if stop:
            raise RuntimeError("stopped")

    for each in (1, 4, 10):
        take = lambda: reservoir.sample_stream(incremental.stream(spark, f"{folder}/rows", rows.schema, each), "kind", 9, 5, "i", f"{folder}/by{each}")  # noqa: B023, E731
        if each == 1:
            monkeypatch.setattr(Ledger, "add", stopped)
            for _ in range(2):
                with pytest.raises(Exception, match="stopped"):
                    take()
        assert {r["name"]: r["n"] for r in take().totals().collect()} == {"seen": 300}
        assert sorted(map(tuple, reservoir.sample(spark, f"{folder}/by{each}").collect()), key=str) == want
