import json
import random
import threading

import pytest

from objectlake.operators import changelog, ids
from objectlake.schema import LOG, OBJECT, ClassExists, Config, ClassNotEmpty, InvalidName, InvalidRequest, NoClass, NotFound
from objectlake.sources.generations import Generations
from objectlake.store import ObjectStore
from objectlake.streaming.apply import apply_stream

BOATS = [("Grey Heron", "NO", 9.5), ("Small Tern", "DK", 7.0), ("Heron's Rest", "no", 12.0), ("Ternary", "SE", 9.5), ("Plover", "NO", 6.25)]


def put(tx, class_, id_, data, op="put", sub=None):
    return (tx, op, "", class_, id_, data, 0, sub)


def test_lifecycle(spark, tmp_path):
    root = str(tmp_path / "s")
    s = ObjectStore(spark, root)
    s.create_class("boat")
    s.create_class("boat", "yard")
    assert s.create_bulk("boat", json.dumps([{"name": n, "flag": f, "metres": m} for n, f, m in BOATS])) == [1, 2, 3, 4, 5]
    assert s.create("boat", '{"name":"raft","id":99}', "yard") == {"id": 1, "name": "raft"}

    def expected(test):
        return [i for i, boat in enumerate(BOATS, 1) if test(*boat)]

    filters = [
        ({"eq.flag": "no"}, lambda n, f, m: f.lower() == "no"), ({"eq.flag": "no", "ci": "0"}, lambda n, f, m: f == "no"), ({"eq.metres": "9.5"}, lambda n, f, m: m == 9.5), ({"eq.metres": "12"}, lambda n, f, m: m == 12),
        ({"like.name": "%tern%"}, lambda n, f, m: "tern" in n.lower()), ({"like.name": "%Tern", "ci": "false"}, lambda n, f, m: n.endswith("Tern")), ({"eq.flag": "NO", "like.name": "%heron%"}, lambda n, f, m: f.lower() == "no" and "heron" in n.lower()), ({"eq.id": "2"}, lambda n, f, m: False),
    ]
    for params, test in filters:
        assert [o["id"] for o in s.find("boat", params)["objects"]] == expected(test), params
    assert s.find("boat", {"limit": "2", "offset": "3"}) == {"objects": [{"flag": f, "id": i, "metres": m, "name": n} for i, (n, f, m) in enumerate(BOATS, 1)][3:5], "count": 2, "limit": 2, "offset": 3}
    assert "Python" not in s.found("boat", {"eq.metres": "7"})._jdf.queryExecution().executedPlan().toString()
    s.checkpoint()
    s.put("boat", 3, '{"n":1.5}')
    s.delete("boat", 4)
    for error, call in ((NotFound, lambda: s.get("boat", 4)), (NotFound, lambda: s.delete("boat", 4)), (NotFound, lambda: s.put("boat", 77, "{}")), (NoClass, lambda: s.create("no", "{}")), (ClassExists, lambda: s.create_class("boat")), (InvalidName, lambda: s.create_class("two words")), (ClassNotEmpty, lambda: s.drop_class("boat")), (InvalidRequest, lambda: s.create("boat", "null"))):
        with pytest.raises(error):
            call()
    again = ObjectStore(spark, root)
    assert again.get("boat", 3) == {"id": 3, "n": 1.5} and again.get("boat", 5)["name"] == "Plover" and again.list_projects() == ["", "yard"] and again.list_classes("yard") == ["boat"]
    again.checkpoint()
    once_more = ObjectStore(spark, root)
    assert once_more.create("boat", "{}")["id"] == 6  # the id of a deleted object is not given again
    facts = once_more.stats()
    assert (facts["active_gen"], facts["num_classes"], facts["overlay_size"]) == (2, 2, 1) and facts["wal_bytes"] > 0
    once_more.delete("boat", 1, "yard")
    once_more.drop_class("boat", "yard")
    once_more.create_class("boat", "yard")
    assert once_more.create("boat", "{}", "yard")["id"] == 1


def test_many_writers(spark, tmp_path):
    """Threads create and delete while checkpoints run; records share log files, and none is lost."""
    root = str(tmp_path / "s")
    s = ObjectStore(spark, root)
    for c in "abc":
        s.create_class(c)
    slow, write = threading.Event(), s.files.write
    s.files.write = lambda *x: (slow.wait(0.02), write(*x))[1]
    made = [[] for _ in range(12)]

    def work(n):
        for i in range(20):
            made[n].append(("abc"[n % 3], s.create("abc"[n % 3], json.dumps({"w": n, "i": i}))["id"]))
        s.delete(*made[n].pop(5))

    threads = [threading.Thread(target=work, args=(n,)) for n in range(12)]
    for t in threads:
        t.start()
    s.checkpoint()
    for t in threads:
        t.join()
    every = [x for some in made for x in some]
    assert len(set(every)) == 12 * 19 and s.last_tx == 3 + 12 * 21
    assert len(s._segments()) < s.last_tx - s.applied
    again = ObjectStore(spark, root)
    assert {(r["class"], r.id) for r in again.view().collect()} == set(every)


def test_checkpoint_when_due(spark, tmp_path):
    s = ObjectStore(spark, str(tmp_path / "s"), Config(data_dir="x", checkpoint_log_bytes=400))
    s.create_class("c")
    assert not s.maintain()
    s.create("c", json.dumps({"x": "y" * 400}))
    with s.generations.pin() as pinned:
        assert s.maintain() and s.generations.current() == pinned + 1 and s.log_bytes == 0 and not s.alive
    assert not s.maintain() and s.get("c", 1)["x"] == "y" * 400


def test_pinned_generations_stay(spark, tmp_path):
    lake = Generations(spark, str(tmp_path / "g"))
    rows = spark.createDataFrame([("", "c", 1, "{}")], OBJECT)
    lake.publish(rows, 1)
    with lake.pin() as n:
        for i in range(2, 5):
            lake.publish(rows, i)
        lake.collect()
        assert lake.numbers() == [n, 4]
    lake.collect()
    assert lake.numbers() == [4]


def test_torn_log_and_leftovers(spark, tmp_path):
    root = str(tmp_path / "s")
    s = ObjectStore(spark, root)
    s.create_class("c")
    s.create("c", '{"a":1}')
    s.create("c", '{"a":2}')
    name = s._segments()[-1]
    s.files.write(f"log/{name}", s.files.read(f"log/{name}")[:-9])
    s.files.write("gen-7.json", "{}")
    (tmp_path / "s" / "gen-7").mkdir()
    again = ObjectStore(spark, root)
    assert again.find("c", {})["count"] == 1 and again.last_tx == 2 and again.create("c", "{}")["id"] == 2
    assert again.generations.numbers() == []


def test_against_a_model(spark, tmp_path):
    rng, root = random.Random(11), str(tmp_path / "s")
    s, model, top = ObjectStore(spark, root), {}, 0
    s.create_class("c")
    for _ in range(24):
        op = rng.choice(["create", "bulk", "put", "delete", "checkpoint", "reopen"])
        if op == "create":
            top = s.create("c", json.dumps({"v": top}))["id"]
            model[top] = top - 1
        elif op == "bulk":
            for i in s.create_bulk("c", json.dumps([{"v": -1}] * rng.randint(0, 3))):
                model[i], top = -1, i
        elif op in ("put", "delete") and model:
            i = rng.choice(list(model))
            if op == "put":
                s.put("c", i, '{"v":7}')
                model[i] = 7
            else:
                s.delete("c", i)
                del model[i]
        elif op == "checkpoint":
            s.checkpoint()
        elif op == "reopen":
            s = ObjectStore(spark, root)
    assert {o["id"]: o["v"] for o in s.find("c", {"limit": "0"})["objects"]} == model


def test_net_delta_of_batches(spark):
    part = ("put", "", "P", 1, "v2", 0)
    log = spark.createDataFrame([put(1, "P", 1, "v1"), put(2, "P", 2, "b"), put(3, None, None, None, "batch", [part, ("delete", "", "P", 2, None, 0), ("put", "", "P", 3, None, 0)]), put(4, None, None, None, "batch", None)], LOG)
    delta = {r.id: (r.data, r.deleted) for r in changelog.net_delta(changelog.flatten(log)).collect()}
    assert delta == {1: ("v2", False), 2: (None, True), 3: (None, False)}
    snapshot = spark.createDataFrame([("", "P", 2, "old"), ("", "P", 9, "old")], OBJECT)
    merged = changelog.merge(snapshot, changelog.net_delta(changelog.flatten(log)).withColumnRenamed("data", "doc"))
    assert {r.id: r.doc for r in merged.collect()} == {1: "v2", 3: None, 9: "old"}


def test_ids_in_ranges(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = spark.range(1000).selectExpr("id AS k", "IF(id % 3 = 0, 'a', 'hot') AS s")
    last = spark.createDataFrame([("a", 10)], "s string, max_id long")
    got = ids.assign(rows, ["s"], ["k"], last, rows_in_task=100).collect()
    for scope, first in (("a", 11), ("hot", 1)):
        mine = [r.id for r in sorted((r for r in got if r.s == scope), key=lambda r: r.k)]
        assert mine == list(range(first, first + len(mine)))


def test_stream_is_idempotent(spark, tmp_path):
    log, root, state = (str(tmp_path / n) for n in ("log", "lake", "state"))
    spark.createDataFrame([put(1, "P", 1, "a"), put(2, "P", 2, "b")], LOG).coalesce(1).write.parquet(log)
    apply_stream(spark, log, root, state).awaitTermination()
    spark.createDataFrame([put(2, "P", 2, "stale"), put(3, "P", 1, None, "delete"), put(4, "P", 3, "c")], LOG).coalesce(1).write.mode("append").parquet(log)
    apply_stream(spark, log, root, state).awaitTermination()
    lake = Generations(spark, root)
    assert {r.id: r.doc for r in lake.read().collect()} == {2: "b", 3: "c"} and lake.manifest()["applied"] == 4
    apply_stream(spark, log, root, str(tmp_path / "lost state")).awaitTermination()
    assert {r.id: r.doc for r in lake.read().collect()} == {2: "b", 3: "c"}


def test_stream_keeps_the_catalog_and_waits_for_late_records(spark, tmp_path):
    log, root, state = (str(tmp_path / n) for n in ("log", "lake", "state"))

    def arrive(*records):
        spark.createDataFrame(list(records), LOG).coalesce(1).write.mode("append").parquet(log)
        apply_stream(spark, log, root, state).awaitTermination()

    def create(tx, class_, op="create_class"):
        return put(tx, class_, None, None, op)

    arrive(create(1, "P"), create(2, "Q"), put(3, "P", 1, "a"), put(4, "P", 2, "b"), put(7, "P", 3, "late"))
    lake = Generations(spark, root)
    assert lake.manifest()["applied"] == 4 and {r.id for r in lake.read().collect()} == {1, 2}
    arrive(put(6, "P", 2, None, "delete"))
    assert lake.manifest()["applied"] == 4
    arrive(create(5, "Q", "drop_class"), put(4, "P", 2, "again"))
    assert lake.manifest()["applied"] == 7 and {r.id: r.doc for r in lake.read().collect()} == {1: "a", 3: "late"}
    s = ObjectStore(spark, root)
    assert s.list_classes() == ["P"] and s.create("P", "{}")["id"] == 4


def test_stream_keeps_the_catalog_and_waits_for_late_records(spark, tmp_path):
    log, root, state = (str(tmp_path / n) for n in ("log", "lake", "state"))

    def arrive(*records):
        spark.createDataFrame(list(records), LOG).coalesce(1).write.mode("append").parquet(log)
        apply_stream(spark, log, root, state).awaitTermination()

    def catalog(tx, class_, op="create_class"):
        return put(tx, class_, None, None, op)

    arrive(catalog(1, "P"), catalog(2, "Q"), put(3, "P", 1, "a"), put(4, "P", 2, "b"), put(7, "P", 3, "{}"))
    lake = Generations(spark, root)
    assert lake.manifest()["applied"] == 4 and {r.id for r in lake.read().collect()} == {1, 2}
    arrive(put(6, "P", 2, None, "delete"))
    assert lake.manifest()["applied"] == 4
    arrive(catalog(5, "Q", "drop_class"), put(4, "P", 2, "again"))
    assert lake.manifest()["applied"] == 7 and {r.id: r.doc for r in lake.read().collect()} == {1: "a", 3: "{}"}
    s = ObjectStore(spark, root)
    assert s.list_classes() == ["P"] and s.create("P", "{}")["id"] == 4
