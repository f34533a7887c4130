"""Documents put together from results, and searched to any depth."""

import json
import random

from photoflow.sources import sidecars


def merged(docs: dict, updates: list[tuple]) -> dict:
    out = {}
    for k, d in docs.items():
        try:
            d = json.loads(d) if d is not None else None
        except ValueError:
            d = None
        if isinstance(d, dict):
            out[k] = d
    done = sorted(updates, key=lambda u: (u[4], u[2] is not None, u[2] or "", u[3], u[1]))
    for k, op, backend, payload, at in done:
        d, new = out.setdefault(k, {}), json.loads(payload)
        if backend is None:
            d[op] = new
        else:
            if not isinstance(d.get(op), dict):
                d[op] = {}
            d[op][backend] = new
        d.setdefault("sidecar_info", {"created_at": at, "operation_type": op}).update(last_updated=at, last_operation=op)
    return out


def test_documents_are_put_together(spark):
    rng = random.Random(6)
    docs = {k: rng.choice([None, "broken {", "[1]", "{}", '{"face":{"success":true,"a":{"n":1}},"other":"x\\"y","sidecar_info":{"created_at":"t0","image_path":"p"}}', '{"face":7}']) for k in range(40)}
    updates = [(rng.randrange(60), rng.choice(["face", "ball", 'od"d']), rng.choice([None, "a", "b", "success"]), json.dumps({"n": rng.randrange(4), "z": [1, None], "é": "q\\"}), f"2025-0{rng.randrange(1, 4)}") for _ in range(300)]
    got = sidecars.merge_documents(spark.createDataFrame(list(docs.items()), "image long, doc string"), spark.createDataFrame(updates, "image long, op string, backend string, payload string, at string"))
    rows = {r.image: r.doc for r in got.collect()}
    want = merged(docs, updates)
    assert {k: json.loads(d) for k, d in rows.items()} == {k: d for k, d in want.items() if d}
    assert all(list(json.loads(d)) == sorted(json.loads(d)) for d in rows.values())
    none = spark.createDataFrame([], "image long, op string, backend string, payload string, at string")
    kept = spark.createDataFrame([(1, '{"b":{"x":1},"a":2}')], "image long, doc string")
    assert [json.loads(r.doc) for r in sidecars.merge_documents(kept, none).collect()] == [{"a": 2, "b": {"x": 1}}]


def nested(inner: dict, path: list[str]) -> dict:
    for k in reversed(path):
        inner = {k: inner}
    return inner


def test_search_to_any_depth(spark):
    deep = ["data", "result", "detection", "data", "data", "result"]
    docs = [
        json.dumps(nested({"faces": [1, 2, 3], "model": "m", "click": 1}, deep)),
        json.dumps(nested({"count": 9}, ["data"] * 40)),
        json.dumps({"data": {"count": 0, "data": {"count": 5}}, "result": {"objects": [1]}}),
        json.dumps({"count": 0, "data": {"count": 5}}),
        json.dumps({"data": [1], "result": {"result": {"sidecar_info": {"operation_type": "click"}, "metadata": {"metadata": {"algorithm": "deep"}}}}}),
        "broken", "[3]", None, "{}",
    ]
    t = spark.createDataFrame(list(enumerate(docs)), "image long, doc string")
    assert {r.image: r.n for r in sidecars.detection_counts(t).collect()} == {0: 3, 1: 9, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}
    tools = {r.image: r.tool for r in sidecars.tool_names(t).collect()}
    assert tools.pop(4) == "deep" and set(tools.values()) == {None}  # detection is no key of this search
    has = {r.image for r in sidecars.with_operation(t, "click").collect() if r.has}
    assert has == {4}
    through = json.dumps(nested({"click": 1, "detector": "d"}, ["data", "result"] * 4))
    t = spark.createDataFrame([(0, through)], "image long, doc string")
    assert sidecars.with_operation(t, "click").first().has and sidecars.tool_names(t).first().tool == "d"


def test_search_writes_no_table_for_a_depth(spark, monkeypatch):
    """Documents are searched within their rows; equal keys together, the first object going down before on."""

    def none(*_):
        raise AssertionError("a depth of objects was written")

    monkeypatch.setattr(sidecars, "materialize", none)
    deep = json.dumps(nested({"count": 4, "model": "m", "click": 1}, ["data", "result"] * 40))
    wide = {"count": 1}
    for _ in range(6):
        wide = {"data": {"x": [{}] * 5}, "result": wide, "detection": {"count": 7}}
    twice = [json.dumps({"result": {"count": 2, "click": 1}}), json.dumps({"data": {"count": 0}, "result": {"count": 5}, "detection": {"count": 6}}), json.dumps({"data": {"count": 9}})]
    rows = [(0, deep), (1, json.dumps(wide)), (2, '"text"'), (3, json.dumps({"data": None, "result": {"model": None, "tool_name": "t"}})), *[(4, d) for d in twice], (5, None)]
    t = spark.createDataFrame(rows, "image long, doc string").repartition(3)
    assert {r.image: r.n for r in sidecars.detection_counts(t).collect()} == {0: 4, 1: 1, 2: 0, 3: 0, 4: 9, 5: 0}
    assert {r.image: r.tool for r in sidecars.tool_names(t).collect()} == {0: "m", 1: None, 2: None, 3: "t", 4: None, 5: None}
    assert {r.image: r.has for r in sidecars.with_operation(t, "click").collect()} == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False}


def test_equal_versions_are_decided(spark):
    from photoflow.operators import joins

    row = "image long, op string, version long, payload string"
    old = spark.createDataFrame([(1, "a", 5, "old"), (2, "a", 9, "old"), (3, "a", 1, "old")], row)
    new = spark.createDataFrame([(1, "a", 5, "new"), (2, "a", 5, "new"), (4, "a", 2, "x"), (4, "a", 2, "y")], row)
    got = {r.image: r for parts in (1, 4) for r in joins.merge_operations(old.repartition(parts), new.repartition(parts), ["image", "op"]).collect()}
    assert [got[k].payload for k in (1, 2, 3)] == ["new", "old", "old"] and (got[2].created_at, got[2].last_updated) == (5, 9)
    both = [joins.merge_operations(old, new.orderBy(c), ["image", "op"]).where("image = 4").first().payload for c in ("payload", new["payload"].desc())]
    assert both[0] == both[1]
