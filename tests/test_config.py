"""Patches by pointer with their audit rows, and envelopes nested deeply."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.sources import io


def patched(spark, config, pointer, value):
    d = spark.createDataFrame([("n1", config)], "node string, config string")
    out, audit = S.config_edit(d, "node", "config", pointer, F.lit(value), F.lit(7))
    r = out.first()
    return r.config, r.problem, [a.labels for a in audit.collect()]


def test_patch_by_pointer(spark):
    config, problem, audit = patched(spark, '{"b":{"x":"1","y":[1,2]},"a":1.5}', "/b/x", '{"deep":true}')
    assert problem is None and json.loads(config) == {"a": 1.5, "b": {"x": {"deep": True}, "y": [1, 2]}}
    assert audit == [{"kind": "config_edit", "node": "n1", "path": "/b/x", "from": '"1"', "to": '{"deep":true}'}]
    config, problem, audit = patched(spark, '{"b":{}}', "/b/new", "3")
    assert json.loads(config) == {"b": {"new": 3}} and audit[0]["from"] == "null"
    for doc, pointer in (('{"a":1}', "/b/c"), ('{"a":1}', "/a/c"), ("[1]", "/a"), ("nothing", "/a"), (None, "/a")):
        config, problem, audit = patched(spark, doc, pointer, "3")
        assert config == doc and problem and audit == []
    assert patched(spark, "{}", "/a", "not json")[1]
    for pointer in ("a", "/", ""):
        with pytest.raises(ValueError, match="pointer"):
            S.json_pointer_patch(F.lit("{}"), pointer, F.lit("1"))


def test_envelopes_of_any_depth(spark):
    one = {"ts": 5, "metric_id": "m", "kind": "metric", "signal": "raw", "value": 1.0}
    deep = [one]
    for i in range(12):
        deep = {"data": deep} if i % 2 else {"observations": deep, "data": {"note": "nothing here"}}
    bodies = [deep, {"data": {"data": []}, "observations": {"data": one}}, {"data": {"data": {"other": 1}}}, [one, one], one, {"kind": "tick"}]
    d = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, None), (10, "broken {")], "i int, m string")
    got = {r.i: r.n for r in d.select("i", F.size(io.parse_observation_envelope(F.col("m"))).alias("n")).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 2, 4: 1, 5: 0, 9: 0, 10: 0}
