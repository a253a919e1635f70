"""Schemas compiled to columns against a plain validator that walks the parsed document, over made-up documents and odd ones."""

from __future__ import annotations

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import schemas as S

R = np.random.default_rng(3)
WORDS = ["confirm", "adjust", "D1", "D2", "ch01", "it's", "a\nb", "é", ""]
CHAPTERS = {
    "type": "object", "propertyNames": {"pattern": r"^ch\d{2,3}$"}, "minProperties": 1,
    "additionalProperties": {
        "type": "object", "propertyNames": {"enum": ["D1", "D2"]}, "minProperties": 1,
        "additionalProperties": {"type": "object", "required": ["mode"], "additionalProperties": False, "properties": {"mode": {"type": "string", "enum": ["confirm", "adjust"]}, "text": {"type": "string"}}, "if": {"properties": {"mode": {"const": "adjust"}}}, "then": {"required": ["mode", "text"]}},
    },
}
MIXED = {
    "type": ["object", "array"], "required": ["a"], "dependentRequired": {"a": ["b"]}, "maxProperties": 3, "minItems": 2, "maxItems": 3, "uniqueItems": True,
    "prefixItems": [{"type": "string"}, {"type": "integer"}], "items": {"type": "boolean"}, "contains": {"type": "integer"},
    "patternProperties": {"^x": {"type": "number", "minimum": 2, "exclusiveMaximum": 7}}, "additionalProperties": {"$ref": "#/$defs/node"},
    "properties": {"a": {"oneOf": [{"type": "integer"}, {"multipleOf": 2}]}, "b": {"anyOf": [{"minLength": 3}, {"type": "null"}]}},
    "$defs": {"node": {"type": ["object", "string", "number", "null"], "maxLength": 5, "not": {"const": 4}, "properties": {"next": {"$ref": "#/$defs/node"}, "on": {"const": True}}, "additionalProperties": False}},
}


def shown(v: object) -> str:
    return repr(v) if isinstance(v, (str, bool)) or v is None else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def is_(v: object, name: str) -> bool:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and float(v).is_integer()}[name]


def faults(v: object, schema: object, root: dict, path: tuple = ()) -> list[tuple]:
    """(path, keyword) and message of each fault."""
    if schema is True or schema == {}:
        return []
    out: list[tuple] = []
    add = lambda keyword, message, at=path: out.append((".".join(map(str, at)) or S.ROOT, message, keyword))
    ok = lambda s: not faults(v, s, root, path)
    number = is_(v, "number")
    for k, a in schema.items():
        if k == "$ref":
            out += faults(v, root["$defs"][a.rsplit("/", 1)[1]], root, path)
        elif k == "type" and not any(is_(v, t) for t in ([a] if isinstance(a, str) else a)):
            add(k, f"{shown(v)} is not of type " + ", ".join(map(repr, [a] if isinstance(a, str) else a)))
        elif k == "enum" and not any(type(v) is type(x) and v == x for x in a):
            add(k, f"{shown(v)} is not one of {a!r}")
        elif k == "const" and not (isinstance(v, bool) == isinstance(a, bool) and v == a):
            add(k, f"{a!r} was expected")
        elif k == "anyOf" and not any(map(ok, a)):
            add(k, f"{shown(v)} is not valid under any of the given schemas")
        elif k == "oneOf" and (n := sum(map(ok, a))) != 1:
            add(k, f"{shown(v)} is valid under {n} of the given schemas" if n else f"{shown(v)} is not valid under any of the given schemas")
        elif k == "not" and ok(a):
            add(k, f"{shown(v)} should not be valid under {a!r}")
        elif k == "if":
            out += faults(v, schema.get("then" if ok(a) else "else", True), root, path)
        elif k == "minimum" and number and v < a:
            add(k, f"{shown(v)} is less than the minimum of {a!r}")
        elif k == "exclusiveMaximum" and number and v >= a:
            add(k, f"{shown(v)} is greater than or equal to the maximum of {a!r}")
        elif k == "multipleOf" and number and v % a:
            add(k, f"{shown(v)} is not a multiple of {a!r}")
        elif k == "minLength" and isinstance(v, str) and len(v) < a:
            add(k, f"{shown(v)} is too short")
        elif k == "maxLength" and isinstance(v, str) and len(v) > a:
            add(k, f"{shown(v)} is too long")
        elif k == "pattern" and isinstance(v, str) and not re.search(a, v):
            add(k, f"{shown(v)} does not match {a!r}")
        if isinstance(v, dict):
            if k == "required":
                [add(k, f"{n!r} is a required property") for n in a if n not in v]
            elif k == "dependentRequired":
                [add(k, f"{n!r} is a dependency of {x!r}") for x, ns in a.items() for n in ns if x in v and n not in v]
            elif k == "properties":
                [out.extend(faults(v[n], s, root, (*path, n))) for n, s in a.items() if n in v]
            elif k == "patternProperties":
                [out.extend(faults(x, s, root, (*path, n))) for p, s in a.items() for n, x in v.items() if re.search(p, n)]
            elif k == "additionalProperties":
                more = sorted(n for n in v if n not in schema.get("properties", {}) and not any(re.search(p, n) for p in schema.get("patternProperties", {})))
                if a is False and more:
                    add(k, f"Additional properties are not allowed ({', '.join(map(repr, more))} {'was' if len(more) == 1 else 'were'} unexpected)")
                elif a is not False:
                    [out.extend(faults(v[n], a, root, (*path, n))) for n in more]
            elif k == "propertyNames":
                [out.extend(faults(n, a, root, path)) for n in v]
            elif k == "minProperties" and len(v) < a:
                add(k, f"{shown(v)} should be non-empty")
            elif k == "maxProperties" and len(v) > a:
                add(k, f"{shown(v)} has too many properties")
        if isinstance(v, list):
            if k == "prefixItems":
                [out.extend(faults(x, s, root, (*path, i))) for i, (x, s) in enumerate(zip(v, a, strict=False))]
            elif k == "items":
                n = len(schema.get("prefixItems", []))
                [out.extend(faults(x, a, root, (*path, i))) for i, x in enumerate(v) if i >= n]
            elif k == "contains" and not any(not faults(x, a, root) for x in v):
                add(k, f"{shown(v)} does not contain items matching the given schema")
            elif k == "minItems" and len(v) < a:
                add(k, f"{shown(v)} is too short")
            elif k == "maxItems" and len(v) > a:
                add(k, f"{shown(v)} is too long")
            elif k == "uniqueItems" and len({shown(x) for x in v}) < len(v):
                add(k, f"{shown(v)} has non-unique elements")
    return out


def some(depth: int, keys: list[str]) -> object:
    kind = R.integers(0, 9)
    if depth and kind < 4:
        return {str(R.choice(keys)): some(depth - 1, keys) for _ in range(R.integers(0, 4))}
    if depth and kind == 4:
        return [some(depth - 1, keys) for _ in range(R.integers(0, 5))]
    return [int(R.integers(0, 9)), str(R.choice(WORDS)), bool(R.integers(0, 2)), None, 2.5, str(R.choice(WORDS))][R.integers(0, 6)]


@pytest.mark.parametrize(("schema", "keys"), [(CHAPTERS, ["ch01", "ch002", "x", "D1", "D2", "mode", "text"]), (MIXED, ["a", "b", "xa", "next", "on", "z.z", "it's"])])
def test_equals_the_plain_validator(spark, schema, keys) -> None:
    docs = [(i, json.dumps(some(4, keys), ensure_ascii=False)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = sorted(map(tuple, S.schema_faults(df, schema).collect()))
    want = sorted((i, *f) for i, t in docs for f in faults(json.loads(t), schema, schema))
    assert len(want) > 400
    assert got == want


def test_odd_texts_and_verdicts(spark) -> None:
    rows = [(1, None), (2, ""), (3, "{bad"), (4, '{"a":1,"a":2}'), (5, "null"), (6, '{"mode":"confirm"}'), (7, '{"mode":1.0}')]
    df = spark.createDataFrame(rows, "`id` int, `text` string")
    schema = {"type": "object", "properties": {"mode": {"type": ["string", "integer"]}}}
    got = {r["doc_id"]: (r["path"], r["keyword"]) for r in S.schema_faults(df, schema, id_col="id").collect()}
    assert got == {i: (S.ROOT, "parse") for i in (1, 2, 3, 4)} | {5: (S.ROOT, "type")}
    v = {r["doc_id"]: (r["valid"], r["error_count"], r["repair_prompt"]) for r in S.schema_verdicts(df, schema, id_col="id").collect()}
    assert v[6] == v[7] == (True, 0, None)
    assert v[5] == (False, 1, "请修正以下字段：\n- (根)：None is not of type 'object'")
    assert S.schema_faults(df.limit(0), schema, id_col="id").collect() == []


def test_what_lies_too_deep_is_a_fault(spark) -> None:
    schema = {"$ref": "#/$defs/n", "$defs": {"n": {"properties": {"n": {"$ref": "#/$defs/n"}}, "additionalProperties": False}}}
    text = lambda n: '{"n":' * n + "{}" + "}" * n
    df = spark.createDataFrame([(1, text(2)), (2, text(5))], "doc_id int, text string")
    assert [tuple(r) for r in S.schema_faults(df, schema, depth=4).collect()] == [(2, "n.n.n.n", "nested deeper than 4 times #/$defs/n", "$ref")]


def test_one_pass_without_python(spark) -> None:
    plan = S.schema_faults(spark.createDataFrame([(1, "{}")], "doc_id int, text string").coalesce(1), CHAPTERS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.replace("PythonRDD", "")
    assert S.faults_of(F.col("text"), True) is not None


def test_keys_and_strings_are_looked_up_without_exceptions(spark) -> None:
    """array_contains (of map_contains_key) and IN leave their loops by an exception, most of the time of a judging task."""
    schema = {"required": ["a"], "properties": {"a": {"type": ["null", "string"], "enum": [None, "x", 'q"\\']}, "b": {"maximum": 5}, "c": {"enum": [f"w{i}" for i in range(12)]}, "d": {"pattern": "^.\\\\$"}}, "additionalProperties": False}
    rows = [(1, '{"a":null}'), (2, '{"a":"q\\"\\\\"}'), (3, '{"a":"x","b":1e400}'), (4, '{"a":"\\u0078","c":"w11"}'), (5, '{"a":"y","c":"w12"}'), (6, '{"a":"x","d":"é\\\\","e":1}'), (7, '{"a":"x","d":"Infinity"}')]
    found = S.schema_faults(spark.createDataFrame(rows, "doc_id int, text string"), schema)
    got = sorted((r["doc_id"], r["path"], r["keyword"]) for r in found.collect())
    assert got == [(3, "b", "maximum"), (5, "a", "enum"), (5, "c", "enum"), (6, S.ROOT, "additionalProperties"), (7, "d", "pattern")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and " IN (" not in plan
