"""JSON documents against a JSON Schema, with a path for each fault.

A schema (Draft 2020-12) is compiled into one column expression over VARIANT: each keyword becomes a function of the value
and its path, objects are walked as maps and arrays by position, and what a value may be is bound once. Judging a table is
one projection: no shuffle, no Python worker, no row for a value that is in order.

Keywords: type, enum, const, required, properties, patternProperties, additionalProperties, propertyNames,
dependentRequired, min/maxProperties, prefixItems, items, contains, min/maxItems, uniqueItems, minimum, maximum, their
exclusive forms, multipleOf, min/maxLength, pattern, allOf, anyOf, oneOf, not, if/then/else, $ref (within the schema), and
true and false as schemas. Others, as annotations, do not judge.

A path names keys and places, joined by dots; the document itself is "(根)". Values in messages are written as Python does,
objects and arrays as JSON with their keys in order. Numbers are compared as doubles; 1.0 is an integer, and true is no
number. A text that is no JSON, or has a key twice in an object, has the one fault "parse"; so has null.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = "(根)"
FAULTS = "array<struct<path:string,message:string,keyword:string>>"
#: Times that a $ref is followed within itself; what lies deeper is a fault of its own, never passed over.
DEPTH = 6


class _Value:
    """A value of a document: bound once, so that keywords do not read it from the document again."""

    def __init__(self, bound: Column, path: Column):
        self.v, self.kind, self.object, self.array, self.path = bound["v"], bound["kind"], bound["object"], bound["array"], path

    def is_(self, name: str) -> Column:
        if name == "integer":
            return (self.kind == "BIGINT") | self.is_("number") & (self.number() == F.floor(self.number()))
        if name == "number":
            return ~_one_of(self.kind, ["STRING", "OBJECT", "ARRAY", "BOOLEAN", "VOID"])
        return self.kind == {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name]

    def has(self, name: str) -> Column:
        """Whether an object has this key (null: no object). JSON's null is a value there, so only a lacking key gives null; map_contains_key would leave its loop by an exception, which in a lambda costs more than all else."""
        return F.when(self.object.isNotNull(), F.try_element_at(self.object, F.lit(name)).isNotNull())

    def string(self) -> Column:
        """A string: what stands between the quotes of its JSON, unless something is escaped there."""
        return _let(F.to_json(self.v), lambda told: F.when(F.contains(told, F.lit("\\")), F.try_variant_get(self.v, "$", "string")).otherwise(F.substring(told, F.lit(2), F.length(told) - 2)))

    def number(self) -> Column:
        """A number, read from its JSON; what that does not tell, as infinity, from the value."""
        return F.coalesce(F.to_json(self.v).try_cast("double"), F.try_variant_get(self.v, "$", "double"))

    def shown(self) -> Column:
        plain = F.to_json(self.v)
        return F.when(self.is_("string"), quoted(self.string())).when(self.is_("boolean"), F.initcap(plain)).when(self.is_("null"), "None").otherwise(plain)

    def equals(self, const: object) -> Column:
        """Whether it is this value of a schema."""
        if isinstance(const, bool) or const is None or isinstance(const, (dict, list)):
            told = json.dumps(const, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            kind = "null" if const is None else "boolean" if isinstance(const, bool) else "object" if isinstance(const, dict) else "array"
            return self.is_(kind) & (F.to_json(self.v) == told)
        if isinstance(const, str):
            return self.among([const])
        return self.is_("number") & (self.number() == float(const))

    def among(self, texts: list[str]) -> Column:
        """Whether it is one of these strings."""
        plain = all(c >= " " and c not in '"\\\x7f' for t in texts for c in t)
        return self.is_("string") & _let(F.to_json(self.v) if plain else self.string(), lambda told: _one_of(told, [f'"{t}"' for t in texts] if plain else texts))


def quoted(s: Column) -> Column:
    """A string as Python shows it: in single quotes, or in double ones if it holds single ones only."""
    plain = s
    for raw, told in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(told))
    has = lambda q: F.contains(s, F.lit(q))
    return F.when(has("'") & ~has('"'), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.when(has('"'), "\\'").otherwise("'")), F.lit("'")))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is read once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _one_of(text: Column, values: list[str]) -> Column:
    """Whether it is one of these. IN leaves its loop by an exception, which is dear in a lambda; over ten values Spark looks them up in a set."""
    if len(values) > 10:
        return text.isin(values)
    return reduce(or_, [text == F.lit(v) for v in values], F.lit(False))


def _kind(v: Column) -> Column:
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def _bound(v: Column, entries: bool) -> Column:
    """v, which is a lambda's variable, with its kind and, if they are asked for, the entries it has."""
    if not entries:
        return F.struct(v.alias("v"), _kind(v).alias("kind"))
    read = F.struct(v.alias("v"), F.try_variant_get(v, "$", "map<string,variant>").alias("object"), F.try_variant_get(v, "$", "array<variant>").alias("array"))
    kind = lambda b: F.when(b["object"].isNotNull(), "OBJECT").when(b["array"].isNotNull(), "ARRAY").otherwise(_kind(b["v"]))
    return _let(read, lambda b: F.struct(b["v"].alias("v"), kind(b).alias("kind"), b["object"].alias("object"), b["array"].alias("array")))


def _none() -> Column:
    return F.array().cast(FAULTS)


class _Fault:
    """One fault that a value may have: a struct, or null."""

    def __init__(self, broken: Column, value: _Value, message: Column, keyword: str):
        self.column = F.when(broken, F.struct(value.path.alias("path"), message.alias("message"), F.lit(keyword).alias("keyword")))


def _all(found: list[_Fault | Column]) -> Column:
    """The faults of all these, single ones and lists; where no single one is, none is gathered."""
    single, lists = [f.column for f in found if isinstance(f, _Fault)], [f for f in found if not isinstance(f, _Fault)]
    if single:
        lists.insert(0, F.when(F.coalesce(*single).isNotNull(), F.array_compact(F.array(*single))).otherwise(_none()))
    return F.concat(*lists) if len(lists) > 1 else lists[0] if lists else _none()


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _key(path: Column, key: Column) -> Column:
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


class _Compiler:
    def __init__(self, root: dict, depth: int):
        self.root, self.depth = root, depth

    def faults(self, schema: dict | bool, v: Column, path: Column, refs: tuple[str, ...] = ()) -> Column:
        """All faults of the value v, a lambda's variable, at a path."""
        if schema is True or schema == {}:
            return _none()
        return _let(_bound(v, self.entries(schema)), lambda b: self.judged(schema, _Value(b, path), refs))

    def entries(self, schema: dict | bool, seen: tuple[str, ...] = ()) -> bool:
        """Whether a schema looks into objects or arrays, itself or by the schemas that judge the same value."""
        if isinstance(schema, bool):
            return False
        same = [s for k in ("allOf", "anyOf", "oneOf") for s in schema.get(k, [])] + [schema[k] for k in ("not", "if", "then", "else") if k in schema]
        if "$ref" in schema and schema["$ref"] not in seen:
            seen = (*seen, schema["$ref"])
            same.append(self.target(schema["$ref"]))
        return not ENTRIES.isdisjoint(schema) or any(self.entries(s, seen) for s in same)

    def target(self, ref: str) -> dict | bool:
        target: object = self.root
        for part in [p for p in ref.removeprefix("#").split("/") if p]:
            target = target[int(part)] if isinstance(target, list) else target[part.replace("~1", "/").replace("~0", "~")]
        return target

    def judged(self, schema: dict | bool, x: _Value, refs: tuple[str, ...]) -> Column:
        if schema is True:
            return _none()
        if schema is False:
            return _all([_Fault(F.lit(True), x, _said("False schema does not allow ", x.shown()), "false")])
        found = [getattr(self, "_" + name.lstrip("$"))(value, schema, x, refs) for name, value in schema.items() if name in KEYWORDS]
        return _all(found)

    def valid(self, schema: dict | bool, x: _Value, refs: tuple[str, ...]) -> Column:
        return F.size(self.judged(schema, x, refs)) == 0

    def _ref(self, ref: str, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault | Column:
        if refs.count(ref) >= self.depth:
            return _Fault(F.lit(True), x, F.lit(f"nested deeper than {self.depth} times {ref}"), "$ref")
        return self.judged(self.target(ref), x, (*refs, ref))

    # of any value

    def _type(self, names: str | list, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        names = [names] if isinstance(names, str) else names
        ok = F.lit(False)
        for name in names:
            ok = ok | x.is_(name)
        return _Fault(~ok, x, _said(x.shown(), " is not of type " + ", ".join(map(repr, names))), "type")

    def _enum(self, values: list, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        texts = [v for v in values if isinstance(v, str)]
        ok = x.among(texts) if texts else F.lit(False)
        for v in values:
            ok = ok if isinstance(v, str) else ok | x.equals(v)
        return _Fault(~ok, x, _said(x.shown(), f" is not one of {values!r}"), "enum")

    def _const(self, value: object, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return _Fault(~x.equals(value), x, F.lit(f"{value!r} was expected"), "const")

    def _allOf(self, schemas: list, schema: dict, x: _Value, refs: tuple[str, ...]) -> Column:
        return _all([self.judged(s, x, refs) for s in schemas])

    def _anyOf(self, schemas: list, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        ok = F.lit(False)
        for s in schemas:
            ok = ok | self.valid(s, x, refs)
        return _Fault(~ok, x, _said(x.shown(), " is not valid under any of the given schemas"), "anyOf")

    def _oneOf(self, schemas: list, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        n = F.lit(0)
        for s in schemas:
            n = n + self.valid(s, x, refs).cast("int")
        message = F.when(n == 0, _said(x.shown(), " is not valid under any of the given schemas")).otherwise(_said(x.shown(), " is valid under ", n.cast("string"), " of the given schemas"))
        return _Fault(n != 1, x, message, "oneOf")

    def _not(self, inner: dict | bool, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return _Fault(self.valid(inner, x, refs), x, _said(x.shown(), f" should not be valid under {inner!r}"), "not")

    def _if(self, test: dict | bool, schema: dict, x: _Value, refs: tuple[str, ...]) -> Column:
        return F.when(self.valid(test, x, refs), self.judged(schema.get("then", True), x, refs)).otherwise(self.judged(schema.get("else", True), x, refs))

    # of numbers and strings

    def _bounds(self, x: _Value, broken: Callable[[Column], Column], words: str, bound: float, keyword: str) -> _Fault:
        return _Fault(x.is_("number") & broken(x.number()), x, _said(x.shown(), f" {words} {bound!r}"), keyword)

    def _minimum(self, m: float, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return self._bounds(x, lambda n: n < m, "is less than the minimum of", m, "minimum")

    def _maximum(self, m: float, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return self._bounds(x, lambda n: n > m, "is greater than the maximum of", m, "maximum")

    def _exclusiveMinimum(self, m: float, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return self._bounds(x, lambda n: n <= m, "is less than or equal to the minimum of", m, "exclusiveMinimum")

    def _exclusiveMaximum(self, m: float, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return self._bounds(x, lambda n: n >= m, "is greater than or equal to the maximum of", m, "exclusiveMaximum")

    def _multipleOf(self, m: float, schema: dict, x: _Value, refs: tuple[str, ...]) -> Column:
        return self._bounds(x, lambda n: n / float(m) != F.floor(n / float(m)), "is not a multiple of", m, "multipleOf")

    def _sized(self, x: _Value, kind: str, size: Column, least: int | None, most: int | None, words: tuple[str, str], keyword: str) -> _Fault:
        if least is not None:
            return _Fault(x.is_(kind) & (size < least), x, _said(x.shown(), " should be non-empty" if least == 1 else f" {words[0]}"), keyword)
        return _Fault(x.is_(kind) & (size > most), x, _said(x.shown(), " is expected to be empty" if most == 0 else f" {words[1]}"), keyword)

    def _minLength(self, n: int, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return self._sized(x, "string", F.length(x.string()), n, None, ("is too short", ""), "minLength")

    def _maxLength(self, n: int, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return self._sized(x, "string", F.length(x.string()), None, n, ("", "is too long"), "maxLength")

    def _pattern(self, p: str, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return _Fault(x.is_("string") & ~x.string().rlike("(?U)" + p), x, _said(x.shown(), f" does not match {p!r}"), "pattern")

    # of objects

    def _entries(self, x: _Value, keep: Callable[[Column], Column] | None, f: Callable[[Column, Column], Column]) -> Column:
        """Faults of f(key, value) over an object's entries."""
        entries = F.map_entries(x.object)
        entries = F.filter(entries, lambda e: keep(e["key"])) if keep else entries
        return F.coalesce(F.flatten(F.transform(entries, lambda e: f(e["key"], e["value"]))), _none())

    def _required(self, names: list, schema: dict, x: _Value, refs: tuple[str, ...]) -> Column:
        return _all([_Fault(~x.has(n), x, F.lit(f"{n!r} is a required property"), "required") for n in names])

    def _dependentRequired(self, needs: dict, schema: dict, x: _Value, refs: tuple[str, ...]) -> Column:
        found = [_Fault(x.has(k) & ~x.has(n), x, F.lit(f"{n!r} is a dependency of {k!r}"), "dependentRequired") for k, names in needs.items() for n in names]
        return _all(found)

    def _properties(self, schemas: dict, schema: dict, x: _Value, refs: tuple[str, ...]) -> Column:
        def property(k: str, inner: dict | bool) -> Column:
            return _let(F.try_element_at(x.object, F.lit(k)), lambda v: F.when(v.isNull(), _none()).otherwise(self.faults(inner, v, _key(x.path, F.lit(k)), refs)))

        return _all([property(k, s) for k, s in schemas.items() if s is not True and s != {}])

    def _patternProperties(self, schemas: dict, schema: dict, x: _Value, refs: tuple[str, ...]) -> Column:
        found = [self._entries(x, lambda k, p=p: k.rlike("(?U)" + p), lambda k, v, s=s: self.faults(s, v, _key(x.path, k), refs)) for p, s in schemas.items()]
        return _all(found)

    def _additionalProperties(self, inner: dict | bool, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault | Column:
        def more(k: Column) -> Column:
            out = ~_one_of(k, list(schema.get("properties", {})))
            for p in schema.get("patternProperties", {}):
                out = out & ~k.rlike("(?U)" + p)
            return out

        if inner is not False:
            return self._entries(x, more, lambda k, v: self.faults(inner, v, _key(x.path, k), refs))
        extras = F.filter(F.map_keys(x.object), more)
        told = _said("Additional properties are not allowed (", F.array_join(F.transform(F.array_sort(extras), quoted), ", "), F.when(F.size(extras) == 1, " was").otherwise(" were"), " unexpected)")
        return _Fault(x.is_("object") & (F.size(extras) > 0), x, told, "additionalProperties")

    def _propertyNames(self, inner: dict | bool, schema: dict, x: _Value, refs: tuple[str, ...]) -> Column:
        return self._entries(x, None, lambda k, v: _let(F.to_variant_object(F.array(k)).cast("array<variant>")[0], lambda name: self.faults(inner, name, x.path, refs)))

    def _minProperties(self, n: int, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return self._sized(x, "object", F.size(x.object), n, None, ("does not have enough properties", ""), "minProperties")

    def _maxProperties(self, n: int, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return self._sized(x, "object", F.size(x.object), None, n, ("", "has too many properties"), "maxProperties")

    # of arrays

    def _items(self, inner: dict | bool, schema: dict, x: _Value, refs: tuple[str, ...]) -> Column:
        first = len(schema.get("prefixItems", []))
        each = F.transform(x.array, lambda v, i: F.when(i >= first, self.faults(inner, v, _key(x.path, i.cast("string")), refs)).otherwise(_none()) if first else self.faults(inner, v, _key(x.path, i.cast("string")), refs))
        return F.coalesce(F.flatten(each), _none())

    def _prefixItems(self, schemas: list, schema: dict, x: _Value, refs: tuple[str, ...]) -> Column:
        def item(i: int, inner: dict | bool) -> Column:
            judged = _let(F.try_element_at(x.array, F.lit(i + 1)), lambda v: self.faults(inner, v, _key(x.path, F.lit(str(i))), refs))
            return F.when(F.size(x.array) > i, judged).otherwise(_none())

        return _all([item(i, s) for i, s in enumerate(schemas)])

    def _contains(self, inner: dict | bool, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault | Column:
        fits = F.size(F.filter(x.array, lambda v: F.size(self.faults(inner, v, F.lit(""), refs)) == 0))
        least, most = schema.get("minContains", 1), schema.get("maxContains")
        few = _Fault(x.is_("array") & (fits < least), x, _said(x.shown(), " does not contain items matching the given schema" if least == 1 else " has too few items matching the given schema"), "contains")
        return few if most is None else _all([few, _Fault(x.is_("array") & (fits > most), x, _said(x.shown(), " has too many items matching the given schema"), "contains")])

    def _minItems(self, n: int, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return self._sized(x, "array", F.size(x.array), n, None, ("is too short", ""), "minItems")

    def _maxItems(self, n: int, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault:
        return self._sized(x, "array", F.size(x.array), None, n, ("", "is too long"), "maxItems")

    def _uniqueItems(self, on: bool, schema: dict, x: _Value, refs: tuple[str, ...]) -> _Fault | Column:
        told = F.transform(x.array, lambda v: F.coalesce(F.to_json(v), F.lit("null")))
        return _Fault(x.is_("array") & (F.size(F.array_distinct(told)) < F.size(x.array)), x, _said(x.shown(), " has non-unique elements"), "uniqueItems") if on else _none()


#: The keywords that judge: a method each.
KEYWORDS = {"$ref" if n == "_ref" else n[1:] for n in vars(_Compiler) if n[0] == "_" != n[1]} - {"entries", "bounds", "sized"}
#: Those that look into objects or arrays.
ENTRIES = {"required", "dependentRequired", "properties", "patternProperties", "additionalProperties", "propertyNames", "minProperties", "maxProperties", "items", "prefixItems", "contains", "minItems", "maxItems", "uniqueItems"}


def faults_of(text: Column, schema: dict, depth: int = DEPTH) -> Column:
    """All faults of a JSON text, as an array of (path, message, keyword)."""
    none = F.array(F.struct(F.lit("").alias("path"), F.lit("not a JSON document").alias("message"), F.lit("parse").alias("keyword")))
    found = _let(F.try_parse_json(text), lambda v: F.when(v.isNull(), none).otherwise(_Compiler(schema, depth).faults(schema, v, F.lit(""))))
    return F.transform(found, lambda f: F.struct(F.when(f["path"] == "", ROOT).otherwise(f["path"]).alias("path"), f["message"].alias("message"), f["keyword"].alias("keyword")))


def schema_faults(docs: DataFrame, schema: dict, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, path, message, keyword: each fault of each document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(faults_of(F.col(text_col), schema, depth)))


def schema_verdicts(docs: DataFrame, schema: dict, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, valid, error_count, repair_prompt (null if valid): the faults in the order of their paths, as a request to mend them."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.array_sort(faults_of(F.col(text_col), schema, depth)).alias("found"))
    lines = F.transform("found", lambda f: F.concat(F.lit("- "), f["path"], F.lit("："), f["message"]))
    prompt = F.when(F.size("found") > 0, F.concat_ws("\n", F.lit("请修正以下字段："), F.array_join(lines, "\n")))
    return found.select("doc_id", (F.size("found") == 0).alias("valid"), F.size("found").cast("long").alias("error_count"), prompt.alias("repair_prompt"))
