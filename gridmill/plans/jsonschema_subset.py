"""JSON documents: loading, freezing, and the part of JSON Schema that catalogs use."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path
from types import MappingProxyType

_KINDS: dict[str, Callable[[object], bool]] = {
    "object": lambda x: isinstance(x, (dict, MappingProxyType)),
    "array": lambda x: isinstance(x, (list, tuple)),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
}
_KNOWN = frozenset(
    "type properties required additionalProperties propertyNames patternProperties pattern enum const items minItems maxItems uniqueItems minProperties maxProperties"
    " minimum maximum minLength maxLength $ref $defs $id $schema $comment title description default examples anyOf oneOf allOf not format".split()
)


class SchemaError(RuntimeError):
    """The schema itself is unusable."""


def load_json(source: str | Path | bytes | object) -> object:
    """JSON of a file name, bytes, or an open file."""
    if isinstance(source, (str, Path)):
        source = Path(source).read_bytes()
    return json.loads(source) if isinstance(source, (bytes, bytearray)) else json.load(source)


def freeze(doc: object) -> object:
    if isinstance(doc, dict):
        return MappingProxyType({k: freeze(v) for k, v in doc.items()})
    if isinstance(doc, list):
        return tuple(map(freeze, doc))
    if doc is None or isinstance(doc, (str, int, float, bool)):
        return doc
    raise TypeError(f"no JSON value: {type(doc).__name__}")


class FrozenEncoder(json.JSONEncoder):
    """Writes frozen documents."""

    def default(self, o: object) -> object:
        return dict(o) if isinstance(o, MappingProxyType) else super().default(o)


def load_schema(source: object) -> dict:
    schema = load_json(source)
    if not isinstance(schema, dict):
        raise SchemaError("a schema is an object")
    _inspect(schema, schema)
    return schema


def _inspect(part: object, root: dict) -> None:
    if isinstance(part, bool):
        return
    if not isinstance(part, dict):
        raise SchemaError(f"no schema: {part!r}")
    if strange := set(part) - _KNOWN:
        raise SchemaError(f"unsupported: {sorted(strange)}")
    kinds = part.get("type", [])
    if any(k not in _KINDS for k in ([kinds] if isinstance(kinds, str) else kinds)):
        raise SchemaError(f"no such type: {kinds!r}")
    for key in ("properties", "$defs", "patternProperties"):
        for x in part.get(key, {}).values():
            _inspect(x, root)
    for key in ("additionalProperties", "propertyNames", "items", "not"):
        if key in part:
            _inspect(part[key], root)
    for key in ("anyOf", "oneOf", "allOf"):
        for x in part.get(key, []):
            _inspect(x, root)
    if "$ref" in part:
        _target(part["$ref"], root)


def _target(ref: str, root: dict) -> object:
    at: object = root
    for step in ref.removeprefix("#").strip("/").split("/"):
        if step:
            if not isinstance(at, dict) or step not in at:
                raise SchemaError(f"nothing at {ref}")
            at = at[step]
    return at


def errors(doc: object, schema: object, root: dict | None = None, at: str = "$") -> list[str]:
    """What is wrong with a document; empty if nothing is."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    root = schema if root is None else root
    out: list[str] = []
    say = lambda ok, what: None if ok else out.append(f"{at}: {what}")
    if "$ref" in schema:
        out += errors(doc, _target(schema["$ref"], root), root, at)
    if kinds := schema.get("type"):
        say(any(_KINDS[k](doc) for k in ([kinds] if isinstance(kinds, str) else kinds)), f"not of type {kinds}")
    if "enum" in schema:
        say(doc in schema["enum"], "not one of the listed values")
    if "const" in schema:
        say(doc == schema["const"], "not the constant")
    if _KINDS["string"](doc):
        say("pattern" not in schema or re.search(schema["pattern"], doc), "does not match the pattern")
        say(schema.get("minLength", 0) <= len(doc) <= schema.get("maxLength", len(doc)), "wrong length")
    if _KINDS["number"](doc):
        say(schema.get("minimum", doc) <= doc <= schema.get("maximum", doc), "out of range")
    if _KINDS["array"](doc):
        say(schema.get("minItems", 0) <= len(doc) <= schema.get("maxItems", len(doc)), "wrong number of items")
        if schema.get("uniqueItems"):
            seen = [json.dumps(x, sort_keys=True, cls=FrozenEncoder) for x in doc]
            say(len(seen) == len(set(seen)), "items repeat")
        if "items" in schema:
            for i, x in enumerate(doc):
                out += errors(x, schema["items"], root, f"{at}[{i}]")
    if _KINDS["object"](doc):
        out += _object_errors(doc, schema, root, at)
    for x in schema.get("allOf", []):
        out += errors(doc, x, root, at)
    for key, good in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if key in schema:
            say(good(sum(not errors(doc, x, root, at) for x in schema[key])), f"{key} does not hold")
    if "not" in schema:
        say(errors(doc, schema["not"], root, at), "matches what it must not")
    return out


def _object_errors(doc: dict, schema: dict, root: dict, at: str) -> list[str]:
    out = [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in doc]
    if not schema.get("minProperties", 0) <= len(doc) <= schema.get("maxProperties", len(doc)):
        out.append(f"{at}: wrong number of properties")
    for k, v in doc.items():
        if "propertyNames" in schema:
            out += errors(k, schema["propertyNames"], root, f"{at} name {k}")
        known = k in schema.get("properties", {})
        if known:
            out += errors(v, schema["properties"][k], root, f"{at}.{k}")
        for pattern, x in schema.get("patternProperties", {}).items():
            if re.search(pattern, k):
                known = True
                out += errors(v, x, root, f"{at}.{k}")
        if not known and "additionalProperties" in schema:
            out += errors(v, schema["additionalProperties"], root, f"{at}.{k}")
    return out


def validate_json(schema: dict, source: object) -> object | None:
    """The document if it is valid, else None."""
    doc = load_json(source)
    return None if errors(doc, schema) else doc
