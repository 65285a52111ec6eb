"""JSON trees taken apart, in order, for rules that are written over columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()


def _record(*fields: str, **more: T.DataType) -> T.StructType:
    return T.StructType([*[T.StructField(f, _S) for f in fields], *[T.StructField(f, t) for f, t in more.items()]])


_ENTRY = _record("name", "quoted", "kind", "json")
_MEMBER = T.StructType([*_ENTRY.fields, T.StructField("entries", T.ArrayType(_ENTRY))])
#: A tree's outermost members, its labelled objects, and places of plain values that stand in none of them.
OUTLINE = _record("kind", members=T.ArrayType(_MEMBER), found=T.ArrayType(_record("path", "label", members=T.ArrayType(_MEMBER))), strays=T.ArrayType(_S))
LEAVES = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), *_record("path", "role", "kind", "value").fields]))


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _unique(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("repeated key")
    return found


def parsed(text: str | None):
    """Strict JSON: no repeated keys, no NaN, no infinities. What nests too deep to be read is no JSON either."""
    try:
        return json.loads(text or "", object_pairs_hook=_unique, parse_constant=_constant)
    except RecursionError:
        raise ValueError("nested too deep") from None


def dumped(value) -> str:
    """The canonical text of a value: sorted keys, no blanks, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def kind_of(value) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")


def children(value) -> list[tuple[str | int, object]]:
    """What a container holds, in its own order, with its key or place."""
    return list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []


def _entry(name, value) -> dict:
    return {"name": str(name), "quoted": dumped(str(name)), "kind": kind_of(value), "json": dumped(value)}


def _member(name, value) -> dict:
    return {**_entry(name, value), "entries": [_entry(k, v) for k, v in children(value)]}


@F.udf(returnType=OUTLINE, useArrow=True)
def outline(text: str, inside: str, label: str):
    """What a JSON text has, in order: its members, and below the member `inside` every outermost object whose member `label` is a plain value.

    Null if the text isn't strict JSON. Containers are gone through with a list, however deep they are.
    """
    try:
        return _outline(parsed(text), inside, label)
    except (ValueError, RecursionError):
        return None


def _outline(whole, inside: str, label: str) -> dict:
    tops = [_member(k, v) for k, v in children(whole)]
    found, strays, todo = [], [], [((), whole[inside])] if isinstance(whole, dict) and inside in whole else []
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict) and label in value and kind_of(value[label]) not in ("object", "array"):
            named = value[label] if isinstance(value[label], str) else dumped(value[label])
            found.append({"path": dumped(list(path)), "label": named, "members": [_member(k, v) for k, v in value.items()]})
        elif isinstance(value, dict | list):
            todo.extend(((*path, k), v) for k, v in reversed(children(value)))
        else:
            strays.append(dumped(list(path)))
    return {"kind": kind_of(whole), "members": tops, "found": found, "strays": strays}


#: Plain values that `tree_leaves` holds at once, those of one text aside.
LEAVES_AT_ONCE = 1 << 15
_LEAF = [("place", pa.int32()), *[(n, pa.string()) for n in ("path", "role", "kind", "value")]]
_LEAVES = pa.list_(pa.struct(_LEAF))


def leaf_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The plain values of texts, a list for each, in arrays that end where LEAVES_AT_ONCE values are reached."""
    for texts in batches:
        held, size = [], 0
        for text in texts:
            held.append(leaves := _leaves(text.as_py()))
            size += len(leaves or ())
            if size >= LEAVES_AT_ONCE:
                yield pa.array(held, _LEAVES)
                held, size = [], 0
        if held:
            yield pa.array(held, _LEAVES)


@F.arrow_udf(returnType=LEAVES)
def tree_leaves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """All plain values and empty containers of a JSON text, by sorted keys: `place` from 0, `path`, `role` (the last key on the path), `kind`, `value` (strings as they are). Null for no JSON."""
    yield from leaf_batches(batches)


tree_leaves = tree_leaves.asNondeterministic()  # else a filter on its result runs it once more


def _leaves(text: str | None) -> list[dict] | None:
    try:
        todo = [((), None, parsed(text))]
    except ValueError:
        return None
    out = []
    while todo:
        path, role, value = todo.pop()
        below = sorted(children(value)) if isinstance(value, dict) else children(value)
        if below:
            todo.extend(((*path, k), k if isinstance(value, dict) else role, v) for k, v in reversed(below))
        else:
            out.append({"place": len(out), "path": dumped(list(path)), "role": role, "kind": kind_of(value), "value": value if isinstance(value, str) else dumped(value)})
    return out
