"""The two places where JSON of unknown shape needs Python: listing string leaves and
putting new values back. Both work on Arrow batches, one session per row; rules and
replacements stay in Spark expressions between them.
"""

from __future__ import annotations

import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column

from tracesieve.functions.slices import sliced, sliced_pairs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF_FIELDS = "leaf:int,path:string,value:string,mime:string"
PARSED_TYPE = f"struct<ok:boolean,error:string,compact:string,leaves:array<struct<{LEAF_FIELDS}>>>"

# Why a session fails.
NOT_JSON = "neither JSON nor JSON lines"
TOO_DEEP = "JSON nested too deep"

# Fixed value: keys that stand in a path without brackets, as child_path writes them.
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_SURROGATE = re.compile("[\ud800-\udfff]")


def _number(text: str):
    value = float(text)
    if value in (float("inf"), float("-inf")):
        return None
    return int(value) if value.is_integer() and abs(value) < 1e21 else value


def _integer(text: str):
    # The interpreter converts so many digits at most; longer numbers are beyond any double.
    return int(text) if len(text) <= 4000 else _number(text)


def _not_json(name: str):
    raise ValueError(name)


def strict_loads(text: str):
    return json.loads(
        text, parse_float=_number, parse_int=_integer, parse_constant=_not_json
    )


def parse_session_text(text: str):
    """One JSON value, else JSON lines as ``{"lines": [...]}``; raises when neither."""
    try:
        return strict_loads(text)
    except ValueError:
        return {"lines": [strict_loads(line) for line in text.split("\n") if line.strip()]}


def compact(tree) -> str:
    text = json.dumps(tree, ensure_ascii=False, separators=(",", ":"))
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def child_path(path: str, key: str) -> str:
    if _IDENTIFIER.match(key):
        return f"{path}.{key}"
    return f"{path}[{json.dumps(key, ensure_ascii=False)}]"


def walk_strings(tree):
    """Yield ``(path, container, key, mime)`` of every string leaf in document order.

    ``mime`` is the ``mimeType`` string beside a leaf named ``data``. A bare string is wrapped
    in a list, which makes it a leaf as well.
    """
    if isinstance(tree, list | dict):
        stack = [_children(tree, "$")]
    else:
        stack = [(iter([(0, "$")]), [tree], None)]
    while stack:
        keys, box, mime = stack[-1]
        step = next(keys, None)
        if step is None:
            stack.pop()
            continue
        key, path = step
        value = box[key]
        if isinstance(value, str):
            yield path, box, key, mime if key == "data" else None
        elif isinstance(value, list | dict):
            stack.append(_children(value, path))


def _children(box, path: str):
    if isinstance(box, list):
        return iter([(i, f"{path}[{i}]") for i in range(len(box))]), box, None
    mime = box.get("mimeType")
    return (
        iter([(k, child_path(path, k)) for k in box]),
        box,
        mime if isinstance(mime, str) else None,
    )


def _clean(text: str) -> str:
    return _SURROGATE.sub("�", text)


def parse_and_list(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        if text is None:
            rows.append(None)
            continue
        try:
            tree = parse_session_text(text)
            leaves = [
                {
                    "leaf": i,
                    "path": _clean(path),
                    "value": _clean(box[key]),
                    "mime": None if mime is None else _clean(mime),
                }
                for i, (path, box, key, mime) in enumerate(walk_strings(tree))
            ]
            rows.append({"ok": True, "error": None, "compact": compact(tree), "leaves": leaves})
        except (ValueError, RecursionError) as fault:
            error = NOT_JSON if isinstance(fault, ValueError) else TOO_DEEP
            rows.append({"ok": False, "error": error, "compact": None, "leaves": None})
    leaf = pa.struct(
        [("leaf", pa.int32()), ("path", pa.string()), ("value", pa.string()), ("mime", pa.string())]
    )
    return pa.array(
        rows,
        pa.struct([("ok", pa.bool_()), ("error", pa.string()), ("compact", pa.string()), ("leaves", pa.list_(leaf))]),
    )


def put_back(texts: pa.Array, changes: pa.Array) -> pa.Array:
    """Compact JSON with the listed leaves replaced; null where there is nothing to change."""
    out = []
    for text, changed in zip(texts.to_pylist(), changes.to_pylist()):
        if text is None:
            out.append(None)
            continue
        tree = strict_loads(text)
        new = {c["leaf"]: c["text"] for c in changed}
        if new and isinstance(tree, str):
            tree = new[0]
        elif new:
            for i, (_, box, key, _) in enumerate(walk_strings(tree)):
                if i in new:
                    box[key] = new[i]
        out.append(compact(tree))
    return pa.array(out, pa.string())


def parsed(content: Column) -> Column:
    """``struct<ok, error, compact, leaves>`` of a session; ``ok`` is false when it is not JSON."""
    return sliced(parse_and_list, PARSED_TYPE)(content)


def with_leaves(compact_json: Column, changes: Column) -> Column:
    """``changes`` is ``array<struct<leaf, text>>``."""
    return sliced_pairs(put_back, "string")(compact_json, changes)
