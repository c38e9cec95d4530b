"""JSON and labelled rows out of free text: the scans that expressions cannot express, as Arrow-batched functions."""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as Y


def first_object(text: str) -> dict | None:
    """The text as a JSON object, or the first balanced object inside it."""
    try:
        whole = json.loads(text)
    except ValueError:
        whole = None
        read = json.JSONDecoder().raw_decode
        for m in re.finditer(r"\{", text):
            try:
                part, _ = read(text, m.start())
            except ValueError:
                continue
            return part
    return whole if isinstance(whole, dict) else None


def any_json(text: str) -> Any:
    """The text, the inside of its code fence, or its outermost list or object, as JSON."""
    body = text.strip()
    if m := re.search(r"(?si)```(?:json)?\s*(.*?)```", body):
        body = m.group(1).strip()
    spans = [body] + [body[body.find(a) : body.rfind(b) + 1] for a, b in ("[]", "{}") if 0 <= body.find(a) < body.rfind(b)]
    for s in filter(None, spans):
        try:
            return json.loads(s)
        except ValueError:
            continue
    return None


def predictions(answer: str) -> list:
    """K3: an answer as a list of predictions: a JSON list as it is, an object alone, other text in a list of its own."""
    found = any_json(answer)
    return found if isinstance(found, list) else [found] if isinstance(found, dict) else [[answer]]


def labelled_rows(text: str) -> list[dict[str, str]]:
    """Rows of a search tool's answer: JSON data or results, else blocks of Title:, URL: and content lines."""
    try:
        data = json.loads(text)
    except ValueError:
        rows: list[dict[str, list[str]]] = []
        for line in text.splitlines():
            m = re.match(r"(Title|URL Source|URL):(.*)", line)
            if m and m[1] == "Title":
                rows.append({"title": [m[2].strip()], "url": [], "content": []})
            elif rows or m:
                rows = rows or [{"title": [], "url": [], "content": []}]
                rows[-1]["url" if m else "content"].append(m[2].strip() if m else line)
        return [{"title": r["title"][-1] if r["title"] else "", "url": r["url"][-1] if r["url"] else "", "content": "\n".join(r["content"]).strip()} for r in rows]
    data = data.get("data", data.get("results")) if isinstance(data, dict) else data
    data = data.get("results", []) if isinstance(data, dict) else data
    pick = lambda row, *names: next((str(row[n]) for n in names if row.get(n)), "")
    return [{"title": pick(x, "title", "name", "url"), "url": pick(x, "url", "link", "href"), "content": pick(x, "content", "description", "title")} for x in data or [] if isinstance(x, dict)]


def urls_within(text: str) -> list[str]:
    """The distinct http(s) urls under url keys anywhere in a JSON text, in order."""
    try:
        stack = [json.loads(text)]
    except ValueError:
        return []
    out: dict[str, None] = {}
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            u = x.get("url")
            if isinstance(u, str) and re.match("https?://", u):
                out.setdefault(u)
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)
    return list(out)


def _column(kind: Y.DataType, arrow: pa.DataType, f):
    @F.arrow_udf(kind)
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in text.to_pylist()], arrow)

    return run


_dump = lambda x: None if x is None else json.dumps(x, ensure_ascii=False)
_ROW = pa.struct([("title", pa.string()), ("url", pa.string()), ("content", pa.string())])
object_in = _column(Y.StringType(), pa.string(), lambda t: _dump(first_object(t)))
json_in = _column(Y.StringType(), pa.string(), lambda t: _dump(any_json(t)))
predictions_of = _column(Y.StringType(), pa.string(), lambda t: _dump(predictions(t)))
rows_in = _column(Y.ArrayType(Y.StructType([Y.StructField(n, Y.StringType()) for n in ("title", "url", "content")])), pa.list_(_ROW), labelled_rows)
urls_in = _column(Y.ArrayType(Y.StringType()), pa.list_(pa.string()), urls_within)
