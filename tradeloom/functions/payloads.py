"""JSON payloads: tolerant parsing, packing, sentences and differences."""

from __future__ import annotations

import base64
import gzip
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def repair_json(text: str | None):
    """A JSON value from text that a model or a person wrote; None if there is none.

    Thinking tags and code fences go, smart quotes become straight, bare keys are quoted, commas before an end and
    what follows the value are dropped, and open strings, lists and objects are closed.
    """
    if not text:
        return None
    text = re.sub(r"(?s)<think>.*?</think>", "", text)
    text = re.sub(r"```(?:json)?", "", text).translate(str.maketrans("“”‘’", "\"\"''"))
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    out, closing, quoted, skip = [], [], False, False
    for ch in text[start:]:
        out.append(ch)
        if quoted:
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            closing.append("}" if ch == "{" else "]")
        elif ch in "}]":
            if not closing or closing[-1] != ch:
                out.pop()
                continue
            closing.pop()
            if not closing:
                break
    body = "".join(out) + '"' * quoted
    body = re.sub(r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", r'\1"\2":', body)
    body = re.sub(r"[,:\s]+$", "", body) if closing else body
    body += "".join(reversed(closing))
    body = re.sub(r",\s*([}\]])", r"\1", body)
    try:
        return json.loads(body)
    except ValueError:
        return None


def unpack(value) -> dict:
    """A payload given as object, JSON text, gzip bytes or their base64; unreadable text becomes {'text': ...}."""
    if value is None:
        return {}
    if isinstance(value, dict):
        return value
    if isinstance(value, str) and value.startswith("H4sI"):
        value = base64.b64decode(value)
    if isinstance(value, (bytes, bytearray)):
        value = gzip.decompress(bytes(value)).decode() if bytes(value[:2]) == b"\x1f\x8b" else bytes(value).decode("utf-8", "replace")
    try:
        out = json.loads(value)
    except ValueError:
        return {"text": value}
    while isinstance(out, dict) and isinstance(out.get("json_data"), (dict, str)):
        inner = out["json_data"]
        out = json.loads(inner) if isinstance(inner, str) else inner
    return out if isinstance(out, dict) else {"text": value}


def sentences(data: dict) -> str:
    """A payload as sentences: id, link and title first, then the other keys by name, without empty or repeated ones."""
    first = [k for k in ("id", "link", "title") if data.get(k)]
    out = []
    for key in first + sorted(k for k in data if k not in first):
        value = data[key]
        if isinstance(value, list):
            value = ", ".join(sentences(v) if isinstance(v, dict) else str(v) for v in value)
        elif isinstance(value, dict):
            value = sentences(value)
        if value not in (None, "", 0):
            line = f"{key.replace('_', ' ')} is {value}."
            if line not in out:
                out.append(line)
    return " ".join(out)


def merge_lists(a: list[dict], b: list[dict], key: str) -> list[dict]:
    """All of a, then those of b whose key a does not have."""
    seen = {x.get(key) for x in a}
    return a + [x for x in b if x.get(key) not in seen]


def merged_bands(bands: list[dict | None], keys: dict[str, str]) -> dict:
    """What the bands of one image hold, as one payload: a later value wins unless it is null, empty or zero, objects are merged, and
    lists joined without repeats by their key (keys: list name to the key of its records)."""
    out: dict = {}
    for band in bands:
        for name, value in (band or {}).items():
            old = out.get(name)
            if isinstance(old, dict) and isinstance(value, dict):
                out[name] = merged_bands([old, value], keys)
            elif isinstance(old, list) and isinstance(value, list):
                out[name] = merge_lists(old, value, keys[name]) if name in keys else old + [v for v in value if v not in old]
            elif name not in out or value not in (None, "", 0):
                out[name] = value
    return out


def deep_diff(a, b, path=""):
    """Paths at which two payloads differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [p for k in sorted({*a, *b}) for p in deep_diff(a.get(k), b.get(k), f"{path}.{k}" if path else k)]
    return [] if a == b else [path]


@F.pandas_udf(T.StringType())
def repaired(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json.dumps(got, sort_keys=True) if (got := repair_json(t)) is not None else None)


@F.pandas_udf(T.BinaryType())
def gzipped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: gzip.compress(t.encode(), mtime=0) if t is not None else None)


@F.pandas_udf(T.StringType())
def gunzipped(data: pd.Series) -> pd.Series:
    return data.map(lambda b: gzip.decompress(b).decode() if b is not None else None)


@F.pandas_udf(T.StringType())
def unpacked(data: pd.Series) -> pd.Series:
    """unpack() as JSON, its keys in order."""
    return data.map(lambda v: json.dumps(unpack(v), sort_keys=True, ensure_ascii=False), na_action=None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def differences(a: pd.Series, b: pd.Series) -> pd.Series:
    """Paths at which two JSON payloads differ; a broken one counts as empty."""
    return pd.Series([deep_diff(unpack(x), unpack(y)) for x, y in zip(a, b)])


def merged_by(a, b, key: str):
    """The values of `key` in two JSON lists of records, those of the second behind what the first has."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[r.get(key) for r in merge_lists(json.loads(p or "[]"), json.loads(q or "[]"), key)] for p, q in zip(x, y)])

    return run(a, b)
