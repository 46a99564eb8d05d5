"""Bencoded files: what they name and hold, and the digest of their info dictionary."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TORRENT = T.StructType([T.StructField("infohash", T.StringType()), T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("files", T.IntegerType())])



def parse(raw: bytes) -> tuple[object, dict[bytes, tuple[int, int]]]:
    """The value of a bencoded text, and where the values of its outermost dictionary begin and end. ValueError if it isn't one.

    Open lists and dictionaries are kept on a stack of its own, so that depth is no limit.
    """
    at, stack, spans = 0, [], {}
    while True:
        kind = raw[at : at + 1]
        begin = at
        if kind in (b"l", b"d"):
            stack.append(([], kind, begin))
            at += 1
            continue
        if kind == b"e" and stack:
            items, kind, begin = stack.pop()
            at += 1
            if kind == b"l":
                value = items
            else:
                if len(items) % 2 or not all(isinstance(k, bytes) for k in items[::2]):
                    raise ValueError("keys and values don't pair")
                value = dict(zip(items[::2], items[1::2]))
        elif kind == b"i":
            stop = raw.find(b"e", at)
            digits = raw[at + 1 : stop] if stop > 0 else b""
            if not digits.removeprefix(b"-").isdigit() or len(digits) > 20:
                raise ValueError("no number")
            value, at = int(digits), stop + 1
        elif kind.isdigit():
            colon = raw.find(b":", at, at + 12)
            if colon < 0 or not raw[at:colon].isdigit():
                raise ValueError("no length")
            size = int(raw[at:colon])
            value, at = raw[colon + 1 : colon + 1 + size], colon + 1 + size
            if len(value) < size:
                raise ValueError("cut")
        else:
            raise ValueError("neither value nor end")
        if not stack:
            if at != len(raw):
                raise ValueError("something follows")
            return value, spans
        items, outer, _ = stack[-1]
        if len(stack) == 1 and outer == b"d" and len(items) % 2 and isinstance(items[-1], bytes):
            spans[items[-1]] = (begin, at)
        items.append(value)


def describe(raw: bytes | None) -> tuple[str | None, str | None, int | None, int | None]:
    """(infohash, name, size, files) of a torrent; all null if it isn't one or its sizes aren't numbers."""
    none = (None, None, None, None)
    try:
        whole, spans = parse(raw) if raw else (None, {})
        info = whole[b"info"]
        listed = info[b"files"] if b"files" in info else [info]
        sizes = [f[b"length"] for f in listed]
        name = info.get(b"name.utf-8", info[b"name"]).decode("utf-8", "replace")
        if not all(isinstance(s, int) and s >= 0 for s in sizes):
            return none
    except (ValueError, KeyError, TypeError, AttributeError):
        return none
    begin, end = spans[b"info"]
    return hashlib.sha1(raw[begin:end]).hexdigest().upper(), name, sum(sizes), len(sizes)


@F.pandas_udf(TORRENT)
def torrent(content: pd.Series) -> pd.DataFrame:
    """A bencoded file as (infohash, name, size, files): the SHA-1 of its info as it stands, and the sum of lengths."""
    out = pd.DataFrame([describe(None if raw is None else bytes(raw)) for raw in content], columns=["infohash", "name", "size", "files"])
    return out.astype({"size": "Int64", "files": "Int32"})
