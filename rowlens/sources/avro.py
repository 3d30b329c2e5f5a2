"""A reader of Avro object container files, as far as table manifests need it: plain Python, null and deflate codecs."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

from rowlens.errors import DiffError


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise DiffError("avro: file is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def blob(self) -> bytes:
        return self.take(self.long())


def _read(schema, r: _Bytes, names: dict):
    if isinstance(schema, list):
        return _read(schema[r.long()], r, names)
    t = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(t, (dict, list)):
        return _read(t, r, names)
    if t in names:
        return _read(names[t], r, names)
    if t == "record":
        return {f["name"]: _read(f["type"], r, names) for f in schema["fields"]}
    if t in ("int", "long"):
        return r.long()
    if t in ("string", "bytes"):
        return r.blob().decode() if t == "string" else r.blob()
    if t in ("null", "boolean"):
        return None if t == "null" else bool(r.take(1)[0])
    if t in ("float", "double"):
        return struct.unpack("<f" if t == "float" else "<d", r.take(4 if t == "float" else 8))[0]
    if t == "fixed":
        return r.take(schema["size"])
    if t == "enum":
        return schema["symbols"][r.long()]
    if t in ("array", "map"):
        items, pairs = [], {}
        while n := r.long():
            if n < 0:
                n = -n
                r.long()
            for _ in range(n):
                if t == "array":
                    items.append(_read(schema["items"], r, names))
                else:
                    key = r.blob().decode()
                    pairs[key] = _read(schema["values"], r, names)
        return items if t == "array" else pairs
    raise DiffError(f"avro: unknown type {t!r}")


def _names(schema, out: dict) -> dict:
    if isinstance(schema, list):
        for s in schema:
            _names(s, out)
    elif isinstance(schema, dict):
        if schema.get("type") in ("record", "fixed", "enum") and "name" in schema:
            out[schema["name"]] = schema
            if "namespace" in schema:
                out[f"{schema['namespace']}.{schema['name']}"] = schema
        for s in ([f["type"] for f in schema.get("fields", [])] + [schema[k] for k in ("items", "values") if k in schema] + ([schema["type"]] if isinstance(schema.get("type"), (dict, list)) else [])):
            _names(s, out)
    return out


def records(data: bytes) -> Iterator[dict]:
    r = _Bytes(data)
    if r.take(4) != b"Obj\x01":
        raise DiffError("avro: not a container file")
    meta = _read({"type": "map", "values": "bytes"}, r, {})
    mark = r.take(16)
    schema = json.loads(meta["avro.schema"])
    names, codec = _names(schema, {}), meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise DiffError(f"avro: codec {codec!r} is not supported")
    while r.at < len(data):
        n, block = r.long(), r.blob()
        part = _Bytes(zlib.decompress(block, -15) if codec == "deflate" else block)
        for _ in range(n):
            yield _read(schema, part, names)
        if r.take(16) != mark:
            raise DiffError("avro: block marker does not match")


def written(schema: dict, rows: list[dict]) -> bytes:
    """An uncompressed container file of records with int, long, string, nullable and record fields."""

    def long(n: int) -> bytes:
        n, out = (n << 1) ^ (n >> 63), bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    def blob(b: bytes) -> bytes:
        return long(len(b)) + b

    def value(t, v) -> bytes:
        if isinstance(t, list):
            i = t.index("null") if v is None else next(i for i, x in enumerate(t) if x != "null")
            return long(i) + value(t[i], v)
        if isinstance(t, dict):
            return b"".join(value(f["type"], v.get(f["name"])) for f in t["fields"])
        return b"" if t == "null" else long(v) if t in ("int", "long") else blob(v.encode())

    head = {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"null"}
    body, mark = b"".join(value(schema, r) for r in rows), b"rowlens-avro-end"
    return b"Obj\x01" + long(len(head)) + b"".join(blob(k.encode()) + blob(v) for k, v in head.items()) + long(0) + mark + long(len(rows)) + blob(body) + mark
