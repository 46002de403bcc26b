"""A CBOR subset for metadata: null, bool, 64-bit integers, floats, text, bytes, arrays and maps with text keys, definite lengths only."""
from __future__ import annotations

import json
import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nested levels that are read.
MAX_DEPTH = 64


class CborError(ValueError):
    pass


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, fmt, limit in ((24, ">B", 1 << 8), (25, ">H", 1 << 16), (26, ">I", 1 << 32), (27, ">Q", 1 << 64)):
        if n < limit:
            return bytes([major << 5 | code]) + struct.pack(fmt, n)
    raise CborError("integer out of range")


def encode(value) -> bytes:
    """The shortest form of a value; floats as eight bytes."""
    if value is None:
        return b"\xf6"
    if value is True or value is False:
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise CborError("integer out of range")
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, (bytes, bytearray)):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, (list, tuple)):
        return _head(4, len(value)) + b"".join(map(encode, value))
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise CborError("keys must be text")
        return _head(5, len(value)) + b"".join(encode(k) + encode(v) for k, v in value.items())
    raise CborError(f"cannot encode {type(value).__name__}")


def _item(raw: bytes, at: int, depth: int):
    if depth > MAX_DEPTH:
        raise CborError("nested too deeply")
    if at >= len(raw):
        raise CborError("truncated")
    major, info = raw[at] >> 5, raw[at] & 31
    at += 1
    if info > 27:
        raise CborError("indefinite lengths are not supported")
    size = 1 << (info - 24) if info >= 24 else 0
    if at + size > len(raw):
        raise CborError("truncated")
    arg, at = (int.from_bytes(raw[at : at + size]) if size else info), at + size
    if major == 7:
        simple = {20: False, 21: True, 22: None}
        if info in simple:
            return simple[info], at
        if info in (25, 26, 27):
            return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[info], raw[at - size : at])[0], at
        raise CborError("unknown simple value")
    if major <= 1:
        if arg >= 1 << 63:
            raise CborError("integer out of range")
        return (arg if major == 0 else -1 - arg), at
    if major in (2, 3):
        if at + arg > len(raw):
            raise CborError("truncated")
        part = raw[at : at + arg]
        try:
            return (part if major == 2 else part.decode()), at + arg
        except UnicodeDecodeError as e:
            raise CborError("text is no UTF-8") from e
    if major == 4:
        out = []
        for _ in range(arg):
            v, at = _item(raw, at, depth + 1)
            out.append(v)
        return out, at
    if major == 5:
        out = {}
        for _ in range(arg):
            k, at = _item(raw, at, depth + 1)
            if not isinstance(k, str):
                raise CborError("keys must be text")
            v, at = _item(raw, at, depth + 1)
            out.setdefault(k, v)
        return out, at
    raise CborError("tags are not supported")


def decode(raw: bytes):
    """The value of exactly these bytes; of equal keys in a map the first counts."""
    value, end = _item(raw, 0, 0)
    if end != len(raw):
        raise CborError("trailing bytes")
    return value


def _plain(v):
    """Bytes as hex text, so that the value has a JSON form."""
    return v.hex() if isinstance(v, bytes) else [_plain(x) for x in v] if isinstance(v, list) else {k: _plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def _to_json(b):
    try:
        return None if b is None else json.dumps(_plain(decode(b)))
    except CborError:
        return None


def _from_json(s):
    try:
        return None if s is None else encode(json.loads(s))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def to_json(b):  # noqa: ANN001, ANN201
    """JSON of CBOR bytes, null where they are malformed; parse_json makes a VARIANT of it."""
    return b.map(_to_json)


@F.pandas_udf(T.BinaryType())
def from_json(s):  # noqa: ANN001, ANN201
    """CBOR of JSON, null where it is malformed."""
    return s.map(_from_json)
