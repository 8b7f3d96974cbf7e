"""Decoding of base58 and of little-endian records, Arrow-batched."""

from __future__ import annotations

import base64
import struct
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the base58 alphabet
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58_bytes(text: str) -> bytes:
    n = 0
    for c in text:
        n = n * 58 + ALPHABET.index(c)
    return b"\0" * (len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def base58_text(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = ALPHABET[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


@F.pandas_udf(T.BinaryType())
def base58_decode(text: pd.Series) -> pd.Series:
    """Bytes of base58 text, null where a character is none of the alphabet's."""

    def one(t):
        try:
            return None if t is None else base58_bytes(t)
        except ValueError:
            return None

    return text.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def base58_encode(data: pd.Series) -> pd.Series:
    return data.map(lambda b: base58_text(bytes(b)), na_action="ignore")


class Reader:
    """Reads little-endian fields and length-prefixed strings; past the end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("past the end")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def text(self) -> str:
        return self.take(self.number("I")).decode("utf-8", "replace")


def decode_record(data: bytes, tag: bytes, fields: list[tuple[str, str]]) -> dict | None:
    """Fields (name, code) after an 8-byte tag; code is a struct code, `s` for text or `k` for a 32-byte key in base58."""
    r = Reader(data)
    try:
        if r.take(len(tag)) != tag:
            return None
        return {n: r.text() if c == "s" else base58_text(r.take(32)) if c == "k" else r.number(c) for n, c in fields}
    except (ValueError, struct.error):
        return None


def record_decoder(tag: bytes, fields: list[tuple[str, str]], from_base64: bool = False):
    """A pandas UDF from binary (or base64 text) to a struct of the fields, null where the record is another or cut short."""
    kinds = {"s": T.StringType(), "k": T.StringType(), "Q": T.DecimalType(20, 0)}

    @F.pandas_udf(T.StructType([T.StructField(n, kinds.get(c, T.LongType())) for n, c in fields]))
    def decode(data: pd.Series) -> pd.DataFrame:
        rows = []
        for d in data:
            try:
                got = None if d is None else decode_record(base64.b64decode(d, validate=True) if from_base64 else bytes(d), tag, fields)
            except ValueError:
                got = None
            rows.append([None] * len(fields) if got is None else [Decimal(got[n]) if c == "Q" else got[n] for n, c in fields])
        return pd.DataFrame(rows, columns=[n for n, _ in fields], dtype=object)

    return decode
