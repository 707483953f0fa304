"""Digests of bytes and of records."""

import struct

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

HEX64 = "^[0-9a-fA-F]{64}$"


def sha256_text(c: Column) -> Column:
    """A SHA-256 in hex, trimmed and lower-cased; null if it isn't one."""
    return F.when(F.trim(c).rlike(HEX64), F.lower(F.trim(c)))


def record_fingerprint(*fields: Column) -> Column:
    """SHA-256 of the fields' UTF-8, each behind its length as 64 bits, least byte first."""

    def framed(f: Column) -> Column:
        data = F.encode(F.coalesce(f.cast("string"), F.lit("")), "UTF-8")
        digits = F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")
        turned = F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2)))
        return F.concat(F.hex(F.unhex(turned)), F.hex(data))

    return F.sha2(F.unhex(F.concat(*map(framed, fields))), 256)


def _rotate(x: int, n: int) -> int:
    n %= 32
    return (x << n | x >> (32 - n)) & 0xFFFFFFFF


def sm3(data: bytes) -> str:
    """The SM3 digest (GB/T 32905) in hex."""
    v = [0x7380166F, 0x4914B2B9, 0x172442D7, 0xDA8A0600, 0xA96F30BC, 0x163138AA, 0xE38DEE4D, 0xB0FB0E4E]
    mixed = lambda x: x ^ _rotate(x, 15) ^ _rotate(x, 23)
    message = data + b"\x80" + b"\0" * (-(len(data) + 9) % 64) + struct.pack(">Q", 8 * len(data))
    for at in range(0, len(message), 64):
        w = list(struct.unpack_from(">16I", message, at))
        for i in range(16, 68):
            w.append(mixed(w[i - 16] ^ w[i - 9] ^ _rotate(w[i - 3], 15)) ^ _rotate(w[i - 13], 7) ^ w[i - 6])
        a, b, c, d, e, f, g, h = v
        for i in range(64):
            constant = 0x79CC4519 if i < 16 else 0x7A879D8A
            s1 = _rotate((_rotate(a, 12) + e + _rotate(constant, i)) & 0xFFFFFFFF, 7)
            s2 = s1 ^ _rotate(a, 12)
            choose_a = a ^ b ^ c if i < 16 else a & b | a & c | b & c
            choose_e = e ^ f ^ g if i < 16 else e & f | ~e & g
            t1 = (choose_a + d + s2 + (w[i] ^ w[i + 4])) & 0xFFFFFFFF
            t2 = (choose_e + h + s1 + w[i]) & 0xFFFFFFFF
            a, b, c, d = t1, a, _rotate(b, 9), c
            e, f, g, h = t2 ^ _rotate(t2, 9) ^ _rotate(t2, 17), e, _rotate(f, 19), g
        v = [x ^ y for x, y in zip(v, (a, b, c, d, e, f, g, h), strict=True)]
    return struct.pack(">8I", *v).hex()


@F.pandas_udf(StringType())
def sm3_hex(data: pd.Series) -> pd.Series:
    """SM3 of binary values, a batch at a time; Spark has no function for it."""
    return data.map(lambda x: sm3(bytes(x)), na_action="ignore")
