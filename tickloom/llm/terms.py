"""Terms of a text: maximal runs of bytes that a class allows, with A-Z lower-cased and nothing else.

All bytes of 128 and above belong to terms, so that runs of UTF-8 bytes are runs of code points.
"""

from __future__ import annotations

LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = b"0123456789"


def term_table(ascii_allowed: bytes) -> bytes:
    """For terms_of(): every other ASCII byte becomes a space."""
    return bytes(b if b > 127 else (bytes([b]).lower()[0] if b in ascii_allowed else 32) for b in range(256))


def terms_of(data: bytes, table: bytes) -> list[bytes]:
    """data: UTF-8; bytes.split() cuts at ASCII white space, of which only spaces are left."""
    return data.translate(table).split()
