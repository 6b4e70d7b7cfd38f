"""Terms of a text, as bytes: what a byte table makes of it, cut at blanks."""

from __future__ import annotations

LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
DIGITS = bytes(range(0x30, 0x3A))


def folding(kept: bytes) -> bytes:
    """A table for ``bytes.translate``: A-Z become a-z, and all bytes but ``kept`` a blank. UTF-8 stays valid, since no byte over 0x7F is touched."""
    lower = bytes(range(256)).lower()
    return bytes(lower[b] if b in kept else 0x20 for b in range(256))
