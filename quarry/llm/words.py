"""Words of letters, digits and all that isn't ASCII, with A-Z lower-cased, as UTF-8 bytes: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""

from __future__ import annotations

from collections.abc import Iterator

#: Each byte as itself, A-Z as a-z, and all other ASCII but a-z and 0-9 as a space.
PLAIN = bytes(c | 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
CHUNK = 1 << 20


def words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def chunks(text: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text in parts, so that a text of any length takes little memory; a part ends where a word ends."""
    plain, at = text.translate(PLAIN), 0
    while at < len(plain):
        end = plain.find(b" ", at + size) if at + size < len(plain) else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end
