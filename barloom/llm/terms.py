"""Terms of texts, read from the UTF-8 bytes in bounded slices: maximal runs of the bytes that a table keeps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes split at once; a slice ends between terms, so only a single longer term makes it grow.
SLICE = 1 << 20


def table(digits: bool) -> bytes:
    """For bytes.translate: ASCII letters in lower case, bytes of other characters and, if asked, digits stay; the rest turns to a space."""
    keep = [b >= 0x80 or chr(b).isalpha() or (digits and chr(b).isdigit()) for b in range(256)]
    return bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if keep[b] else 0x20 for b in range(256))


def split(text: bytes, kept: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists."""
    if len(text) <= SLICE:
        yield text.translate(kept).split()
        return
    rest = b""
    for at in range(0, len(text), SLICE):
        part = text[at : at + SLICE].translate(kept)
        end = part.rfind(b" ")
        if end < 0:
            rest += part
            continue
        yield (rest + part[:end]).split()
        rest = part[end:]
    yield rest.split()


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """A column's texts as bytes, one at a time; null is empty."""
    for value in batch.column(name).cast(pa.binary()):
        yield value.as_py() or b""
