"""Terms of a text by byte classes: a term is a longest run of kept characters, A-Z in lower case.

All characters beyond ASCII are kept; of ASCII the letters, or the letters and digits.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa

from seqlake.llm.common import words


def byte_table(digits: bool) -> bytes:
    """What each byte of UTF-8 becomes: a kept one itself, A-Z lower case, any other a space."""
    kept = string.ascii_letters + (string.digits if digits else "")
    return bytes(ord(chr(code).lower()) if chr(code) in kept else code if code >= 0x80 else 0x20 for code in range(256))


LETTERS = byte_table(digits=False)
LETTERS_DIGITS = byte_table(digits=True)


def terms(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """All terms, text after text, and their number per text. A null text has none."""
    if len(texts) == 0:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    texts = texts.cast(pa.string()).fill_null("")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    start, end = int(places[0]), int(places[-1])
    folded = data.slice(start, end - start).to_pybytes().translate(table) if end > start else b""
    return words(
        pa.StringArray.from_buffers(len(texts), pa.py_buffer((places - start).tobytes()), pa.py_buffer(folded))
    )
