"""Words of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased, as UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are split in pieces of about this many bytes, which bounds the words held at once.
PIECE = 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(raw: np.ndarray | bytes) -> Iterator[list[bytes]]:
    """The words of one text's bytes, in order, a list for each piece of it."""
    folded = bytes(raw).translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end
