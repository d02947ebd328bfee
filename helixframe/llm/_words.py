"""Words of whole texts in Arrow arrays: runs of ASCII digits and letters and of all signs beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Each byte of UTF-8 as it is in a word, or a space.
IN_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def written(texts: pa.Array) -> pa.Array:
    """``texts``, or bytes of UTF-8, with words of lower-case letters between spaces."""
    whole = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, 8 * whole.offset) if len(whole) else np.zeros(1, np.int64)
    held = whole.buffers()[2]
    data = bytes(memoryview(held)[offsets[0] : offsets[-1]]).translate(IN_WORDS) if held else b""
    return pa.Array.from_buffers(pa.large_binary(), len(whole), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)])


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words one after another, and where each text's begin and the last one's end."""
    parts = pc.split_pattern(written(texts), b" ")
    flat = parts.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)
    bounds = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[parts.offsets.to_numpy()]
    return flat.filter(real).dictionary_encode(), bounds
