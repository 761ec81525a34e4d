"""Terms of UTF-8 text as bytes, slice by slice: maximal runs of ASCII letters, digits and code points beyond ASCII.

All other ASCII characters separate. Only A-Z are lower-cased. Bytes of longer UTF-8 sequences are never ASCII, so bytes
give the same terms as characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

_SLICE = 1 << 20
#: Every byte that separates becomes a blank, A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: pa.Scalar) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time; nothing for null. A slice ends where a term does."""
    raw = text.as_buffer() if text.is_valid else None
    if raw is None:
        return
    at, size = 0, raw.size
    while at < size:
        end = min(size, at + _SLICE)
        part = raw.slice(at, end - at).to_pybytes().translate(_TABLE)
        while end < size and part[-1] != 32:  # to the end of the term that the slice cuts
            more = raw.slice(end, min(size - end, _SLICE)).to_pybytes().translate(_TABLE)
            cut = more.find(b" ") + 1 or len(more)
            part, end = part + more[:cut], end + cut
        at = end
        if found := part.split():
            yield found
