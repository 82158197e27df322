"""Bytes of a page to text: the declared encoding first, then what the bytes look like."""

from __future__ import annotations

import re

#: Bytes in plain ASCII that are kept on both sides of a stretch with others.
AROUND = 32

_OUTSIDE = re.compile(rb"[\x80-\xff]+(?:[\x00-\x7f]{1,%d}[\x80-\xff]+)*" % (2 * AROUND))
_DECLARED = re.compile(rb"charset=[\"']?([\w-]+)", re.I)


def guess(raw: bytes) -> str | None:
    """An encoding by byte order mark or by strict decoding, else by all stretches outside ASCII; null if nothing fits."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return name
    if not raw:
        return None
    for name in ("ascii", "utf-8"):
        try:
            raw.decode(name)
            return name
        except UnicodeDecodeError:
            pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(b"".join(raw[max(m.start() - AROUND, 0) : m.end() + AROUND] for m in _OUTSIDE.finditer(raw)) or raw).best()
        return best.encoding if best else None
    except ImportError:
        return None


def decode(raw: bytes) -> tuple[str, str | None, str | None, str]:
    """(text, declared, detected, used): the first of declared, detected, utf-8 and gb18030 that decodes strictly, else utf-8 with replacement."""
    m = _DECLARED.search(raw[:4096])
    declared = m.group(1).decode("ascii").lower() if m else None
    detected = guess(raw)
    for name in dict.fromkeys(x for x in (declared, detected, "utf-8", "gb18030") if x):
        try:
            return raw.decode(name), declared, detected, name
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace"), declared, detected, "utf-8(replace)"
