"""Byte budgets, page slices and cursors: what the driver does with an already limited result."""

from __future__ import annotations

import base64
import json
from hashlib import sha256

from ..functions.text import canonical_json


def serialized_size(value) -> int:
    """Bytes of the indented, ASCII-escaped form that a caller gets."""
    return len(json.dumps(value, indent=2).encode())


def pack_stop(items: list[dict], budget: int, smaller=None) -> tuple[list[dict], int]:
    """Items in order until one doesn't fit, even in its smaller form; and how many are left out."""
    out, used = [], 0
    for item in items:
        for form in (item, smaller(item)) if smaller else (item,):
            size = serialized_size(form)
            if used + size <= budget:
                out.append(form)
                used += size
                break
        else:
            break
    return out, len(items) - len(out)


def pack_groups(groups: list[list[dict]], budget: int, chars: int | None = None, counter=None, tokens: int | None = None) -> tuple[list[list[dict]], int]:
    """Whole groups, first fit: one that misses is skipped and later ones may still fit."""
    out: list[list[dict]] = []

    def fits(candidate):
        text = "".join(str(u.get("text", "")) for g in candidate for u in g)
        return serialized_size(candidate) <= budget and (chars is None or len(text) <= chars) and (counter is None or counter(text) <= tokens)

    for group in groups:
        if fits([*out, group]):
            out.append(group)
    return out, len(groups) - len(out)


def encode_cursor(kind: str, revision: str, position) -> str:
    body = canonical_json([kind, revision, position])
    return base64.urlsafe_b64encode(f"{body}{sha256(body.encode()).hexdigest()[:16]}".encode()).decode().rstrip("=")


def decode_cursor(token: str, kind: str) -> tuple[str, object]:
    """(revision, position); a ValueError for anything that encode_cursor didn't make for this kind."""
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode()
        body, check = raw[:-16], raw[-16:]
        if sha256(body.encode()).hexdigest()[:16] != check:
            raise ValueError("checksum")
        got, revision, position = json.loads(body)
    except ValueError as e:
        raise ValueError("invalid_cursor") from e
    if got != kind:
        raise ValueError("invalid_cursor")
    return revision, position


def slice_text(text: str, at: int, budget: int, wrap=lambda part: {"text": part}) -> tuple[str, int | None]:
    """The longest slice from ``at`` whose wrapped form fits, and where the next one starts (None at the end)."""
    low, high = 0, len(text) - at
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if serialized_size(wrap(text[at : at + mid])) <= budget else (low, mid - 1)
    if not low and at < len(text):
        raise ValueError("budget_too_small")
    return text[at : at + low], at + low if at + low < len(text) else None


def revision(*parts) -> str:
    """A digest of whatever a page depends on; a page of another revision is stale."""
    return sha256(canonical_json(parts).encode()).hexdigest()
