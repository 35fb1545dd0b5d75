"""The marks that the rules of the gates read, and the keys of the store; both are literals of a plan, never a table."""

from __future__ import annotations

import base64
import dataclasses
from collections.abc import Mapping

from lanewise.functions.text import NAME_PASS
from lanewise.operators.dimensions import MIN_AGE

# Where each mark may lie, ends included; shares lie strictly inside 0 and 1.
CLOSED = {"name_pass": (50, 100), "min_age": (16, 100), "face_pass": (0.2, 0.95)}
SHARES = ("live_pass",)
KEY_BYTES = 32


@dataclasses.dataclass(frozen=True)
class Rules:
    """Pass marks of a name, a face, a live person and a plate, and the least age; wrong ones raise ValueError."""

    name_pass: float = NAME_PASS
    min_age: int = MIN_AGE
    face_pass: float = 0.35
    live_pass: float = 0.5
    plate_pass: float = 0.6

    def __post_init__(self):
        wrong = [n for n, (a, b) in CLOSED.items() if not a <= getattr(self, n) <= b] + [n for n in SHARES if not 0 < getattr(self, n) < 1]
        if wrong:
            raise ValueError(f"out of bounds: {', '.join(wrong)}")

    @classmethod
    def read(cls, given: Mapping[str, str], prefix: str = "") -> Rules:
        """From texts by name; names are read in capitals behind the prefix, blank texts and other names count as not given."""
        texts = {f: given.get((prefix + f.name).upper(), "").strip() for f in dataclasses.fields(cls)}
        return cls(**{f.name: type(f.default)(t) for f, t in texts.items() if t})


def key_of(encoded: str) -> bytes:
    """A key's bytes from Base64; one of another length is refused."""
    key = base64.b64decode(encoded, validate=True)
    if len(key) != KEY_BYTES:
        raise ValueError(f"a key of {len(key)} bytes")
    return key
