"""Words: maximal runs of letters and digits (Unicode L or N) of the lower-cased text."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []
