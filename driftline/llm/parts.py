"""Texts cut at single spaces, and a bounded worker cache of what each part gives.

The GPT-2 style split lets a space begin a piece and never end one that has letters. A space
between two characters that are no white space therefore always begins a new piece, so a text
may be cut there and the parts encoded apart, with the space kept in front.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

# Characters that some engine counts as white space although ``str.isspace`` doesn't.
ODD_SPACES = frozenset("᠎​﻿")
#: Parts of letters with at most a mark at the end; all these letters are in category L, and stay so in lower case.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([,.]?)").fullmatch


def cut(text: str) -> list[str]:
    """Parts as keys: ``x`` stands for `` x``, and a key that begins with a space for the rest of it."""
    parts = text.split(" ")
    parts[0] = " " + parts[0]
    return parts


def spelled(key: str) -> str:
    """The text that a key stands for."""
    return key[1:] if key[:1] == " " else " " + key


def clean(key: str) -> bool:
    """Whether the text may be cut at both ends of this part."""
    if key[:1] == " ":
        return len(key) > 1 and not (key[-1].isspace() or key[-1] in ODD_SPACES)
    return key != "" and not (
        key[0].isspace() or key[-1].isspace() or key[0] in ODD_SPACES or key[-1] in ODD_SPACES
    )


class Cache(dict):
    """Values by key, emptied when it holds ``most`` entries; ``kept`` entries stay."""

    def __init__(self, most: int, kept: dict | None = None):
        super().__init__(kept or {})
        self.most, self.kept = most, kept or {}

    def learn(self, keys: Iterable[str], values: Callable[[list[str]], Iterable]) -> None:
        """Make sure that all ``keys`` are present; ``values`` gets those that are missing."""
        keys = set(keys)
        missing = list(keys.difference(self))
        if missing and len(self) + len(missing) > self.most:
            self.clear()
            self.update(self.kept)
            missing = list(keys.difference(self))
        if missing:
            self.update(zip(missing, values(missing), strict=True))


def groups(texts: list, chars: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters, at least one text each."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
