"""Split long texts where no tokenizer merge crosses.

A single space with a non-blank character on both sides is a safe boundary for the vocabularies
used here: byte-level pre-tokenizers start a new match there, and no piece of the sentencepiece
vocabulary holds a space after another character.  The encoding of a text is therefore the
concatenation of the encodings of its parts.
"""

from __future__ import annotations

import re

#: U+2581 is sentencepiece's own form of a space, so it may not stand beside a boundary.
SAFE = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")


def cut(text: str, about: int, keep_space: bool) -> list[str]:
    """Parts of ``about`` characters or a little more.

    The space at a boundary opens the following part if ``keep_space``; a library that puts a
    space of its own before each text needs it dropped.
    """
    parts, start = [], 0
    while len(text) - start > about:
        found = SAFE.search(text, start + about)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.start() if keep_space else found.end()
    parts.append(text[start:])
    return parts
