"""Where a text may be cut without changing its byte-level BPE tokens.

The pre-tokenizer's pattern splits a text into matches that are encoded each by itself, so a cut at a
border of matches changes nothing. Whatever the text, such a border lies

* before white space that follows another character: a match with other characters ends with them;
* between a letter or digit and a mark after it, and between a letter and a digit, in either order:
  no match goes from one class to the next, but for a quote before letters, which no cut splits.

Only characters are used whose class is the same in every library. A run of letters without any of these
is one match, however long, and is never cut.
"""

from __future__ import annotations

import re

_MARKS = r"。，、；：！？.,;:!?)\]」』）"
_LETTER = r"A-Za-zÀ-ÖØ-öø-ÿぁ-ゖァ-ヺ一-鿿가-힣"
_CUT = re.compile(rf"(?<=\S)(?=[ \n\t\r])|(?<=[{_LETTER}0-9])(?=[{_MARKS}])|(?<=[{_LETTER}])(?=[0-9])|(?<=[0-9])(?=[{_LETTER}])")
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_GAP = re.compile(r"\s\s")


def cut_through(token: str) -> bool:
    """Whether some cut could fall inside this string; a tokenizer with such an added token can't take cut texts."""
    return bool(_CUT.search(token)) or token != token.strip()


def words(text: str) -> list[str]:
    """Pieces between single spaces. All but the first have lost the space that they start with."""
    if _GAP.search(text) or text[:1].isspace() or text[-1:].isspace():
        return _SPACE.split(text)
    return text.split(" ")  # the same where every space stands between two other characters


def blocks(text: str, size: int) -> list[str]:
    """The text in blocks of about ``size`` characters, cut at safe places only; they concatenate to the text."""
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None or m.start() == len(text):
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out
