"""Cutting text where the public byte-level pattern always cuts, so that words can be cached."""

from __future__ import annotations

import re
from itertools import product

#: White space but space and newline; the separators 1C to 1F, which not every engine takes for any.
_OTHER = r"\t\r\x0b\x0c\x85\xa0  -     　"
_ANY_OTHER = re.compile(f"[{_OTHER}]")
#: Stretches of white space that are not cut before each character: those with other white space, of
#: three characters or more, or of two at the end.
_LONG = re.compile(rf"[ \n]*[{_OTHER}][ \n{_OTHER}]*|[ \n]{{3,}}|[ \n]{{2}}\Z")
_TWOS, _THREES = (tuple(map("".join, product(" \n", repeat=n))) for n in (2, 3))
#: Plain searches for single signs are many times as fast as a pattern.
_UNSURE_SIGNS, _OTHER_ASCII = "\x1c\x1d\x1e\x1f", "\t\r\x0b\x0c"


def _even(text: str) -> bool:
    """Whether all white space are spaces and newlines in stretches of one or two, and one at the end."""
    if any(s in text for s in _OTHER_ASCII) or not text.isascii() and _ANY_OTHER.search(text):
        return False
    if "  " not in text and ("\n" not in text or not any(t in text for t in _TWOS)):
        return True
    return not any(t in text for t in _THREES) and (text[-1] not in " \n" or text[-2:-1] not in (" ", "\n"))


def pieces(text: str) -> list[str] | None:
    """Pieces of a text that the pattern matches by themselves, or None for a text that is left whole.

    No match of the pattern crosses the place before the last white space of a stretch: what stands
    before it is one match, it begins the next match if it is a space and is a match of its own if
    not. So a stretch of one or two is cut before each character. A piece that starts with white space
    stands for itself, any other for a space and itself; the first piece gets a newline that is not in
    the text, whose id the caller drops.
    """
    if not text or any(s in text for s in _UNSURE_SIGNS):
        return None
    if _even(text):
        out = (text.replace("\n", " \n") if "\n" in text else text).split(" ")
        out[0] = "\n" + out[0]
        return out
    out = []
    lead, at = "\n", 0
    for m in _LONG.finditer(text):
        if m.end() == len(text):
            break
        if m.start() > at or not out:
            out += _plain(lead, text[at : m.start()])
        if m.end() - m.start() > 1:
            out.append(text[m.start() : m.end() - 1])
        lead, at = text[m.end() - 1], m.end()
    else:
        return out + _plain(lead, text[at:])
    out += _plain(lead, text[at : m.start()])
    out.append(m.group())
    return out


def _plain(lead: str, part: str) -> list[str]:
    """Pieces of a part without long stretches, after one character of white space."""
    if lead == " ":
        return part.replace("\n", " \n").split(" ")
    cut = (lead + part).replace("\n", " \n").split(" ")
    return cut[1:] if lead == "\n" else cut


def spelled(piece: str) -> str:
    return piece if piece[:1].isspace() else f" {piece}"


def blank(piece: str) -> bool:
    """Pieces of white space alone, which must not stand beside others where they are encoded."""
    return not piece or piece.isspace()
