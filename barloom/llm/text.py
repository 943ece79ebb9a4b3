"""Words of a text, whatever its writing: case, markup, line breaks, width of characters, numbers and signs."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--.*?-->", re.S)
#: A word broken at a line end: hyphen (plain, soft or typographic), line break, lower-case rest.
_BROKEN = re.compile(r"[-‐‑\xad](?<=[^\W\d_].)[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_INVISIBLE = re.compile("[­​‌‍⁠﻿]")
#: Digits in groups of three; patterns that begin with a digit are searched fast.
_GROUPED = re.compile(r"\d+(?:(?:[,' ’ _]\d{3})+(?!\d)|(?:\.\d{3}){2,}(?![.\d]))")
_BLANK_GROUP = re.compile(r"\d \d{3}(?!\d)")
_DECIMAL_COMMA = re.compile(r"(\d),(?=\d{1,2}(?!\d))")
_WORD = re.compile(r"\d+(?:\.\d+)?|[^\W\d_]+")
#: A lead byte of UTF-8 and what may follow it, both read as single bytes.
_FOLLOWING = "[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_MOJIBAKE = re.compile(f"[Â-ô]{_FOLLOWING}+")
#: Words that stand for signs (fixed values).
DROPPED = frozenset({"usd", "us", "dollars", "dollar", "percent", "pct"})
#: Numbers written as words (fixed values).
_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = {w: str(i) for i, w in enumerate(_SMALL)} | {w: str(10 * i) for i, w in enumerate(_TENS, 2)}


def repair(text: str) -> str:
    """Undo UTF-8 read as a one-byte encoding, where the text looks like it and turns back without loss."""
    if _MOJIBAKE.search(text):
        for codec in ("cp1252", "latin-1"):
            try:
                return text.encode(codec).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return _MOJIBAKE.sub(_one, text)
    return text


def _one(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return m[0]


def plain(text: str) -> str:
    """The text without markup, with broken words joined and characters in their usual width."""
    s = text if text.isascii() else repair(text)
    if "<" in s:
        s = _TAG.sub(" ", s)
    if "&" in s:
        s = html.unescape(s)
    if "\n" in s:
        s = _BROKEN.sub("", s)
    return s if s.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", s))


def _join(m: re.Match) -> str:
    """One number, if its first group has at most three digits and it is no tail of another number."""
    head = re.match(r"\d+", m[0])[0]
    tail = m.start() > 1 and m.string[m.start() - 1] in ".," and m.string[m.start() - 2].isdigit()
    return m[0] if len(head) > 3 or tail else re.sub(r"\D", "", m[0])


def _numbers(s: str) -> str:
    return _DECIMAL_COMMA.sub(r"\1.", _GROUPED.sub(_join, s))


def normal(chunk: str) -> tuple[str, ...]:
    """The words of a stretch without blanks, in lower case; signs, currency and percent words are left out."""
    out = []
    for w in _WORD.findall(chunk if chunk.isalpha() else _numbers(chunk)):
        if w[0].isdigit():
            w = w.rstrip("0").rstrip(".") if "." in w else w
            w = w.lstrip("0")
            out.append(w if w and w[0] != "." else "0" + w)
        elif w not in DROPPED:
            out.append(NUMBERS.get(w, w))
    return tuple(out)


def chunks(text: str) -> list[str]:
    """The stretches between blanks of a text in lower case; digits grouped by blanks are joined, so no word crosses their borders."""
    s = plain(text).lower()
    return (_numbers(s) if _BLANK_GROUP.search(s) else s).split()


def words(text: str) -> list[str]:
    """Lower-case words and numbers in order; signs, currency and percent words are left out, grouped digits joined."""
    return [w for c in chunks(text) for w in normal(c)]


class Memo(dict):
    """What ``make`` says of each key, kept for the next time; emptied when it holds ``most`` keys, so a corpus of any size fits."""

    def __init__(self, make, most: int = 400_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        got = self[key] = self.make(key)
        return got
