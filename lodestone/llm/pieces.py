"""Texts as the tokenizer's words.

No word, normal form or special token reaches across an ASCII blank, so a
text's tokens are those of its pieces between blanks. A plain piece holds only
printable ASCII and Latin-1 letters: its normal form is its lower case, and
the words of the tokenizer's pattern are told by a short pattern of our own.
Any other piece is left to the tokenizers library, whole.
"""

from __future__ import annotations

import re

import numpy as np

_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_TEXT = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*")
_WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: The tokenizer's pattern takes these endings first.
_WORDS_AND_ENDINGS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: Marks a piece that is not plain among a text's units.
ODD = "\0"
#: Stand behind each of the texts that spans() takes, and for a piece that is not plain; no plain text holds them.
STOP, GAP = b"\1", b"\0"
#: In UTF-8, a Latin-1 letter is one lead byte and a byte that no other plain character has; these two alone are signs (× and ÷).
_LATIN = bytes(set(range(0x80, 0xC0)) - {0x97, 0xB7}) + b"\xc3"
_PLAIN_BYTES = b" \n" + bytes(range(0x21, 0x7F)) + _LATIN
_ODD_BYTES = bytes(k not in _PLAIN_BYTES for k in range(256))
_LOWER = bytes(k + 32 if 0x41 <= k <= 0x5A or 0x80 <= k <= 0x9E else k for k in range(256))
#: Kinds of bytes; those of the last two are a word each.
_BLANK, _LETTER, _MARK, _DIGIT, _STOP = range(5)
_KINDS = bytes(_BLANK if k in b" \n" else _STOP if k in STOP + GAP else _DIGIT if k in b"0123456789" else _LETTER if k in _LATIN or chr(k).isalpha() else _MARK for k in range(256))


def pieces(text: str | None) -> list[str]:
    return text.replace("\n", " ").split(" ") if text else []


def plain_words(text: str) -> list[str]:
    """The lower-cased words of a text of plain pieces and blanks."""
    return (_WORDS_AND_ENDINGS if "'" in text else _WORDS).findall(text.lower())


def is_plain(text: str) -> bool:
    return _PLAIN_TEXT.fullmatch(text) is not None


def plain_parts(texts: list[bytes], special: list[bytes]) -> tuple[bytes, list[bytes]]:
    """Texts in UTF-8, a STOP behind each, with a GAP for each piece that is not plain; and these pieces in order."""
    joined = b"".join([t + STOP for t in texts])
    if len(joined.translate(None, _PLAIN_BYTES)) == len(texts) and not any(s in joined for s in special):
        return joined, []
    odd = np.frombuffer(joined.translate(_ODD_BYTES), np.uint8) == 1
    for s in special:
        at = joined.find(s)
        while at >= 0:
            odd[at] = True
            at = joined.find(s, at + 1)
    breaks = np.frombuffer(joined.translate(_KINDS), np.uint8) == _BLANK
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    odd[stops], breaks[stops] = False, True
    breaks = np.flatnonzero(breaks)
    at = np.unique(np.searchsorted(breaks, np.flatnonzero(odd)))
    froms, untils = np.append(-1, breaks)[at] + 1, breaks[at]
    parts, done, found = [], 0, []
    for a, b in zip(froms.tolist(), untils.tolist(), strict=True):
        parts += joined[done:a], GAP
        found.append(joined[a:b])
        done = b
    return b"".join([*parts, joined[done:]]), found


def spans(texts: bytes) -> tuple[np.ndarray, bytes]:
    """Where the words of plain texts in UTF-8 begin and the last one ends, and their bytes, lower-cased; a STOP or GAP is a word."""
    low = texts.translate(_LOWER)
    kind = np.frombuffer(low.translate(_KINDS), np.uint8)
    begins = kind >= _DIGIT
    begins[:1] |= kind[:1] != _BLANK
    begins[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != _BLANK)
    if b"'" in low:  # endings are taken first, and only where a run of marks begins
        raw = np.frombuffer(low + b"  ", np.uint8)
        at = np.flatnonzero((raw[:-2] == ord("'")) & begins)
        a, b = raw[at + 1], raw[at + 2]
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        at, after = at[one | two] + 1, (at + 2 + two)[one | two]
        begins[at] = False
        begins[after[np.append(kind, [_BLANK, _BLANK])[after] == _LETTER]] = True
    places = np.flatnonzero(begins)
    short = low.translate(None, b" \n")
    return np.append(places - np.cumsum(kind == _BLANK, dtype=np.int32)[places], len(short)), short


def units(text: str | None, special: list[str]) -> list[str]:
    """A text's plain words, lower-cased, and its other pieces as they are behind ODD, in order."""
    if not text:
        return []
    risky = any(s in text for s in special)
    if not risky and is_plain(text):
        return plain_words(text)
    out, plain = [], []
    for piece in pieces(text):
        if _PLAIN.fullmatch(piece) and not (risky and any(s in piece for s in special)):
            plain.append(piece)
        elif piece:
            out += plain_words(" ".join(plain))
            out.append(ODD + piece)
            plain = []
    return out + plain_words(" ".join(plain))
