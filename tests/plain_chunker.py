"""The chunker as a plain state machine over one text, which the tests hold the
columns of ``recollect.functions.chunking`` against.

Lengths are UTF-16 units.  A text with characters beyond the basic plane is
worked on as its surrogate pairs, so one code path serves both.
"""

from __future__ import annotations

import re
from math import ceil

SPACE = r"[\t\n\v\f\r    -     　﻿]"
_TRIM = re.compile(rf"^{SPACE}+|{SPACE}+$")
_TRIM_END = re.compile(rf"{SPACE}+$")
_FENCE = re.compile(r"```|~~~")
_END = re.compile(r"[.!?。！？]")
_CLOSERS = "\"')]}»”"
_CJK = re.compile(r"[一-鿿぀-ヿ가-힯]")
_BREAK = re.compile(SPACE)


def trim(s: str) -> str:
    return _TRIM.sub("", s)


def tokens(s: str) -> int:
    cjk = len(_CJK.findall(s))
    return ceil(cjk * 1.5) + ceil((len(s) - cjk) / 4)


def paragraphs(text: str) -> list[str]:
    """Blocks between blank lines; a fence keeps its blank lines."""
    out, held, fenced = [], [], False

    def close() -> None:
        block = _TRIM_END.sub("", "".join(held))
        if trim(block):
            out.append(block)
            held.clear()

    for line in re.split(r"\r?\n", text):
        fenced ^= bool(_FENCE.match(trim(line)))
        if fenced or trim(line):
            held.append(line + "\n")
        else:
            close()
    close()
    return out


def sentences(block: str) -> list[str]:
    """Cut after every terminator and the closers behind it, decimals apart."""
    cuts, at = [0], 0
    while m := _END.search(block, at):
        i, at = m.start(), m.end()
        if m[0] == "." and block[i - 1 : i].isdecimal() and block[i - 1 : i].isascii() and block[at : at + 1].isdecimal() and block[at : at + 1].isascii():
            continue
        while at < len(block) and block[at] in _CLOSERS:
            at += 1
        cuts.append(at)
    pieces = (trim(block[a:z]) for a, z in zip(cuts, [*cuts[1:], len(block)]))
    return [p for p in pieces if p]


def long_pieces(text: str, most: int) -> list[str]:
    """Cut a long text at the last good break past 60% of the budget."""
    out, floor = [], int(most * 0.6)
    while len(text) > most:
        head = text[:most]
        cut = max(head.rfind(x) for x in (". ", ".\n", "。", "\n", ", ")) + 1
        if cut - 1 <= floor:
            blanks = [m.end() for m in _BREAK.finditer(head, floor + 1)]
            cut = blanks[-1] if blanks else most
        out.append(trim(text[:cut]))
        text = text[cut:]
    return [*out, trim(text)] if trim(text) else out


def _wordy(c: str) -> bool:
    return c == "_" or c.isalnum()


def overlap_tail(text: str, size: int) -> str:
    """The last ``size`` characters, without a word cut at their beginning."""
    if size <= 0:
        return ""
    tail, before = text[-size:], text[: -size or None][-1:] if len(text) > size else ""
    body = re.sub(rf"^{SPACE}+", "", tail)
    if body and before and _wordy(before) and _wordy(body[0]):
        gap = _BREAK.search(body)
        if gap:
            body = re.sub(rf"^{SPACE}+", "", body[gap.start() :])
    return body


def glue(left: str, right: str) -> str:
    if not left or left.endswith("\n") or right.startswith("\n"):
        return ""
    return "\n" if "\n" in left or "\n" in right else " "


def chunk_text(text: str, max_chars: int = 900, overlap_chars: int = 120) -> list[tuple[int, str, int]]:
    """(index, text, estimated tokens) of each chunk; none exceeds ``max_chars``."""
    if not max_chars >= 1 or max_chars == float("inf"):
        raise ValueError("max_chars must be at least 1")
    if not 0 <= overlap_chars < float("inf"):
        raise ValueError("overlap_chars must be at least 0")
    astral = not text.isascii() and max(text) > "￿"
    if astral:
        text = _pairs(text)
    overlap, out, window = min(overlap_chars, max_chars // 2), [], ""
    for block in paragraphs(text):
        for piece in long_pieces(block, max_chars) if len(block) > max_chars else sentences(block) or [block]:
            if window and len(window) + len(glue(window, piece)) + len(piece) > max_chars:
                out.append(trim(window))
                window = overlap_tail(window, overlap)
            window += glue(window, piece) + piece
    if trim(window):
        out.append(trim(window))
    parts = [p for c in out for p in (long_pieces(c, max_chars) if len(c) > max_chars else [c]) if p]
    return [(i, _whole(p) if astral else p, tokens(p)) for i, p in enumerate(parts)]


def _pairs(text: str) -> str:
    """The text's UTF-16 units as one character each."""
    raw = text.encode("utf-16-le", "surrogatepass")
    return "".join(map(chr, memoryview(raw).cast("H")))


def _whole(units: str) -> str:
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
