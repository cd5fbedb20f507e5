"""Whether a text ends where its writer ended it: a pushdown parser and the words before the end."""

from __future__ import annotations

import re

# Abbreviations whose point ends no sentence, and short forms that may close one.
ABBREVIATIONS = frozenset("dr mr mrs ms prof st mt ft capt lt sgt col gen rev hon sr sra srta dra mme mlle nr nº núm vol vols fig figs nos pp ed eds approx aprox ca cf vs viz resp dept univ e.g i.e z.b d.h u.a bzw inkl exkl ggf evtl vgl sog geb gest bd hrsg abb env p.ej p.ex c.-à-d av bd pág págs avda ej tel".split())
CLOSING_SHORT = frozenset("etc usw u.s.w inc ltd co corp jr sr a.m p.m u.s u.k".split())
# Words that can't end a sentence.
OPEN_WORDS = frozenset(
    "the a an of to in and or with from by for at on into near under his her its their than as le la les un une des du de et à au aux en dans par pour sur avec der die das den dem ein eine einen und oder mit von vom zum zur für bei nach el los las una del y con por para".split()
)
# Those of them that not even a full stop makes whole.
NEVER_LAST = frozenset("the a an and or le les une des du et und oder el los y".split())
_OPENERS, _CLOSERS = "([{«“„", ")]}»”"
_MATES = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
_FENCES, _STRAIGHT = ("```", "~~~"), ('"', "'")
_FENCE = re.compile(r"^\s*(```|~~~)")
# Words that begin with an apostrophe.
_ELISION = re.compile(r"'(?:tis|twas|em|cause|til|n|bout|round)\b", re.I)
_TAG_OPEN = re.compile(r"<[a-zA-Z/!][^<>]*$")
_ENTITY_OPEN = re.compile(r"&(#x?[0-9a-fA-F]*|[a-zA-Z]{1,10})$")
_RESIDUE = re.compile(r"(?:�|\[?\s*(?:\.\.\.+|…)\s*\]?|\[|[-‐‑–—,;:&/\\(<]|\\u[0-9a-fA-F]{0,3})$")
_BROKEN = re.compile(r"[\ud800-\udfff]$")
_LIST_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s*$")
_LISTED = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+\S")
# Elements that must be closed; others may stand alone.
_ELEMENT = re.compile(r"<(/?)(a|b|i|u|s|em|strong|span|div|code|pre|sup|sub|q|cite|mark|small|blockquote|table|ul|ol|h[1-6])(?:\s[^<>]*)?>", re.I)
_LAST_WORD = re.compile(r"([^\s]+?)\.$")


def open_parts(text: str) -> list[str]:
    """What the text opens and does not close, by a pushdown parser: one stack for code fences, brackets, quotations, elements and lists.

    Inside a fence only its own mark counts. A closer takes everything above its opener with it and is ignored without
    one. Straight quotes open after a space or an opener and close elsewhere; they end with their paragraph. A list
    whose last item is only its marker stays open.
    """
    stack: list[str] = []

    def close(opener: str) -> None:
        if opener in stack:
            while stack.pop() != opener:
                pass

    listed, offset = False, 0
    for line in text.split("\n"):
        begin, offset = offset, offset + len(line) + 1
        fence = _FENCE.match(line)
        if stack and stack[-1] in _FENCES:
            if fence and fence[1] == stack[-1]:
                stack.pop()
            continue
        if fence:
            stack.append(fence[1])
            continue
        if "•" in stack:
            stack.remove("•")
        if _LIST_ITEM.match(line) and listed:
            stack.append("•")
        listed = listed or bool(_LISTED.match(line))
        for i, c in enumerate(line, begin):
            if c == "<" and (tag := _ELEMENT.match(text, i)):
                name = "<" + tag[2].lower()
                if tag[1]:
                    close(name)
                elif not tag[0].endswith("/>"):
                    stack.append(name)
            elif c in _OPENERS:
                stack.append(c)
            elif c in _CLOSERS:
                close(_MATES[c])
            elif c in "\"'":
                before, after = text[i - 1 : i] if i > begin else " ", text[i + 1 : i + 2]
                opens = (before.isspace() or before in _OPENERS or before in "\"'") and after.isalnum()
                if c == "'" and (before.isalnum() and after.isalnum() or opens and (after.isdigit() or _ELISION.match(text, i))):
                    continue
                if opens and c not in stack:
                    stack.append(c)
                else:
                    close(c)
        if offset <= len(text):
            stack = [x for x in stack if x not in _STRAIGHT]
    return stack


def strip_residue(text: str) -> tuple[str, bool]:
    """text without what a cut may leave at the end, and whether there was any."""
    text = text.rstrip()
    if _BROKEN.search(text) or _TAG_OPEN.search(text) or _ENTITY_OPEN.search(text):
        return text, True
    found = _RESIDUE.search(text)
    return (text[: found.start()].rstrip(), True) if found else (text, False)


def sentence_end(text: str) -> bool:
    """Whether text ends with a mark that ends a sentence, closers and symbols after it allowed."""
    core = re.sub(r"[\s\"'’”»)\]}*_`>]+$", "", text)
    if not core or core[-1] not in ".!?。！？؟।:" or core[-1] == ":":
        return False
    if core[-1] == ".":
        last = _LAST_WORD.search(core)
        word = last.group(1).lower().lstrip("(\"'“«[") if last else ""
        if word in CLOSING_SHORT:
            return True
        if word in ABBREVIATIONS or word in NEVER_LAST:
            return False
    return True
