"""The author's own words of a forum post: quotes, signatures, code and markup taken away."""

from __future__ import annotations

import html
import re

_HEAD = re.compile(r'\s*\[quote="[^"\]]*"\]\r?\n')
_OPEN = re.compile(r"\[quote(?:=[^\]]*)?\]|<blockquote[^>]*>", re.I)
_TAG = {"q": re.compile(r"\[(/?)quote(?:=[^\]]*)?\]", re.I), "b": re.compile(r"<(/?)blockquote[^>]*>", re.I)}
_SAYS = re.compile(r"^.{0,80}\b(?:wrote|schrieb|writes|escribió|a écrit)\s?:\s*$")
_MARK = re.compile(r"^\s*[>|]")
_CODE = re.compile(r"```.*?(?:```|\Z)|\[code\].*?(?:\[/code\]|\Z)|<pre>.*?(?:</pre>|\Z)", re.S | re.I)
_SIGN = re.compile(r"\[sig\].*?(?:\[/sig\]|\Z)|<small>[^<]*::[^<]*(?:</small>|\Z)|<span[^>]*sig[^>]*>.*?(?:</span>|\Z)", re.S | re.I)
_RULE = re.compile(r"^(?:--\s*\S*|_{6,})\s*$")
_SENT = re.compile(r"^Sent from my \S+\s*$", re.M)
_IMAGE = re.compile(r"\[img\].*?\[/img\]|<img[^>]*>", re.S | re.I)
_LINK = re.compile(r"https?://\S+", re.I)
_BREAK = re.compile(r"<br\s*/?>|\[br\]|</?p>", re.I)
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|\[/?[a-zA-Z*]+(?:=[^\]]{0,120})?\]")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.startswith(b[:mid]) else (lo, mid - 1)
    return lo


def _after_loose(rest: str, parent: str | None) -> str:
    """What follows a quote that has a head but no end: it repeats the start of the parent's text.

    Without that text, the quote ends at the first line break inside running text that no quoted line follows.
    """
    if parent:
        n = _common(rest, parent)
        if n >= 12 or n == len(parent):
            return rest[n:]
    lines = rest.split("\n")
    for i in range(len(lines) - 1):
        quoted = _MARK.match(lines[i + 1]) or _SAYS.match(lines[i]) or _HEAD.match(lines[i] + "\n")
        if lines[i].strip() and lines[i + 1].strip() and not quoted:
            return "\n".join(lines[i + 1 :])
    return rest


def _end_of_block(text: str, at: int) -> int:
    """End of the quote that opens at ``at``; inner quotes may have lost their ends.  -1: it has no end at all."""
    tag, depth, last = _TAG["q" if text[at] == "[" else "b"], 0, -1
    for m in tag.finditer(text, at):
        depth += -1 if m.group(1) else 1
        last = m.end() if m.group(1) else last
        if depth == 0:
            return m.end()
    return last


def own_text(text: str | None, parent: str | None = None) -> str:
    """The author's own words of ``text`` as plain text; ``parent`` is the text that the post replies to, if known.

    Null gives an empty string.  Works on the whole text in linear passes.
    """
    if not text:
        return ""
    m = _HEAD.match(text)
    if m:
        text = _after_loose(text[m.end() :], parent)
    kept, i = [], 0
    while i < len(text):
        end = text.find("\n", i)
        end = len(text) if end < 0 else end
        line = text[i:end]
        if _MARK.match(line) or _SAYS.match(line):
            i = end + 1
            continue
        m = _OPEN.search(line)
        if m:
            kept.append(line[: m.start()])
            stop = _end_of_block(text, i + m.start())
            if stop < 0:
                stop = end if m.end() < len(line) else min(len(text), (text.find("\n", end + 1) + 1 or len(text) + 1) - 1)
            i = stop
            continue
        kept.append(line + "\n")
        i = end + 1
    out = _SIGN.sub(" ", _CODE.sub(" ", "".join(kept)))
    lines = _SENT.sub("", out).split("\n")
    for k in range(max(0, len(lines) - 5), len(lines)):  # a signature's rule stands near the end
        if _RULE.match(lines[k]):
            lines = lines[:k]
            break
    out = _IMAGE.sub(" ", _BREAK.sub("\n", "\n".join(lines)))
    out = _LINK.sub(" ", _MARKUP.sub("", out))
    return _MARKUP.sub("", html.unescape(html.unescape(out))).replace("**", "").replace("\xa0", " ")
