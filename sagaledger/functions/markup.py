"""What a reader sees of a message that holds markup, in one walk over its marks.

A mark is a tag, a media token in double braces, an image link, or inline data.  Marks are found from left to right, each by one
look-up, and a walk over them decides what stands in their place; whatever lies between is text.  Nothing is searched again
from a mark that turns out to be none: elements are paired with their ends by one list of ends for each name, and where a
closing sign stands next is remembered.  So the work grows with the text, whatever it holds.

What counts as a mark, beyond the fixed names below:

- a tag begins with ``<`` or ``</`` and a letter and ends at the first ``>`` outside of quotes; it holds no other ``<`` outside
  of quotes, and a line end only after its name and a space.  Anything else, as in ``HP < 30``, is text.
- a declaration or comment begins with ``<!`` and ends at the next ``>``.
- an element that is never closed is no element: its tag goes, its content stays.
"""

from __future__ import annotations

import html
import re

# Elements whose content is not story, media tokens, elements that end a line.
DROPPED = ("style", "script", "thoughts", "think", "thinking")
MEDIA = ("inlay", "inlayed", "inlayeddata", "img", "image", "asset", "emotion", "raw", "path", "bg", "bgm", "video", "video-img", "audio", "source")
BLOCKS = ("br", "p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "details", "summary", "table", "section")

#: The element that a packet of ours stands in, and those of its lines, which hold text only.
PACKET, LINES = "memory", ("Fact", "Claim", "Thread", "Excerpt")

#: Characters of a tag with neither quotes nor spaces in it, at most.
PLAIN_TAG = 500

_MARK = re.compile(r"</?[^\W\d_]|<!|\{\{|!\[|data:")
_NAME = re.compile(r"[\w-]+")
_STOP = re.compile(r"[<>\"'\n]")
_INLINE = re.compile(r"[\w.+-]+/[\w.+-]+(?:;[\w=.+-]+)*,[A-Za-z0-9+/=%]+")


class _Walk:
    def __init__(self, text: str):
        self.text = text
        self.found: dict[str, tuple[int, int]] = {}

    def _after(self, what: str, at: int) -> int:
        """Where `what` stands next, or past the text's end.  The last answer is kept, so no stretch is searched twice."""
        since, found = self.found.get(what, (0, -1))
        if not since <= at <= found:
            found = self.text.find(what, at)
            self.found[what] = at, found = at, len(self.text) if found < 0 else found
        return found

    def _tag_end(self, at: int, name_end: int) -> int:
        """The place after a tag, or -1 if it is none."""
        text, spaced = self.text, name_end < len(self.text) and self.text[name_end].isspace()
        here = name_end
        while True:
            m = _STOP.search(text, here, len(text) if spaced else min(len(text), at + PLAIN_TAG))
            if m is None or m[0] == "<" or (m[0] == "\n" and not spaced):
                return -1
            if m[0] == ">":
                return m.end()
            here = m.end()
            if m[0] in "\"'" and spaced:
                close = self._after(m[0], here)
                if close < len(text):
                    here = close + 1

    def tags(self) -> list[tuple[int, int, str, bool, str]]:
        """(begin, end, kind, whether it closes, name) of all marks in order; a kind is tag, note, media, image or data."""
        text, out, at = self.text, [], 0
        while (m := _MARK.search(text, at)) is not None:
            begin, at = m.start(), m.end()
            if m[0] == "<!":
                end = self._after(">", at)
                if end < len(text):
                    out.append((begin, end + 1, "note", False, ""))
                    at = end + 1
            elif m[0] == "{{":
                end = self._after("}", at)
                if end < self._after("{", at) and text.startswith("}}", end) and (name := text[at:end].partition("::"))[1] and name[0].lower() in MEDIA:
                    out.append((begin, end + 2, "media", False, ""))
                    at = end + 2
            elif m[0] == "![":
                close = self._after("]", at)
                end = self._after(")", close)
                if end < len(text) and text[close + 1] == "(" and self._after("\n", at) > end and min(self._after(c, close) for c in " \t\r") > end:
                    out.append((begin, end + 1, "image", False, ""))
                    at = end + 1
            elif m[0] == "data:":
                if (link := _INLINE.match(text, at)) is not None:
                    out.append((begin, link.end(), "data", False, ""))
                    at = link.end()
            else:
                closes = m[0][1] == "/"
                name = _NAME.match(text, at - 1)
                end = self._tag_end(begin, name.end())
                if end >= 0:
                    out.append((begin, end, "tag", closes, name[0]))
                    at = end
        return out

    def readable(self) -> str:
        text, marks = self.text, self.tags()
        ends: dict[str, list[int]] = {}
        for k, (_, _, kind, closes, name) in enumerate(marks):
            if kind == "tag" and closes:
                ends.setdefault(name if name == PACKET or name in LINES else name.lower(), []).append(k)
        turn = dict.fromkeys(ends, 0)
        out, at, k = [], 0, 0
        while k < len(marks):
            begin, end, kind, closes, name = marks[k]
            low, to = name.lower(), None
            if kind == "tag" and not closes and not text.endswith("/>", begin, end):
                if low in DROPPED or name == PACKET:
                    key = PACKET if name == PACKET else low
                    mine = ends.get(key, [])
                    while turn.get(key, 0) < len(mine) and mine[turn[key]] < k:
                        turn[key] += 1
                    if turn.get(key, 0) < len(mine):
                        to = mine[turn[key]]
                elif name in LINES and k + 1 < len(marks) and marks[k + 1][2:] == ("tag", True, name) and "<" not in text[end : marks[k + 1][0]]:
                    to = k + 1
            out.append(text[at:begin])
            if to is not None:
                out.append(" ")
                k, at = to + 1, marks[to][1]
                continue
            if kind == "tag" and low in BLOCKS:
                out.append("\n")
            k, at = k + 1, end
        out.append(text[at:])
        return "".join(out)


def readable(text: str | None) -> str | None:
    """A message without its markup, with the characters that entities stand for, and white space collapsed: one space between
    words, no empty lines, no space beside a line's end."""
    if text is None:
        return None
    if "<" in text or "{{" in text or "![" in text or "data:" in text:
        text = _Walk(text).readable()
    lines = (" ".join(part for part in re.split("[ \t ]+", line) if part) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line.strip()).strip()
