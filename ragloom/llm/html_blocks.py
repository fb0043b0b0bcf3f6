"""HTML as a sequence of leaf blocks: their text and the tags above them."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

TAG_HASHES, WORD_HASHES = 512, 1024

_FLAGS = re.S | re.I
# A tag whose attributes hold no "<": what nearly all are, and tried in no more time than it takes to reach the next one.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:"[^"<]*+"|'[^'<]*+'|[^<>"'])*+)>""", _FLAGS)
_TAG_START = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)", _FLAGS)
_SPECIAL, _GREATER = re.compile(r"""[>"']"""), re.compile(">")
_WHOLE = re.compile(r"<(script|style|template|textarea|title|iframe)\b", _FLAGS)
_ENDS = {name: re.compile(rf"</{name}\s*+>", _FLAGS) for name in ("script", "style", "template", "textarea", "title", "iframe")}
#: How something that is left out can begin; S and K have further forms when case is ignored.
_ODD = frozenset("!stinſ")
#: Elements that are left out if they are closed before one of these tags begins.
_CLOSED = re.compile(r"<(svg|select|noscript)\b", _FLAGS)
_STOPS = {
    "svg": re.compile(r"</svg\s*+>|<(?P<stop>p|div|h[1-6]|[uod]l|li|d[dt]|table|pre|blockquote|body|span)\b", _FLAGS),
    "select": re.compile(r"</select\s*+>|<(?P<stop>select|input|textarea)\b", _FLAGS),
    "noscript": re.compile(r"</noscript\s*+>|<(?P<stop>noscript)\b", _FLAGS),
}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+|[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Opening a tag closes the tag open before it of these names.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Block(NamedTuple):
    """A leaf block: its text, the hashed tokens of its tag path, and the share of its characters inside links."""

    text: str
    path: tuple[int, ...]
    link_share: float


@lru_cache(maxsize=4096)
def _tokens(tag: str, attributes: str) -> tuple[int, ...]:
    names = {tag}
    for match in _ATTRIBUTE.finditer(attributes):
        names.update("." + n for n in _NAME.findall((match[2] or match[3] or match[4] or "").lower()))
    return tuple(sorted({zlib.crc32(n.encode()) % TAG_HASHES for n in names}))


@lru_cache(maxsize=200_000)
def word_hash(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "replace")) % WORD_HASHES


class _Scan:
    """Texts and tags of a page, in time that grows with its length however broken it is: what a search found, or did not, is kept for later starts."""

    def __init__(self, source: str):
        self.source = source
        self._next: dict[re.Pattern, tuple[int, re.Match | None]] = {}
        self._quotes: dict[int, int] = {}

    def _search(self, pattern: re.Pattern, at: int) -> re.Match | None:
        """The first match from ``at`` on; one that an earlier search found further on is it again."""
        since, found = self._next.get(pattern, (-1, None))
        if not 0 <= since <= at or (found is not None and found.start() < at):
            found = pattern.search(self.source, at)
            self._next[pattern] = (at, found)
        return found

    def _tag_end(self, at: int) -> int:
        """The place of the ">" that ends the attributes from ``at``, outside quotes; -1 if there is none."""
        passed, end = [], -1
        while (mark := self._search(_SPECIAL, at)) is not None:
            at = mark.start()
            if mark[0] == ">":
                end = at
                break
            if at in self._quotes:
                end = self._quotes[at]
                break
            passed.append(at)
            close = self.source.find(mark[0], at + 1)
            if close < 0:
                break
            at = close + 1
        for place in passed:
            self._quotes[place] = end
        return end

    def _left_out(self, at: int) -> int:
        """Where the comment, script, drawing or the like ends that begins at ``at``; -1 if none does."""
        source = self.source
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            return len(source) if end < 0 else end + 3
        closed = _CLOSED.match(source, at)
        if closed and closed[1].lower() == "svg":
            end = self._tag_end(closed.end())
            if end > 0 and source[end - 1] == "/":
                return end + 1
        whole = _WHOLE.match(source, at)
        if not whole and not closed:
            return -1
        mark = self._search(_GREATER, (whole or closed).end())
        if mark is None:
            return -1
        if whole:
            end_ = _ENDS[whole[1].lower()].search(source, mark.end())
            return end_.end() if end_ else len(source)
        end_ = self._search(_STOPS[closed[1].lower()], mark.end())
        return end_.end() if end_ and not end_["stop"] else -1

    def tokens(self) -> Iterator[tuple[str | None, str, str, str]]:
        """``text, tag, close, attributes``: a text, or else a tag, with "/" if it closes."""
        source, at = self.source, 0
        while at < len(source):
            start = source.find("<", at)
            if start != at:
                yield source[at : start if start > 0 else len(source)], "", "", ""
                if start < 0:
                    return
            head = source[start + 1 : start + 3].lower()
            end = self._left_out(start) if head[:1] in _ODD else -1
            if end > 0:
                at = end
                continue
            tag = _PLAIN_TAG.match(source, start)
            if tag:
                at = tag.end()
                yield None, tag[2], tag[1], tag[3]
                continue
            tag = _TAG_START.match(source, start)
            if tag and (end := self._tag_end(tag.end())) >= 0:
                at = end + 1
                yield None, tag[2], tag[1], source[tag.end() : end]
                continue
            mark = self._search(_GREATER, start + 2) if head[:1] in ("!", "?", "/") else None
            if mark is not None:
                at = mark.end()
                continue
            at = start + 1
            yield "<", "", "", ""


def blocks(source: str) -> list[Block]:
    """The leaf blocks of ``source`` in page order.

    Character references are decoded, white space becomes one space, and ends are trimmed. Comments, scripts, styles
    and what a title holds are no blocks; an svg, select or noscript is none if it is closed, before what ends it
    in a parser, and else a tag like others. However deep, all open tags count. Tags that are not closed, or not opened, do no harm.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset[int], int]] = []  # a tag, the tokens of it and those above, the links among them
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    path: tuple[int, ...] = ()
    linked = 0

    def end() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, path, min(1.0, linked / len(text))))
            pieces.clear()
        linked = 0

    def close(k: int) -> None:
        opened.subtract(name for name, *_ in stack[k:])
        del stack[k:]

    for text, tag, closing, attributes in _Scan(source).tokens():
        if text is not None:
            if not pieces:
                if text.isspace():
                    continue
                path = tuple(sorted(stack[-1][1])) if stack else ()
            text = html.unescape(text)
            pieces.append(text)
            if stack and stack[-1][2]:
                linked += len(text.strip())
            continue
        tag = tag.lower()
        inline = tag in _INLINE
        if not inline:
            end()
        elif tag == "br":
            if pieces:
                pieces.append(" ")
            continue
        if tag in _VOID:
            continue
        if closing:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if not inline:
            closes = ("p",) if tag not in _CLOSES else (*_CLOSES[tag], "p")
            for k in range(len(stack) - 1 if any(opened[c] for c in closes) else -1, -1, -1):
                if stack[k][0] in closes:
                    close(k)
                    if stack and stack[-1][0] not in closes:
                        break
                elif stack[k][0] not in _INLINE and stack[k][0] != "p":
                    break
        above, links = stack[-1][1:] if stack else (frozenset(), 0)
        own = _tokens(tag, attributes)
        stack.append((tag, above if above.issuperset(own) else above.union(own), links + (tag == "a")))
        opened[tag] += 1
    end()
    return out
