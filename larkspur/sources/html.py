"""A tolerant HTML reader for markup that the expression chain in ``functions.text`` is not made for."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkspur.functions.text import BLOCK_TAGS, DROP_TAGS

_BLOCK, _DROP = frozenset(BLOCK_TAGS), frozenset(DROP_TAGS)


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.inside = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _DROP:
            self.inside += 1
        elif tag in _BLOCK:
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in _DROP:
            self.inside = max(0, self.inside - 1)
        elif tag in _BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)


def visible(html: str | bytes | None) -> str:
    """Text of a page before normalisation; bytes are UTF-8, errors replaced."""
    if isinstance(html, (bytes, bytearray)):
        html = bytes(html).decode("utf-8", "replace")
    reader = _Visible()
    reader.feed(html or "")
    reader.close()
    return "".join(reader.parts)


@F.udf(StringType(), useArrow=False)  # pages come by the hundred, in Arrow by the ten thousand, all of which Python would hold
def visible_text(html):
    return visible(html)
