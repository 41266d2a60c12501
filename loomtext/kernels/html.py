"""Text of an HTML page."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Also applied on the JVM side; unclosed regions run to the end.
HIDDEN = r"(?is)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)"
_HIDDEN = re.compile(HIDDEN.replace(r"\z", r"\Z"))
_BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())


def visible(html: str) -> str:
    """The page without scripts and style sheets."""
    return _HIDDEN.sub("", html)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.verbatim = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "li":
            self.parts.append("\n* ")
        elif tag in _BLOCKS or tag == "br":
            self.parts.append("\n")
        elif tag == "img":
            self.parts += [v for k, v in attrs if k == "alt" and v]
        self.verbatim += tag == "pre"

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.parts.append("\n")
        self.verbatim = max(0, self.verbatim - (tag == "pre"))

    def handle_data(self, data: str) -> None:
        self.parts.append(data if self.verbatim else re.sub(r"[ \t\r\n\f]+", " ", data))


def text(html: str) -> str:
    """Visible text: a line for each block, entities decoded, no limit to a line's width."""
    reader = _Reader()
    reader.feed(visible(html))
    reader.close()
    lines = (line.strip(" \t") for line in "".join(reader.parts).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")
