"""Text of a Markdown document (CommonMark without extensions): a walk over blocks, then over the inlines of each."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    code_blocks: bool = True
    inline_code: bool = True
    break_to_space: bool = True


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_RAW_BLOCK = re.compile(r" {0,3}<(?:!--|\?|![A-Za-z]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_DEFINITION = re.compile(r" {0,3}\[([^\[\]]+)\]:[ \t]*(\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_RAW = re.compile(r"<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|</[A-Za-z][A-Za-z0-9-]*\s*>|<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_ESCAPED = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class _Out:
    def __init__(self, options: Options):
        self.options, self.parts, self.broken = options, [], True

    def text(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.broken = False

    def gap(self) -> None:
        if self.options.break_to_space and not self.broken:
            self.parts.append(" ")
            self.broken = True


def _inlines(s: str, out: _Out, defined: set[str]) -> None:
    """Emits the text of a paragraph's inlines."""
    nodes: list[tuple[str, str]] = []  # (kind, text): t text, c code, b break, d run of emphasis marks
    closers: list[tuple[int, int]] = []  # open brackets: node index, place in s
    i, n = 0, len(s)
    while i < n:
        ch = s[i]
        if ch == "\\" and i + 1 < n and (s[i + 1] in _ESCAPED or s[i + 1] == "\n"):
            nodes.append(("b", "") if s[i + 1] == "\n" else ("t", s[i + 1]))
            i += 2
        elif ch == "`":
            run = re.match("`+", s[i:])[0]
            end = re.compile(rf"(?<!`){run}(?!`)").search(s, i + len(run))
            if end:
                code = s[i + len(run) : end.start()].replace("\n", " ")
                if len(code) > 2 and code[0] == code[-1] == " " and code.strip():
                    code = code[1:-1]
                nodes.append(("c", code))
                i = end.end()
            else:
                nodes.append(("t", run))
                i += len(run)
        elif ch == "\n":
            if nodes and nodes[-1][0] == "t":
                nodes[-1] = ("t", nodes[-1][1].rstrip(" "))
            nodes.append(("b", ""))
            i += 1
            while i < n and s[i] in " \t":
                i += 1
        elif ch == "<" and (m := _AUTOLINK.match(s, i)):
            nodes.append(("t", m[1]))
            i = m.end()
        elif ch == "<" and (m := _RAW.match(s, i)):
            i = m.end()
        elif ch == "&" and (m := _ENTITY.match(s, i)):
            nodes.append(("t", html.unescape(m[0])))
            i = m.end()
        elif ch == "[" or ch == "!" and s[i : i + 2] == "![":
            mark = "[" if ch == "[" else "!["
            closers.append((len(nodes), i + len(mark)))
            nodes.append(("t", mark))
            i += len(mark)
        elif ch == "]" and closers:
            at, begin = closers.pop()
            m = _TARGET.match(s, i + 1) if s[i + 1 : i + 2] == "(" else None
            end = m.end() if m else None
            if end is None:
                label = re.compile(r"\[([^\[\]]*)\]").match(s, i + 1)
                name = label[1] if label and label[1] else s[begin:i]
                if " ".join(name.split()).casefold() in defined:
                    end = label.end() if label else i + 1
            if end is None:
                nodes.append(("t", "]"))
                i += 1
            else:
                nodes[at] = ("t", "")
                i = end
        elif ch in "*_":
            run = re.match(rf"\{ch}+", s[i:])[0]
            before, after = s[i - 1] if i else " ", s[i + len(run)] if i + len(run) < n else " "
            punct = lambda c: not c.isalnum() and not c.isspace()
            left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
            right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
            opens = left and (ch == "*" or not right or punct(before))
            closes = right and (ch == "*" or not left or punct(after))
            nodes.append((f"d{int(opens)}{int(closes)}", run))
            i += len(run)
        else:
            end = i + 1
            while end < n and s[end] not in "\\`\n<&[]!*_":
                end += 1
            nodes.append(("t", s[i:end]))
            i = end
    _emphasis(nodes)
    for kind, text in nodes:
        if kind == "b":
            out.gap()
        elif kind == "c":
            if out.options.inline_code:
                out.text(text)
        else:
            out.text(text)


def _emphasis(nodes: list[tuple[str, str]]) -> None:
    """Takes out the marks that pair up."""
    length: dict[int, int] = {}
    opened: list[int] = []
    for i, (kind, text) in enumerate(nodes):
        if kind[0] != "d":
            continue
        length[i] = len(text)
        if kind[2] == "1":
            j = len(opened) - 1
            while j >= 0 and length[i]:
                o = opened[j]
                both = kind[1] == "1" or nodes[o][0][2] == "1"
                if nodes[o][1][0] != text[0] or both and (len(nodes[o][1]) + len(text)) % 3 == 0 and (len(nodes[o][1]) % 3 or len(text) % 3):
                    j -= 1
                    continue
                take = 2 if length[o] > 1 and length[i] > 1 else 1
                length[o] -= take
                length[i] -= take
                del opened[j + 1 :]
                if not length[o]:
                    opened.pop()
                    j = len(opened) - 1
        if kind[1] == "1" and length[i]:
            opened.append(i)
    for i, left in length.items():
        nodes[i] = ("t", nodes[i][1][:left])


def _blocks(lines: list[str], out: _Out, defined: set[str], loose: bool = True) -> None:
    """Walks the blocks of some lines; quotes and list items are walked with their own lines."""
    i, n = 0, len(lines)
    held: list[str] = []

    def flush() -> None:
        if held:
            out.gap()
            _inlines("\n".join(x.strip(" \t") if j else x.lstrip(" \t") for j, x in enumerate(_hard(held))), out, defined)
            out.gap()
            held.clear()

    while i < n:
        line = lines[i].expandtabs(4)
        fence = _FENCE.match(line)
        if not line.strip():
            flush()
            i += 1
        elif not held and line.startswith("    "):
            j = i
            while j < n and (not lines[j].strip() or lines[j].expandtabs(4).startswith("    ")):
                j += 1
            body = [x.expandtabs(4)[4:] for x in lines[i:j]]
            while body and not body[-1].strip():
                body.pop()
            if out.options.code_blocks:
                out.text("\n".join(body) + "\n")
            out.gap()
            i = j
        elif fence and not (fence[1][0] == "`" and "`" in fence[2]):
            flush()
            indent = len(line) - len(line.lstrip(" "))
            close = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
            j = i + 1
            body = []
            while j < n and not close.match(lines[j]):
                own = len(lines[j]) - len(lines[j].lstrip(" "))
                body.append(lines[j][min(own, indent) :])
                j += 1
            if out.options.code_blocks and body:
                out.text("\n".join(body) + "\n")
            out.gap()
            i = j + 1
        elif m := _HEADING.match(line):
            flush()
            out.gap()
            _inlines((m[1] or "").strip(), out, defined)
            out.gap()
            i += 1
        elif held and _SETEXT.match(line):
            flush()
            i += 1
        elif _RULE.match(line):
            flush()
            i += 1
        elif _QUOTE.match(line):
            flush()
            j, own = i, []
            while j < n and lines[j].strip() and (_QUOTE.match(lines[j]) or own and own[-1].strip() and not _starts(lines[j])):
                own.append(_QUOTE.sub("", lines[j], count=1) if _QUOTE.match(lines[j]) else lines[j])
                j += 1
            _blocks(own, out, defined)
            i = j
        elif (m := _ITEM.match(line)) and not (held and (not line[m.end() :].strip() or m[2][0].isdigit() and m[2][:-1] != "1")):
            flush()
            spaces = len(m[3])
            rest = line[m.end() :]
            width = m.end() if rest.strip() and spaces <= 4 else m.end() - spaces + 1
            own, j = [" " * (max(0, spaces - 1) if spaces > 4 else 0) + rest], i + 1
            while j < n:
                x = lines[j].expandtabs(4)
                if not x.strip():
                    own.append("")
                elif len(x) - len(x.lstrip(" ")) >= width:
                    own.append(x[width:])
                elif own[-1].strip() and not _starts(x):
                    own.append(x.strip())
                else:
                    break
                j += 1
            while own and not own[-1].strip():
                own.pop()
            out.gap()
            _blocks(own, out, defined)
            out.gap()
            i = j
        elif not held and _RAW_BLOCK.match(line) and not _AUTOLINK.match(line.strip()):
            comment = line.lstrip().startswith("<!--")
            while i < n and (lines[i].strip() or comment):
                done = comment and "-->" in lines[i]
                i += 1
                if done:
                    break
        elif not held and _DEFINITION.match(line):
            i += 1
        else:
            held.append(lines[i])
            i += 1
    flush()


def _hard(lines: list[str]) -> list[str]:
    return [x.rstrip(" \t") for x in lines]


def _starts(line: str) -> bool:
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _ITEM.match(line) or _QUOTE.match(line))


def text(markdown: str, options: Options = Options()) -> str:
    lines = re.split(r"\r\n|\n|\r", markdown)
    defined = {" ".join(m[1].split()).casefold() for m in map(_DEFINITION.match, lines) if m}
    out = _Out(options)
    _blocks(lines, out, defined)
    return "".join(out.parts).strip()
