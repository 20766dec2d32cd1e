"""Markdown cells to HTML: blocks by lines, then inline marks with a stack of delimiters.

Follows the CommonMark rules for code, headings, quotes, lists, emphasis, links and raw
HTML, with tables of pipes besides; link titles and destinations are dropped, as only
words and code tags are looked for.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections import defaultdict

#: Quotes and lists nested deeper than this are text.
DEPTH = 40
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ ]*([^`]*)$|^ {0,3}(~{3,}).*$")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ ]+(.*?))?(?:[ ]+#+)?[ ]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ ]*$")
RULE = re.compile(r" {0,3}([-*_])(?:[ ]*\1){2,}[ ]*$")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( +|$)")
TABLE = re.compile(r" {0,3}\|?[ ]*:?-+:?[ ]*(?:\|[ ]*:?-+:?[ ]*)*\|?[ ]*$")
RAW_BLOCK = re.compile(r" {0,3}<(?:!--|/?(?:address|article|aside|blockquote|body|center|details|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|script|section|style|summary|table|tbody|td|th|thead|tr|ul)\b)", re.I)
DEFINITION = re.compile(r" {0,3}\[([^\]\[]+)\]:[ ]*\S+.*$")
RAW_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--.*?--)>", re.S)
TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
LABEL = re.compile(r"\[([^\]\[]*)\]")
SPECIAL = re.compile(r"[\\`<!\[\]*_]")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\w+);")


def render(markdown: str) -> str:
    """HTML of a text."""
    rows = [x.expandtabs(4) for x in re.split(r"\r\n|\r|\n", markdown)]
    labels = {m[1].strip().lower() for m in map(DEFINITION.match, rows) if m}
    return "\n".join(blocks(rows, labels, 0))


def code_block(rows: list[str]) -> str:
    return f"<pre><code>{html.escape('\n'.join(rows), quote=False)}</code></pre>"


def starts_block(row: str) -> bool:
    """Whether a row ends a paragraph that it follows."""
    item = ITEM.match(row)
    return bool(FENCE.match(row) or HEADING.match(row) or RULE.match(row) or QUOTE.match(row) or RAW_BLOCK.match(row) or (item and row[item.end() :].strip() and item[2] in "-+*1.1)"))


def cells_of(row: str) -> list[str]:
    """The cells of a table's row; an escaped bar doesn't part them."""
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\||(?<!\\)\|$", "", row.strip()))]


def blocks(rows: list[str], labels: set[str], depth: int, tight: bool = False) -> list[str]:
    out: list[str] = []
    text: list[str] = []

    def close(tag: str = "p") -> None:
        if text:
            inner = inline("\n".join(x.strip() for x in text), labels)
            out.append(inner if tight and tag == "p" else f"<{tag}>{inner}</{tag}>")
            text.clear()

    i = 0
    while i < len(rows):
        row = rows[i]
        if not row.strip():
            close()
            i += 1
        elif not text and row.startswith("    "):
            j = i
            while j < len(rows) and (rows[j].startswith("    ") or not rows[j].strip()):
                j += 1
            own = [x[4:] for x in rows[i:j]]
            while not own[-1].strip():
                own.pop()
            out.append(code_block(own))
            i = j
        elif not row.startswith("    ") and (m := FENCE.match(row)):
            close()
            mark, indent = m[1] or m[3], len(row) - len(row.lstrip())
            ends = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ ]*$")
            j = next((k for k in range(i + 1, len(rows)) if ends.match(rows[k])), len(rows))
            out.append(code_block([re.sub(rf"^ {{0,{indent}}}", "", x) for x in rows[i + 1 : j]]))
            i = j + 1
        elif m := HEADING.match(row):
            close()
            out.append(f"<h{len(m[1])}>{inline(m[2] or '', labels)}</h{len(m[1])}>")
            i += 1
        elif text and (m := UNDERLINE.match(row)):
            close("h1" if m[1][0] == "=" else "h2")
            i += 1
        elif RULE.match(row):
            close()
            out.append("<hr />")
            i += 1
        elif depth < DEPTH and QUOTE.match(row):
            close()
            j = i
            while j < len(rows) and rows[j].strip() and (QUOTE.match(rows[j]) or not starts_block(rows[j])):
                j += 1
            out += ["<blockquote>", *blocks([QUOTE.sub("", x, count=1) for x in rows[i:j]], labels, depth + 1), "</blockquote>"]
            i = j
        elif depth < DEPTH and (m := ITEM.match(row)) and not (text and not (row[m.end() :].strip() and m[2] in ("-", "+", "*", "1.", "1)"))):
            close()
            found, i = list_at(rows, i, labels, depth)
            out += found
        elif not text and RAW_BLOCK.match(row):
            while i < len(rows) and rows[i].strip():
                out.append(rows[i])
                i += 1
        elif not text and "|" in row and i + 1 < len(rows) and TABLE.match(rows[i + 1]) and len(cells_of(row)) == len(cells_of(rows[i + 1])):
            out += ["<table>", "".join(f"<th>{inline(c, labels)}</th> " for c in cells_of(row))]
            i += 2
            while i < len(rows) and rows[i].strip() and not starts_block(rows[i]):
                out.append("".join(f"<td>{inline(c, labels)}</td> " for c in cells_of(rows[i])))
                i += 1
            out.append("</table>")
        elif not text and DEFINITION.match(row):
            i += 1
        else:
            text.append(row)
            i += 1
    close()
    return out


def list_at(rows: list[str], i: int, labels: set[str], depth: int) -> tuple[list[str], int]:
    """(HTML of the list that begins at row i, the row after it)."""
    first = ITEM.match(rows[i])
    kind = first[2][-1]
    items: list[list[str]] = []
    loose = False
    while i < len(rows) and (m := ITEM.match(rows[i])) and m[2][-1] == kind and not RULE.match(rows[i]):
        pad = len(m[3]) if 1 <= len(m[3]) <= 4 and rows[i][m.end() :].strip() else 1
        width = len(m[1]) + len(m[2]) + pad
        own = [rows[i][width:]]
        i += 1
        while i < len(rows):
            row = rows[i]
            if row.startswith(" " * width):
                own.append(row[width:])
            elif not row.strip():
                own.append("")
            elif own[-1].strip() and not starts_block(row) and not ITEM.match(row):
                own.append(row.lstrip())  # the paragraph goes on
            else:
                break
            i += 1
        while own and not own[-1].strip():
            own.pop()
            loose = loose or bool(i < len(rows) and (n := ITEM.match(rows[i])) and n[2][-1] == kind)
        loose = loose or any(not x.strip() for x in own)
        items.append(own)
    tag = "ol" if first[2][0].isdigit() else "ul"
    return [f"<{tag}>", *("<li>" + "\n".join(blocks(x, labels, depth + 1, not loose)) + "</li>" for x in items), f"</{tag}>"], i


class Run:
    """A run of * or _ that may open or close emphasis, and its place among the pieces."""

    def __init__(self, mark: str, n: int, opens: bool, closes: bool, at: int):
        self.mark, self.n, self.length, self.opens, self.closes, self.at = mark, n, n, opens, closes, at


def flanks(text: str, a: int, b: int) -> tuple[bool, bool]:
    """Whether the run text[a:b] can open and close emphasis."""
    before, after = text[a - 1 : a] or " ", text[b : b + 1] or " "
    sign = lambda c: unicodedata.category(c)[0] in "PS"
    left = not after.isspace() and (not sign(after) or before.isspace() or sign(before))
    right = not before.isspace() and (not sign(before) or after.isspace() or sign(after))
    if text[a] == "*":
        return left, right
    return left and (not right or sign(before)), right and (not left or sign(after))


def emphasis(pieces: list[str], runs: list[Run]) -> None:
    """Puts the tags of emphasis into the pieces: each closing run takes the nearest opening one."""
    closing = 0
    bottom: dict[tuple, int] = {}  # below this place no opening run fits a closing one of the kind
    while closing < len(runs):
        end = runs[closing]
        if not end.closes or not end.n:
            closing += 1
            continue
        kind = (end.mark, end.opens, end.length % 3)
        k = closing - 1
        while k >= bottom.get(kind, 0):
            begin = runs[k]
            odd = (begin.closes or end.opens) and (begin.length + end.length) % 3 == 0 and (begin.length % 3 or end.length % 3)
            if begin.mark == end.mark and begin.opens and begin.n and not odd:
                break
            k -= 1
        else:
            bottom[kind] = closing
            closing += 1
            continue
        n = 2 if begin.n >= 2 and end.n >= 2 else 1
        tag = "strong" if n == 2 else "em"
        begin.n, end.n = begin.n - n, end.n - n
        shut = re.match(r"(?:</\w+>)*", pieces[begin.at])[0]  # what the run closed before it opened
        pieces[begin.at] = f"{shut}<{tag}>{pieces[begin.at][len(shut):]}"
        pieces[end.at] += f"</{tag}>"
        del runs[k + 1 : closing]
        closing = k + 1


def inline(text: str, labels: set[str]) -> str:
    """HTML of the marks inside a paragraph."""
    ticks: dict[int, list[int]] = defaultdict(list)
    for m in re.finditer(r"`+", text):
        ticks[len(m[0])].append(m.start())
    pieces: list[str] = []
    runs: list[Run] = []
    brackets: list[tuple[int, int, int]] = []  # piece, run, place in the text
    i = 0
    while i < len(text):
        m = SPECIAL.search(text, i)
        j = m.start() if m else len(text)
        if j > i:
            pieces.append(plain(text[i:j]))
        if not m:
            break
        c, i = text[j], j + 1
        if c == "\\":
            if text[i : i + 1] and text[i] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                pieces.append(html.escape(text[i], quote=False))
                i += 1
            else:
                pieces.append("\\")
        elif c == "`":
            n = len(re.compile(r"`+").match(text, j)[0])
            at = bisect.bisect_right(ticks[n], j)
            if at < len(ticks[n]):
                inner = text[j + n : ticks[n][at]].replace("\n", " ")
                if inner.strip(" ") and inner[0] == inner[-1] == " ":
                    inner = inner[1:-1]
                pieces.append(f"<code>{html.escape(inner, quote=False)}</code>")
                i = ticks[n][at] + n
            else:
                pieces.append("`" * n)
                i = j + n
        elif c == "<":
            if tag := RAW_TAG.match(text, j):
                link = re.fullmatch(r"<((?:[A-Za-z][A-Za-z0-9+.-]{1,31}:|[^\s@<>]+@)[^\s<>]*)>", tag[0])
                pieces.append(f"<a>{html.escape(link[1], quote=False)}</a>" if link else tag[0])
                i = tag.end()
            else:
                pieces.append("&lt;")
        elif c == "[" or (c == "!" and text[i : i + 1] == "["):
            i += c == "!"
            brackets.append((len(pieces), len(runs), i))
            pieces.append(text[j:i])
        elif c == "!":
            pieces.append("!")
        elif c == "]":
            opened = brackets.pop() if brackets else None
            target = opened and (TARGET.match(text, i) or LABEL.match(text, i))
            if target and target[0][0] == "[" and (target[1] or text[opened[2] : j]).strip().lower() not in labels:
                target = None
            if opened and (target or text[opened[2] : j].strip().lower() in labels):
                inner, own = runs[opened[1] :], opened[0]
                del runs[opened[1] :]
                emphasis(pieces, inner)
                spell(pieces, inner)
                pieces[own] = "<a>"
                pieces.append("</a>")
                i = target.end() if target else i
            else:
                pieces.append("]")
        else:
            n = len(re.compile(re.escape(c) + "+").match(text, j)[0])
            i = j + n
            runs.append(Run(c, n, *flanks(text, j, i), len(pieces)))
            pieces.append("")
    every = list(runs)
    emphasis(pieces, runs)
    spell(pieces, every)
    return "".join(pieces)


def spell(pieces: list[str], runs: list[Run]) -> None:
    """What a run has left stands as it was: before the tags it opens, after those it closes."""
    for run in runs:
        if run.n:
            closed = re.match(r"(?:</\w+>)*", pieces[run.at])[0]
            pieces[run.at] = closed + run.mark * run.n + pieces[run.at][len(closed) :]
            run.n = 0


def plain(text: str) -> str:
    """Text with its signs escaped, entities as they are."""
    out, at = [], 0
    for m in ENTITY.finditer(text):
        out += [html.escape(text[at : m.start()], quote=False), m[0]]
        at = m.end()
    return "".join([*out, html.escape(text[at:], quote=False)])
