"""Structure of Markdown notes: blocks, headings, tags, links and block ids.

A line scanner covers what notes use: ATX and setext headings, fenced and indented code, quotes, lists,
tables, HTML blocks, rules, the metadata block and code spans. Offsets are UTF-8 bytes unless a name says
`char`; lines count from 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from marginalia.functions import frontmatter

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r" {0,3}(?:[-+*]|[0-9]{1,9}[.)])(?:[ \t]|$)")
_HTML = re.compile(r" {0,3}<(?:/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$)|!--|\?|![A-Z])")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_ATTRIBUTES = re.compile(r"[ \t]*\{[^{}]*\}[ \t]*$")
_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_TAG = re.compile(r"(?:^|[ \t])#([a-zA-Z][\w/-]*)", re.M)
_LINK = re.compile(r"\[\[([^\[\]]+)\]\]")
_BLOCK_ID = re.compile(r"\^([a-zA-Z0-9-]+)[^\S\n]*$", re.M)
_INLINE = re.compile(r"(\*\*|__|\*|_|~~|`)(?=\S)(.+?)(?<=\S)\1")
_MD_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()]*\)")


@dataclass(frozen=True)
class Heading:
    level: int
    text: str
    line: int
    offset: int
    end: int


@dataclass(frozen=True)
class Block:
    kind: str
    start: int
    end: int


@dataclass
class Structure:
    headings: list[Heading]
    blocks: list[Block]
    code: list[tuple[int, int]]  # character ranges that hold no tags, links or ids


def _shown(text: str) -> str:
    """Heading text as shown: emphasis marks, code ticks and link targets go, wikilinks stay."""
    text = _MD_LINK.sub(r"\1", text)
    while (new := _INLINE.sub(r"\2", text)) != text:
        text = new
    return text.strip()


def structure(content: str) -> Structure:
    """Headings, outer blocks and code ranges of a note."""
    lines = re.findall(r"[^\n]*\n|[^\n]+$", content)
    chars = [0]
    for x in lines:
        chars.append(chars[-1] + len(x))
    byte = _byte_offsets(content, chars)
    out = Structure([], [], [])
    _, body = frontmatter.split(content)
    i = bisect_right(chars, body) - 1 if body else 0
    if body:
        out.blocks.append(Block("metadata", 0, byte[i]))
        out.code.append((0, body))

    def close(kind: str, a: int, b: int) -> None:
        if b > a:
            out.blocks.append(Block(kind, byte[a], byte[b]))
            if kind == "code":
                out.code.append((chars[a], chars[b]))

    def heading(level: int, text: str, a: int, b: int) -> None:
        text = _shown(_ATTRIBUTES.sub("", text) if _ATTRIBUTES.search(text) else text)
        out.headings.append(Heading(level, text, a, byte[a], byte[b]))
        out.blocks.append(Block("heading", byte[a], byte[b]))

    n = len(lines)
    bare = [x.rstrip("\r\n") for x in lines]
    while i < n:
        x = bare[i]
        if not x.strip():
            i += 1
            continue
        if x.startswith(("    ", "\t")):
            j = i
            while j < n and (not bare[j].strip() or bare[j].startswith(("    ", "\t"))):
                j += 1
            last = j
            while not bare[last - 1].strip():
                last -= 1
            close("code", i, last)
            i = j
            continue
        if m := _FENCE.match(x):
            mark, j = m[1], i + 1
            shut = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            while j < n and not shut.match(bare[j]):
                j += 1
            close("code", i, min(n, j + 1))
            i = j + 1
            continue
        if m := _ATX.match(x):
            heading(len(m[1]), m[2] or "", i, i + 1)
            i += 1
            continue
        if _RULE.match(x):
            close("rule", i, i + 1)
            i += 1
            continue
        if x.lstrip().startswith(">"):
            j = i + 1
            while j < n and bare[j].strip() and (bare[j].lstrip().startswith(">") or not _starts_block(bare[j])):
                j += 1
            close("quote", i, j)
            _nested(out, bare, chars, byte, i, j, lambda s: re.sub(r"^ {0,3}> ?", "", s))
            i = j
            continue
        if _ITEM.match(x):
            j, blank = i + 1, False
            while j < n:
                if not bare[j].strip():
                    blank = True
                elif bare[j].startswith(("  ", "\t")) or _ITEM.match(bare[j]) and not _RULE.match(bare[j]):
                    blank = False
                elif blank or _starts_block(bare[j]):
                    break
                j += 1
            last = j
            while not bare[last - 1].strip():
                last -= 1
            close("list", i, last)
            _nested(out, bare, chars, byte, i, last, lambda s: s)
            i = j
            continue
        if _HTML.match(x):
            j = i + 1
            while j < n and bare[j].strip():
                j += 1
            close("html", i, j)
            i = j
            continue
        if i + 1 < n and "|" in x and _DELIMITER.match(bare[i + 1]) and "|" in bare[i + 1]:
            j = i + 2
            while j < n and bare[j].strip() and not _starts_block(bare[j]):
                j += 1
            close("table", i, j)
            i = j
            continue
        j, level = i + 1, 0
        while j < n and bare[j].strip():
            if m := _SETEXT.match(bare[j]):
                level = 1 if m[1][0] == "=" else 2
                break
            if _starts_block(bare[j]):
                break
            j += 1
        if level:
            heading(level, " ".join(s.strip() for s in bare[i:j]), i, j + 1)
            i = j + 1
        else:
            close("paragraph", i, j)
            i = j
    out.code += [(m.start(), m.end()) for m in _SPAN.finditer(content) if not _within(m.start(), out.code) and "\n\n" not in m[0]]
    out.code.sort()
    return out


def _starts_block(line: str) -> bool:
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or line.lstrip().startswith(">") and not line.startswith("    ") or _ITEM.match(line) and line.strip()[1:2] == " ")


def _nested(out: Structure, bare, chars, byte, i: int, j: int, strip) -> None:
    """Fenced code and ATX headings inside quotes and lists."""
    k = i
    while k < j:
        x = strip(bare[k]).lstrip()
        if m := _FENCE.match(x):
            e = k + 1
            while e < j and not strip(bare[e]).lstrip().startswith(m[1]):
                e += 1
            out.code.append((chars[k], chars[min(j, e + 1)]))
            k = e + 1
            continue
        y = re.sub(r"^(?:[-+*]|[0-9]{1,9}[.)])[ \t]+", "", x)
        if (m := _ATX.match(y)) and (x != bare[k].lstrip() or y != x):
            out.headings.append(Heading(len(m[1]), _shown(m[2] or ""), k, byte[k] + len(bare[k][: bare[k].index(y[:1])].encode()), byte[k + 1]))
        k += 1


def _byte_offsets(content: str, chars: list[int]) -> list[int]:
    if content.isascii():
        return chars
    out = [0]
    for a, b in zip(chars, chars[1:]):
        out.append(out[-1] + len(content[a:b].encode("utf-8", "surrogatepass")))
    return out


def _within(at: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= at < b for a, b in ranges)


def _outside(matches, ranges: list[tuple[int, int]]):
    starts = [a for a, _ in ranges]
    for m in matches:
        k = bisect_right(starts, m.start()) - 1
        # ranges may nest, so every one that starts before counts
        if k < 0 or not any(a <= m.start() < b for a, b in ranges[: k + 1]):
            yield m


def inline_tags(content: str, code: list[tuple[int, int]]) -> list[str]:
    """Tags outside code, sorted and without repeats, as written."""
    if "#" not in content:
        return []
    at_hash = ((m, m.start(1) - 1) for m in _TAG.finditer(content))
    return sorted({m[1] for m, h in at_hash if not _within(h, code)}, key=str.encode)


def parse_link(inner: str) -> dict:
    """target, heading, block_ref and alias of what stands in double brackets."""
    target, bar, alias = inner.partition("|")
    target, mark, sub = target.partition("#")
    is_block = mark and sub.startswith("^")
    return {
        "raw": inner,
        "target": target.strip(),
        "heading": sub.strip() if mark and not is_block and sub.strip() else None,
        "block_ref": sub[1:].strip() if is_block else None,
        "alias": alias.strip() or None if bar else None,
    }


def wikilinks(content: str, code: list[tuple[int, int]]) -> list[dict]:
    return [parse_link(m[1]) | {"line": content.count("\n", 0, m.start())} for m in _outside(_LINK.finditer(content), code)]


def block_ids(content: str, code: list[tuple[int, int]]) -> list[str]:
    return [m[1] for m in _outside(_BLOCK_ID.finditer(content), code)]


def find_block(content: str, block_id: str) -> tuple[int, int, int, int] | None:
    """Character offsets of the line of a block id: start, end, end with its newline, start of the marker."""
    for m in _outside(_BLOCK_ID.finditer(content), structure(content).code):
        if m[1] == block_id:
            a = content.rfind("\n", 0, m.start()) + 1
            nl = content.find("\n", m.end())
            whole = len(content) if nl < 0 else nl + 1
            end = whole if nl < 0 else nl - (content[nl - 1 : nl] == "\r")
            return a, end, whole, m.start()
    return None


def document_map(content: str) -> dict:
    """Headings as `## text`, block ids and top-level front-matter keys."""
    s = structure(content)
    try:
        keys = list(frontmatter.parse(content) or {})
    except frontmatter.FrontmatterError:
        keys = []
    return {"headings": [f"{'#' * h.level} {h.text}" for h in s.headings], "blocks": block_ids(content, s.code), "frontmatter_keys": keys}


def section_range(content: str, path: str, delimiter: str = "::") -> tuple[int, int] | None:
    """Bytes from the end of a (nested) heading to the next heading of its level or above."""
    return _section(content, path.split(delimiter), lambda part: [part.strip()])


def _section(content: str, parts: list[str], spellings) -> tuple[int, int] | None:
    headings, total = structure(content).headings, len(content.encode("utf-8", "surrogatepass"))
    lo, hi, after = 0, total, 0
    lines = content.split("\n")
    same = lambda h, c: h.text.lower() == c.lower() or (m := _ATX.match(lines[h.line].rstrip("\r"))) and (m[2] or "").lower() == c.lower()
    for part in parts:
        h = next((h for c in spellings(part) for h in headings if lo <= h.offset < hi and same(h, c)), None)
        if h is None:
            return None
        after = lo = h.end
        hi = min(hi, next((x.offset for x in headings if x.offset > h.offset and x.level <= h.level), total))
    return after, hi


def _line_ended(text: str) -> str:
    return text if not text or text.endswith("\n") else text + "\n"


def patch_heading(content: str, operation: str, target: str, text: str) -> str:
    """Put text at the start or end of a heading's section, or in its place; `::` separates nested headings."""
    spellings = lambda part: list(dict.fromkeys([part.strip(), re.sub(r"^#{1,6}\s+", "", part.strip()).strip()]))
    found = _section(content, target.split("::"), spellings)
    if found is None:
        raise KeyError(f"no heading {target!r}")
    raw = content.encode("utf-8", "surrogatepass")
    cut = lambda a, b: raw[a:b].decode("utf-8", "surrogatepass")
    after, end = found
    if operation == "append":
        return _line_ended(_line_ended(cut(0, end)) + text) + cut(end, len(raw))
    head = _line_ended(cut(0, after)) + text
    if operation == "prepend":
        return _line_ended(head) + cut(after, len(raw))
    return (_line_ended(head) if end < len(raw) else head) + cut(end, len(raw))


def patch_block(content: str, operation: str, target: str, text: str) -> str:
    """Replace the text of a block (its id stays) or put lines before or after it, with the note's line ends."""
    found = find_block(content, target.removeprefix("^"))
    if found is None:
        raise KeyError(f"no block {target!r}")
    start, end, whole, marker = found
    if operation == "replace":
        return content[:start] + (text + " " if text else "") + content[marker:]
    newline = content[end:whole] or ("\r\n" if content[:start].endswith("\r\n") else "\n")
    at = start if operation == "prepend" else whole
    ended = lambda s: s if not s or s.endswith("\n") else s + newline
    return ended(ended(content[:at]) + text) + content[at:]


def patch(content: str, operation: str, target_type: str, target: str, text: str) -> str:
    """append, prepend or replace at a heading, a block or a front-matter property."""
    how = {"heading": patch_heading, "block": patch_block, "frontmatter": frontmatter.patch_field}
    if operation not in ("append", "prepend", "replace") or target_type not in how:
        raise ValueError(f"unknown patch {operation!r} of {target_type!r}")
    return how[target_type](content, operation, target, text)
