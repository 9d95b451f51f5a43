"""Chunks of a note for embedding: whole if it fits, else by heading section, else cut at natural ends.

Offsets are UTF-8 bytes of the note. The chunks of a note cover its body without gaps or overlaps; what a
chunk repeats of its predecessor for context is kept apart. Token counts may do what they like as a text
grows: every text that becomes a chunk has been counted.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from hashlib import sha256

from marginalia.functions import frontmatter, markdown

# Chunks of a note, tokens (and bytes for each of them) repeated from the chunk before, prefixes tried one by one.
MAX_CHUNKS, OVERLAP_TOKENS, OVERLAP_BYTES, MAX_PROBES = 4096, 32, 8, 4096
_STOP = re.compile(r"[.!?。！？](?=\s|\Z)")
_SPACE = re.compile(r"\s")


class TooLong(ValueError):
    """No part of a section fits beside its title and headings."""


def word_count(text: str) -> int:
    """The default token counter: words, long ones counting once more for every eight bytes."""
    if text.isascii():
        return sum((len(w) + 7) // 8 for w in text.split())
    return sum((len(w.encode("utf-8", "surrogatepass")) + 7) // 8 for w in text.split())


def input_hash(text: str) -> str:
    return sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class _Note:
    """The bytes of a note with its blocks and the limits that chunks are cut by."""

    def __init__(self, content: str, blocks: list[tuple[int, int, str]], max_tokens: int, count: Callable[[str], int]):
        self.raw, self.blocks, self.max_tokens, self.count = content.encode("utf-8", "surrogatepass"), blocks, max_tokens, count
        self.ends = [end for _, end, _ in blocks]

    def text(self, a: int, b: int) -> str:
        return self.raw[a:b].decode("utf-8", "surrogatepass")

    def whole(self, at: int, up: bool = False) -> int:
        """The character boundary at or before a byte (at or after it)."""
        while 0 < at < len(self.raw) and self.raw[at] & 0xC0 == 0x80:
            at += 1 if up else -1
        return at

    def after(self, at: int) -> int:
        """Where the character at a byte ends."""
        return min(len(self.raw), self.whole(at + 1, up=True)) if at < len(self.raw) else at

    def fits(self, lead: str, a: int, b: int) -> bool:
        return self.count(lead + self.text(a, b)) <= self.max_tokens

    def block_at(self, at: int) -> tuple[int, int, str] | None:
        n = bisect_right(self.ends, at)
        return self.blocks[n] if n < len(self.blocks) and self.blocks[n][0] <= at else None

    def block_cut(self, a: int, b: int) -> str | None:
        """The kind of the block that a chunk cuts, the one at its start first."""
        first, last = self.block_at(a), self.block_at(max(0, b - 1))
        if first and (a > first[0] or b < first[1]):
            return first[2]
        return last[2] if last and b < last[1] else None

    def overlap(self, prefix: str, start: int, low: int) -> int:
        """Where what is repeated before `start` begins: in the same block, halved until it is few tokens and leaves room."""
        block = self.block_at(start)
        if block is None or start <= low or start <= block[0]:
            return start
        at = self.whole(max(start - OVERLAP_TOKENS * OVERLAP_BYTES, block[0], low), up=True)
        while at < start:
            if self.count(self.text(at, start)) <= OVERLAP_TOKENS and self.fits(prefix + self.text(at, start), start, self.after(start)):
                return at
            at = self.whole(at + (start - at + 1) // 2, up=True)
        return start

    def reach(self, lead: str, start: int, stop: int) -> int:
        """An end that fits, from a first guess doubled while it fits or halved until it does."""
        least = self.after(start)
        end, fit = max(least, self.whole(min(stop, start + max(4, 4 * self.max_tokens)))), None
        while True:
            if self.fits(lead, start, end):
                fit = end
                if end == stop:
                    return end
                end = max(self.whole(min(stop, start + 2 * (end - start))), self.after(end))
            elif fit is not None:
                return fit
            elif end == least:
                return self.probe(lead, start, stop)
            else:
                end = max(least, self.whole(start + (end - start) // 2))

    def probe(self, lead: str, start: int, stop: int) -> int:
        """The first prefix that fits, character by character, for counts that fall as a text grows."""
        end = start
        for _ in range(MAX_PROBES):
            if end >= stop:
                raise TooLong("a section doesn't fit beside its headings")
            end = self.after(end)
            if self.fits(lead, start, end):
                return end
        raise ValueError(f"more than {MAX_PROBES} ends tried")

    def natural(self, lead: str, start: int, end: int, least: int) -> int:
        """The last block end up to `end`, else sentence, line or word end; past `least`, and counted again."""
        n = bisect_right(self.ends, end)
        text = self.text(start, end)
        after = self.text(end, self.after(end))
        place = lambda found: start + len(text[: found[-1]].encode("utf-8", "surrogatepass")) if found else start
        stops = [m.end() for m in _STOP.finditer(text + after) if m.end() <= len(text)]
        spaces = [m.end() for m in _SPACE.finditer(text)]
        line = text.rfind("\n") + 1
        for cut in (self.ends[n - 1] if n else start, place(stops), place([line] if line else []), place(spaces)):
            if least < cut <= end and (cut == end or self.fits(lead, start, cut)):
                return cut
        return end


def chunks(path_title: str, content: str, max_tokens: int, count: Callable[[str], int] = word_count) -> list[dict]:
    """scope, text, input_hash, start, end, overlap_start, heading_path and block_kind of each chunk of a note."""
    _, body_at = frontmatter.split(content)
    body = content[body_at:]
    if not body.strip():
        return []
    whole, first = f"{path_title}\n{body}", len(content[:body_at].encode("utf-8", "surrogatepass"))
    out: list[dict] = []

    def add(scope, text, a, b, overlap, heads, kind):
        if len(out) == MAX_CHUNKS:
            raise ValueError(f"more than {MAX_CHUNKS} chunks")
        out.append({"scope": scope, "text": text, "input_hash": input_hash(text), "start": a, "end": b, "overlap_start": overlap if overlap < a else None, "heading_path": heads, "block_kind": kind})

    if count(whole) <= max_tokens:
        add("note", whole, first, first + len(body.encode("utf-8", "surrogatepass")), first, [], None)
        return out
    s = markdown.structure(content)
    note = _Note(content, [(x.start, x.end, x.kind) for x in s.blocks], max_tokens, count)
    heads = [h for h in s.headings if h.offset >= first]
    starts = [h.offset for h in heads] + [len(note.raw)]
    sections = [(first, starts[0], first, [])] if starts[0] > first or not heads else []
    stack: list[tuple[int, str]] = []
    for h, stop in zip(heads, starts[1:]):
        stack = [x for x in stack if x[0] < h.level] + [(h.level, h.text)]
        sections.append((h.offset, stop, h.end, [t for _, t in stack]))
    for a, b, heading_end, names in sections:
        prefix = f"{path_title}\n" + (" > ".join(names) + "\n" if names else "")
        if note.fits(prefix, a, b):
            add("passage", prefix + note.text(a, b), a, b, a, names, None)
            continue
        if a == b:
            raise TooLong("a section doesn't fit beside its headings")
        has_text, start = bool(note.text(heading_end, b).strip()), a
        while start < b:
            overlap = note.overlap(prefix, start, a)
            lead = prefix + note.text(overlap, start)
            end = note.reach(lead, start, b)
            if end < b:
                end = note.natural(lead, start, end, heading_end if start == a and has_text else start)
            add("passage", lead + note.text(start, end), start, end, overlap, names, note.block_cut(start, end))
            start = end
    return out


def plan_batch(sizes: list[int], max_items: int, max_tokens: int) -> int:
    """How many of the first inputs go into one request; one at least."""
    n = total = 0
    for size in sizes[:max_items]:
        if n and total + size > max_tokens:
            break
        n, total = n + 1, total + size
    return n


def validate_vectors(vectors: list[list[float]], expected: int, dim: int) -> None:
    """A reply's vectors must be as many as asked for, of one dimension and finite."""
    if len(vectors) != expected or any(len(v) != dim or any(x != x or x in (float("inf"), float("-inf")) for x in v) for v in vectors):
        raise ValueError("the embedding reply doesn't match the request")
