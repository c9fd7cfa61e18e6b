"""Chunked lexer of notebook code: comments and string literals as spans.

The lexer is a finite automaton over lines.  A chunk of a file is summed up by its transition
function (end state and open brackets for each start state); functions compose, so the start of
every chunk of a huge file follows from a parallel prefix over the functions, and chunks are then lexed
independently.  Cells start afresh: a cell header resets the state whatever came before.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

CODE, COMMENT, SINGLE, DOUBLE, TRIPLE_SINGLE, TRIPLE_DOUBLE, FOREIGN, FOREIGN_REMARK = range(8)
STATES = 8
#: More brackets than are ever open.
FAR = 1 << 40
QUOTE = {SINGLE: "'", DOUBLE: '"', TRIPLE_SINGLE: "'''", TRIPLE_DOUBLE: '"""'}
HEADER = re.compile(r"Content of code cell #\d+:")
HEADED = re.compile(r"Content of code cell #\d+:\s*(?:%%\w+)?")
#: Cell magics whose cells are not Python; others (``%%time``) leave the cell as it is.
FOREIGN_MAGIC = re.compile(r"\s*%%(?:bash|sh|script|perl|ruby|html|javascript|js|svg|latex|markdown|sql|bigquery|R|writefile|file|cmd|system|sx)\b")
IN_CODE = re.compile(r"#|'''|\"\"\"|'|\"|[()\[\]{}]")
IN_STRING = {
    SINGLE: re.compile(r"\\.|'", re.S),
    DOUBLE: re.compile(r'\\.|"', re.S),
    TRIPLE_SINGLE: re.compile(r"\\.|'''", re.S),
    TRIPLE_DOUBLE: re.compile(r'\\.|"""', re.S),
}
PREFIX = re.compile(r"(?:^|[^\w])((?:[rR][bBfF]?|[bBfF][rR]?|[uU]))\Z")
FOREIGN_COMMENT = re.compile(r"(?:^|(?<=\s))#")


@dataclass
class Span:
    """A piece of text: ``kind`` comment or string; prefix of the literal; brackets open before it.

    ``left``/``right`` say that it continues from or into the neighbouring chunk; ``gap`` is what
    stands before it, as ``gap_of`` tells it.
    """

    kind: str
    start: int
    end: int
    text: str
    prefix: str = ""
    depth: int = 0
    left: bool = False
    right: bool = False
    own_line: bool = False
    gap: int = -1


_CONTINUED = re.compile(r"(?:[ \t]|\\\r?\n)*")


def gap_of(text: str) -> int:
    """What stands between two spans: -1 code, else white space with so many line ends, continued lines not counted."""
    if not text or text.isspace():
        return text.count("\n")
    return 0 if "\\" in text and _CONTINUED.fullmatch(text) else -1


def gap_sum(first: int, then: int) -> int:
    """The gap that two gaps make one after the other."""
    return -1 if first < 0 or then < 0 else first + then


def lex_line(line: str, state: int, at: int, depth: int, spans: list[Span] | None) -> tuple[int, int]:
    """Advance over one line (with its end of line); append spans if asked.  Returns (state, depth)."""
    header = HEADER.match(line)
    pos = 0
    if header:
        pos, depth = header.end(), 0
        state = FOREIGN if FOREIGN_MAGIC.match(line, pos) else CODE
    body_end = len(line.rstrip("\r\n"))
    ended = body_end < len(line)
    if state in (COMMENT, FOREIGN_REMARK):  # the chunk begins within a comment
        if spans is not None:
            spans.append(Span("comment", at, at + body_end, line[:body_end], left=True, right=not ended))
        return (state if not ended else CODE if state == COMMENT else FOREIGN), depth
    if state == FOREIGN:
        if mark := FOREIGN_COMMENT.search(line, pos, body_end):
            if spans is not None:
                spans.append(Span("comment", at + mark.start(), at + body_end, line[mark.end() : body_end], right=not ended, own_line=not line[pos : mark.start()].strip()))
            return (FOREIGN if ended else FOREIGN_REMARK), 0
        return FOREIGN, 0
    while pos < len(line):
        if state == CODE:
            mark = IN_CODE.search(line, pos, body_end)
            if not mark:
                break
            token = mark.group()
            if token == "#":
                if spans is not None:
                    first = header.end() if header else 0
                    spans.append(Span("comment", at + mark.start(), at + body_end, line[mark.end() : body_end], right=not ended, own_line=not line[first : mark.start()].strip()))
                return (CODE if ended else COMMENT), depth
            if token in "([{":
                depth += 1
            elif token in ")]}":
                depth = max(0, depth - 1)
            else:
                state = {"'": SINGLE, '"': DOUBLE, "'''": TRIPLE_SINGLE, '"""': TRIPLE_DOUBLE}[token]
                if spans is not None:
                    lead = PREFIX.search(line[max(0, mark.start() - 3) : mark.start()])
                    prefix = lead.group(1).lower() if lead else ""
                    spans.append(Span("string", at + mark.start() - len(prefix), at + len(line), "", prefix, depth, right=True))
            pos = mark.end()
        else:
            begin, closed = pos, False
            while mark := IN_STRING[state].search(line, pos):
                pos = mark.end()
                if mark.group() == QUOTE[state]:
                    closed = True
                    break
            stop = pos - len(QUOTE[state]) if closed else len(line)
            if spans is not None:
                if not spans or not (spans[-1].kind == "string" and spans[-1].right):
                    spans.append(Span("string", at + begin, at + len(line), "", left=True, right=True))
                spans[-1].text += line[begin:stop]
                spans[-1].end = at + pos if closed else at + len(line)
            if closed:
                state = CODE
                if spans is not None:
                    spans[-1].right = False
                continue
            if state in (SINGLE, DOUBLE) and ended and not line[:body_end].endswith("\\"):
                state = CODE  # an unclosed literal ends with its line
                if spans is not None:
                    spans[-1].right = False
            break
    return state, depth


def effects(chunk: str) -> list[tuple[int, int, int]]:
    """The chunk's transition function: (end state, low, change) for each start state.

    Brackets open before it, d, become max(low, d + change): that is what steps up, steps down to
    no less than none, and resets at cell headers (a change of -``FAR``) come to, line after line.
    """
    image = [(s, 0, 0) for s in range(STATES)]
    for line in chunk.splitlines(keepends=True):
        step = {}
        for s in {e for e, _, _ in image}:
            (end, low), (_, high) = lex_line(line, s, 0, 0, None), lex_line(line, s, 0, FAR, None)
            step[s] = (end, low, high - FAR if high > FAR // 2 else -FAR)
        image = [composed(own, step[own[0]]) for own in image]
    return image


def composed(first: tuple[int, int, int], then: tuple[int, int, int]) -> tuple[int, int, int]:
    """The effect of two pieces one after the other, ``then`` being that for the end state of ``first``."""
    return then[0], max(then[1], first[1] + then[2]), max(-FAR, first[2] + then[2])


def prefix_starts(functions: list[list[tuple[int, int, int]]], start: int = CODE) -> list[tuple[int, int]]:
    """Start state and open brackets of each chunk, by doubling: after round r every entry covers 2^r chunks."""
    maps = np.array(functions, dtype=np.int64)
    span = 1
    while span < len(maps):
        first = maps[:-span]
        then = np.take_along_axis(maps[span:], first[:, :, :1], axis=1)
        both = np.stack([then[..., 0], np.maximum(then[..., 1], first[..., 1] + then[..., 2]), np.maximum(-FAR, first[..., 2] + then[..., 2])], axis=-1)
        maps = np.concatenate([maps[:span], both])
        span *= 2
    return [(start, 0), *((int(end), int(max(low, change))) for end, low, change in maps[:-1, start])] if len(maps) else []


def transition(chunk: str) -> list[int]:
    """The end state of the chunk for each start state."""
    return [end for end, _, _ in effects(chunk)]


def prefix_states(functions: list[list[int]], start: int = CODE) -> list[int]:
    """Start state of each chunk from its ``transition``."""
    return [s for s, _ in prefix_starts([[(end, 0, 0) for end in f] for f in functions], start)]


def cut(text: str, size: int) -> list[tuple[int, str]]:
    """Chunks of about ``size`` characters as (offset, text), cut after a line end where there is one,
    else after a blank, else where no quote, hash or backslash touches the cut."""
    out, at = [], 0
    while len(text) - at > size:
        end = text.rfind("\n", at, at + size) + 1
        if end <= at:
            end = text.rfind(" ", at, at + size) + 1
            if end <= at or text[end - 2 : end - 1] == "\\":
                end = at + size
                while end < len(text) and (text[end - 1] in "'\"\\#rRbBfFuU" or text[end] in "'\"\\#"):
                    end += 1
            head = HEADED.match(text, text.rfind("\n", 0, end) + 1)
            end = max(end, head.end()) if head else end
        out.append((at, text[at:end]))
        at = end
    out.append((at, text[at:]))
    return out


def lex(chunk: str, state: int = CODE, offset: int = 0, depth: int = 0) -> list[Span]:
    """Spans of a chunk lexed from ``state`` with ``depth`` brackets open."""
    spans: list[Span] = []
    at = offset
    for line in chunk.splitlines(keepends=True):
        state, depth = lex_line(line, state, at, depth, spans)
        at += len(line)
    end = offset
    for span in spans:
        span.gap = 0 if span.left else gap_of(chunk[end - offset : span.start - offset])
        end = span.end
    return spans


def edges(chunk: str, spans: list[Span], offset: int, first: bool, last: bool) -> tuple[list[Span], list[Span], int]:
    """(spans within the chunk, spans that may go together with those of its neighbours, gap at its end).

    Only code parts spans for good, so what follows the chunk's begin or comes before its end without
    code between is kept for ``stitch``.  Without spans the gap is the whole chunk's.
    """
    tail = gap_of(chunk[(spans[-1].end if spans else offset) - offset :])
    head, back = 0, len(spans)
    if spans and not first and spans[0].gap >= 0:
        head = 1
        while head < len(spans) and spans[head].gap >= 0:
            head += 1
    if spans and not last and (tail >= 0 or spans[-1].right):
        back -= 1
        while back > head and spans[back].gap >= 0:
            back -= 1
    return spans[head:back], spans[:head] + spans[max(head, back) :], tail


def stitch(parts: list[tuple[list[Span], int, bool]]) -> list[Span]:
    """Join the spans of consecutive chunks, given as (spans, gap at the end, whether the chunk has any
    span at all); a literal cut by a boundary becomes one span again."""
    out: list[Span] = []
    gap = -1
    for spans, tail, some in parts:
        for k, span in enumerate(spans):
            if span.left and out and out[-1].right and out[-1].kind == span.kind:
                out[-1].text += span.text
                out[-1].end, out[-1].right = span.end, span.right
            else:
                if not k and not span.left:
                    span.gap = gap_sum(gap, span.gap)
                out.append(span)
        gap = tail if some else gap_sum(gap, tail)
    return out
