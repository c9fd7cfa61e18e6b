"""Problem 2: markup residue in text documents.

A narrative is cut into its cells and parsed into a tree: HTML containers and the sections that
headings open hold blocks and each other.  Code, comments and formulas are taken out first, so
that nothing inside them is read as other markup; then tags, LaTeX commands, wiki and Markdown
marks are recognised, and every structure belongs to the node where it was found.  Paragraphs pass
points for length and commas to their ancestors, discounted by link density; the best container
and the siblings that reach a share of its score make up the clean text, with what stands in them
of headings, lists, code and formulas.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.operators.current import current_rows
from notemill.operators.spread import spread

# Elements by the structure that they stand for.
TAGS = {
    **dict.fromkeys(["h1", "h2", "h3", "h4", "h5", "h6"], "heading"),
    **dict.fromkeys(["ul", "ol", "li", "dl", "dt", "dd"], "list"),
    **dict.fromkeys(["pre", "code", "kbd", "samp", "tt"], "code"),
    **dict.fromkeys(["table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"], "table"),
    **dict.fromkeys(["a", "img"], "link"),
    **dict.fromkeys(["b", "strong", "i", "em", "u", "font"], "emphasis"),
    **dict.fromkeys(["div", "p", "br", "hr", "center", "span", "sup"], "layout"),
}
OTHER_TAGS = {"s", "del", "ins", "sub", "small", "big", "mark", "blockquote", "details", "summary", "section", "article", "style", "script", "iframe", "video", "figure", "figcaption", "nav", "header", "footer", "main", "form", "input", "button", "strike"}
MATH_ENVS = "equation|align|alignat|gather|multline|eqnarray|displaymath|math|split|cases|array|[bpvB]?matrix|flalign|aligned"
CODE_ENVS = "verbatim|lstlisting|minted|Verbatim|alltt"
#: Names between double underscores that are Python's, not emphasis.
DUNDER = re.compile(r"__(?:init|name|main|len|str|repr|dict|file|getitem|setitem|delitem|eq|ne|lt|le|gt|ge|slots|builtins|pycache)__")

FRAME_HEAD = re.compile(r"\A\s*Markdown Narrative from:[^\n]*\n={50}[ \t]*(?:\n|\Z)")
CELL_HEAD = re.compile(r"Markdown Cell #\d+:[ \t]*(?:\n|\Z)")
CELL_RULE = "-" * 30

OPAQUE = re.compile(
    r"(?=[`~$<\\ \t>])(?:(?P<fence>^[ \t]{0,3}(?:>[ ]?)?(?P<bar>`{3,}|~{3,})[^\n`]*\n(?:.*?\n)??[ \t]{0,3}(?:>[ ]?)?(?P=bar)[`~]*[ \t]*$|^[ ]{0,3}(?:`{3,}|~{3,})[^\n`]*(?:\n.*)?\Z)"
    r"|(?P<comment><!--.*?(?:-->|\Z))"
    r"|(?P<pre><pre\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*>.*?(?:</pre\s*>|(?=\n[ \t]*\n)|\Z))"
    rf"|(?P<verbatim>\\begin\{{(?P<env>(?:{CODE_ENVS})\*?)\}}.*?(?:\\end\{{(?P=env)\}}|\Z))"
    r"|(?P<verb>\\(?:verb\*?|lstinline)(?:\[[^\]\n]*\])?(?:(?P<sep>[^\sA-Za-z{*])[^\n]*?(?P=sep)|\{[^{}\n]*\}))"
    r"|(?P<tick>(?<![`\\])(?P<ticks>`+)(?!`)(?:(?!\n[ \t]*\n).)+?(?<!`)(?P=ticks)(?!`))"
    r"|(?P<htmlcode><(?P<ctag>code|kbd|samp|tt)\b[^<>]*>.*?(?:</(?P=ctag)\s*>))"
    r"|(?P<display>\$\$(?:(?!\n[ \t]*\n).)+?\$\$|\\\[(?:(?!\n[ \t]*\n).)+?\\\])"
    rf"|(?P<mathenv>\\begin\{{(?P<menv>(?:{MATH_ENVS})\*?)\}}.*?(?:\\end\{{(?P=menv)\}}|(?=\n[ \t]*\n)|\Z))"
    r"|(?P<paren>\\\((?:(?!\n[ \t]*\n).)+?\\\))"
    r"|(?P<inline>(?<![\\$\w])\$(?![\s$])(?P<body>[^$\n]*?[^\s\\$])\$(?![\w$])))",
    re.S | re.M | re.I,
)
MATHLIKE = re.compile(r"[\\^_=<>+*/{}()|\[\]≤≥±∑∫-]|^\s*\w\s*$|^[\d.,\s]+$|^\w'?$")
TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9]*)(?P<rest>(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^\"'<>])*)>")
AUTOLINK = re.compile(r"<(?:(?:https?|ftp)://[^\s<>]+|mailto:[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>", re.I)
ENTITY = re.compile(r"&(?:([a-zA-Z][a-zA-Z0-9]{1,31})|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
LATEX = [
    ("heading", re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\s*(?:\[[^\]\n]*\])?\{")),
    ("list", re.compile(r"\\(?:begin|end)\s*\{(?:itemize|enumerate|description)\}|\\item\b")),
    ("table", re.compile(r"\\(?:begin|end)\s*\{(?:tabular[xy]?\*?|longtable|table\*?)\}")),
    ("link", re.compile(r"\\(?:href|url|hyperref|includegraphics|nolinkurl)\s*(?:\[[^\]\n]*\])?\s*\{")),
    ("emphasis", re.compile(r"\\(?:textbf|textit|emph|underline|textsc|textsl|uline|sout|textcolor)\s*\{|\{\s*\\(?:bf|it|em|sl|sc|bfseries|itshape|scshape)\b|\\begin\{(?:em|bf|it)\}")),
    ("code", re.compile(r"\\texttt\s*\{|\{\s*\\(?:tt|ttfamily)\b")),
]
WIKI_HEADING = re.compile(r"^[ ]{0,3}={2,6}[ \t]*[^=\s][^\n]*?={2,6}[ \t]*$", re.M)
WIKI_LINK = re.compile(r"(?<![\w\])])\[\[(?![\s\d.,;:-]*\]\])(?![\s'\"\[\]])[^\[\]\n]+?\]\]|(?<!\])\[(?:https?|ftp)://[^\s\]]+(?:[ \t][^\]\n]*)?\](?![(\[])")
WIKI_EMPHASIS = re.compile(r"(?<!')(?<!\w)('{2,5})(?=[^\s'])(?:(?!'').)+?(?<=[^\s'])'{2,5}(?!\w)|(?:(?<=\s)|^)'{3}(?=\w)", re.M)
WIKI_TABLE = re.compile(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z|(?=^[ \t]*$))", re.M | re.S)
MD_ATX = re.compile(r"^[ ]{0,3}(?:>[ ]?)*(?:#{1,6}(?=[ \t]+\S)|#{2,6}(?=[^\s#!]))", re.M)
MD_RULE = re.compile(r"^[ ]{0,3}(=+|-+)[ \t]*$")
MD_LIST = re.compile(r"^[ \t]*(?:>[ ]?)*(?:[-*+]|\d{1,9}[.)])[ \t]+(?=\S)")
MD_HR = re.compile(r"^[ ]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
MD_QUOTE = re.compile(r"^[ ]{0,3}>[ \t]?(?=\S)")
MD_TABLE = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*$")
MD_LINK = re.compile(r"!?(?<![\w\]])\[(?!\[)(?:[^\[\]\n]|\[[^\[\]\n]*\])*\](?:\((?:[^()\n]|\([^()\n]*\))*(?:\)|(?=\s*$))|\[[^\[\]\n]*\])|!\[[^\[\]\n]*\]\([^)\n]*\)", re.M)
MD_DEF = re.compile(r"^[ ]{0,3}\[(?!\^)[^\]\n]+\]:[ \t]*\S+[^\n]*$", re.M)
MD_STRONG = re.compile(
    r"(?<![\\*])(?P<s>\*{1,3})(?=[^\s*])(?:(?!\n[ \t]*\n|\*).)+?(?<=[^\s*\\])(?P=s)(?!\*)"
    r"|(?<![\\\w_])(?P<u>_{1,3})(?=[^\s_])(?:(?!\n[ \t]*\n)(?:[^_]|(?<=\w)_(?=\w)))+?(?<=[^\s_\\])(?P=u)(?![\w_])"
    r"|(?<![\\~])~~(?=[^\s~])(?:(?!\n[ \t]*\n|~~).)+?(?<=[^\s~])~~(?!~)",
    re.S,
)
#: Unclosed marks at the beginning of a word.
MD_BROKEN = re.compile(r"(?:(?<=\s)|^)(?:\*\*(?=[^\W\d_])(?!kwargs\b)|~~(?=[^\W\d_]))", re.M)
INDENTED = re.compile(r"(?:\A|\n[ \t]*\n)((?:(?: {4}|\t)[^\n]*(?:\n|\Z))+)")

MASK = "\ue000"
#: Marks of this parser in the text: heading and list item by tag, begin and end of a container.
HEAD_MARK, ITEM_MARK, OPEN, CLOSE = "\ue001", "\ue002", "\ue004", "\ue005"
CONTAINERS = {"div", "center", "section", "article", "main", "nav", "header", "footer", "blockquote", "details"}
#: Containers for finding one's way, by their meaning.
AROUND = {"nav", "footer"}
#: Signs without which there is nothing to take out, or nothing to clean within a line.
_MAY_HIDE = re.compile(r"[`~$<]|\\[(\[bvl]")
_MARKS = re.compile(rf"[\\\[*_~{MASK}]|''")
_MASKED = re.compile(rf"{MASK}(\d+){MASK}")
_BLANKS = re.compile(r"[ \t]+")
_LATEX_HEAD = re.compile(r"\s*\\(?:part|chapter|(?:sub){0,2}section)\*?\s*\{")
_LATEX_TABLE = re.compile(r"\\begin\{(tabular[xy]?\*?|longtable)\}.*?(?:\\end\{\1\}|\Z|(?=\n[ \t]*\n))", re.S)
_LATEX_ENDS = re.compile(r"\\(?:begin|end)\s*\{[^{}\n]*\}|\\item\b[ \t]*(?:\[[^\]\n]*\])?")
_LATEX_HREF = re.compile(r"\\href\s*\{[^{}\n]*\}\s*\{([^{}\n]*)\}?")
_LATEX_COMMAND = re.compile(r"\\[a-zA-Z]+\*?\s*(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_LATEX_GROUP = re.compile(r"\{\s*\\[a-z]+\s+([^{}\n]*)\}")
_ESCAPED = re.compile(r"\\([\\`*_{}\[\]()#+.!$~<>-])")
_HEAD_SIGNS = re.compile(rf"^[#=\s>{HEAD_MARK}]+|[#=\s]+$")
_ITEM_SIGNS = re.compile(rf"^\s*(?:{ITEM_MARK}|[-*+]|\d{{1,9}}[.)])\s*(?:\[[ xX]\]\s+)?")
_INDENT = re.compile(r"(?: {4}|\t)\S")
_SENTENCE = re.compile(r"[.!?…。！？।؟](?:[\"'”’»)\]]*)(?:\s|$)")
SOLID = ("code", "formula", "table")


@dataclass
class Node:
    """A node of the tree: its kind (or tag), text, children and the structures found in it."""

    kind: str
    text: str = ""
    score: float = 0.0
    link_chars: int = 0
    children: list[Node] = field(default_factory=list)
    found: dict[tuple[str, str], int] = field(default_factory=dict)

    def add(self, family: str, structure: str) -> None:
        self.found[family, structure] = self.found.get((family, structure), 0) + 1

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.walk()


def cells(narrative: str) -> list[str]:
    """The bodies of the cells, without the frame; a text without frame is one cell."""
    frame = FRAME_HEAD.match(narrative)
    body = narrative[frame.end() :] if frame else narrative
    heads = [h for h in CELL_HEAD.finditer(body) if not h.start() or body[h.start() - 1] == "\n"]
    if not heads:
        return [body] if body.strip() else []
    out = [body[: heads[0].start()]] if body[: heads[0].start()].strip() else []
    for head, end in zip(heads, [*(h.start() for h in heads[1:]), len(body)], strict=True):
        own = body[head.end() : end].rstrip()
        above = own[:-30].rstrip(" \t") if own.endswith(CELL_RULE) else "x"
        out.append(above.rstrip() if not above or above[-1] == "\n" else own)
    return out


class Cell:
    """One parsed cell: a tree of containers, sections and blocks.

    With ``prose`` only what holds running text is cleaned and kept: paragraphs, quotes and items.
    """

    def __init__(self, text: str, prose: bool = False) -> None:
        self.kept: list[tuple[str, str, str, str]] = []  # (kind, clean text, family, structure) of what is masked
        self.prose = prose
        self.root = self.at = Node("cell")
        rest = self._opaque(text.replace("\r\n", "\n") if "\r" in text else text)
        rest = self._tables(rest)
        rest = self._tags(rest)
        self._blocks(rest)

    def _mask(self, kind: str, text: str, family: str = "", structure: str = "") -> str:
        self.kept.append((kind, text, family, structure))
        return f"{MASK}{len(self.kept) - 1}{MASK}"

    def _unmask(self, number: str, node: Node) -> tuple[str, str]:
        """Kind and text of what a mask stands for, masks in it too; its structures go to ``node``."""
        kind, text, family, structure = self.kept[int(number)]
        if family:
            node.add(family, structure)
        return kind, _MASKED.sub(lambda m: self._unmask(m.group(1), node)[1], text) if MASK in text else text

    def _opaque(self, text: str) -> str:
        def code(m: re.Match[str]) -> str:
            kind, whole = m.lastgroup, m.group()
            groups = m.groupdict()
            if groups["fence"] is not None:
                lines = whole.split("\n")
                inner = lines[1:-1] if len(lines) > 1 and re.match(r"\s*(?:>\s?)?[`~]{3}", lines[-1]) else lines[1:]
                return "\n" + self._mask("code", "\n".join(inner), "markdown", "code") + "\n"
            if groups["comment"] is not None:
                self.root.add("html", "comment")
                return ""
            if groups["pre"] is not None:
                return "\n" + self._mask("code", html.unescape(re.sub(r"</?(?:pre|code)\b[^<>]*>", "", whole, flags=re.I)).strip("\n"), "html", "code") + "\n"
            if groups["verbatim"] is not None:
                return "\n" + self._mask("code", re.sub(r"\A\\begin\{[^}]*\}(?:\[[^\]]*\])?|\\end\{[^}]*\}\Z", "", whole).strip("\n"), "latex", "code") + "\n"
            if groups["verb"] is not None:
                return self._mask("inline", whole[whole.find(groups["sep"] or "{") + 1 : -1], "latex", "code")
            if groups["tick"] is not None:
                return self._mask("inline", whole.strip("`").strip(), "markdown", "code")
            if groups["htmlcode"] is not None:
                return self._mask("inline", html.unescape(re.sub(r"<[^<>]*>", "", whole)), "html", "code")
            if groups["inline"] is not None and not MATHLIKE.search(groups["body"]):
                return whole
            block = kind in ("display", "mathenv", "menv") or groups["display"] is not None or groups["mathenv"] is not None
            shown = self._mask("formula" if block else "inline", whole, "latex", "formula")
            return f"\n{shown}\n" if block else shown

        return OPAQUE.sub(code, text) if _MAY_HIDE.search(text) else text

    def _tables(self, text: str) -> str:
        def wiki(m: re.Match[str]) -> str:
            rows = [[]]
            for line in m.group().split("\n")[1:]:
                bare = line.strip()
                if bare.startswith("|-"):
                    rows.append([])
                elif bare[:1] in "|!" and not bare.startswith("|}"):
                    rows[-1] += [c.strip() for c in re.split(r"\|\||!!", bare[1:])]
            return "\n" + self._mask("table", "\n".join("\t".join(r) for r in rows if r), "wiki", "table") + "\n"

        def latex(m: re.Match[str]) -> str:
            body = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})?|\\hline|\\(?:top|mid|bottom)rule", "", m.group())
            rows = [[c.strip() for c in row.split("&")] for row in body.split("\\\\")]
            return "\n" + self._mask("table", "\n".join("\t".join(r) for r in rows if any(r)), "latex", "table") + "\n"

        if "{|" in text:
            text = WIKI_TABLE.sub(wiki, text)
        if "\\begin" not in text:
            return text
        return _LATEX_TABLE.sub(latex, text)

    def _tags(self, text: str) -> str:
        def auto(m: re.Match[str]) -> str:
            return self._mask("link", m.group()[1:-1], "markdown", "link")

        text = AUTOLINK.sub(auto, text) if "<" in text else text

        def tag(m: re.Match[str]) -> str:
            name = m["name"].lower()
            if name not in TAGS and name not in OTHER_TAGS:
                return m.group()
            glued = m.start() and m.string[m.start() - 1].isalnum() and not m["end"] and not m["rest"].strip() and len(name) == 1
            if glued and not re.search(rf"</{name}\s*>", m.string[m.end() :], re.I):
                return m.group()
            if name in TAGS:
                self.root.add("html", TAGS[name])
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                return f"\n{HEAD_MARK} " if not m["end"] else "\n"
            if name == "li":
                return f"\n{ITEM_MARK} " if not m["end"] else "\n"
            if name in CONTAINERS:
                return f"\n\n{CLOSE if m['end'] else OPEN}{name}\n\n"
            if name in ("td", "th"):
                return "\t" if m["end"] else ""
            if name == "img":
                alt = re.search(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", m["rest"], re.I)
                return self._mask("link", (alt.group(1) or alt.group(2) or "") if alt else "")
            if name in ("br", "hr", "tr", "table", "ul", "ol", "dl"):
                return "\n"
            if name == "p":
                return "\n\n"
            return ""

        marked = TAG.sub(tag, text) if "<" in text else text

        def entity(m: re.Match[str]) -> str:
            if m.group(1) and m.group(1) + ";" not in html.entities.html5:
                return m.group()
            self.root.add("html", "entity")
            return html.unescape(m.group())

        return ENTITY.sub(entity, marked) if "&" in marked else marked

    def _inline(self, text: str) -> tuple[str, int]:
        """Clean a run of text; returns it with the number of its characters that are links."""
        links, at = 0, self.at
        if not _MARKS.search(text):
            return text, 0
        if "\\" in text:
            for structure, pattern in LATEX:
                for _ in pattern.finditer(text):
                    at.add("latex", structure)
            text = _LATEX_HREF.sub(r"\1", _LATEX_ENDS.sub("", text))
            text = _LATEX_GROUP.sub(r"\1", _LATEX_COMMAND.sub(r"\1", text))

        def wiki(m: re.Match[str]) -> str:
            nonlocal links
            at.add("wiki", "link")
            inner = m.group().strip("[]")
            label = inner.rsplit("|", 1)[-1] if m.group().startswith("[[") else inner.split(None, 1)[-1]
            links += len(label)
            return label

        def definition(m: re.Match[str]) -> str:
            at.add("markdown", "link")
            return ""

        def link(m: re.Match[str]) -> str:
            nonlocal links
            at.add("markdown", "link")
            label = m.group()[m.group().find("[") + 1 : m.group().find("]")]
            links += len(label)
            return label

        if "[" in text:
            text = WIKI_LINK.sub(wiki, text)
        if "''" in text and (marks := WIKI_EMPHASIS.findall(text)):
            for _ in marks:
                at.add("wiki", "emphasis")
            text = re.sub(r"'{2,5}", "", text)
        if "[" in text:
            text = MD_LINK.sub(link, MD_DEF.sub(definition, text))
        if "*" in text or "_" in text or "~" in text:
            for _ in range(3):
                hits = [m for m in MD_STRONG.finditer(text) if not DUNDER.fullmatch(m.group())]
                if not hits:
                    break
                for _ in hits:
                    at.add("markdown", "emphasis")
                text = MD_STRONG.sub(lambda m: m.group() if DUNDER.fullmatch(m.group()) else m.group()[len(m["s"] or m["u"] or "~~") : -len(m["s"] or m["u"] or "~~")], text)
            for _ in MD_BROKEN.finditer(text):
                at.add("markdown", "emphasis")
            text = MD_BROKEN.sub("", text)
        if "\\" in text:
            text = _ESCAPED.sub(r"\1", text)

        def unmask(m: re.Match[str]) -> str:
            nonlocal links
            kind, kept = self._unmask(m.group(1), at)
            links += len(kept) if kind == "link" else 0
            return kept

        return _MASKED.sub(unmask, text) if MASK in text else text, links

    def _put(self, kind: str, text: str, parent: Node, family: str = "", structure: str = "") -> None:
        """Append a block to ``parent``; one without text only leaves its structures there."""
        if self.prose and kind in ("heading", "table"):
            return
        node = self.at = Node(kind)
        if family:
            node.add(family, structure)
        clean, node.link_chars = self._inline(text)
        node.text = (_BLANKS.sub(" ", clean) if kind != "table" and ("  " in clean or "\t" in clean) else clean).strip()
        if node.text:
            parent.children.append(node)
        else:
            for (f, x), n in node.found.items():
                parent.found[f, x] = parent.found.get((f, x), 0) + n

    def _blocks(self, text: str) -> None:
        lines = text.split("\n")
        holder, section = self.root, Node("section")
        holder.children.append(section)
        around: list[tuple[Node, Node]] = []  # containers that are open: (holder, section) outside of each
        pending: list[str] = []

        def flush() -> None:
            if pending:
                self._put("paragraph", "\n".join(pending), section)
                pending.clear()

        def begin() -> Node:
            holder.children.append(Node("section"))
            return holder.children[-1]

        k = -1
        while k + 1 < len(lines):
            k += 1
            line = lines[k]
            bare = line.strip()
            if not bare:
                flush()
                continue
            first = bare[0]
            if first.isalpha() and line[0] not in " \t":
                # no mark begins with a letter
                pending.append(line)
            elif first == MASK and (block := _MASKED.fullmatch(bare)) and self.kept[int(block.group(1))][0] in SOLID:
                flush()
                node = Node("")
                node.kind, node.text = self._unmask(block.group(1), node)
                section.children.append(node)
            elif first == OPEN:
                flush()
                box = Node(bare[1:])
                section.children.append(box)
                around.append((holder, section))
                holder = box
                section = begin()
            elif first == CLOSE:
                flush()
                inner = [n for n, (_, outer) in enumerate(around) if outer.children[-1].kind == bare[1:]]
                if inner:
                    holder, section = around[inner[-1]]
                    del around[inner[-1] :]
            elif first == HEAD_MARK or first in "#>" and MD_ATX.match(line) or first == "=" and WIKI_HEADING.match(line) or first == "\\" and _LATEX_HEAD.match(line):
                flush()
                section = begin()
                mark = ("wiki", "heading") if first == "=" else ("", "") if first in (HEAD_MARK, "\\") and not MD_ATX.match(line) else ("markdown", "heading")
                self._put("heading", _HEAD_SIGNS.sub("", line) if first != "\\" else line, section, *mark)
            elif first in "=-" and len(pending) == 1 and MD_RULE.match(line) and len(bare) >= 2 and not MD_LIST.match(pending[0]):
                title = pending.pop()
                section = begin()
                self._put("heading", title, section, "markdown", "heading")
            elif first in "|:-" and (pending and "|" in pending[-1] and MD_TABLE.match(line) or first == "|" and bare.endswith("|") and len(bare) > 2 and k + 1 < len(lines) and lines[k + 1].strip().startswith("|") and not MD_TABLE.match(lines[k + 1]) and not pending):
                head = [pending.pop()] if pending else []
                flush()
                rows = head + ([line] if not MD_TABLE.match(line) else [])
                while k + 1 < len(lines) and "|" in lines[k + 1] and lines[k + 1].strip():
                    k += 1
                    rows.append(lines[k])
                self._put("table", "\n".join("\t".join(c.strip() for c in r.strip().strip("|").split("|")) for r in rows), section, "markdown", "table")
            elif first in "-*_" and MD_HR.match(line):
                flush()
            elif first == ITEM_MARK or (first in "-*+>" or first.isdigit()) and MD_LIST.match(line):
                flush()
                if not section.children or section.children[-1].kind != "list":
                    section.children.append(Node("list"))
                mark = ("", "") if first == ITEM_MARK else ("markdown", "list")
                self._put("item", _ITEM_SIGNS.sub("", line), section.children[-1], *mark)
            elif first == ">" and MD_QUOTE.match(line):
                flush()
                self._put("quote", MD_QUOTE.sub("", line), section, "markdown", "quote")
            elif line[0] in " \t" and not pending and _INDENT.match(line) and not (section.children and section.children[-1].kind == "list"):
                body = [line[4:] if line.startswith("    ") else line[1:]]
                while k + 1 < len(lines) and lines[k + 1].startswith(("    ", "\t")):
                    k += 1
                    body.append(lines[k][4:] if lines[k].startswith("    ") else lines[k][1:])
                section.children.append(Node("code", "\n".join(body), found={("markdown", "code"): 1}))
            else:
                pending.append(line)
        flush()


def density(node: Node) -> float:
    """Share of the characters below a node that are links."""
    chars = sum(len(n.text) for n in node.walk())
    return sum(n.link_chars for n in node.walk()) / chars if chars else 0.0


def labels_only(text: str) -> bool:
    """Two or more words that all begin with a capital and no stop: names of places to go, no running text."""
    words = re.findall(r"[^\W_]+", text)
    return len(words) > 1 and not _SENTENCE.search(text) and all(w[0].isupper() for w in words)


def points(node: Node) -> float:
    """Points of a block of text: one, and more for commas and length, less its link density."""
    if labels_only(node.text):
        return 0.0
    full = 1.0 + node.text.count(",") + node.text.count("，") + node.text.count("、") + min(len(node.text) / 100, 3.0)
    full *= 1.0 - min(1.0, node.link_chars / max(1, len(node.text)))
    return full * 0.2 if node.kind == "heading" else full


def score_tree(root: Node) -> Node:
    """Sets ``score``: points of text blocks pass to their parent in full, to the grandparent by half
    and to the n-th ancestor beyond by 1/(3n); each container is then discounted by its link density."""

    def visit(node: Node, above: list[Node]) -> None:
        if node.kind in ("paragraph", "quote", "item", "heading"):
            node.score = points(node)
            for level, ancestor in enumerate(reversed(above)):
                ancestor.score += node.score / (1, 2)[level] if level < 2 else node.score / (3 * level)
        for child in node.children:
            visit(child, [*above, node])
        if node.children:
            node.score *= 1.0 - density(node)

    visit(root, [])
    return root


def worth(node: Node) -> bool:
    """A sibling below the share is kept if it holds code, a formula or a table, a sentence, or other
    running text of few links; in containers for finding one's way only the former count."""

    def visit(node: Node, around: bool) -> bool:
        if node.kind in SOLID:
            return True
        if node.kind in ("paragraph", "quote", "item") and node.text:
            links = node.link_chars / len(node.text)
            return links < 0.5 and _SENTENCE.search(node.text) is not None or links < 0.25 and not around and not labels_only(node.text)
        return any(visit(c, around or node.kind in AROUND) for c in node.children)

    return visit(node, False)


def clean_text(root: Node, share: float = 0.2) -> str:
    """Text of the best container and of the others that reach ``share`` of its score or are ``worth``
    keeping, block after block; a heading is kept where it opens a kept section or stands alone."""
    best = max((n.score for n in root.walk() if n.kind == "section" or n.kind in CONTAINERS - AROUND), default=0.0)
    out: list[str] = []

    def show(node: Node, around: bool) -> None:
        if node.kind == "section" and any(c.kind != "heading" for c in node.children):
            rest = Node("section", children=[c for c in node.children if c.kind != "heading"])
            if not worth(Node("nav", children=[rest]) if around else rest) and (around or node.score < share * best or node.score == 0):
                return
        if node.kind == "heading":
            out.append("# " + node.text)
        elif node.kind == "list":
            out.append("\n".join("- " + i.text for i in node.children))
        elif node.kind == "quote":
            out.append("> " + node.text)
        elif node.kind == "code":
            out.append("```\n" + node.text + "\n```")
        elif node.text:
            out.append(node.text)
        else:
            for child in node.children:
                show(child, around or node.kind in AROUND)

    show(root, False)
    return "\n\n".join(x for x in out if x.strip())


def parse(narrative: str) -> tuple[str, dict[tuple[str, str], int]]:
    """Clean text, and the count of each (family, structure) over the nodes of the tree."""
    root = Node("document", children=[Cell(body).root for body in cells(narrative)])
    found: dict[tuple[str, str], int] = {}
    for node in score_tree(root).walk():
        for key, n in node.found.items():
            found[key] = found.get(key, 0) + n
    return clean_text(root), found


def running_text(narrative: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of the paragraphs, quotes and list items of a narrative, in order."""
    for body in cells(narrative):
        for node in Cell(body, prose=True).root.walk():
            if node.kind in ("paragraph", "quote", "item"):
                yield node.kind, node.text


SCHEMA = "notebook_id long, clean_text string, structures array<struct<family string, structure string, n long>>"


def strip_markup(nb_contents: DataFrame) -> DataFrame:
    """Clean current narratives of ``nb_contents`` (notebook_id, markdown_narrative, scraped_at).

    Returns (notebook_id, clean_text, structures), one row per notebook whose current narrative
    is not null; an empty one gives an empty text and no structures.  Whole texts are parsed.
    Other columns are ignored, repeated rows give one result, an empty table none.
    """
    current = current_rows(nb_contents, ["notebook_id"], "scraped_at", ["markdown_narrative"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for notebook_id, text in zip(batch["notebook_id"], batch["markdown_narrative"], strict=True):
                clean, found = parse(text)
                rows.append((notebook_id, clean, [{"family": f, "structure": s, "n": n} for (f, s), n in sorted(found.items())]))
            yield pd.DataFrame(rows, columns=["notebook_id", "clean_text", "structures"])

    return spread(current.where("markdown_narrative is not null")).mapInPandas(run, SCHEMA)


def structures(cleaned: DataFrame) -> DataFrame:
    """(notebook_id, family, structure, n) of the result of ``strip_markup``."""
    return cleaned.select("notebook_id", F.explode("structures").alias("s")).select("notebook_id", "s.family", "s.structure", "s.n")
