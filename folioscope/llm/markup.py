"""Text of mixed notations (HTML, Markdown, wiki, LaTeX) as clean text that keeps its structure.

A page is parsed into nodes in document order. Each node has a root-to-leaf tag path whose root is its notation: html/main/ul/li,
markdown/h2, wiki/table/row, latex/itemize/item, text/p, code/pre; marks within a line (emphasis, links, tags, character references,
TeX) are leaves of their own below it. Per path the number of nodes, their text length and their punctuation are added up. Every node
takes its path's mean text length and mean punctuation; both series are smoothed along the document by a Gaussian, fused by product,
and cut at a share of their spread: a path whose nodes lie above on average is content, and paragraphs of other paths are left out wherever
they stand. Headings, list items, tables, code and formulas are kept where they stand between content. What is kept is written out in one plain notation: # headings, - and 1. lists, | tables |, ``` code, $ formulas.

A page has a notation if one of its paths has that root. Code blocks, inline code and front matter have the root code or none.
List signs, bars between words, unfilled values and example templates are no notation; # lists count as wiki on a wiki page.

Defined cases: rows without page_id are left out; null and empty texts have no nodes, no notation, and an empty clean text; a page on which nothing passes the threshold is kept
whole; an unclosed fence runs to the end; of several deliveries of a page the one with the greatest `loaded_at` counts for its clean
text; an empty table gives no rows.

Scale: a page is a unit of work and nothing of its text is shuffled for its notations or path table.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.core.runtime import current
from folioscope.llm.text import identified

NOTATIONS = ("html", "latex", "markdown", "wiki")
#: Reach and spread of the smoothing, in nodes, and the share of the spread that cuts content from the rest.
RADIUS, SIGMA, CUT = 2, 1.0, 0.5

TAG = re.compile(r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>")
OPEN_TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)((?:\s[^<>]*)?)(/?)>")
LONG_TAG = re.compile(r"<[A-Za-z][\w:-]*\s[^<>\n]*\n[^<>]*>")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>?|<\?xml[^>]*>", re.S | re.I)
ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
HTML_CODE = re.compile(r"(<(code|kbd|samp|tt|nowiki)\b[^<>]*>)(.*?)(</\2\s*>)", re.I)
BLOCK_CODE = re.compile(r"<(pre|nowiki|syntaxhighlight|source|script|style)\b[^<>]*>", re.I)
VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}")
TEX_CODE = re.compile(r"\\(?:texttt|verb|lstinline)\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}")
TICKS = re.compile(r"(`+)([^`]+)\1")
FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,})[ \t]*([^\s`]*)")
TEX_COMMAND = re.compile(r"(?<![\\:/\w])\\[A-Za-z]{2,}|(?<=[\w.,])\\[A-Za-z]{2,}\{")
TEX_FORMULA = re.compile(r"\$\$[^$]+\$\$|\\\[|\\\(|\$(?=[^\s${])[^$\n]*[\\^_=+<>{}][^$\n]*(?<=\S)\$")
MATH_TAG = re.compile(r"<math\b[^>]*>(.*?)</math>", re.I)
WIKI_MARKS = [
    ("''", "quotes", re.compile(r"(?<![\w'])'{2,5}(?=[^\s'])[^\n]*?(?<=[^\s'])'{2,5}(?![\w'])")),
    ("[[", "link", re.compile(r"\[\[[^\[\]\n]+\]\]")),
    ("{{", "template", re.compile(r"\{\{[^{}|\n%]+\||\{\{[a-z]+(?: [a-z]+)*\}\}|^\{\{[A-Z]\w+[^{}|\n]*$")),
    ("[http", "external", re.compile(r"(?<![\w\]!])\[https?://\S+[ ][^\]\n]+\](?!\()")),
    ("__", "switch", re.compile(r"__[A-Z]{3,}__")),
]
MARKDOWN_MARKS = [
    ("**", "strong", re.compile(r"\*\*(?=[^\s*])[^\n]+?(?<=\S)\*\*")),
    ("*", "em", re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])")),
    ("_", "under", re.compile(r"(?<![\w_])_{1,2}(?=[^\s_])[^_\n]+(?<=[^\s_])_{1,2}(?![\w_])")),
    ("~~", "strike", re.compile(r"~~\S[^\n]*?~~")),
    ("](", "link", re.compile(r"!?\[[^\]\n]*\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+[\"'][^\n]*?[\"'])?\)")),
    ("][", "reference", re.compile(r"\[[^\]\[\n]+\]\[[^\]\[\n]*\]")),
    ("[^", "footnote", re.compile(r"\[\^[^\]\s]+\]")),
    ("<http", "auto", re.compile(r"<https?://[^>\s]+>")),
]
ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t\r]*$")
UNDERLINE = re.compile(r"^ {0,3}(={3,}|-{3,})[ \t\r]*$")
TABLE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t\r]*$")
DEFINITION = re.compile(r"^ {0,3}\[[^\]\n]+\]:\s*\S+")
WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\s].*?)[ \t]*\1[ \t\r]*$")
WIKI_HEADINGS = re.compile(r"^(={1,6})[ \t]*[^=\s][^\n]*?\1[ \t\r]*$", re.M)
LIST_ITEM = re.compile(r"^(\s*)(?:([-*+•])|(\d+)[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(.*)$")
TASK = re.compile(r"^\s*[-*+] \[[ xX]\] ")
WIKI_ITEM = re.compile(r"^([*#:;]+)[ \t]*(.*)$")
TEX_SECTION = re.compile(r"^\\(chapter|section|subsection|subsubsection|paragraph)\*?\{(.*?)\}(?:\\label\{[^}]*\})?[ \t\r]*$")
TEX_BLOCK = re.compile(r"^\\(begin|end)\{(\w+)\*?\}")
TEX_FRAME = re.compile(r"^\\(?:documentclass|usepackage|title|author|date|maketitle|label|pagestyle|bibliography)\b")
SECTION_LEVEL = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "thead", "tbody", "h1", "h2", "h3", "h4", "h5", "h6", "main", "article", "section", "nav", "header", "footer", "aside", "blockquote", "body", "html", "head", "dl", "dt", "dd", "figure", "form"}
#: By an element's tag the open elements that it ends, and those beyond which it ends nothing.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "tr": ({"tr"}, {"table", "thead", "tbody"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "p": ({"p"}, BLOCKS - {"p"}),
}
#: Tags at either end of a path; of a deeper one the middle is left out.
DEEP = 25
PUNCTUATION = re.compile(r"[.,;:!?()\"'“”«»…—–-]")
WORDS = re.compile(r"[^\W_]")


class Node:
    __slots__ = ("path", "kind", "text", "level")

    def __init__(self, path: str, kind: str, text: str = "", level: int = 0):
        self.path, self.kind, self.text, self.level = path, kind, text, level


class Page:
    """The nodes of one text, and what its tag paths add up to."""

    def __init__(self, text: str | None, clean: bool = True):
        self.nodes: list[Node] = []
        self.paths: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
        self.clean = clean
        if text and not text.isspace():
            self._read(text)

    def _add(self, path: str, kind: str, text: str, level: int = 0) -> None:
        if self.clean:
            text = plain(text) if kind not in ("code", "formula") else text
        total = self.paths[path]
        total[0] += 1
        total[1] += len(text)
        total[2] += len(PUNCTUATION.findall(text)) if self.clean else 0
        if self.clean and (text or kind == "break"):
            self.nodes.append(Node(path, kind, text, level))

    def _mark(self, notation: str, block: str, name: str) -> None:
        self.paths[f"{notation}/{block}/{name}"][0] += 1

    def _marks(self, line: str, block: str) -> None:
        """The marks within a line; inline code is out of it, its tags and commands are not."""
        if "`" in line:
            line = TICKS.sub(" ", line)
        if "<" in line:
            line = HTML_CODE.sub(r"\1\4", line)
            for found in OPEN_TAG.finditer(line):
                self._mark("html", block, found[2].lower())
                if found[2].lower() == "math":
                    self._mark("latex", block, "formula")
            if COMMENT.search(line):
                self._mark("html", block, "comment")
        if "&" in line and ENTITY.search(line):
            self._mark("html", block, "reference")
        if "\\" in line:
            line = TEX_CODE.sub(r"\\texttt{}", line)
            if TEX_COMMAND.search(line):
                self._mark("latex", block, "command")
        if ("$" in line or "\\" in line) and TEX_FORMULA.search(line):
            self._mark("latex", block, "formula")
        for sign, name, pattern in WIKI_MARKS:
            if sign in line and pattern.search(line):
                self._mark("wiki", block, name)
        for sign, name, pattern in MARKDOWN_MARKS:
            if sign in line and pattern.search(line):
                self._mark("markdown", block, name)

    def _read(self, text: str) -> None:
        if "<" in text:
            text = LONG_TAG.sub(lambda m: m[0].replace("\n", " "), text)
        lines = [x.rstrip("\r") for x in text.split("\n")]
        n, i = len(lines), 0
        if lines[0].rstrip() == "---":
            end = next((k for k in range(1, n) if lines[k].rstrip() == "---"), 0)
            i = end + 1 if end else 0
        self.wiki = bool(WIKI_HEADINGS.search(text))
        self.tags: list[str] = []
        self.tex: list[str] = []
        blank = True
        while i < n:
            line = lines[i]
            if not line or line.isspace():
                self._add("text/break", "break", "")
                blank, i = True, i + 1
                continue
            fence = FENCE.match(line)
            if fence:
                end = next((k for k in range(i + 1, n) if lines[k].strip(" \t>").startswith(fence[1])), n)
                self._add("code/pre", "code", "\n".join(lines[i + 1 : end]), 0)
                if self.clean and self.nodes and self.nodes[-1].kind == "code":
                    self.nodes[-1].path = f"code/pre {fence[2]}"
                i, blank = end + 1, False
                continue
            if "<" in line and (opened := self._opened(lines, i, n)):
                i = self._element_code(lines, i, n, opened, blank)
                blank = False
                continue
            low = line[:60].lower()
            if low.startswith("\\begin{") and (verbatim := VERBATIM.match(line)):
                stop = f"\\end{{{verbatim[1]}}}"
                end = next((k for k in range(i + 1, n) if stop in lines[k]), n)
                self._mark("latex", "block", verbatim[1])
                self._add("code/pre", "code", "\n".join(lines[i + 1 : end]))
                i, blank = end + 1, False
                continue
            if line.startswith(("    ", "\t")) and line.lstrip()[:1] != "<":
                end = i
                while end < n and (lines[end].startswith(("    ", "\t")) and lines[end].lstrip()[:1] != "<"):
                    end += 1
                self._add("code/pre", "code", "\n".join(x[4:] if x.startswith("    ") else x[1:] for x in lines[i:end]))
                i, blank = end, False
                continue
            i = self._block(lines, i, n, blank)
            blank = False

    def _opened(self, lines: list[str], i: int, n: int) -> re.Match | None:
        """The first code element that a line opens outside of inline code; one without an end only where it begins the line."""
        line = lines[i]
        if not BLOCK_CODE.search(line):
            return None
        is_html = bool(self.tags) or line.lstrip()[:1] == "<"
        if not is_html and line.startswith(("    ", "\t")):
            return None
        cover = lambda m: "." * len(m[0])
        shown = TICKS.sub(cover, line) if "`" in line else line
        shown = HTML_CODE.sub(lambda m: m[0] if is_html and m[2].lower() == "nowiki" else cover(m), shown)
        for found in BLOCK_CODE.finditer(shown):
            if found[0].endswith("/>"):
                continue
            stop = f"</{found[1].lower()}"
            if stop in line[found.end() :].lower() or any(stop in lines[k].lower() for k in range(i + 1, n)):
                return found
            if found[1].lower() != "source" and not line[: found.start()].strip():
                return found
        return None

    def _element_code(self, lines: list[str], i: int, n: int, opened: re.Match, blank: bool) -> int:
        """A code element over one or more lines; its tags are notation, its content is not. What stands around it on its lines is read as lines."""
        name, line = opened[1].lower(), lines[i]
        self._mark("html", "block", name)
        before = line[: opened.start()].rstrip()
        if before:
            self._block([before], 0, 1, blank)
        stop, body, k = f"</{name}", [line[opened.end() :]], i
        while stop not in body[-1].lower() and k + 1 < n:
            k += 1
            body.append(lines[k])
        after = ""
        at = body[-1].lower().find(stop)
        if at >= 0:
            after = body[-1][at:].partition(">")[2].strip()
            body[-1] = body[-1][:at]
        if name not in ("script", "style"):
            self._add("code/pre", "code", re.sub(r"</?code[^>]*>", "", "\n".join(body), flags=re.I).strip("\n"))
        if after:
            lines[k] = after
            return k
        return k + 1

    def _block(self, lines: list[str], i: int, n: int, blank: bool) -> int:
        line = lines[i]
        bare = line.strip()
        if (found := ATX.match(line)) and not (self.wiki and len(found[1]) == 1):
            self._mark("markdown", "block", "heading")
            self._marks(found[2], "heading")
            self._add(f"markdown/h{len(found[1])}", "heading", found[2], len(found[1]))
            return i + 1
        if i + 1 < n and bare[0] not in "|>#*+-" and (rule := UNDERLINE.match(lines[i + 1])) and not OPEN_TAG.match(bare):
            level = 1 if rule[1][0] == "=" else 2
            self._mark("markdown", "block", "heading")
            self._marks(line, "heading")
            self._add(f"markdown/h{level}", "heading", bare, level)
            return i + 2
        if bare[0] == "=" and (found := WIKI_HEADING.match(bare)):
            self._marks(found[2], "heading")
            self._add(f"wiki/h{len(found[1])}", "heading", found[2], len(found[1]))
            return i + 1
        if bare[0] == "\\":
            return self._tex(lines, i, n, bare)
        if bare.startswith("$$"):
            end = i if bare.count("$$") > 1 else next((k for k in range(i + 1, n) if "$$" in lines[k]), i)
            self._add("latex/formula", "formula", " ".join(x.strip() for x in lines[i : end + 1]).strip().strip("$").strip())
            return end + 1
        if bare[0] == "|" or TABLE_RULE.match(line):
            if bare[:2] in ("|-", "|}") and not TABLE_RULE.match(line):
                self._mark("wiki", "block", "table")
                return i + 1
            if TABLE_RULE.match(line):
                self._mark("markdown", "block", "table")
                return i + 1
            self._marks(line, "cell")
            self._add("text/table/row", "row", bare)
            return i + 1
        if bare.startswith(("{|", "|}")):
            self._mark("wiki", "block", "table")
            return i + 1
        if bare[0] == "!" and "!!" in bare:
            self._mark("wiki", "block", "table")
            self._marks(line, "cell")
            self._add("wiki/table/row", "row", "|" + bare[1:].replace("!!", "|") + "|")
            return i + 1
        if bare[0] == "<" or self.tags:
            return self._html(lines, i, bare)
        if bare[0] == ">":
            self._mark("markdown", "block", "quote")
            self._marks(bare, "quote")
            self._add("markdown/blockquote", "p", bare.lstrip("> "))
            return i + 1
        if DEFINITION.match(line):
            self._mark("markdown", "block", "definition")
            return i + 1
        if self.wiki and bare[0] in "*#:;" and (found := WIKI_ITEM.match(bare)):
            if bare[0] == "#":
                self._mark("wiki", "block", "list")
            self._marks(found[2], "item")
            self._add("wiki/li" if bare[0] == "#" else "text/li", "numbered" if bare[0] == "#" else "item", found[2], len(found[1]) - 1)
            return i + 1
        if found := LIST_ITEM.match(line):
            if TASK.match(line):
                self._mark("markdown", "block", "task")
            self._marks(found[4], "item")
            self._add("text/li", "numbered" if found[3] else "item", found[4], len(found[1]) // 2)
            return i + 1
        self._marks(line, "p")
        self._add("text/p", "p", bare)
        return i + 1

    def _tex(self, lines: list[str], i: int, n: int, bare: str) -> int:
        if found := TEX_SECTION.match(bare):
            level = SECTION_LEVEL[found[1]]
            self._marks(found[2], "heading")
            self._add(f"latex/h{level}", "heading", found[2], level)
        elif bare.startswith(("\\[", "\\begin{equation", "\\begin{align")):
            stop = "\\]" if bare[1] == "[" else "\\end{"
            end = next((k for k in range(i, n) if stop in lines[k]), i)
            inner = " ".join(x.strip() for x in lines[i : end + 1])
            self._add("latex/formula", "formula", re.sub(r"^\\\[|\\\]$|\\(?:begin|end)\{\w+\*?\}", "", inner.strip()).strip())
            return end + 1
        elif found := TEX_BLOCK.match(bare):
            self._mark("latex", "block", found[2])
            if found[1] == "begin":
                self.tex.append(found[2])
            elif found[2] in self.tex:
                while self.tex.pop() != found[2]:
                    pass
        elif bare.startswith("\\item"):
            rest = bare[5:].lstrip()
            self._marks(rest, "item")
            self._add(f"latex/{self.tex[-1] if self.tex else 'list'}/item", "numbered" if "enumerate" in self.tex[-1:] else "item", rest)
        elif TEX_FRAME.match(bare):
            self._mark("latex", "block", "frame")
        else:
            self._marks(bare, "p")
            self._add("text/p", "p", bare)
        return i + 1

    def _open(self, name: str) -> None:
        """An element begins; one that it ends by beginning (an item the item before, a row the row before) is closed first."""
        ended = IMPLIED.get(name)
        if ended:
            for k in range(len(self.tags) - 1, -1, -1):
                if self.tags[k] in ended[0]:
                    del self.tags[k:]
                    break
                if self.tags[k] in ended[1]:
                    break
        self.tags.append(name)

    def _html(self, lines: list[str], i: int, bare: str) -> int:
        """A line of HTML, or within an open element: its blocks become nodes below the open tags."""
        self._marks(bare, "block")
        at, kind, level, piece = 0, "p", 0, []

        def close() -> None:
            nonlocal piece
            text = "".join(piece).strip()
            piece = []
            if text:
                inner = [t for t in self.tags if t in BLOCKS]
                leaf = next((t for t in reversed(inner) if t in ("li", "td", "th", "tr") or t[0] == "h" and t[1:].isdigit()), "p")
                what = "numbered" if leaf == "li" and "ol" in inner else "item" if leaf == "li" else "row" if leaf in ("td", "th", "tr") else "heading" if leaf != "p" else "p"
                root = "html/" + tag_path(inner) if inner else "text/p"
                self._add(root, what, text, int(leaf[1:]) if what == "heading" else 0)

        if self.tags and not OPEN_TAG.search(bare):
            piece.append(bare)
            at = len(bare)
        cells: list[str] = []
        for found in OPEN_TAG.finditer(bare):
            name = found[2].lower()
            if name not in BLOCKS:
                continue
            piece.append(bare[at : found.start()])
            at = found.end()
            if name in ("td", "th"):
                if found[1]:
                    cells.append("".join(piece).strip())
                piece = []
                continue
            close()
            if found[1]:
                if name in self.tags:
                    while self.tags.pop() != name:
                        pass
            elif not found[4]:
                self._open(name)
        piece.append(bare[at:])
        close()
        if cells:
            self._add("html/" + tag_path([t for t in self.tags if t in BLOCKS] + ["tr"]), "row", "| " + " | ".join(cells) + " |")
        # inline-level elements and paragraphs left open end with their line
        while self.tags and self.tags[-1] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and f"</{self.tags[-1]}" not in bare.lower() and i + 1 < len(lines) and not lines[i + 1].strip():
            self.tags.pop()
        return i + 1

    def notations(self) -> list[str]:
        return sorted({p.split("/", 1)[0] for p in self.paths} & set(NOTATIONS))

    def content(self) -> list[bool]:
        """For each node whether it is content, by the smoothed and fused ratios of its tag path."""
        live = [k for k, x in enumerate(self.nodes) if x.kind != "break"]
        keep = [False] * len(self.nodes)
        if not live:
            return keep
        stats = [self.paths.get(self.nodes[k].path) or [1, len(self.nodes[k].text), 0] for k in live]
        length = smooth(np.array([s[1] / s[0] for s in stats], float))
        marks = smooth(np.array([s[2] / s[0] for s in stats], float))
        fused = length * (1 + marks)
        cut = CUT * fused.std()
        # a path is content if its nodes are so on average
        score: dict[str, list[float]] = defaultdict(lambda: [0.0, 0])
        for k, value in zip(live, fused, strict=True):
            total = score[self.nodes[k].path]
            total[0] += value
            total[1] += 1
        paths = {p for p, (total, n) in score.items() if total >= cut * n}
        chosen = [k for k in live if self.nodes[k].path in paths and (self.nodes[k].kind not in ("item", "numbered") or len(self.nodes[k].text) > 30)]
        if not chosen:
            return [True] * len(self.nodes)
        first, last = chosen[0], chosen[-1]
        while first > 0 and self.nodes[first - 1].kind in ("heading", "break"):
            first -= 1
        for k in range(first, last + 1):
            keep[k] = self.nodes[k].path in paths or self.nodes[k].kind != "p"
        for k in range(last + 1, len(self.nodes)):  # code, tables and formulas that end a text
            if self.nodes[k].kind in ("code", "row", "formula"):
                keep[last + 1 : k + 1] = [True] * (k - last)
                last = k
        return keep

    def render(self) -> str:
        out: list[str] = []
        for node, kept in zip(self.nodes, self.content(), strict=True):
            if not kept:
                continue
            if node.kind == "heading":
                out += ["", "#" * max(1, min(6, node.level)) + " " + node.text, ""]
            elif node.kind == "code":
                out += ["", "```" + (node.path.split(" ", 1)[1] if " " in node.path else ""), node.text, "```", ""]
            elif node.kind == "formula":
                out += ["", f"$${node.text}$$", ""]
            elif node.kind == "item":
                out.append("  " * node.level + "- " + node.text)
            elif node.kind == "numbered":
                out.append("  " * node.level + "1. " + node.text)
            elif node.kind == "row":
                cells = [c.strip() for c in node.text.strip().strip("|").replace("||", "|").split("|")]
                out.append("| " + " | ".join(cells) + " |")
            else:
                out.append(node.text)
        return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def tag_path(tags: list[str]) -> str:
    return "/".join(tags if len(tags) <= 2 * DEEP else [*tags[:DEEP], "…", *tags[-DEEP:]])


def smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.array([math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)])
    weight = np.convolve(np.ones(len(x)), kernel, "full")[RADIUS : RADIUS + len(x)]
    return np.convolve(x, kernel, "full")[RADIUS : RADIUS + len(x)] / weight


def plain(text: str) -> str:
    """One line without its marks; inline code keeps its back-ticks, formulas their dollars."""
    kept: list[str] = []

    def hold(value: str) -> str:
        kept.append(value)
        return f"\x00{len(kept) - 1}\x00"

    if "`" in text:
        text = TICKS.sub(lambda m: hold(f"`{m[2].strip()}`"), text)
    if "<" in text:
        text = HTML_CODE.sub(lambda m: hold(f"`{html.unescape(TAG.sub('', m[3]))}`"), text)
        text = MATH_TAG.sub(lambda m: hold(f"${m[1]}$"), text)
        text = COMMENT.sub("", text)
    if "\\" in text:
        text = TEX_CODE.sub(lambda m: hold(f"`{m[1]}`"), text)
        text = re.sub(r"\\\((.+?)\\\)", lambda m: hold(f"${m[1].strip()}$"), text)
    if "$" in text:
        text = TEX_FORMULA.sub(lambda m: hold(m[0]), text)
    if "\\" in text:
        text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\\(?:label|cite|ref|footnote|index)\{[^{}]*\}", "", text)
        for _ in range(3):
            text = re.sub(r"\\[A-Za-z]+\*?\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\\\\|\\[A-Za-z]+\b\s?", " ", text)
        text = re.sub(r"\\([%&_#${}*])", r"\1", text)
    if "[" in text:
        text = re.sub(r"!?\[([^\]\n]*)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+[\"'][^\n]*?[\"'])?\)", r"\1", text)
        text = re.sub(r"\[\[(?:Category|File|Image):[^\[\]]*\]\]", "", text)
        text = re.sub(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", r"\1", text)
        text = re.sub(r"\[([^\]\[\n]+)\]\[[^\]\[\n]*\]", r"\1", text)
        text = re.sub(r"\[\^[^\]\s]+\]", "", text)
        text = re.sub(r"(?<![\w\]!])\[https?://\S+[ ]([^\]\n]+)\](?!\()", r"\1", text)
    if "{{" in text:
        text = re.sub(r"\{\{[^{}|\n%.]+\|([^{}]*)\}\}", r"\1", text)
        text = re.sub(r"\{\{[a-z]+(?: [a-z]+)*\}\}", "", text)
    if "<" in text:
        text = re.sub(r"<https?://([^>\s]+)>", r"\1", text)
        text = TAG.sub("", text)
    if "&" in text and ENTITY.search(text):
        text = TAG.sub(" ", html.unescape(text))
    if "''" in text:
        text = re.sub(r"'{2,5}(?=[^\s'])(.*?)(?<=[^\s'])'{2,5}", r"\1", text)
    if "*" in text:
        text = re.sub(r"\*{1,3}(?=[^\s*])([^\n]+?)(?<=[^\s*])\*{1,3}", r"\1", text)
    if "~~" in text:
        text = re.sub(r"~~(\S[^\n]*?)~~", r"\1", text)
    if "_" in text:
        text = re.sub(r"(?<![\w_])_{1,2}(?=[^\s_])([^_\n]+)(?<=[^\s_])_{1,2}(?![\w_])", r"\1", text)
    text = " ".join(text.split())
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text)


def _paths(batches):
    for batch in batches:
        out = {"page_id": [], "path": [], "nodes": [], "chars": [], "marks": []}
        for page, text in zip(batch.column("page_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for path, (nodes, chars, marks) in Page(text).paths.items():
                out["page_id"].append(page)
                out["path"].append(path)
                out["nodes"].append(nodes)
                out["chars"].append(chars)
                out["marks"].append(marks)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "path" else pa.int64()) for k, v in out.items()], names=list(out))


def tag_paths(pages: DataFrame) -> DataFrame:
    """`page_id, path, nodes, chars, marks`: what each root-to-leaf tag path of a page adds up to."""
    return identified(pages, "page_id").select("page_id", "text").mapInArrow(_paths, "page_id bigint, path string, nodes bigint, chars bigint, marks bigint").dropDuplicates(["page_id", "path"])


def _notations(batches):
    for batch in batches:
        ids, found = [], []
        for page, text in zip(batch.column("page_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            names = Page(text, clean=False).notations()
            ids += [page] * len(names)
            found += names
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["page_id", "markup"])


def notations(pages: DataFrame) -> DataFrame:
    """`page_id, markup`: the roots of each page's tag paths that are notations."""
    return identified(pages, "page_id").select("page_id", "text").mapInArrow(_notations, "page_id bigint, markup string").distinct()


def _clean(batches):
    for batch in batches:
        ids, texts = [], []
        for page, text in zip(batch.column("page_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(page)
            texts.append(Page(text).render())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["page_id", "text"])


def clean_text(pages: DataFrame) -> DataFrame:
    """`page_id, text`: every page's content as clean text."""
    one = current(identified(pages, "page_id").select("page_id", "loaded_at", "text"), "page_id", "loaded_at").select("page_id", "text")
    return one.mapInArrow(_clean, "page_id bigint, text string")


def path_ratios(pages: DataFrame) -> DataFrame:
    """`path, pages, nodes, text_ratio, mark_ratio`: mean text length and mean punctuation of each tag path over all pages."""
    per = tag_paths(pages).groupBy("path").agg(F.countDistinct("page_id").alias("pages"), F.sum("nodes").alias("nodes"), F.sum("chars").alias("chars"), F.sum("marks").alias("marks"))
    return per.select("path", "pages", "nodes", (F.col("chars") / F.col("nodes")).alias("text_ratio"), (F.col("marks") / F.col("nodes")).alias("mark_ratio"))
