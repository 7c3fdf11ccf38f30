"""Pages that hold what a template or a server left instead of content.

Labelled exemplars (scripts required, errors, access, waiting, stubs, filler, unfilled values, and, as counter-examples, sentences
that explain such things) stand in an inverted index from term to exemplar. A page without its code, inline code and front matter is
cut into passage windows: its lines, its sentences and the contents of its elements (within a line and across line ends), and spans of
about an exemplar's length that begin and end anywhere. Only messages of under SPAN_TERMS terms need a window of their own, as prose
names them within its sentences. The index returns the exemplars that share a term with a window; of each the TF-IDF containment
is taken both ways: the share of the window's weight that the exemplar covers, and the share of the exemplar's weight that the window
covers. A window covered highly by a residue exemplar, or by the exemplars of one kind together with one of them half held (a message in
other words), and not as highly by a counter-example, is residue. Term weights come from the
document frequencies over all pages.

An unfilled value (`{{page.title}}`, `[object Object]`, `%PRODUCT_NAME%`, a lone `undefined`) is a term of its own kind, and its window
is the value with its neighbours, so that it is found within running text too; next to the words of a counter-example it is an example.
Values that a reader is to replace (YOUR_API_KEY) are no terms of this kind. Notes of a wiki such as {{citation needed}} are none either.

Defined cases: rows without page_id are left out; null and empty texts are no residue; a page counts once, however often it is delivered or matched; windows without
letters or digits match nothing; ties between exemplars go to the first of the list; an empty table gives no rows.

Scale: both passes are narrow; what is shuffled are counts of the exemplars' terms (their number is fixed) and page ids.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.text import WORD, identified

#: Share of a window's weight, and of an exemplar's, from which a window is residue.
WINDOW_COVERED, EXEMPLAR_COVERED = 0.75, 0.7
#: A message in other words: the share of a window's weight that all exemplars of one kind cover together, and of one of them that the window covers.
KIND_COVERED, ONE_COVERED = 0.9, 0.5
#: The same for filler, whose exemplars are vocabularies rather than texts: only the window counts, from so many words on.
FILLER_COVERED, FILLER_WORDS = 0.8, 4
#: Share of a counter-example's weight near a value, from which the value is an example.
EXPLAINED = 0.5
#: Weight of a term that no exemplar has, as a share of the greatest weight.
UNKNOWN = 0.35
#: Distinct terms from which an exemplar is found within a sentence too; a shorter message there is named by it ("returns 404 Not Found").
SPAN_TERMS = 5
#: Words before and after an unfilled value that make its window.
NEAR = 7

RESIDUE = [
    ("script", "Please enable JavaScript to view this page"),
    ("script", "You need to enable JavaScript to run this app"),
    ("script", "JavaScript is disabled"),
    ("script", "This site does not work without it JavaScript"),
    ("script", "JavaScript is required to use this site"),
    ("script", "Your browser does not support JavaScript"),
    ("script", "requires scripts Turn on JavaScript in your browser and reload"),
    ("script", "Scripts must be active for the docs to load"),
    ("script", "Your browser is not supported or blocks scripts"),
    ("script", "Switch to a newer browser to read"),
    ("error", "Page not found"),
    ("error", "404 Not Found"),
    ("error", "The page you asked for has moved or never existed"),
    ("error", "The page you are looking for does not exist"),
    ("error", "The requested URL was not found on this server"),
    ("error", "Oops We could not find what you were looking for"),
    ("error", "Internal Server Error"),
    ("error", "Something went wrong on our side Request"),
    ("error", "Something went wrong please try again later"),
    ("error", "Bad gateway 502"),
    ("error", "node did not answer in 30 s"),
    ("error", "503 Service Unavailable"),
    ("error", "The gateway is being restarted try again in 5 minutes"),
    ("error", "504 Gateway Timeout"),
    ("error", "Database connection failed timeout after 30 s"),
    ("error", "Error establishing a database connection"),
    ("error", "This page is temporarily down for maintenance Sorry"),
    ("error", "The site is undergoing scheduled maintenance"),
    ("error", "Traceback most recent call last"),
    ("error", "message not found code document type invalid request"),
    ("access", "Access denied"),
    ("access", "403 Forbidden"),
    ("access", "You do not have permission to read this page on HOST"),
    ("access", "You do not have permission to access this resource"),
    ("access", "Your session has expired Sign in again to continue"),
    ("access", "You must be logged in to view this page"),
    ("access", "Too many requests"),
    ("access", "You have been rate limited wait 30 seconds and reload"),
    ("access", "Verifying that you are not a robot this takes a moment"),
    ("access", "Checking your browser before accessing HOST"),
    ("wait", "Loading please wait"),
    ("wait", "please wait"),
    ("wait", "Loading"),
    ("wait", "Redirecting you to the page"),
    ("stub", "Coming soon"),
    ("stub", "This article has not been written yet"),
    ("stub", "This page is a stub and needs content"),
    ("stub", "This page is under construction"),
    ("stub", "TODO write this page"),
    ("stub", "TBD"),
    ("stub", "TODO"),
    ("stub", "Placeholder for article 5 owner to be named"),
    ("stub", "Insert summary"),
    ("stub", "Insert steps"),
    ("stub", "Insert result"),
    ("stub", "Heading goes here"),
    ("stub", "Body copy goes here Replace this paragraph with your own text"),
    ("stub", "Your text goes here"),
    ("stub", "This is a sample page Edit or delete it then start writing"),
    ("stub", "Sample page"),
    ("stub", "Text text text text text text"),
    ("filler", "asdf asdf asdf qwer test test 123 qwerty foo bar baz"),
    (
        "filler",
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam"
        " quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse"
        " cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum",
    ),
    ("value", "§value"),
    # messages that widely used public software shows (servers, frameworks, wikis, browsers, site builders)
    ("script", "We are sorry but this app does not work properly without JavaScript enabled Please enable it to continue"),
    ("script", "This page requires JavaScript"),
    ("script", "Please turn JavaScript on and reload the page"),
    ("script", "JavaScript must be enabled to view this page"),
    ("script", "This content requires JavaScript and cookies to be enabled"),
    ("error", "Server Error 500"),
    ("error", "Whoops looks like something went wrong"),
    ("error", "An unexpected error has occurred"),
    ("error", "This site can not be reached"),
    ("error", "We are having trouble finding that site"),
    ("error", "The server encountered an internal error and was unable to complete your request"),
    ("error", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems"),
    ("error", "The upstream server took too long to respond"),
    ("error", "Sorry this page is not available The link may be broken or the page may have been removed"),
    ("error", "Fatal error Uncaught Error Call to undefined function"),
    ("error", "Uncaught TypeError Cannot read properties of undefined"),
    ("error", "There has been a critical error on this website"),
    ("access", "Sorry you have been blocked"),
    ("access", "Please complete the security check to access this site"),
    ("access", "Attention Required"),
    ("access", "You need to sign in to see this page"),
    ("access", "Please verify you are a human"),
    ("access", "Your IP address has been blocked due to suspicious activity"),
    ("access", "Authentication is required to view this content"),
    ("wait", "Just a moment"),
    ("wait", "If you are not redirected automatically follow this link"),
    ("wait", "Please wait while your request is being verified"),
    ("stub", "Welcome to nginx If you see this page the web server is successfully installed and working Further configuration is required"),
    ("stub", "Apache default page It works"),
    ("stub", "Hello world This is your first post Edit or delete it then start writing"),
    ("stub", "There is currently no text in this page You can search for this page title in other pages"),
    ("stub", "This section is empty You can help by adding to it"),
    ("stub", "Content for this page will be added soon"),
    ("stub", "This domain is parked Buy this domain"),
    ("stub", "Add your content here"),
    ("stub", "Nothing here yet"),
]
COUNTER = [
    ("explained", "Write the template as and the engine"),
    ("explained", "In scripts an is skipped and a value"),
    ("explained", "Filler text such as lorem ipsum in the demo helps to test"),
    ("explained", "The error page of reads access denied which can restyle"),
    ("explained", "A missing returns 404 Not Found with the code"),
    ("explained", "If a browser says that JavaScript must be enabled the cannot render in"),
    ("explained", "Replace with the key of"),
    ("explained", "The placeholder stands for a value, for example"),
    ("explained", "the variable is replaced by its value when the template is rendered"),
]

TERM = re.compile(r"§value|§host|[^\W_]+")
DOMAIN = re.compile(r"\.(?:example|com|org|net|io|dev)\b", re.I)
HOST = re.compile(r"\b(?:https?://)?[\w-]+(?:\.[\w-]+)*\.(?:example|com|org|net|io|dev)\b(?:/\S*)?", re.I)
#: Any digit makes a term read as 0.
NUMBER = re.compile(r"\d")
#: Values that a template left unfilled, by the notations of common template languages.
VALUE = re.compile(
    r"\{\{\{?-?\s*%?\s*[a-z_]+(?:[._][A-Za-z_]+|[A-Z]\w*)+\s*%?\s*-?\}?\}\}|\{\{%-?\s*\w[^%\n]*%-?\}\}|\{\{\s*(?:title|name|version|product|url|date|author|content|description)\s*\}\}"
    r"|\{%-?\s*[a-z]+[^%\n]*%\}|\$\{[A-Za-z_][\w.]*\}|<%[=-]?[^%<>\n]*%>|#\{[A-Za-z_][\w.]*\}|%%?[A-Z][A-Z_]{2,}%%?|\$[A-Z][A-Z_]{2,}\$|@@\w+@@|\(\([a-z_.]+\)\)"
    r"|(?<![\w/}\])^{$#\\])\{(?:\d|[a-z]+(?:[_.][a-z]+|[A-Z][a-z]+)+)\}(?!\})|\[object Object\]|\[(?:insert|add|your|enter|tbd|todo|company|product)\b(?:[ _][\w ]*)?\](?![(\[:])"
    r"|(?<![\w.])(?:undefined|NaN|null)(?![\w(])",
    re.I,
)
#: A line without any of these has no unfilled value.
SIGNS = re.compile(r"[{}\[%$#@(]|undefined|NaN|NAN|null|UNDEFINED|NULL")
#: Code of each notation with the signs without which a text has none of it.
CODE = [
    (("```", "~~~"), re.compile(r"^[ \t>]*(?P<f>`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t>]*(?P=f)[`~]*[ \t\r]*$|\Z)", re.S | re.M)),
    (("<pre", "<PRE"), re.compile(r"<pre\b.*?</pre\s*>", re.S | re.I)),
    (("\\begin{",), re.compile(r"\\begin\{(?P<v>verbatim|lstlisting|minted)\}.*?\\end\{(?P=v)\}", re.S)),
    (("<code", "<CODE", "<kbd", "<samp", "<tt", "<nowiki", "<syntax", "<source", "<script", "<style"), re.compile(r"<(?P<t>code|kbd|samp|tt|nowiki|syntaxhighlight|source|script|style)\b.*?</(?P=t)\s*>", re.S | re.I)),
    (("`",), re.compile(r"(?P<b>`+)[^`\n]+(?P=b)")),
    (("\\texttt{", "\\verb{", "\\lstinline{"), re.compile(r"\\(?:texttt|verb|lstinline)\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}")),
    (("\n    ", "\n\t"), re.compile(r"^(?: {4}|\t)[ \t]*[^\s<][^\n]*$", re.M)),
    (("<!--",), re.compile(r"<!--.*?-->", re.S)),
]
TAG = re.compile(r"</?[A-Za-z][^<>]*>|\\(?:begin|end|section|subsection|subsubsection|emph|textbf|item|title)\b\*?")

#: Where a passage ends within a line: a sentence's end, or a tag of an element that is no part of running text.
END = re.compile(r"[.!?…]+[\"'”’)\]*_]*(?=\s|$)|</?(?!(?:a|abbr|b|em|font|i|mark|q|s|small|span|strong|sub|sup|u)\b)[A-Za-z][^<>]*>", re.I)


def strip_code(text: str) -> str:
    """The text without code, inline code, comments and front matter; lines stay."""
    if text.startswith("---"):
        end = text.find("\n---", 3)
        if end > 0:
            end = text.find("\n", end + 1)
            text = text[end:] if end > 0 else ""
    for signs, pattern in CODE:
        if any(s in text for s in signs):
            text = pattern.sub(lambda m: " ` " + "\n" * m[0].count("\n"), text)
    return text


def terms(text: str) -> list[str]:
    """Lower-cased words; numbers and identifiers with digits read as 0."""
    return [w if w.isalpha() or w[0] == "§" else "0" for w in TERM.findall(text.lower())]


def prepared(text: str):
    """The lines of a text with hosts and unfilled values as terms of their own; null for a blank line."""
    for line in strip_code(text).split("\n"):
        if not line or line.isspace():
            yield None
            continue
        if "." in line and DOMAIN.search(line):
            line = HOST.sub(" §host ", line)
        if SIGNS.search(line):
            line = VALUE.sub(_value, line)
        yield line


def line_terms(line: str) -> list[str]:
    return terms(TAG.sub(" ", line) if "<" in line or "\\" in line else line)


def windows(text: str):
    """The lines of a text as lists of terms."""
    for line in prepared(text):
        if line is not None:
            yield line_terms(line)


def pieces(lines: list[str | None], cut_lines: bool):
    """Sentences and elements' contents as (number of the first non-blank line, terms), across line ends or cut there too."""
    at, first, held = -1, 0, []
    for line in lines:
        at += line is not None
        parts = [""] if line is None else END.split(line)
        for k, part in enumerate(parts):
            if held and (k or line is None):
                yield first, held
                held = []
            found = line_terms(part)
            if not held:
                first = at
            held = held + found
        if held and cut_lines:
            yield first, held
            held = []
    if held:
        yield first, held


def _value(found: re.Match) -> str:
    word = found[0]
    if word.isalpha():
        # the bare words only in their exact case, as scripts print them, or in a heading that is all capitals
        whole = found.string.strip()
        return " §value " if word in ("undefined", "NaN", "null") or (word.isupper() and whole.isupper()) else word
    return " §value "


class Exemplars:
    """The inverted index of all exemplars, and the weight of each of their terms."""

    def __init__(self, frequencies: dict[str, int], pages: int, residue=RESIDUE, counter=COUNTER):
        self.kinds = [k for k, _ in residue] + [k for k, _ in counter]
        self.sets = [frozenset(terms(t.replace("HOST", "§host"))) for _, t in residue + counter]
        self.weight = {t: math.log((pages + 1) / (frequencies.get(t, 0) + 0.5)) + 0.1 for s in self.sets for t in s}
        self.total = [sum(self.weight[t] for t in s) for s in self.sets]
        self.unknown = UNKNOWN * math.log(2 * pages + 2)
        self.index: dict[str, list[int]] = defaultdict(list)
        for i, s in enumerate(self.sets):
            for t in s:
                self.index[t].append(i)
        #: The kinds of message in which a term occurs; for these a window may be put together from several exemplars.
        self.kinds_of: dict[str, set[str]] = defaultdict(set)
        for i, k in enumerate(self.kinds):
            if k not in ("filler", "explained", "value"):
                for t in self.sets[i]:
                    self.kinds_of[t].add(k)
        others = frozenset().union(*(s for s, k in zip(self.sets, self.kinds, strict=True) if k not in ("filler", "explained")))
        #: Of each exemplar the terms of which a matching window has at least one, whatever the frequencies: the others hold too little of it.
        self.gates = [self.sets[i] - others if k == "filler" else self._gate(i) for i, k in enumerate(self.kinds)]
        self.gated = [i for i, k in enumerate(self.kinds) if k not in ("explained", "value")]
        self.key = frozenset().union(*(self.gates[i] for i in self.gated))

    def _gate(self, i: int) -> frozenset[str]:
        gate, rest = set(), self.total[i]
        for t in sorted(self.sets[i], key=lambda t: (-self.weight[t], t)):
            if rest < ONE_COVERED * self.total[i]:
                break
            gate.add(t)
            rest -= self.weight[t]
        return frozenset(gate)

    def containment(self, window: set[str]) -> tuple[dict[int, float], float]:
        """The common weight of the window with each exemplar that shares a term, and the window's own weight."""
        common: dict[int, float] = defaultdict(float)
        whole = 0.0
        for t in window:
            w = self.weight.get(t)
            if w is None:
                whole += self.unknown
                continue
            whole += w
            for i in self.index[t]:
                common[i] += w
        return common, whole

    def page(self, text: str) -> list[tuple[int, str]]:
        """(number of the non-blank line, kind) of the windows that are residue: lines, sentences, and spans of about an exemplar's length."""
        lines = list(prepared(text))
        by_line = [line_terms(x) for x in lines if x is not None]
        found = {i: kind for i, w in enumerate(by_line) if w and (kind := self.label(w))}
        held = set().union(*by_line)
        near = [i for i in self.gated if not self.gates[i].isdisjoint(held) and self.within(i, held)]
        if near:
            for cut_lines in (True, False):
                for first, w in pieces(lines, cut_lines):
                    if first not in found and (kind := self.match(w)):
                        found[first] = kind
            stream, owner = [t for w in by_line for t in w], [i for i, w in enumerate(by_line) for _ in w]
            for i in near:
                for a, b in self.spans(i, stream):
                    if found.keys().isdisjoint(range(owner[a], owner[b] + 1)):
                        found[owner[a]] = self.kinds[i]
        return sorted(found.items())

    def within(self, i: int, held: set[str]) -> bool:
        return self.kinds[i] == "filler" or sum(self.weight[t] for t in self.sets[i] & held) >= EXEMPLAR_COVERED * self.total[i]

    def spans(self, i: int, stream: list[str]):
        """First and last place of the runs of terms that match an exemplar, wherever they begin and end; not next to a counter-example's words."""
        own, total, filler, at = self.sets[i], self.total[i], self.kinds[i] == "filler", -1
        if not filler and len(own) < SPAN_TERMS:
            return
        for a, t in enumerate(stream):
            if a <= at or t not in own or (a and filler and stream[a - 1] in own):
                continue
            inside, outside, seen, b = 0.0, 0.0, set(), a
            for b in range(a, len(stream)):
                w = stream[b]
                if filler:
                    if w not in own:
                        b -= 1
                        break
                    seen.add(w)
                    continue
                if w in seen:
                    continue
                seen.add(w)
                if w in own:
                    inside += self.weight[w]
                    if inside >= EXEMPLAR_COVERED * total and inside >= WINDOW_COVERED * (inside + outside):
                        break
                else:
                    outside += self.weight.get(w, self.unknown)
                    if outside > total * (1 / WINDOW_COVERED - 1):
                        break
            hit = b - a + 1 >= FILLER_WORDS and len(seen & self.gates[i]) >= 2 if filler else inside >= EXEMPLAR_COVERED * total and inside >= WINDOW_COVERED * (inside + outside)
            if hit and not self._explained(stream[max(0, a - NEAR) : b + 1 + NEAR]):
                yield a, b
                at = b

    def label(self, window: list[str]) -> str | None:
        """The kind of residue that the window is, if any."""
        if "§value" in window and self._unfilled(window):
            return "value"
        return self.match(window)

    def match(self, window: list[str]) -> str | None:
        """The kind of the exemplar that covers the window most, if none explains it."""
        known = set(window)
        if self.key.isdisjoint(known):
            return None
        common, whole = self.containment(known)
        best, kind, against = 0.0, None, 0.0
        by_kind: dict[str, float] = defaultdict(float)
        for t in known:
            for k in self.kinds_of.get(t, ()):
                by_kind[k] += self.weight[t]
        for i in sorted(common):
            covered, held = common[i] / whole, common[i] / self.total[i]
            if self.kinds[i] == "filler":
                hit = covered >= FILLER_COVERED and len(window) >= FILLER_WORDS and len(known & self.gates[i]) >= 2
            elif self.kinds[i] in ("explained", "value"):
                against = max(against, held if self.kinds[i] == "explained" else 0.0)
                continue
            else:
                hit = covered >= WINDOW_COVERED and held >= EXEMPLAR_COVERED or len(self.sets[i]) > 1 and held >= ONE_COVERED and by_kind[self.kinds[i]] >= KIND_COVERED * whole
            if hit and covered > best:
                best, kind = covered, self.kinds[i]
        return kind if best > against else None

    def _unfilled(self, window: list[str]) -> bool:
        """Whether a value in the window stands apart from every counter-example."""
        for at, t in enumerate(window):
            if t == "§value":
                if not self._explained(window[max(0, at - NEAR) : at] + window[at + 1 : at + 1 + NEAR]):
                    return True
        return False

    def _explained(self, window: list[str]) -> bool:
        common, _ = self.containment(set(window))
        return any(self.kinds[i] == "explained" and common[i] / self.total[i] >= EXPLAINED for i in common)


def vocabulary() -> frozenset[str]:
    return frozenset(t for _, text in RESIDUE + COUNTER for t in terms(text.replace("HOST", "§host")))


def held_kinds(text: str) -> set[str]:
    """The terms that stand for many: numbers, hosts, unfilled values."""
    signs = {"0": NUMBER.search(text), "§host": "." in text and HOST.search(text), "§value": SIGNS.search(text) and any(_value(m) == " §value " for m in VALUE.finditer(text))}
    return {t for t, found in signs.items() if found}


def _present(batches):
    wanted = vocabulary()
    for batch in batches:
        ids, found = [], []
        for page, text in zip(batch.column("page_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                held = wanted.intersection(WORD.findall(text.lower())) | held_kinds(text)
                ids += [page] * len(held)
                found += held
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["page_id", "term"])


def frequencies(pages: DataFrame) -> dict[str, int]:
    """In how many deliveries of pages each term, code included, of the exemplars occurs; at most as many rows as the exemplars have terms."""
    return {r["term"]: r["n"] for r in pages.select("page_id", "text").mapInArrow(_present, "page_id bigint, term string").groupBy("term").agg(F.count("*").alias("n")).collect()}


def _label(frequencies: dict[str, int], pages: int):
    def run(batches):
        known = Exemplars(frequencies, pages)
        for batch in batches:
            out = {"page_id": [], "line_window": [], "kind": []}
            for page, text in zip(batch.column("page_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for i, kind in known.page(text or ""):
                    out["page_id"].append(page)
                    out["line_window"].append(i)
                    out["kind"].append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(out["page_id"], pa.int64()), pa.array(out["line_window"], pa.int32()), pa.array(out["kind"], pa.string())], names=list(out))

    return run


def matches(pages: DataFrame) -> DataFrame:
    """`page_id, line_window, kind` of every passage window that is residue."""
    pages = identified(pages, "page_id")
    n = pages.count()
    return pages.select("page_id", "text").mapInArrow(_label(frequencies(pages), n), "page_id bigint, line_window int, kind string")


def residue_pages(pages: DataFrame) -> DataFrame:
    """`page_id` of the pages to leave out."""
    return matches(pages).select("page_id").distinct()


def residue_report(pages: DataFrame) -> DataFrame:
    """`page_id, kinds, n_windows`: of each such page the kinds of residue and the number of windows."""
    return matches(pages).distinct().groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n_windows"))
