"""The main content of pages, told from the site's own surroundings by a consensus of each host's pages.

A page is cut into containers: an element with all its lines (menu, footer, a classed block), a titled list with its title, or a single
line. Each container gets a generalised tag-class path: its tag with class, id or role; for lines without such a name the kind of line
with its words, digits read as 0, so that a line that changes only in dates or numbers keeps its path; breadcrumbs and pagers, whose
words change with every page, by their shape. Each page scores its containers: 1 if no heading or running text stands before or
none after it, or if it is a list of the page's own headings; else 0. Per host, the pages vote: a path wins as surroundings if enough of the
host's pages have it and its mean score passes `WINNING` (for titled lists `WINNING_LIST`, as they also stand between paragraphs).
Bylines, legal notes and share prompts repeat just as often, but among the text, so they lose the vote. Winning paths are then taken
out of every page of the host.

Where fewer pages of a host have a path than a vote needs, all hosts that have it vote together.

A page without url goes by the host whose own winning paths it shares most; if it shares none, nothing is taken out.

Defined cases: rows without page_id are left out; null and empty texts have no lines; front matter, code blocks, headings, wrappers of the main body and blank lines
are never surroundings; a path that fewer than `LEAST_PAGES` pages have stays; of several deliveries of a page the one with the
greatest `loaded_at` counts; an empty table gives no rows.

Scale: a page sends on a few bytes a line. Votes are sums, combined before the shuffle, so a host with a third of all pages is no hot
spot. Winning paths go back to the pages by broadcast if their checked number is small, else by a shuffle on the path.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.core.runtime import broadcast_checked, current, durable
from folioscope.llm.text import WORD, identified, latest, site_column, without_lines

LEAST_PAGES, LEAST_PERCENT = 4, 1
LEAST_HOSTS = 2
WINNING, WINNING_LIST = 0.82, 0.5
#: Added to the number of votes, so that a few pages need a clearer vote than many.
DOUBT = 0.5
#: Words from which a line counts as running text, and above which running text has no path, and other lines are no pager, breadcrumb or title.
RUNNING, MOST_WORDS = 10, 24
#: Headings and lines of running text that a page needs to vote.
LEAST_TEXT = 3

TAG = re.compile(r"<[^<>]*>")
DIGITS = re.compile(r"\d+")
OPENING = re.compile(r"<([A-Za-z][\w-]*)((?:\s[^<>]*)?)>")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([\w-]+)""", re.I)
FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})")
HEADING = re.compile(r"^(?:#{1,6}\s|=+[^=].*=+\s*$|\\(?:sub)*section|<h[1-6]\b)", re.I)
HEADING_MARK = re.compile(r"^(?:#{1,6}\s+|=+\s*|\\(?:sub)*section\*?\{)|[#=}]+\s*$")
#: Lines that frame the text rather than being part of it, or that are notation of the text itself.
NEVER = re.compile(r"^(?:\\|\{\{|\}\}|\{\||\|[-}]?|!|\[\[(?:Category|Kategorie|File|Datei)\b|<!|</?(?:html|head|body|main|article|title|style|script|meta|link|table|thead|tbody|tr|t[dh])\b|%|\$\$|:?-{3,}|={3,})", re.I)
ITEM = re.compile(r"""^(?:[•·▪‣]\s*\S|[-*+]\s+\[[^\]]*\]\([^)\s]*\)\s*$|(?:<li[^>]*>\s*)?<a\s[^>]*>.*</a>\s*(?:</li>)?\s*$|\[\[[^\]]*\]\]\s*$|\*\s*\[\[[^\]]*\]\]\s*$)""", re.I)
ENTRY = re.compile(r"^[A-ZÀ-Þ][^.!?:;|<>{}\[\]\\=*#]{2,}$")
PAGER = re.compile(r"^\W*(?:prev(?:ious)?|zurück|précédent|anterior)(?:\s+(?:article|page|topic)\b|\s*[:›»→])|^\W*(?:next|weiter|suivant|siguiente)(?:\s+(?:article|page|topic)\b|\s*[:›»→])", re.I)
ARROWS = re.compile(r"^[←→‹›«»⟵⟶]\s*\S|\S\s*[→»⟶]$")
PARTS = re.compile(r"\s+[|/›>»·•]\s+|\s*[›»]\s*")
#: How running text ends a line, if the next one does not go on in lower case.
ENDING = re.compile(r"[.!?:]['\"”’)\]*_~]*$")
#: Elements that stand for a container by themselves.
ELEMENTS = {"nav", "footer", "header", "aside", "section", "menu", "form", "dialog"}


def line_key(line: str) -> str:
    if "<" in line:
        line = TAG.sub("", line)
    return DIGITS.sub("0", " ".join(WORD.findall(line.lower())))


def element(line: str) -> str | None:
    """The path of a line's outer element, if it has a name of its own."""
    found = OPENING.match(line)
    if not found:
        return None
    tag, name = found[1].lower(), NAMED.search(found[2])
    if name and tag != "a":
        return f"{tag}.{name[1].lower()}"
    return tag if tag in ELEMENTS else None


def closes(line: str, path: str) -> bool:
    return f"</{path.split('.')[0]}>" in line.lower()


class Lines:
    """The lines of one page that have a path: number, path, whether it is a titled list's, and how many lines of text stand before."""

    def __init__(self, text: str):
        self.no: list[int] = []
        self.path: list[str] = []
        self.titled: list[bool] = []
        self.before: list[int] = []
        self.toc: list[bool] = []
        self.total = 0
        if text:
            raw = text.split("\n")
            self._read([x.strip() for x in raw], [x.startswith(("    ", "\t")) for x in raw])

    def _put(self, i: int, path: str, titled: bool = False, toc: bool = False) -> None:
        self.no.append(i + 1)
        self.path.append(path)
        self.titled.append(titled)
        self.before.append(self.total)
        self.toc.append(toc)

    def _read(self, lines: list[str], indented: list[bool]) -> None:
        n, i = len(lines), 0
        if lines[0] == "---":
            end = next((k for k in range(1, n) if lines[k] == "---"), 0)
            i = end + 1 if end else 0
        headings = {line_key(HEADING_MARK.sub("", x)) for x in lines if x and HEADING.match(x)}
        headings |= {line_key(lines[k - 1]) for k in range(1, n) if lines[k][:3] in ("---", "===") and lines[k - 1]}
        while i < n:
            line = lines[i]
            if not line:
                i += 1
                continue
            fence = FENCE.match(line)
            if fence:
                mark, i = fence[1], i + 1
                while i < n and not lines[i].startswith(mark):
                    i += 1
                i += 1
                continue
            low = line[:12].lower()
            if low.startswith("<pre") or line.startswith("\\begin{verbatim}"):
                stop = "</pre>" if low.startswith("<pre") else "\\end{verbatim}"
                while i < n and stop not in lines[i].lower():
                    i += 1
                i += 1
                continue
            if indented[i] and line[0] != "<":  # a code block
                i += 1
                continue
            if HEADING.match(line):
                self.total += 1
                i += 1
                continue
            if NEVER.match(line) or (i + 1 < n and lines[i + 1][:3] in ("---", "===") and not lines[i + 1].strip("-=")):
                i += 1
                continue
            if line[0] == "<":
                path = element(line)
                if path and not closes(line, path):
                    # an element over several lines, up to its end; without one it is the line alone
                    end = next((k for k in range(i, n) if closes(lines[k], path)), i)
                    for k in range(i, end + 1):
                        if lines[k]:
                            self._put(k, path)
                    i = end + 1
                    continue
                if path:
                    self._put(i, path)
                    i += 1
                    continue
            i = self._line(lines, i, n, headings)

    def _line(self, lines: list[str], i: int, n: int, headings: set[str]) -> int:
        """One line, or a titled list; the title and the entries of such a list keep their own paths too."""
        end = self._list(lines, i, n, headings)
        for k in range(i, end):
            self._single(lines, k, n)
        return end

    def _list(self, lines: list[str], i: int, n: int, headings: set[str]) -> int:
        line = lines[i]
        if i + 1 >= n or not lines[i + 1] or line[-1] in ".,;:" or ITEM.match(line) or PAGER.match(line):
            return i + 1
        key = line_key(line)
        end = self._list_end(lines, i + 1, n) if key and key.count(" ") < 6 else i + 1
        if end > i + 1:
            items = [line_key(x) for x in lines[i + 1 : end]]
            toc = sum(x in headings for x in items) * 2 > len(items) or all(x[0] == "•" or 'href="#' in x for x in lines[i + 1 : end])
            for k in range(i, end):
                self._put(k, f"list:{key}", True, toc)
        return end

    def _single(self, lines: list[str], i: int, n: int) -> None:
        line = lines[i]
        key = line_key(line)
        words = key.count(" ") + 1 if key else 0
        if not words:
            return
        bare = TAG.sub("", line).strip() if "<" in line else line
        running = words >= RUNNING and bool(ENDING.search(bare) or (i + 1 < n and lines[i + 1][:1].islower()))
        if words > MOST_WORDS:
            if not running:
                self._put(i, f"line:{key}")
        else:
            parts = PARTS.split(bare)
            if PAGER.match(bare) or ARROWS.search(bare):
                self._put(i, "pager")
            elif len(parts) == 2 and words <= 14 and parts[0] and parts[1]:
                self._put(i, f"crumb:{line_key(parts[0])}")
            else:
                self._put(i, f"line:{key}")
                if words <= 6:
                    self._put(i, f"list:{key}", True)  # a title whose list is empty here
        if running:
            self.total += 1

    @staticmethod
    def _list_end(lines: list[str], i: int, n: int) -> int:
        """The end of the list that begins at line i: items of one shape; with plain entries only if two or more."""
        k = i
        if ITEM.match(lines[i]):
            lead = lines[i][0]
            while k < n and lines[k] and lines[k][0] == lead and ITEM.match(lines[k]):
                k += 1
            return k
        while k < n and lines[k] and ENTRY.match(lines[k]) and 2 <= lines[k].count(" ") + 1 <= 9:
            k += 1
        return k

    def scores(self) -> list[int | None]:
        """A page with hardly any text has no middle, and no say."""
        if self.total < LEAST_TEXT:
            return [None] * len(self.no)
        return [int(t or b == 0 or self.total == b) for b, t in zip(self.before, self.toc, strict=True)]


def _paths(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            ends, no, path, score, first, titled = [0], [], [], [], [], []
            for text in part.column("text").to_pylist():
                page, seen = Lines(text or ""), set()
                no += page.no
                score += page.scores()
                titled += page.titled
                for p in page.path:
                    path.append(xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) - (1 << 63))
                    first.append(p not in seen)
                    seen.add(p)
                ends.append(len(no))
            columns = {"line_no": pa.array(no, pa.int32()), "path": pa.array(np.array(path, np.int64)), "score": pa.array(score, pa.int8()), "titled": pa.array(titled, pa.bool_()), "is_first": pa.array(first, pa.bool_())}
            lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("loaded_at"), part.column("site"), lines], names=["page_id", "loaded_at", "site", "lines"])


LINES = "array<struct<line_no:int,path:bigint,score:tinyint,titled:boolean,is_first:boolean>>"


def page_paths(pages: DataFrame) -> DataFrame:
    """`page_id, site, lines` of each page; `site` is null where the url is missing."""
    rows = identified(pages, "page_id").select("page_id", F.col("loaded_at").cast("timestamp").alias("loaded_at"), site_column(F.col("url")).alias("site"), "text")
    return latest(rows.mapInArrow(_paths, f"page_id bigint, loaded_at timestamp, site string, lines {LINES}"), "page_id", "loaded_at", ["site", "lines"])


def votes(paths: DataFrame) -> DataFrame:
    """`site, path, titled, n_pages, n_lines, total, site_pages`: of each path of a host the pages and lines that have it and the sum of its scores."""
    each = paths.filter(F.col("site").isNotNull()).select("site", F.inline("lines")).filter(F.col("score").isNotNull())
    counted = each.groupBy("site", "path").agg(F.sum(F.col("is_first").cast("int")).alias("n_pages"), F.count("score").alias("n_lines"), F.sum("score").alias("total"), F.max("titled").alias("titled"))
    sites = paths.filter(F.col("site").isNotNull()).groupBy("site").agg(F.count("*").alias("site_pages"))
    return counted.join(broadcast_checked(sites), "site")


def passes(total: str, lines: str) -> Column:
    """Whether the mean score, a little lowered, wins."""
    return F.col(total) / (F.col(lines) + DOUBT) >= F.when(F.col("titled"), WINNING_LIST).otherwise(WINNING)


def winners(voted: DataFrame) -> DataFrame:
    """`site, path` of the surroundings; of paths that too few of a host's pages have, the vote of all hosts decides."""
    enough = (F.col("n_pages") >= LEAST_PAGES) & (F.col("n_pages") * 100 >= F.col("site_pages") * LEAST_PERCENT)
    everywhere = voted.groupBy("path").agg(F.sum("n_pages").alias("pages"), F.sum("n_lines").alias("lines"), F.sum("total").alias("sum"), F.max("titled").alias("titled"), F.count("*").alias("hosts"))
    common = everywhere.filter((F.col("hosts") >= LEAST_HOSTS) & (F.col("pages") >= LEAST_PAGES) & passes("sum", "lines")).select("path")
    rare = voted.filter(~enough).select("site", "path").join(broadcast_checked(durable(common)), "path", "left_semi").select("site", "path")
    return voted.filter(enough & passes("total", "n_lines")).select("site", "path").unionByName(rare)


def adopted(paths: DataFrame, won: DataFrame) -> DataFrame:
    """The pages without url as pages of the host with which they share most of the paths that no other host has."""
    alone = won.groupBy("path").agg(F.count("*").alias("hosts"), F.min("site").alias("site")).filter("hosts = 1").select("path", "site")
    lost = paths.filter(F.col("site").isNull())
    shared = lost.select("page_id", F.inline("lines")).select("page_id", "path").distinct().join(broadcast_checked(alone), "path").groupBy("page_id", "site").count()
    best = shared.groupBy("page_id").agg(F.max(F.struct("count", "site")).alias("b")).select("page_id", F.col("b.site").alias("site"))
    return lost.drop("site").join(best, "page_id").select("page_id", "site", "lines")


def surroundings(pages: DataFrame) -> DataFrame:
    """`page_id, line_no` of the lines that are the site's, not the page's."""
    paths = durable(page_paths(pages))
    won = durable(winners(durable(votes(paths))))
    every = paths.filter(F.col("site").isNotNull()).select("page_id", "site", "lines").unionByName(adopted(paths, won))
    lines = every.select("page_id", "site", F.inline("lines")).select("page_id", "line_no", F.xxhash64("site", "path").alias("key"))
    keys = durable(won.select(F.xxhash64("site", "path").alias("key")).distinct())
    return lines.join(broadcast_checked(keys), "key", "left_semi").select("page_id", "line_no").distinct()


def main_content(pages: DataFrame) -> DataFrame:
    """`page_id, n_dropped, text`: every page without its surroundings; runs of blank lines that this leaves become one."""
    drop = surroundings(pages).groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))
    texts = current(identified(pages, "page_id").select("page_id", "loaded_at", F.coalesce("text", F.lit("")).alias("text")), "page_id", "loaded_at")
    met = texts.join(drop, "page_id", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
    clean = F.trim(F.regexp_replace("text", r"\n(?:[ \t\r]*\n){2,}", "\n\n"))
    return without_lines(met, "text", "drop").select("page_id", F.size("drop").alias("n_dropped"), clean.alias("text"))
