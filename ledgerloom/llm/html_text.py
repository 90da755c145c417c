"""Main text of web pages.

Every page goes through the host suffix array: the token streams of a host's pages are sorted by
suffix, and a run of LONG tokens that stands on enough distinct pages of the host is repeated. A
block of which COVERED lies in repeated runs is a candidate to go. An exact check by markup follows.
What lies inside article (else main) elements is text and stays, repeated or not (passages of
articles repeat across pages of a host); what lies outside them is not; on pages that mark neither
article nor main the array's verdict holds, and blocks go or stay whole, so no sentence loses words
because a phrase of it is common. Menus, headers, footers, sidebars, notices, adverts, forms, scripts
and reader comments, by element, role and class, are no text anywhere and are not read into streams.

A page has two streams: what its article holds, and the rest. Pages are counted by the rest only, so
the text of articles never makes a run of an open page repeated, while what stands around articles
does. Both streams are judged.

A hot host is split by a hash of the page into parts of bounded size; the pages of a run are counted
over all parts, so the split decides nothing. A page is its page_id and url, or where both are null
its blocks; repeated rows of it count once.

Defined results: null html is an empty page, its text empty; a page cut off inside a tag, comment
or script ends there; elements end as HTML ends them, by their own tag, by the end of one around
them, or (p, li, dd, dt, option, table parts, head, ...) by what follows; an element without an end
tag of its own in which an article or main element starts is not skipped; null urls are a host of
their own; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import html as html_module
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, table

LONG = 8
#: A run of tokens is boilerplate on at least so many distinct pages of its host, however large the host is.
MIN_PAGES = 3
#: A block goes if so much of it lies in such runs; all others stay whole.
COVERED = 0.9
GROUP_PAGES = 500
TAG = re.compile(r"""<(?:!--.*?(?:-->|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|[!?][^>]*>|/?[a-zA-Z][^>]*(?:>|$)|[!?/]?$)""", re.S)
#: An attribute: its whole name, then perhaps a value, in quotes or without.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"\s+")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
SKIP = {"head", "nav", "aside", "footer", "form", "button", "select", "option", "svg", "canvas", "object", "dialog", "menu", "audio", "video"}
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label link mark meta q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# How HTML ends elements: headings end each other, a p ends before blocks, cells and rows before the next, the head before any other tag.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_P = HEADINGS | set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p dd dt pre search section summary table ul xmp".split())
SPECIAL = ENDS_P | set("applet body button caption colgroup frameset html marquee object select tbody td tfoot th thead tr".split())
LI_BARRIER = SPECIAL - {"address", "div", "p"}
SCOPE = set("applet caption html marquee object table td th".split())
TABLE_CONTEXT = {"td": {"tr", "tbody", "thead", "tfoot", "table"}, "tr": {"tbody", "thead", "tfoot", "table"}, "tbody": {"table"}}
TABLE_CONTEXT |= {"th": TABLE_CONTEXT["td"], "thead": {"table"}, "tfoot": {"table"}, "caption": {"table"}, "colgroup": {"table"}}
IN_HEAD = set("base basefont bgsound head html link meta noframes".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement adsense sponsored sponsor promo promotion banner cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended comment comments commentlist disqus respond login search widget pagination pager toolbar masthead".split())


def _skipped(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no main text. inside: of an article or main element."""
    if name in SKIP or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "main") or name == "article" and not inside:
        return False
    told = {}
    for kind, *values in ATTRIBUTE.findall(attributes):
        # The first of several attributes of one name holds.
        told.setdefault(kind.lower(), "".join(values).lower())
    for kind, value in told.items():
        if kind == "hidden" and value != "until-found" or kind == "role" and value in ROLES:
            return True
        if kind in ("class", "id"):
            parts = set(re.split(r"[^a-z0-9]+", value))
            if parts & WORDS or "header" in parts and not inside:
                return True
    return False


class _Open:
    """The stack of open elements. An element is a number; at what step it ended, and whether by an end tag of its own, is kept."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.count: Counter[str] = Counter()
        self.ended: list[int] = []
        self.own: list[bool] = []

    def nearest(self, names: set[str], barrier: set[str]) -> int:
        """Place of the innermost open element of the names, -1 if there is none or one of the barrier lies before it."""
        if any(self.count[n] for n in names):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in names:
                    return k
                if self.stack[k][0] in barrier:
                    break
        return -1

    def end(self, first: int, last: int, step: int) -> None:
        for name, element in self.stack[first:last]:
            self.ended[element] = step
            self.count[name] -= 1
        del self.stack[first:last]

    def end_from(self, k: int, step: int) -> None:
        if k >= 0:
            self.end(k, len(self.stack), step)

    def end_head(self, step: int) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self.end_from(len(self.stack) - 1, step)

    def start_tag(self, name: str, step: int, empty: bool) -> int:
        """The number of the new element, -1 for one that holds nothing."""
        if name not in IN_HEAD:
            self.end_head(step)
        if name == "li":
            self.end_from(self.nearest({"li"}, LI_BARRIER), step)
        elif name in ("dd", "dt"):
            self.end_from(self.nearest({"dd", "dt"}, LI_BARRIER), step)
        elif name in ("option", "optgroup"):
            self.end_from(self.nearest({"option"}, SPECIAL | {"optgroup"}), step)
            if name == "optgroup":
                self.end_from(self.nearest({"optgroup"}, SPECIAL), step)
        elif name in TABLE_CONTEXT:
            around = self.nearest(TABLE_CONTEXT[name], set())
            if around < 0:
                return -1
            self.end_from(around + 1, step)
        elif name in ("a", "button"):
            k = self.nearest({name}, SCOPE)
            if k >= 0:
                self.end(k, len(self.stack) if name == "button" else k + 1, step)
        elif self.stack and (name in HEADINGS and self.stack[-1][0] in HEADINGS or name in ("rt", "rp") and self.stack[-1][0] in ("rt", "rp")):
            self.end_from(len(self.stack) - 1, step)
        if name in ENDS_P:
            self.end_from(self.nearest({"p"}, SCOPE | {"button"}), step)
        if empty:
            return -1
        self.stack.append((name, len(self.ended)))
        self.count[name] += 1
        self.ended.append(-1)
        self.own.append(False)
        return len(self.ended) - 1

    def end_tag(self, name: str, step: int) -> None:
        barrier = {"html", "table"} if name in TABLE_CONTEXT or name == "table" else SCOPE | {"ol", "ul"} if name == "li" else SCOPE | {"button"} if name == "p" else SCOPE
        k = self.nearest(HEADINGS if name in HEADINGS else {name}, barrier)
        if k < 0:
            return
        self.own[self.stack[k][1]] = True
        over_blocks = name in INLINE and any(n in SPECIAL for n, _ in self.stack[k + 1 :])
        self.end(k, k + 1 if over_blocks else len(self.stack), step)


def _steps(page: str) -> tuple[list[tuple[str, str, bool, str, int]], _Open]:
    """The page as steps of text and the tag behind it: text, name, whether an end tag, attributes, number of the element. And how elements end."""
    steps: list[tuple[str, str, bool, str, int]] = []
    tree, at = _Open(), 0
    while True:
        tag = TAG.search(page, at)
        text = page[at : tag.start() if tag else len(page)]
        if text and tree.stack and tree.stack[-1][0] == "head" and not text.isspace():
            tree.end_head(len(steps))
            steps.append(("", "", False, "", -1))
        if not tag:
            steps.append((text, "", False, "", -1))
            return steps, tree
        at, name, attributes = tag.end(), (tag[2] or "").lower(), tag[3] or ""
        if tag[1]:
            tree.end_tag(name, len(steps))
            steps.append((text, name, True, "", -1))
        elif name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            steps.append((text, "", False, "", -1))
        elif name:
            empty = name in VOID or attributes.endswith("/")
            steps.append((text, name, False, attributes, tree.start_tag(name, len(steps), empty)))
        else:
            steps.append((text, "", False, "", -1))


#: How markup marks a block: outside the article there is, on a page without one, inside it.
OUTSIDE, UNDECIDED, HELD = -1, 0, 1


def marked_blocks(page: str) -> tuple[list[str], list[int], bool]:
    """The blocks of the page, their marks, and whether markup decides on them (an article or main element was there)."""
    steps, tree = _steps(page)
    mains = [i for i, (_, name, ends, *_) in enumerate(steps) if name in ("article", "main") and not ends]
    found: list[str] = []
    inside: dict[str, list[bool]] = {"article": [], "main": []}
    open_now = {"article": 0, "main": 0}
    parts: list[str] = []
    skip = -1

    def close() -> None:
        text = SPACE.sub(" ", html_module.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            found.append(text)
            for kind, marks in inside.items():
                marks.append(open_now[kind] > 0)

    def holds_main(element: int, step: int) -> bool:
        """Whether an article or main element starts in an element that has no end tag of its own."""
        k = bisect_right(mains, step)
        return not tree.own[element] and k < len(mains) and (tree.ended[element] < 0 or mains[k] < tree.ended[element])

    seen = {"article": False, "main": False}
    for i, (text, name, ends, attributes, element) in enumerate(steps):
        if skip < 0:
            parts.append(text)
        elif tree.ended[skip] == i:
            own, skip = tree.own[skip], -1
            if own:
                continue
        else:
            continue
        if not name:
            continue
        if name not in INLINE:
            close()
        elif name == "br":
            parts.append(" ")
        if ends:
            if open_now.get(name):
                open_now[name] -= 1
        elif element >= 0 and _skipped(name, attributes, bool(open_now["article"] or open_now["main"])) and not holds_main(element, i):
            skip = element
        elif name in open_now:
            open_now[name] += 1
            seen[name] = True
    close()
    for kind, marks in inside.items():
        if seen[kind]:
            return found, [HELD if m else OUTSIDE for m in marks], True
    return found, [UNDECIDED] * len(found), False


def page_blocks(page: str) -> tuple[list[str], bool]:
    """The blocks of text, and whether markup decided on them (an article or main element was there)."""
    blocks, marks, decided = marked_blocks(page)
    return [b for b, m in zip(blocks, marks, strict=True) if m != OUTSIDE], decided


def shared_runs(streams: list[np.ndarray], long: int = LONG, pages: np.ndarray | None = None, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the joined streams, each ended by a code of its own: per token the rank of the `long` tokens from it on, and per rank on how many pages it stands.

    Suffixes of the joined streams are sorted by doubling: ranks of 1, 2, 4, ... tokens, until they
    tell `long` tokens apart. Equal ranks are then neighbours in the suffix array with a common
    prefix of at least `long` tokens. As each stream ends in a code of its own, no run crosses
    streams. pages: the number of each stream's page, where several streams may be of one. counted:
    per stream, whether pages are counted by it; by default by all.
    """
    sizes = np.asarray([s.size for s in streams])
    pages = np.arange(len(streams)) if pages is None else pages
    top = max(int(s.max()) for s in streams if s.size) + 1
    joined = np.concatenate([np.append(s, top + i) for i, s in enumerate(streams)])
    page = np.repeat(pages, sizes + 1)
    rank, width = np.unique(joined, return_inverse=True)[1].astype(np.int64), 1
    while width < long:
        step = min(width, long - width)
        after = np.full(rank.size, -1, np.int64)
        after[: rank.size - step] = rank[step:]
        rank = np.unique(rank * (rank.size + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    pairs = rank * len(streams) + page
    pairs = np.unique(pairs if counted is None else pairs[np.repeat(counted, sizes + 1)])
    return rank, np.bincount(pairs // len(streams), minlength=int(rank.max()) + 1)


def covered(streams: list[np.ndarray], starts: np.ndarray, long: int = LONG) -> list[np.ndarray]:
    """Per stream, which tokens lie in a run that starts at one of the positions of the joined streams."""
    sizes = np.asarray([s.size for s in streams])
    n, ends = int(sizes.sum()) + len(streams), np.cumsum(sizes + 1)
    change = np.zeros(n + long + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + long, -1)
    inside = np.cumsum(change)[:n] > 0
    return [inside[e - n - 1 : e - 1] for e, n in zip(ends, sizes, strict=True)]


def repeated(streams: list[np.ndarray], least: int, long: int = LONG, pages: np.ndarray | None = None, counted: np.ndarray | None = None) -> list[np.ndarray]:
    """Per stream of token codes, which tokens lie in a run of `long` tokens that at least `least` pages hold."""
    if not sum(s.size for s in streams):
        return [np.zeros(0, bool) for _ in streams]
    rank, pages_with = shared_runs(streams, long, pages, counted)
    return covered(streams, np.flatnonzero(pages_with[rank] >= least), long)


def run_hashes(streams: list[np.ndarray], words: list[str], long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Where whole runs of `long` tokens start in the joined streams, and a 64-bit hash of each, the same in every part. words: by token code."""
    sizes = np.asarray([s.size for s in streams])
    token = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words), np.uint64)
    joined = np.concatenate([np.append(token[s], np.uint64(0)) for s in streams])
    left = np.concatenate([np.arange(n, -1, -1) for n in sizes])
    starts = np.flatnonzero(left >= long)
    hashes = np.zeros(starts.size, np.uint64)
    for i in range(long):
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + joined[starts + i]
    return starts, (hashes ^ (hashes >> np.uint64(32))).view(np.int64)


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks, marks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [marked_blocks(p or "") for p in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "blocks": [b for b, _, _ in got], "marks": [m for _, m, _ in got]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, blocks array<string>, marks array<tinyint>").withColumn("host", _host())


class _Streams:
    """The token streams of a group's rows: of each row first what is outside of articles or undecided, which is counted, then what articles hold."""

    def __init__(self, group: pd.DataFrame) -> None:
        codes: dict[str, int] = {}
        self.group, self.streams = group, []
        for blocks, marks in zip(group["blocks"], group["marks"], strict=True):
            for held in (False, True):
                self.streams.append(np.asarray([codes.setdefault(w, len(codes)) for b, m in zip(blocks, marks, strict=True) if (m == HELD) == held for w in b.split()], np.int64))
        self.words = list(codes)
        self.pages = np.repeat(np.unique(group["page"].to_numpy(np.int64), return_inverse=True)[1], 2)
        self.counted = np.tile([True, False], len(group))

    def checked(self, gone: list[np.ndarray]) -> pd.DataFrame:
        """The array's verdict by markup: candidates to go that articles hold stay, and are counted; what is outside of articles goes."""
        kept, returned = [], []
        for i, (blocks, marks) in enumerate(zip(self.group["blocks"], self.group["marks"], strict=True)):
            at, out, n = [0, 0], [], 0
            for block, mark in zip(blocks, marks, strict=True):
                held, size = int(mark == HELD), len(block.split())
                candidate = int(gone[2 * i + held][at[held] : at[held] + size].sum()) >= COVERED * size
                at[held] += size
                n += held and candidate
                if held or mark == UNDECIDED and not candidate:
                    out.append(block)
            kept.append(out)
            returned.append(n)
        return pd.DataFrame({"page_id": self.group["page_id"], "url": self.group["url"], "blocks": kept, "n_repeated": returned})


def dealt_pages(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """Parsed pages with page, and the part of their host they are in. Hosts of several parts are few: at most one in group_pages pages."""
    large = pages.groupBy(_host().alias("host")).agg(F.ceil(F.count("*") / group_pages).cast("int").alias("parts")).filter("parts > 1")
    page = F.when(F.col("page_id").isNull() & F.col("url").isNull(), F.xxhash64("blocks")).otherwise(F.xxhash64("page_id", "url"))
    dealt = parsed_pages(pages).join(materialize(large, "hosts"), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("page", page)
    return dealt.withColumn("part", F.pmod("page", F.col("parts")).cast("int"))


def judged_pages(dealt: DataFrame, long: int = LONG) -> DataFrame:
    """page_id, url, blocks of the main text, n_repeated: how many of them the array called repeated and markup gave back.

    A host of one part is judged there. Of a larger one each part counts the distinct pages of its
    runs, the counts are added over the parts, and the runs that reach the bar go back to all parts of
    the host that count or hold them. All rows of a page are in one part, so added counts are of distinct pages.
    """
    def count(group: pd.DataFrame) -> pd.DataFrame:
        none = group[["host", "part"]].head(0).assign(run=0, pages=0)
        if group["parts"].iloc[0] == 1:
            return none
        told = _Streams(group)
        if not told.words:
            return none
        starts, hashes = run_hashes(told.streams, told.words, long)
        rank, pages_with = shared_runs(told.streams, long, told.pages, told.counted)
        first = np.unique(rank[starts], return_index=True)[1]
        first = first[pages_with[rank[starts[first]]] > 0]
        return pd.DataFrame({"host": group["host"].iloc[0], "part": group["part"].iloc[0], "run": hashes[first], "pages": pages_with[rank[starts[first]]]})

    def judge(group: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return group[["page_id", "url", "blocks"]].assign(n_repeated=0)
        told = _Streams(group)
        if group["parts"].iloc[0] == 1:
            return told.checked(repeated(told.streams, MIN_PAGES, long, told.pages, told.counted))
        if not told.words or common.empty:
            return told.checked([np.zeros(s.size, bool) for s in told.streams])
        starts, hashes = run_hashes(told.streams, told.words, long)
        return told.checked(covered(told.streams, starts[np.isin(hashes, common["run"].to_numpy(np.int64))], long))

    parts = dealt.groupBy("host", "part")
    runs = parts.applyInPandas(count, "host string, part int, run long, pages long")
    common = runs.withColumn("pages", F.sum("pages").over(Window.partitionBy("host", "run"))).filter(F.col("pages") >= MIN_PAGES).select("host", "part", "run")
    return parts.cogroup(common.groupBy("host", "part")).applyInPandas(judge, "page_id long, url string, blocks array<string>, n_repeated long")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the blocks in page order, two line ends between them, and n_repeated."""
    return judged_pages(dealt_pages(pages)).select("page_id", "url", F.array_join("blocks", "\n\n").alias("text"), "n_repeated")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
