"""HTML extraction by consensus host paths.

Each page's containers are scored by the running text they hold, and the best one votes for its generalised tag-class path.
Votes are summed per host in Spark, and pages are extracted by their host's winning paths, so a page whose own best guess is
odd (a short article under many comments) follows its siblings. Siblings also show what isn't article: a container whose
text is the same on most pages of its host is left out. Words in class names are a weak hint only (see ``hint``).

Pages are scanned once from left to right, in time and memory linear in their length, whatever is left unclosed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bound_batches, look_up, stored

# Fixed values of HTML: elements without content, whose content is no markup, without text to show, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noscript title textarea xmp".split())
UNSHOWN = frozenset("template svg math object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr picture source".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address hr br".split())
LISTS = frozenset("ul ol dl table".split())
#: Elements that aren't part of an article.
ASIDE = frozenset("nav aside footer form menu dialog button select fieldset".split())
#: Words that hint at the same in a class, id or role, and words that say nothing beside them.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot slot sponsor sponsored promo promotion banner outbrain taboola "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pager pagination sitemap "
    "header masthead topbar footer colophon bottombar copyright "
    "sidebar aside complementary widget widgets rail related recommended recommendations "
    "notice notices cookie cookies consent gdpr alert disclaimer popup modal overlay toast paywall "
    "form search searchbox login signup signin newsletter subscribe subscription "
    "comment comments commentlist disqus respond reply replies discussion share sharing social "
    "werbung anzeige anzeigen kommentar kommentare fusszeile kopfzeile seitenleiste hinweis "
    "publicite pub commentaire commentaires pied publicidad anuncio anuncios comentario comentarios".split()
)
ARTICLE_WORDS = frozenset("article content entry post story".split())
GENERIC_WORDS = ARTICLE_WORDS | frozenset("site page main global box block container wrapper wrap inner outer list item items area section module panel top bottom left right bar links the".split())
#: Words that say what a layout has ("with-sidebar"), not what an element is.
LAYOUT_WORDS = frozenset("has with no without layout".split())
CLOSES_P = PLAIN - {"br", "hr"} | frozenset("div section article main header footer nav aside form fieldset details".split())
#: Share of a page's running text that its container must hold. Of links in a container that confirms a hint.
SHARE, LINKED = 0.75, 0.3
#: Pages of a host that must have a container before its repeated text counts.
REPEATED = 3
#: Paths of hosts that are sent to every executor at most (8 bytes each); beyond that they are joined, hot hosts apart.
BROADCAST_PATHS = 500_000

NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
WORDS = re.compile(r"[^\W\d_]+")
CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW} | {"head": re.compile(r"</head(?=[\s/>])|<body(?=[\s/>])", re.I)}


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in ATTRIBUTE.findall(text):
        out.setdefault(k.lower(), v[1:-1] if v[:1] in "\"'" and v else v)
    return out


def hint(values: list[str]) -> int:
    """What class, id and role say: 2 where most of their names hold only words for what isn't article, 1 where some word is one, 0 else."""
    named = strong = weak = 0
    seen: set[str] = set()
    for name in " ".join(values).split():
        words = {w.lower() for w in WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name))}
        seen |= words
        own = words - GENERIC_WORDS
        found = own & ASIDE_WORDS
        if found == {"header"} and words & ARTICLE_WORDS:  # "post-header" names a part of an article
            found = set()
        named += bool(own)
        weak += bool(found)
        strong += bool(found) and found == own
    if not weak or seen & LAYOUT_WORDS:
        return 0
    return 2 if strong * 2 > named else 1


class Page:
    """Elements (outer before inner) and blocks of text of a page; broken and unclosed markup is taken as it comes.

    Of element i: tag, path (hash of its parent's path, its tag and its classes without digits), parent, and the blocks
    [begin, end) in it. aside: whether it, or what it is in, isn't article.
    """

    def __init__(self, html: str):
        self.tag, self.path, self.parent, self.hard, self.hint = [""], [0], [-1], [False], [0]
        self.begin, self.end = [0], [0]
        self.texts: list[str] = []
        self.owner: list[int] = []
        self.linked: list[int] = []
        self._scan(html)
        n = len(self.texts)
        self.end = [n if e is None else e for e in self.end]
        self.end[0] = n
        sums = lambda x: np.concatenate(([0], np.cumsum(np.array(x, np.int64)))) if n else np.zeros(1, np.int64)
        self.chars, self.links = sums([len(t) for t in self.texts]), sums(self.linked)
        with np.errstate(over="ignore"):
            self.digests = np.cumsum(np.array([0, *map(xxhash.xxh64_intdigest, self.texts)], np.uint64), dtype=np.uint64)
        self.aside = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            self.aside[i] = self.aside[self.parent[i]] or self._own_aside(i)
        good = [0 if self.aside[o] else max(0, len(t) - k) for t, o, k in zip(self.texts, self.owner, self.linked)]
        self.running = sums(good)

    def _own_aside(self, i: int) -> bool:
        a, z = self.begin[i], self.end[i]
        chars = self.chars[z] - self.chars[a]
        if self.hard[i]:
            # a form around most of the page is no form of it
            return not (self.tag[i] == "form" and chars * 2 > self.chars[-1])
        return self.hint[i] == 2 or self.hint[i] == 1 and self.links[z] - self.links[a] >= LINKED * max(1, chars)

    def good(self, i: int) -> int:
        return int(self.running[self.end[i]] - self.running[self.begin[i]])

    def _scan(self, html: str) -> None:
        stack, opened = [0], Counter()
        line: list[str] = []
        at, n = 0, len(html)
        linked, link, unseen, depth = 0, 0, "", 0  # link: depth of the stack in which a link is open; unseen: a hidden inline element
        unpaired = {'"': n + 1, "'": n + 1}  # from here on there is none

        def close_line() -> None:
            nonlocal linked, unseen
            text = " ".join("".join(line).split())
            line.clear()
            if text:
                self.texts.append(text)
                self.owner.append(stack[-1])
                self.linked.append(min(linked, len(text)))
            linked, unseen = 0, ""

        def pop() -> int:
            i = stack.pop()
            opened[self.tag[i]] -= 1
            self.end[i] = len(self.texts)
            return i

        def tag_end(i: int) -> int:
            """Where the tag that goes on at i ends (its > included). A quote that has no second one is an ordinary character."""
            while m := STOP.search(html, i):
                if m[0] == ">":
                    return m.end()
                i = m.end()
                if html[max(0, i - 200) : i - 1].rstrip().endswith("=") and i < unpaired[m[0]]:
                    j = html.find(m[0], i)
                    if j < 0:
                        unpaired[m[0]] = i
                    else:
                        i = j + 1
            return n

        while at < n:
            lt = html.find("<", at)
            text = html[at : lt if lt >= 0 else n]
            if text and not unseen:
                text = unescape(text) if "&" in text else text
                line.append(text)
                if link:
                    linked += len(" ".join(text.split()))
            if lt < 0:
                break
            c = html[lt + 1 : lt + 2]
            if c == "!" or c == "?":
                if html.startswith("<!--", lt):
                    stop = html.find("-->", lt + 4)
                    at = stop + 3 if stop >= 0 else n
                else:
                    stop = html.find(">", lt)
                    at = stop + 1 if stop >= 0 else n
                continue
            closing = c == "/"
            m = NAME.match(html, lt + 1 + closing)
            if not m:
                if not unseen:
                    line.append("<")
                at = lt + 1
                continue
            tag = m[0].lower()
            at = tag_end(m.end())
            rest = html[m.end() : at - 1]
            if closing:
                if tag == "a":
                    link = 0
                if tag in INLINE:
                    if tag == unseen:
                        depth -= 1
                        unseen = unseen if depth else ""
                    continue
                if tag in VOID and tag != "br":
                    continue
                close_line()
                if opened[tag]:
                    while self.tag[pop()] != tag:
                        pass
                    link = link if link <= len(stack) else 0
                continue
            if tag in RAW or tag == "head":
                stop = CLOSE[tag].search(html, at)
                if tag != "head":
                    at = tag_end(stop.end()) if stop else n
                elif stop:
                    at = stop.start()
                if tag in ("head", "title", "textarea"):
                    close_line()
                continue
            said = attributes(rest) if rest.strip("/ ") else {}
            hidden = "hidden" in said or bool(UNSEEN.search(said.get("style", "")))
            if tag in INLINE:
                if tag == "a":
                    link = len(stack)
                if tag not in VOID:
                    if unseen:
                        depth += tag == unseen
                    elif hidden:
                        unseen, depth = tag, 1
                continue
            if tag in UNSHOWN and rest.endswith("/"):
                continue
            close_line()
            if tag in VOID:
                continue
            if tag in CLOSES_P and opened["p"]:
                # an open paragraph ends where a block begins, unless a container was opened in it
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == "p":
                        while len(stack) > k:
                            pop()
                        break
                    if self.tag[stack[k]] not in PLAIN:
                        break
            if tag == "li" and self.tag[stack[-1]] == "li":
                pop()
            above = stack[-1]
            classes = ".".join(sorted(set(re.sub(r"\d+", "", said.get("class", "")).lower().split())))
            i = len(self.tag)
            self.tag.append(tag)
            self.path.append(xxhash.xxh64_intdigest(f"{self.path[above]:x}/{tag}.{classes}") >> 1)
            self.parent.append(above)
            self.hard.append(tag in ASIDE or tag in UNSHOWN or hidden or (tag == "header" and not opened["article"] and not opened["main"]))
            judged = (tag not in PLAIN or tag in LISTS) and tag not in ("html", "body", "article", "main")
            self.hint.append(hint([said[k] for k in ("class", "id", "role") if k in said]) if judged and said else 0)
            self.begin.append(len(self.texts))
            self.end.append(None)
            stack.append(i)
            opened[tag] += 1
        close_line()

    def containers(self) -> Iterator[int]:
        return (i for i in range(1, len(self.tag)) if self.tag[i] not in PLAIN)

    def best(self) -> int:
        """The element that holds the article.

        The innermost <article>, else <main>, with half of the page's running text; else the innermost container with SHARE of it,
        or the one around it while that begins with more running text or a headline.
        """
        total = self.good(0)
        pool = [i for i in self.containers() if not self.aside[i] and self.good(i) * 2 >= total and self.good(i)]
        for tag in ("article", "main"):
            if found := [i for i in pool if self.tag[i] == tag]:
                return found[-1]
        pool = [i for i in pool if self.good(i) >= SHARE * total]
        if not pool:
            return 0
        i = pool[-1]
        while (up := self.parent[i]) > 0 and self.tag[up] not in ("body", "html") and self.running[self.begin[i]] > self.running[self.begin[up]]:
            i = up
        return i

    def text(self, roots: list[int], repeated: frozenset[int]) -> str:
        """Blocks of elements that don't hold one another, in page order, without what isn't article."""
        out = []
        for r in roots:
            out_here = {r: False}
            for k in range(self.begin[r], self.end[r]):
                i = self.owner[k]
                chain = []
                while i not in out_here:
                    chain.append(i)
                    i = self.parent[i]
                left = out_here[i]
                for i in reversed(chain):
                    left = out_here[i] = left or self.aside[i] or (self.path[i] in repeated and self.tag[i] not in PLAIN)
                if not left and not self.aside[self.owner[k]]:
                    out.append(self.texts[k])
        return "\n".join(out)


def extract_page(html: str | None, paths: list[tuple[int, int]], repeated: list[int]) -> str:
    """Text of a page, given its host's voted paths (path, votes; best first) and the paths of repeated text.

    The page follows the first voted path that holds running text, all elements of it. It keeps to its own best container where that
    path has votes of other pages too (a second template), or where the voted path is no majority and holds less than half as much.
    """
    if not html:
        return ""
    page = Page(html)
    own = page.best()
    votes = dict(paths)
    total = sum(votes.values())
    if votes:
        held: dict[int, list[int]] = {}
        for i in page.containers():
            if page.path[i] in votes and not page.aside[i] and page.good(i):
                held.setdefault(page.path[i], []).append(i)
        first = next((p for p, _ in paths if p in held), None)
        if first is not None and not votes.get(page.path[own], 0) >= max(2, votes[first] / 4):
            if votes[first] * 2 > total or 2 * sum(map(page.good, held[first])) >= page.good(own):
                return page.text(held[first], frozenset(repeated))
        if page.path[own] in held:
            return page.text(held[page.path[own]], frozenset(repeated))
    return page.text([own], frozenset(repeated))


def host_of(url):
    """Column: lower-case host of a url; without one, the empty string."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def shapes(html: str | None) -> list[tuple[int, int, int, int, int]]:
    """(page, path, digest, vote, running text) of each container path of a page that holds text: digests are of its texts and of the whole page."""
    page = Page(html or "")
    best = page.best()
    rows: dict[int, list[int]] = {}
    for i in page.containers():
        a, z = page.begin[i], page.end[i]
        if page.chars[z] > page.chars[a]:
            row = rows.setdefault(page.path[i], [0, 0, 0])
            row[0] = (row[0] + int(page.digests[z]) - int(page.digests[a])) % (1 << 64)
            row[1] |= i == best and page.good(i) > 0
            row[2] += page.good(i)
    whole = int(page.digests[-1]) >> 1
    return [(whole, p, d >> 1, int(v), g) for p, (d, v, g) in rows.items()]


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, pages, kinds, votes, chars): of the different pages of a host that have the path, how many texts it holds, and votes for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, rows = [], []
            for host, html in zip(b["host"].to_pylist(), b["html"]):
                new = shapes(html.as_py())
                hosts += [host] * len(new)
                rows += new
                if len(rows) > 20_000:
                    yield batch(hosts, rows)
                    hosts, rows = [], []
            yield batch(hosts, rows)

    def batch(hosts: list[str], rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 5
        return pa.record_batch([pa.array(hosts, pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=["host", "page", "path", "digest", "vote", "chars"])

    bound_batches(pages.sparkSession, 200)
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, page long, path long, digest long, vote long, chars long")
    # copies of a page count once
    once = rows.groupBy("host", "path", "page", "digest").agg(F.max("vote").alias("vote"), F.max("chars").alias("chars"))
    kinds = once.groupBy("host", "path", "digest").agg(F.count("*").alias("pages"), F.sum("vote").alias("votes"), F.sum("chars").alias("chars"))
    return kinds.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.count("*").alias("kinds"), F.sum("votes").alias("votes"), F.sum("chars").alias("chars"))


def winners(counted: DataFrame) -> DataFrame:
    """(host, paths, repeated, pages): each host's voted paths, most votes first (then most running text, then by path); paths whose text repeats.

    A single vote is the page's own, which it doesn't need; so paths are listed from two votes on. pages: the host's largest count.
    """
    voted = F.when(F.col("votes") >= 2, F.struct((-F.col("votes")).alias("v"), (-F.col("chars")).alias("c"), "path"))
    again = F.when((F.col("pages") >= REPEATED) & (F.col("kinds") * 2 <= F.col("pages")) & (F.col("votes") == 0), F.col("path"))
    found = counted.groupBy("host").agg(F.collect_list(voted).alias("v"), F.sort_array(F.collect_list(again)).alias("repeated"), F.max("pages").alias("pages"))
    return found.select("host", F.transform(F.sort_array("v"), lambda x: F.struct(x["path"].alias("path"), (-x["v"]).alias("votes"))).alias("paths"), "repeated", "pages")


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url and text, the article's blocks joined by line feeds.

    Null and empty html give an empty text; a page without a host (those make one host, of no name), or of a host without
    votes, is extracted by its own best container. Repeated rows agree; an empty table gives an empty result; other columns are ignored.
    What is kept of a host grows with its templates, not with its pages.
    """
    paths = stored(winners(votes(pages)), "host-paths")
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    size = paths.agg(F.sum(F.size("paths") + F.size("repeated") + 1), F.sum("pages")).first()
    if (size[0] or 0) <= BROADCAST_PATHS:
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:
        joined = look_up(rows, paths, ["host"], "pages", size[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = zip(b["paths"].to_pylist(), b["repeated"].to_pylist())
            texts = [extract_page(h.as_py(), [(x["path"], x["votes"]) for x in p or []], r or []) for h, (p, r) in zip(b["html"], known)]
            yield pa.record_batch([b["page_id"], b["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    schema = T.StructType([pages.schema["page_id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    return joined.select("page_id", "url", "html", "paths", "repeated").mapInArrow(run, schema)
