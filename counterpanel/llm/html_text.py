"""Main text of web pages by consensus over the container paths of each host.

A page's containers are scored by the text they hold outside links, a container
inheriting part of its children's score. The best container is widened to the
ancestors that add text outside links, and votes with its generalised tag-class
path; votes are summed per host in Spark, and every page is extracted again from
the containers whose path won on its host, widened in the same way. A page that
has none of its host's winning paths keeps its own best container.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpanel.llm.memory import handing_back

# fixed values: element names of the HTML standard
CONTAINERS = frozenset(
    "html body main article section div aside nav header footer form table tbody thead tfoot tr td th "
    "ul ol dl li dd dt figure blockquote details fieldset dialog".split()
)
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 hr pre address figcaption caption summary legend hgroup".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
SKIPPED = frozenset("head nav header footer aside dialog menu".split())
INLINE = frozenset("button select datalist svg math object audio video canvas".split())  # left out without ending a block
# fixed values: class and id words of page furniture
FURNITURE = frozenset(
    "ad ads advert adverts advertisement banner cookie cookies consent notice notices sidebar sidenav menu nav navbar "
    "navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies disqus share sharing social "
    "related promo sponsor sponsored popup modal newsletter subscribe signup login search pagination pager widget toolbar".split()
)
STRICT = frozenset("footer comment comments reply replies disqus".split())  # never the main text, however large
GENERIC = frozenset(  # words that say nothing about what a container holds
    "area bar block bottom box container content form group holder inner item items left links list main outer panel "
    "post posts right row section site slot top unit wrap wrapper".split()
)
MODIFIERS = frozenset("has with no without is show hide".split())  # begin words about the page, not the container
UNSEEN = frozenset("hidden submit button image reset".split())  # input types that are no fields
FIELD_TEXT = 200  # characters a field that make a form a wrapper of text
KEEP_SHARE = 0.1  # of a host's votes that a path needs to be one of its winners
INHERIT = 0.8
LARGE = 0.8  # of a page's text that a container needs to be no furniture whatever its name, STRICT ones aside
FORM_SHARE = 0.5  # of a page's text that a form needs to be its wrapper
ROOTS = frozenset(("", "html", "body"))
SALTS = 64
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*+>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TYPE = re.compile(r"(?:^|\s)type\s*=\s*[\"']?([a-z]+)", re.I)
_WORDS = re.compile(r"[a-z]+")


def furniture(tokens: list[str], inside: bool) -> int:
    """What class, id and role say: 0 nothing, 1 furniture, 2 STRICT furniture,
    3 if a name is nothing else. ``inside`` main or article a name counts only if
    all its words are furniture or generic."""
    level = 0
    for token in tokens:
        words = _WORDS.findall(token)
        if not words or words[0] in MODIFIERS or FURNITURE.isdisjoint(words):
            continue
        core = [w for w in words if w not in GENERIC]
        if inside and not FURNITURE.issuperset(core):
            continue
        level = max(level, 3 if STRICT.issuperset(core) else 2 if core[-1] in STRICT else 1)
    return level


class Page:
    """Containers (parent, path, hidden, own score) and text blocks of a page."""

    def __init__(self, source: str) -> None:
        self.parents, self.paths, self.hidden, self.own = [-1], [""], [False], [0.0]
        self.names, self.named, self.plain, self.size = [""], [0], [0], [0]  # furniture by name; text outside links; text
        self.inside, self.fields = [False], [0]  # in main or article; form fields
        self.blocks: list[tuple[int, str]] = []  # container, text
        self._parse(source)
        self._hide_furniture()

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # open containers and skipped elements
        text: list[str] = []
        linked = 0
        in_link = False
        muted: list[str] = []  # open elements from an INLINE one on
        at, lower = 0, None

        def flush() -> None:
            nonlocal linked
            if text:
                words = " ".join("".join(text).split())
                where = stack[-1][1]
                if words and not self.hidden[where]:
                    self.blocks.append((where, words))
                    self.own[where] += len(words) - 2 * min(linked, len(words))
                    self.plain[where] += max(0, len(words) - 2 * linked)
                    self.size[where] += len(words)
                text.clear()
            linked = 0

        while at < len(source):
            lt = source.find("<", at)
            chunk = source[at : lt if lt >= 0 else len(source)]
            if chunk and not muted:
                chunk = entities.unescape(chunk)
                text.append(chunk)
                linked += len(chunk.strip()) if in_link else 0
            if lt < 0:
                break
            m = _TAG.match(source, lt) or _LOOSE.match(source, lt)
            if m is None:
                if not muted:
                    text.append("<")
                at = lt + 1
                continue
            at = m.end()
            if m.lastindex is None:
                continue
            closing, name, attrs = m[1], m[2].lower(), m[3]
            if not closing and name in ("select", "textarea", "input"):
                kind = _TYPE.search(attrs) if name == "input" else None
                self.fields[stack[-1][1]] += kind is None or kind[1].lower() not in UNSEEN
            if muted and name not in RAW:
                if not closing:
                    if (name in INLINE or name in CONTAINERS) and not attrs.endswith("/"):
                        muted.append(name)
                    continue
                if name in muted:
                    del muted[len(muted) - 1 - muted[::-1].index(name) :]
                    continue
                if all(name != opened for opened, _ in stack):
                    continue
                muted.clear()  # the end of what the element stands in ends it as well
            if name in INLINE:
                if not closing and not attrs.endswith("/"):
                    muted.append(name)
            elif name == "a":
                in_link = not closing
            elif name == "br":
                text.append(" ")
            elif name in RAW:
                if not closing:
                    if lower is None:
                        lower = source.lower() if len(source.lower()) == len(source) else source
                    end = lower.find("</" + name, at)
                    at = len(source) if end < 0 else end
            elif name in BREAKS or name in SKIPPED:
                flush()
                in_link = False
                if name not in CONTAINERS and name not in SKIPPED:
                    continue
                if closing:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                            break
                elif not attrs.endswith("/"):
                    if name in ("li", "tr", "td", "th", "dd", "dt") and stack[-1][0] == name:
                        stack.pop()  # an end tag that may be left out
                    stack.append((name, self._open(stack[-1][1], name, attrs)))
        flush()

    def _open(self, parent: int, name: str, attrs: str) -> int:
        found = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attrs)} if attrs else {}
        tokens = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower().split()
        classes = sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").lower().split()})
        hidden = self.hidden[parent] or name in SKIPPED
        hidden = hidden or bool(attrs and re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", attrs, re.I))
        self.parents.append(parent)
        self.paths.append(f"{self.paths[parent]}/{'.'.join([name, *classes])}")
        self.hidden.append(hidden)
        self.own.append(0.0)
        self.names.append(name)
        level = 0 if name in ROOTS or name == "main" else furniture(tokens, self.inside[parent])
        self.named.append(level if name != "article" or level == 3 else 0)
        self.inside.append(self.inside[parent] or name in ("main", "article"))
        self.fields.append(0)
        self.plain.append(0)
        self.size.append(0)
        return len(self.parents) - 1

    def _hide_furniture(self) -> None:
        """Hide containers with furniture names, unless they hold the main element or
        nearly all text and the name is not STRICT; hide forms that do not wrap the
        page's text; sum ``plain`` over what is in the rest."""
        main = [name == "main" and not h for name, h in zip(self.names, self.hidden, strict=True)]
        article = [name == "article" and not h for name, h in zip(self.names, self.hidden, strict=True)]
        for i in range(len(self.parents) - 1, 0, -1):
            up = self.parents[i]
            self.size[up] += self.size[i]
            self.fields[up] += self.fields[i]
            main[up] |= main[i]
            article[up] |= article[i] and self.named[i] < 2
        for i in range(1, len(self.parents)):
            named = self.named[i] and (self.named[i] > 1 or self.size[i] < LARGE * self.size[0]) and not main[i]
            if self.names[i] == "form" and not main[i] and not article[i]:
                named = named or self.size[i] < max(FORM_SHARE * self.size[0], FIELD_TEXT * self.fields[i])
            self.hidden[i] = self.hidden[i] or self.hidden[self.parents[i]] or bool(named)
            if self.hidden[i]:
                self.own[i], self.plain[i] = 0.0, 0
        self.blocks = [(where, words) for where, words in self.blocks if not self.hidden[where]]
        self.direct = list(self.plain)
        for i in range(len(self.parents) - 1, 0, -1):
            self.plain[self.parents[i]] += self.plain[i]

    def _widened(self, i: int) -> int:
        """The highest ancestor that adds text outside links; html and body count
        with the text that is directly in them."""
        top, at = i, self.parents[i]
        while at >= 0:
            if self.direct[at] > 0 if self.names[at] in ROOTS else self.plain[at] > self.plain[top]:
                top = at
            at = self.parents[at]
        return top

    def best(self) -> str | None:
        """Path of the best container, widened; the deeper, then the earlier of equals."""
        score = list(self.own)
        for i in range(len(score) - 1, 0, -1):
            score[self.parents[i]] += INHERIT * score[i]
        open_ = [i for i in range(len(score)) if not self.hidden[i] and score[i] > 0]
        return self.paths[self._widened(max(open_, key=lambda i: (score[i], self.paths[i].count("/"), -i)))] if open_ else None

    def text(self, path: str) -> str:
        """Blocks inside the containers with this path, widened, in page order."""
        roots = {self._widened(i) for i, p in enumerate(self.paths) if p == path and not self.hidden[i]}
        inside = [i in roots for i in range(len(self.paths))]
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parents[i]]
        return "\n".join(words for where, words in self.blocks if inside[where])


def main_text(source: str | None, winners: list[str]) -> str:
    """Text under the first winning path that the page has, else under its best."""
    page = Page(source or "")
    present = {page.paths[where] for where, _ in page.blocks}
    for path in winners:
        if any(p == path or p.startswith(path + "/") for p in present):
            return page.text(path)
    own = page.best()
    return page.text(own) if own is not None else ""


def host_of(url: str = "url"):
    """Lower-case host of a URL column; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def host_paths(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, paths): each host's winning paths, most votes first.

    One vote per page, summed before the shuffle; at most 1 / KEEP_SHARE paths
    of a host are kept, the rest fall to the pages' own best containers.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [(h.as_py(), Page(s.as_py()).best()) for h, s in zip(batch.column(0), batch.column(1), strict=True)]
            votes = [v for v in votes if v[1] is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.string())], names=["host", "path"]
            )

    given = pages.select(host_of(url).alias("host"), F.col(f"`{html}`").alias("source")).filter("host IS NOT NULL AND source IS NOT NULL")
    votes = given.mapInArrow(handing_back(vote), "host string, path string").groupBy("host", "path").agg(F.count("*").alias("votes"))
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    kept = votes.join(total, "host").filter(F.col("votes") >= KEEP_SHARE * F.col("total"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return kept.groupBy("host").agg(ordered.alias("o")).select("host", F.col("o.path").alias("paths"))


def extract(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a line feed in page order. Null or empty html,
    and pages without text, give an empty text. Pages without a host use their
    own best container. Repeated rows stay; other columns are not read.
    """
    given = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("source"))
    winners = host_paths(given, url="url", html="source").withColumnRenamed("host", "of_host")
    # a host may have a third of all pages: its winners are copied to every salt
    winners = winners.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = given.withColumn("host", host_of("url")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(winners, (F.col("host") == F.col("of_host")) & (F.col("salt") == F.col("of_salt")), "left")
    joined = joined.select("page_id", "url", "source", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s.as_py(), w.as_py() or []) for s, w in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    return joined.mapInArrow(handing_back(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
