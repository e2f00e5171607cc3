"""Main text of web pages by the consensus of each host's pages.

First every page scores its containers by the text they hold and names the best ones by a generalised
path of tags and classes. Spark sums these votes per host and path. Then every page is read again, and
its text is taken from the container that most of its host's pages agree on; a page that has no
such container uses its own best.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from letterloom.llm.common import map_batches
from letterloom.session import written

VOTES_PER_PAGE = 3
# Paths of a host that are tried in turn: those with at least this share of the best one's votes, and so many at most; pages that
# hold none of them use their own best container.
LEAST_VOTE_SHARE = 0.05
MOST_PATHS = 64

_RAW = frozenset("script style textarea title iframe svg math noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset("br hr".split())
_SCORED = frozenset("html body main article section div center".split())
_BLOCKS = _SCORED | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption "
    "header footer nav aside form fieldset address details summary noscript template dialog menu head hgroup search".split()
)
_DROPPED_TAGS = frozenset("head header footer nav aside form noscript template dialog menu search button select canvas audio video object".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
# Words of a class or id that say what is no part of an article. Those of the first list say so in any name of a container;
# those of the second only in a name of nothing but such words and neutral ones ("share-buttons", not "share-price").
_STRONG_WORDS = frozenset(
    "nav navbar navigation menubar breadcrumb breadcrumbs masthead topbar footer sidebar widget cookie cookies consent gdpr popup modal overlay "
    "ad ads adv advert adverts advertisement advertising adsense promo sponsor sponsored newsletter comment comments disqus pagination pager toolbar".split()
)
_WEAK_WORDS = frozenset(
    "menu header aside notice notices banner alert promotion form subscribe subscription signup login reply replies respond share sharing "
    "social related recommended recommendations dropdown".split()
)
_NEUTRAL_WORDS = frozenset(
    "area article articles bar block bottom box button buttons container content global group holder icon icons inner item items left link links list "
    "lists main more outer page panel post posts primary right secondary section site slot text title top unit wrap wrapper".split()
)
_CONTAINERS = frozenset("div section aside ul ol dl table span figure details center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Words of a class that speak of the page's layout, not of the element ("has-sidebar"), or of a title within the article.
_ABOUT_LAYOUT = frozenset("has with without no is".split())
_ARTICLE_WORDS = frozenset("article post entry story".split())
_ARTICLE_DROPPED = frozenset("comment comments reply ad ads advert advertisement promo sponsored related".split())
# Words of a class of what stands beside an article's body and belongs to it.
_LEAD_WORDS = frozenset("intro introduction lead lede standfirst abstract excerpt summary deck headline subtitle subheading title teaser".split())
# How far up from the chosen container its title and lead are looked for.
_LEAD_STEPS = 3
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@dataclass
class Page:
    """A page's kept blocks in order, and the elements they lie in. A path is named by a digest of its steps, so a page of deeply
    nested elements takes as much for each as any other."""

    parents: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    leads: list[bool] = field(default_factory=list)  # a heading, or named like a lead
    scored: list[int] = field(default_factory=list)  # the nearest scored element, itself included, or -1
    whole: list[int] = field(default_factory=list)  # the outermost article around, or else main, or -1
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters of links

    def add(self, parent: int, tag: str, attributes: dict[str, str]) -> int:
        node = len(self.tags)
        self.parents.append(parent)
        self.tags.append(tag)
        above = self.paths[parent] if parent >= 0 else ""
        self.paths.append(xxhash.xxh64_hexdigest(f"{above}/{_step(tag, attributes)}"))
        self.leads.append(tag in _HEADINGS or any(_LEAD_WORDS & set(w) for w in _names(attributes.get("class", ""))))
        self.scored.append(node if tag in _SCORED else self.scored[parent] if parent >= 0 else -1)
        around = self.whole[parent] if parent >= 0 else -1
        inner = tag == "article" and (around < 0 or self.tags[around] == "main") or tag == "main" and around < 0
        self.whole.append(node if inner else around)
        return node

    def scores(self) -> dict[int, float]:
        """Text of each container's own blocks, and half of that of the containers in it."""
        found: dict[int, float] = {}
        for node, text, links in self.blocks:
            share = float(max(len(text) - links, 0))
            near = self.scored[node] if node >= 0 else -1
            for part in (share, share / 2):
                if near < 0:
                    break
                found[near] = found.get(near, 0.0) + part
                near = self.scored[self.parents[near]] if self.parents[near] >= 0 else -1
        return found

    def best(self, n: int = 1) -> list[tuple[str, float]]:
        """The paths of the best containers with their shares of the page; one inside an article or main is that."""
        scores = self.scores()
        total = sum(len(text) for _, text, _ in self.blocks) or 1
        found: dict[str, float] = {}
        for node in sorted(scores, key=lambda a: (-scores[a], a))[:n]:
            path = self.paths[self.whole[node] if self.whole[node] >= 0 else node]
            found[path] = found.get(path, 0.0) + scores[node] / total
        return list(found.items())

    def text_of(self, path: str) -> str:
        """All blocks inside elements of this path, with the headings and leads that stand before them and the paragraphs beside them,
        in page order; empty if the elements themselves hold none."""
        inside = [False] * len(self.paths)
        for node, own in enumerate(self.paths):
            inside[node] = own == path or (self.parents[node] >= 0 and inside[self.parents[node]])
        kept = {node for node, _, _ in self.blocks if node >= 0 and inside[node]}
        if not kept:
            return ""
        chosen = next(node for node, own in enumerate(self.paths) if own == path and inside[node])
        if self.tags[chosen] not in ("article", "main", "body", "html"):
            self._with_leads(chosen, inside)
        return " ".join(text for node, text, _ in self.blocks if node >= 0 and inside[node])

    def _with_leads(self, chosen: int, inside: list[bool]) -> None:
        around: dict[int, int] = {}  # each element above, to the one of them that holds the chosen
        node = chosen
        for _ in range(_LEAD_STEPS):
            parent = self.parents[node]
            if parent < 0 or self.tags[parent] in ("article", "main", "html"):
                break
            around[parent] = node
            node = parent
        for node, parent in enumerate(self.parents):
            beside = around.get(parent)
            if beside is not None and node != beside:
                beside_body = self.tags[node] == "p" and parent == self.parents[chosen]
                if self.tags[parent] != "body" and (beside_body or self.leads[node] and node < beside):
                    inside[node] = True
            elif parent >= 0 and inside[parent]:
                inside[node] = True
        titles = [n for n, tag in enumerate(self.tags) if tag == "h1"]
        if not any(inside[n] for n in titles):
            # the page's own title, if the article brings none
            before = [n for n in titles if self.parents[n] in around and n < around[self.parents[n]]]
            for node in before[-1:]:
                inside[node] = True


def _names(names: str) -> list[list[str]]:
    """The words of each name, but for those about the layout and titles within an article."""
    out = []
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] not in _ABOUT_LAYOUT and not ("header" in words and _ARTICLE_WORDS & set(words)):
            out.append(words)
    return out


def _is_dropped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element is no part of an article, by its tag, role, or the words of its class and id.

    Inside an article only containers go by a word in a longer name, and only by their class; ids of headings never count.
    """
    if tag in ("html", "body", "main"):
        return False
    if tag in _DROPPED_TAGS or attributes.get("role", "").lower() in _DROPPED_ROLES:
        return True
    classes, ids = _names(attributes.get("class", "")), _names(attributes.get("id", ""))
    if tag == "article":
        return any(_ARTICLE_DROPPED & set(words) for words in [*classes, *ids])
    if tag in _CONTAINERS and any(_STRONG_WORDS & set(words) for words in (classes if in_article else [*classes, *ids])):
        return True
    said = _STRONG_WORDS | _WEAK_WORDS
    return any(said & set(words) and set(words) <= said | _NEUTRAL_WORDS for words in (classes if tag in _HEADINGS else [*classes, *ids]))


def _step(tag: str, attributes: dict[str, str]) -> str:
    names = attributes.get("class", "").split() or [f"#{v}" for v in attributes.get("id", "").split()]
    return ".".join([tag, *sorted({re.sub(r"\d+", "0", name) for name in names})])


def read_page(html: str) -> Page:
    """Elements and kept blocks of a page; unclosed and crossed tags are tolerated."""
    page = Page()
    stack: list[tuple[str, int, bool]] = []  # tag, element, dropped
    pieces: list[str] = []
    links, link, at, end = 0, False, 0, len(html)
    held: Counter[str] = Counter()  # open elements by tag

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join(html_module.unescape("".join(pieces)).split())
            if text:
                page.blocks.append((stack[-1][1] if stack else -1, text, links))
            pieces.clear()
        links = 0

    def pop() -> None:
        if stack[-1][0] in _BLOCKS:
            flush()
        held[stack.pop()[0]] -= 1

    def push(tag: str, attributes: dict[str, str], dropped: bool) -> None:
        parent = stack[-1][1] if stack else -1
        held[tag] += 1
        stack.append((tag, page.add(parent, tag, attributes), dropped or bool(stack and stack[-1][2])))

    def take(text: str) -> None:
        nonlocal links
        if text and not (stack and stack[-1][2]):
            pieces.append(text)
            links += len(text) * link

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            take(html[at:])
            break
        take(html[at:lt])
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            continue
        if html.startswith(("<!", "<?"), lt):
            close = html.find(">", lt)
            at = close + 1 if close >= 0 else end
            continue
        m = _TAG.match(html, lt) or _LOOSE_TAG.match(html, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", html[lt : lt + 3]):  # a tag that the page's end cuts off
                break
            take("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[1].lower()
        if html[lt + 1] == "/":
            if tag == "a":
                link = False
            if held[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag == "p":
                flush()
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else end
            continue
        if tag in _BREAKS:
            flush()
        if tag in _VOID:
            continue
        if tag == "a":
            link = True
        attributes = {a[1].lower(): html_module.unescape(next((v for v in a.groups()[1:] if v is not None), "")) for a in _ATTRIBUTE.finditer(m[2])} if m[2] else {}
        dropped = _is_dropped(tag, attributes, held["article"] > 0)
        if tag in _BLOCKS:
            while stack and (stack[-1][0] == "p" or stack[-1][0] in _ENDS.get(tag, ())):
                pop()
            flush()
            push(tag, attributes, dropped)
        elif dropped or held[tag]:
            push(tag, attributes, dropped)
    flush()
    return page


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, paths)``: for every host the paths its pages vote for, the one with most votes first.

    A page spreads its votes over its best containers by their share of its text. Votes are summed in the tasks before
    they are shuffled, so a host with a third of all pages sends one row per path and task.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host is not null and html is not null")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], float] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, share in read_page(html).best(VOTES_PER_PAGE):
                    votes[host, path] = votes.get((host, path), 0.0) + share
            columns = [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(votes.values()), pa.float64())], ["host", "path", "votes"])

    # sums in whole numbers do not depend on the order of the rows
    votes = map_batches(rows, vote, "host string, path string, votes double").groupBy("host", "path")
    votes = votes.agg(F.sum(F.round(F.col("votes") * 1_000_000).cast("long")).alias("votes"))
    most = F.max("votes").over(Window.partitionBy("host"))
    nth = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    kept = votes.withColumn("nth", nth).where(F.col("nth") <= MOST_PATHS).withColumn("most", most)
    kept = kept.where(F.col("votes") >= F.col("most") * LEAST_VOTE_SHARE)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), F.col("path"))))
    return kept.groupBy("host").agg(F.transform(ranked, lambda p: p["path"]).alias("paths"))


def main_text_of(html: str | None, paths: list[str] | None) -> str:
    """Text of the first path that holds any on this page, or of the page's own best container."""
    page = read_page(html or "")
    for path in [*(paths or []), *(p for p, _ in page.best())]:
        if text := page.text_of(path):
            return text
    return " ".join(text for _, text, _ in page.blocks)


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text)`` of every row, by two readings of each page.

    Null and empty pages, and pages without any kept text, have the empty text; pages without a host use their own best
    container; repeated rows vote once each; other columns are ignored; an empty table gives no rows. The
    paths of all hosts are a written table of known size: Spark sends it along if it is small, and else joins by host,
    splitting the pages of a large one.
    """
    winners = written(host_paths(pages, url, html), "host-paths")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    rows = rows.join(winners, "host", "left").select("key", "url", "html", "paths")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text_of(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])

    schema = StructType([rows.schema["key"], rows.schema["url"], StructField("text", StructType.fromDDL("t string")["t"].dataType)])
    return map_batches(rows, extract, schema).withColumnRenamed("key", key).withColumnRenamed("url", url)


def pages_report(pages: DataFrame) -> DataFrame:
    """Main texts with their lengths in code points, one row per page."""
    return main_texts(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
