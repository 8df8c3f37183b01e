"""Main text of web pages by the consensus of their hosts.

Every page is read into blocks of text, without what its tags or classes declare to be no
part of an article, and each block is credited to the containers it stands in: the innermost
in full, the next by half, and so on. A page votes for the path of its best container, made
of tags and classes without digits. Votes are counted in Spark by host; then every page is
read again and gives the blocks below its host's winning path, or below its own best one if
it has no such container.

The winners are one short row for each host. Up to ``BROADCAST_HOSTS`` of them go to every task, more are
joined on the host. Votes are combined before they are shuffled, so a large host is a few rows.

A class, id or role drops an element only if it is one of ``NEVER_CLASSES`` or ``DROPPED_CLASSES``
as a whole, and never one that contains an article or main element. What ``NEVER_CLASSES`` name,
reader comments, menus, adverts and consent, is no article however long it is. The others are
names of layout as well: they drop no element that holds most of the page's text outside links,
and where they would remove most of that text between them, they are ignored. If no text at all
would be left, all is kept. If there is text in article or main elements, only that counts: an
advertisement beside a short article is none of it. Elements that ``DROPPED`` names go with all
they contain, but where a page opens more of a name than it closes, they count like layout
names, so that an unclosed menu or form does not swallow what follows.

Containers are kept as a tree, and all is counted in one pass over it from the leaves: time and
memory grow with a page, however deeply its elements are nested.

Null and empty pages have an empty text; pages without a URL share the host ''. Repeated pages vote each.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import add_columns, values
from factorlab.session import cut

BROADCAST_HOSTS = 200_000
# Fixed values of HTML: elements without content, elements that end an open paragraph, and their like.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
                   "tfoot th thead tr ul".split())
ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("article body div main section table tbody td tr".split())
DROPPED = frozenset("aside button canvas dialog footer form head header iframe menu nav noscript object script select style svg "
                    "template textarea title".split())
NEVER_CLASSES = frozenset("ad ads advert advertisement adverts comment comments consent cookie cookies disqus menu nav navbar "
                          "navigation replies reply sponsor sponsored".split())
DROPPED_CLASSES = frozenset("banner breadcrumb breadcrumbs footer header login modal newsletter notice pager pagination popup promo "
                            "promoted recommended related search share sharing sidebar social subscribe toolbar widget".split())
#: Of ``DROPPED``, those that a page may leave open by mistake.
_OPENED = re.compile(r"<(/?)(aside|button|dialog|footer|form|header|menu|nav|select)\b", re.IGNORECASE)
_PREFERRED = frozenset("article content entry main post story".split())
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"[^a-z]+")


class Blocks(list):
    """Blocks of a page, ``(container, text, characters in links)``, and the tree of their containers.

    Container 0 is the page; a container's parent has a smaller number.
    """

    def __init__(self, parents: list[int], labels: list[str], index: dict[tuple[int, str], int], rows=()):
        super().__init__(rows)
        self.parents, self.labels, self.index = parents, labels, index

    def path(self, node: int) -> tuple[str, ...]:
        found = []
        while node:
            found.append(self.labels[node])
            node = self.parents[node]
        return tuple(reversed(found))


class _Reader(HTMLParser):
    """Reads a page into pieces of text, each with its container and the doubtful element it stands in."""

    def __init__(self, open_names: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.open_names = open_names  # dropped names that the page leaves open
        # tag, whether dropped, whether doubtful, whether an article; and the container before it
        self.stack: list[tuple[str, bool, bool, bool, int]] = []
        self.count: dict[str, int] = {}
        self.dropped = self.links = self.articles = 0
        self.total = [0, 0]  # text outside links, that in articles
        self.node, self.parents, self.labels, self.index = 0, [0], [""], {}
        self.around = -1  # the innermost open element that classes would drop
        self.doubtful: list[list[int]] = []  # of each: text outside links, that in articles, articles in it, the one around it, whether never kept
        self.parts: list[tuple[str, int, int]] = []
        self.read: list[tuple[int, list[tuple[str, int, int]]]] = []

    def _end_block(self):
        if self.parts:
            self.read.append((self.node, self.parts))
            self.parts = []

    def _pop(self, upto: int):
        while len(self.stack) > upto:
            tag, dropped, doubt, article, node = self.stack.pop()
            self.count[tag] -= 1
            self.dropped -= dropped
            self.articles -= article
            self.links -= tag == "a"
            self.node = node
            if doubt:
                self.around = self.doubtful[self.around][3]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_block()
            like = ENDS_LIKE.get(tag, ())
            for i in range(len(self.stack) - 1, -1, -1):
                open_ = self.stack[i][0]
                if open_ == "p" and tag != "br" or open_ in like:
                    self._pop(i)
                elif open_ in CONTAINERS or open_ in ("ul", "ol", "dl", "table"):
                    break
        if tag in VOID:
            return
        names = {name for k, v in attrs if v and k in ("class", "id", "role") for name in v.lower().split()}
        never = not NEVER_CLASSES.isdisjoint(names) and tag not in ("html", "body", "main")
        article = tag in ("article", "main") and not never
        doubt = never or tag in self.open_names or (
            not DROPPED_CLASSES.isdisjoint(names) and tag not in ("html", "body", "article", "main"))
        if article and self.around >= 0:
            self.doubtful[self.around][2] += 1
        if doubt:
            self.doubtful.append([0, 0, 0, self.around, never])
            self.around = len(self.doubtful) - 1
        dropped = tag in DROPPED and tag not in self.open_names
        self.stack.append((tag, dropped, doubt, article, self.node))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.dropped += dropped
        self.articles += article
        self.links += tag == "a"
        if tag in CONTAINERS:
            classes = " ".join(v for k, v in attrs if v and k == "class").lower()
            label = ".".join([tag, *sorted(_DIGITS.sub("#", c) for c in classes.split())])
            node = self.index.setdefault((self.node, label), len(self.parents))
            if node == len(self.parents):
                self.parents.append(self.node)
                self.labels.append(label)
            self.node = node

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_block()

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_block()
        if self.count.get(tag):
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self._pop(at)

    def handle_data(self, data):
        if not self.dropped:
            self.parts.append((data, len(data) if self.links else 0, self.around))
            if not self.links:
                n = len(data.strip())
                for counts in (self.total, *([self.doubtful[self.around]] if self.around >= 0 else ())):
                    counts[0] += n
                    counts[1] += n if self.articles else 0

    def close(self):
        super().close()
        self._end_block()

    def blocks(self, gone: list[bool]) -> Blocks:
        """The blocks that have text outside the doubtful elements that are ``gone``."""
        found = Blocks(self.parents, self.labels, self.index)
        for node, parts in self.read:
            kept = [x for x in parts if x[2] < 0 or not gone[x[2]]]
            text = " ".join("".join([x[0] for x in kept]).split())
            if text:
                found.append((node, text, sum(x[1] for x in kept)))
        return found

    def judged(self) -> Blocks:
        around = [x[3] for x in self.doubtful]
        for x in reversed(self.doubtful):  # elements inside others belong to those too
            if x[3] >= 0:
                for k in range(3):
                    self.doubtful[x[3]][k] += x[k]
        scope = 1 if self.total[1] else 0
        total = self.total[scope]
        never = [bool(x[4]) and not x[2] for x in self.doubtful]
        weak = [not x[2] and 2 * x[scope] <= total for x in self.doubtful]

        def inherited(own: list[bool]) -> list[bool]:
            out: list[bool] = []
            for i, mine in enumerate(own):
                out.append(mine or around[i] >= 0 and out[around[i]])
            return out
        never = inherited(never)
        both = inherited([a or b for a, b in zip(never, weak)])
        removed = sum(x[scope] for i, x in enumerate(self.doubtful) if both[i] and not never[i] and not (around[i] >= 0 and both[around[i]]))
        left = total - sum(x[scope] for i, x in enumerate(self.doubtful) if never[i] and not (around[i] >= 0 and never[around[i]]))
        blocks = self.blocks(both if 2 * removed <= left else never)
        return blocks or self.blocks(never) or self.blocks([False] * len(around))


def read_blocks(html: str | None) -> Blocks:
    """The blocks of a page, in page order, without what its tags and classes declare to be no article."""
    html = html or ""
    opened: dict[str, int] = {}
    for slash, name in _OPENED.findall(html):
        opened[name.lower()] = opened.get(name.lower(), 0) + (-1 if slash else 1)
    reader = _Reader(frozenset(name for name, n in opened.items() if n > 0))
    reader.feed(html)
    reader.close()
    return reader.judged()


def best_container(blocks: Blocks) -> tuple[str, ...]:
    """The path whose containers hold most of the text that is not links, inner ones before outer ones.

    A block counts in full for its innermost container, by half for the next, and so on.
    """
    scores = [0.0] * len(blocks.parents)
    seen = [False] * len(blocks.parents)
    for node, text, linked in blocks:
        scores[node] += float(max(0, len(text) - 2 * linked))
        seen[node] = True
    for node in range(len(scores) - 1, 0, -1):
        scores[blocks.parents[node]] += scores[node] / 2
        seen[blocks.parents[node]] |= seen[node]
    nodes = [n for n in range(1, len(scores)) if seen[n]]
    if not nodes:
        return ()
    prefer = {n: scores[n] * (1.5 if set(_TOKEN.split(blocks.labels[n])) & _PREFERRED else 1.0) for n in nodes}
    most = max(prefer.values())
    # of equally good ones the first path: down from the page, always to the first label that leads to one
    leads = [False] * len(scores)
    least: list[int] = [0] * len(scores)
    for node in range(len(scores) - 1, 0, -1):
        leads[node] |= prefer.get(node) == most
        parent = blocks.parents[node]
        if leads[node]:
            leads[parent] = True
            if not least[parent] or blocks.labels[node] < blocks.labels[least[parent]]:
                least[parent] = node
    node = least[0]
    while prefer.get(node) != most:
        node = least[node]
    best = blocks.path(node)
    # an article is whole: what stands beside its longest part belongs to it
    whole = next((d for d in range(1, len(best)) if best[d - 1].split(".")[0] in ("article", "main")), None)
    return best[:whole] if whole else best


def below(blocks: Blocks, path: tuple[str, ...]) -> str:
    """The text of the blocks in containers of ``path``."""
    node = 0
    for label in path:
        node = blocks.index.get((node, label), -1)
        if node < 0:
            return ""
    inside = [False] * len(blocks.parents)
    for n in range(len(inside)):
        inside[n] = n == node or n > 0 and inside[blocks.parents[n]]
    return " ".join(text for own, text, _ in blocks if inside[own])


def _path_text(path: tuple[str, ...]) -> str:
    return ">".join(path)


def host(url_col: str = "url"):
    """What stands between ``://`` and the next ``/``, ``?`` or ``#``, lower-cased; '' without a URL."""
    return F.coalesce(F.lower(F.regexp_extract(url_col, "://([^/?#]*)", 1)), F.lit(""))


def consensus(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(site, path)``: the path that most pages of each host vote for; ties go to the first path."""

    def voted(columns):
        return [pa.array([_path_text(best_container(read_blocks(h))) for h in values(columns[0])], pa.string())]

    votes = add_columns(pages.select(host().alias("site"), F.col(html_col).alias("html")), ["html"], "path string", voted)
    counts = votes.where("path <> ''").groupBy("site", "path").agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("best")
    return counts.groupBy("site").agg(first).select("site", "best.path")


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text, and ``path``, where it was found."""
    winners = cut(consensus(pages, html_col).withColumnRenamed("path", "winning_path"))
    few = F.broadcast(winners) if winners.count() <= BROADCAST_HOSTS else winners
    joined = (pages.drop("site", "winning_path").withColumn("site", host()).join(few, "site", "left"))

    def extracted(columns):
        texts, paths = [], []
        for html, winning in zip(values(columns[0]), values(columns[1])):
            blocks = read_blocks(html)
            path = tuple(winning.split(">")) if winning else ()
            text = below(blocks, path) if path else ""
            if not text:
                path = best_container(blocks)
                text = below(blocks, path)
            texts.append(text)
            paths.append(_path_text(path))
        return [pa.array(texts, pa.string()), pa.array(paths, pa.string())]

    return add_columns(joined, [html_col, "winning_path"], "text string, path string", extracted).drop("winning_path", "site")
