"""HTML extraction by wrapper induction: what same-host pages share is template, what varies is content.

All pages of a host are parsed into DOM trees and aligned with the largest of
them by simple tree matching. Nodes that nearly all pages have (MET of them), all
with one text, are constant, and so template; the others are slots. Tasks count
what their pages say of each node, and Spark adds these counts up. The wrapper of a host keeps the constants
and the path of the slot that holds the article: that of the pages' article or
main elements, or where they have none the innermost element that holds most of
the text that varies from page to page (the text of links counts against it),
with a varying heading before it. Every page is then parsed whole and read
through its host's wrapper; a page that the wrapper doesn't fit, or of a host
with one page, is read by the roles of its elements alone.

Wrappers are one small row for each host. Up to BROADCAST_BYTES of them, as
counted, they go to all executors; beyond, pages meet them by a join, dealt out
by host and a salt so that a host of a third of all pages is many tasks.

Defined results: null or empty html has an empty text. A page of a null url, or
of one without a host, is read by the roles of its elements alone. Elements may
nest to any depth (alignment takes what is deeper than LEVELS as text of the
element there). A very long page is one value of one task. A null page_id stays
null. Rows with one page_id are extracted each for itself; an empty table gives
an empty one. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, record_batch, table

#: Share of a host's pages that must have a constant's node.
MET = 0.9
#: What a task counts before it sends it: nodes, paths and pages, and bytes of the largest pages.
HELD, HELD_BYTES = 100_000, 32 << 20
#: Different pages that have to agree on a constant: outside of the article, and in it, where authors may repeat themselves.
AGREE, AGREE_INSIDE = 3, 5
#: Different pages from which the slot of the article is told by its text.
DIFFER = 3
#: Depth of alignment, cells of an alignment's tables in all, and the share of the varying text that an element must hold.
LEVELS, CELLS, SHARE = 64, 100_000, 0.6
BROADCAST_BYTES = 16 << 20
SALTS = 32

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
ROLES = frozenset("nav footer aside form script style noscript template iframe button select textarea option svg canvas head title dialog menu object audio video".split())
#: Words of class, id and role that name the same.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar side aside rail widget menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist reply replies respond discussion disqus share sharing social related recommended newsletter subscribe subscription "
    "popup modal overlay login signup search pagination pager toolbar skip complementary contentinfo".split()
)
#: Words that go with these in a name and only tell of place or shape.
SHAPES = frozenset(
    "area articles bar block body bottom box button buttons center col column container content control desktop first fixed float form global group holder icon icons inner item items large last left links link "
    "list local main mobile module outer page panel posts primary reader readers right row secondary section site slot small sticky stories tab tabs this top unit user users view wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|([^<]+|<)", re.S)
#: Attributes one after the other: a value in quotes is passed over whole.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
_RAW_END = {x: re.compile(rf"</{x}\b", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option"}


class Node:
    __slots__ = ("tag", "names", "ids", "children", "parent", "order")

    def __init__(self, tag: str, names: tuple[str, ...] = (), ids: tuple[str, ...] = (), parent: Node | None = None, order: int = 0):
        self.tag, self.names, self.ids, self.parent, self.order = tag, names, ids, parent, order
        self.children: list[Node | str] = []

    @property
    def sign(self) -> str:
        """Tag and classes: what same elements of a template's pages have in common."""
        return f"{self.tag}.{'.'.join(self.names).lower()}" if self.names else self.tag

    def elements(self) -> list[Node]:
        return [x for x in self.children if isinstance(x, Node)]


def parse(html: str) -> Node:
    """The DOM tree of a page, with the ends that writers leave out."""
    root = now = Node("#root")
    at = 0
    while m := _TOKEN.match(html, at):
        at = m.end()
        data, end, tag, rest, text = m.groups()
        if text is not None:
            now.children.append(text)
            continue
        if data is not None:
            now.children.append(data)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            up = now
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                now = up.parent
            continue
        if tag in _CLOSES_P or tag in _SAME:
            stop = ("p",) if tag in _CLOSES_P else (tag, _SAME[tag])
            up = now
            while up is not root and up.tag not in stop and (up.tag in INLINE or up.tag == "p"):
                up = up.parent
            if up is not root and up.tag in stop:
                now = up.parent
        said = [(g[0].lower(), g[1] or g[2] or g[3]) for g in _ATTRIBUTE.findall(rest)] if "=" in rest else []
        names = tuple(x for name, value in said if name in ("class", "role") for x in value.split())
        node = Node(tag, names, tuple(x for name, value in said if name == "id" for x in value.split()), now, at)
        now.children.append(node)
        if tag in _RAW_END:
            stop = _RAW_END[tag].search(html, at)
            node.children.append(html[at : stop.start() if stop else len(html)])
            at = stop.start() if stop else len(html)
            now = node
        elif tag not in VOID and not rest.endswith("/"):
            now = node
    return root


@lru_cache(maxsize=1 << 16)
def tells(name: str) -> bool:
    """Whether a name is one of NAMES, or made of such and of SHAPES alone: ``cookiebar``, ``userComments``, ``site-footer``, but not ``social-history``."""
    if name.lower() in NAMES:
        return True
    words: list[str] = []
    for x in _WORD.findall(name):
        word = x.lower()
        glued = next((k for k in range(2, len(word) - 1) if word[:k] in NAMES and word[k:] in SHAPES or word[:k] in SHAPES and word[k:] in NAMES), 0) if word not in NAMES and word not in SHAPES else 0
        words += [word[:glued], word[glued:]] if glued else [word]
    return any(w in NAMES for w in words) and all(w in NAMES or w in SHAPES for w in words)


def boilerplate(node: Node, in_article: bool) -> bool:
    """Whether the element's role or names say that it isn't the article. Ids are often made of a heading's text: they count on no heading, and in an article only if they are one of NAMES."""
    if node.tag in ROLES or node.tag == "header" and not in_article:
        return True
    if any(map(tells, node.names)):
        return True
    return bool(node.ids) and node.tag not in HEADINGS and any(x.lower() in NAMES if in_article else tells(x) for x in node.ids)


def text_of(node: Node, in_article: bool = False, constants: dict[str, set[str]] | None = None, path: str = "") -> list[str]:
    """Pieces of text in page order, with a blank where a block or line ends."""
    out: list[str] = []
    stack = [(iter(node.children), in_article, path, 0, False)]
    while stack:
        rest, inside, above, level, block = stack[-1]
        for x in rest:
            if isinstance(x, str):
                out.append(unescape(x) if "&" in x else x)
                continue
            if boilerplate(x, inside):
                continue
            below = f"{above}/{x.sign}" if constants and level < LEVELS else ""
            if below and below in constants and squeeze(text_of(x)) in constants[below]:
                continue
            ends = x.tag not in INLINE
            if ends:
                out.append(" ")
            stack.append((iter(x.children), inside or x.tag in ("article", "main"), below, level + 1 if below else LEVELS, ends))
            break
        else:
            stack.pop()
            if block:
                out.append(" ")
    return out


def squeeze(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


def find(node: Node, tags: tuple[str, ...]) -> list[Node]:
    """Outermost elements of these tags that aren't boilerplate, in page order."""
    out, stack = [], node.elements()[::-1]
    while stack:
        x = stack.pop()
        if boilerplate(x, False):
            continue
        if x.tag in tags:
            out.append(x)
        else:
            stack += x.elements()[::-1]
    return out


def path_of(node: Node) -> str:
    parts = []
    while node.parent is not None:
        parts.append(node.sign)
        node = node.parent
    return "/" + "/".join(reversed(parts))


def at_path(root: Node, path: str) -> list[Node]:
    found = [root]
    for sign in path.split("/")[1:]:
        found = [x for n in found for x in n.elements() if x.sign == sign]
    return found


# -- induction ---------------------------------------------------------------------------


class Reduced:
    """A tree for alignment: runs of like siblings are one node, inline elements are their parent's text, and so is all that is deeper than LEVELS; boilerplate is left out."""

    def __init__(self, nodes: list[Node], path: str, level: int = 0):
        self.sign, self.path, self.tag = nodes[0].sign, path, nodes[0].tag
        self.children: list[Reduced] = []
        self.text = self.links = ""
        if len(nodes) > 1 or level == LEVELS:
            self.text = " ".join(squeeze(text_of(x)) for x in nodes)
            self.links = " ".join(squeeze(text_of(a)) for x in nodes for a in find(x, ("a",)))
        else:
            texts, links, runs = [], [], []
            for x in nodes[0].children:
                if isinstance(x, str):
                    texts.append(x)
                elif x.tag in INLINE:
                    texts += text_of(x)
                    links += [squeeze(text_of(a)) for a in ([x] if x.tag == "a" else find(x, ("a",)))]
                elif runs and runs[-1][0].sign == x.sign:
                    runs[-1].append(x)
                else:
                    runs.append([x])
            self.text, self.links = squeeze(texts), " ".join(links)
            self.children = [Reduced(r, f"{path}/{r[0].sign}", level + 1) for r in runs if not boilerplate(r[0], False)]
        self.size = 1 + sum(x.size for x in self.children)


def matching(a: Reduced, b: Reduced, cells: list[int] | None = None) -> tuple[int, list[tuple[Reduced, Reduced]]]:
    """Simple tree matching: the most pairs of nodes that agree, order and descent kept.

    ``cells`` is what its tables may take in all (of CELLS). What doesn't fit
    is aligned by counting: the k-th child of a sign meets the k-th there, as
    far as the order allows.
    """
    cells = [CELLS] if cells is None else cells
    if a.sign != b.sign:
        return 0, []
    n, m = len(a.children), len(b.children)
    if n * m > cells[0]:
        pairs, total = [(a, b)], 1
        for x, y in counted(a.children, b.children):
            size, below = matching(x, y, cells)
            pairs += below
            total += size
        return total, pairs
    cells[0] -= n * m
    best = [[0] * (m + 1) for _ in range(n + 1)]
    below: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            got = 0
            if a.children[i - 1].sign == b.children[j - 1].sign:
                below[i, j] = matching(a.children[i - 1], b.children[j - 1], cells)
                got = below[i, j][0]
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + got)
    pairs = [(a, b)]
    i, j = n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += below[i, j][1]
            i, j = i - 1, j - 1
    return best[n][m] + 1, pairs


def counted(a: list[Reduced], b: list[Reduced]) -> list[tuple[Reduced, Reduced]]:
    """The k-th node of a sign with the k-th there; of these pairs the most whose order agrees."""
    place: dict[tuple[str, int], int] = {}
    seen: Counter[str] = Counter()
    for j, y in enumerate(b):
        place[y.sign, seen[y.sign]] = j
        seen[y.sign] += 1
    seen.clear()
    met = []
    for i, x in enumerate(a):
        if (x.sign, seen[x.sign]) in place:
            met.append((i, place[x.sign, seen[x.sign]]))
        seen[x.sign] += 1
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(met)
    for k, (_, j) in enumerate(met):
        size = bisect_left(tails, j)
        before[k] = at[size - 1] if size else -1
        tails[size : size + 1], at[size : size + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append((a[met[k][0]], b[met[k][1]]))
        k = before[k]
    return out[::-1]


def content_of(reference: Reduced, varying: dict[int, int]) -> list[str]:
    """Paths of the innermost element that holds SHARE of the varying text, and of the varying headings before it; none if that is the page."""
    total: dict[int, int] = {}

    def add(node: Reduced) -> int:
        total[id(node)] = varying.get(id(node), 0) + sum(map(add, node.children))
        return total[id(node)]

    add(reference)
    now, above = reference, None
    while nxt := next((x for x in now.children if total[id(x)] >= SHARE * total[id(reference)] > 0 and x.tag not in _CLOSES_P - {"div", "section", "main", "article"} and x.tag not in _SAME), None):
        now, above = nxt, now
    if above is None or now.tag in ("html", "body"):
        return []
    before = above.children[: above.children.index(now)]
    return [*(x.path for x in before if x.tag in HEADINGS and varying.get(id(x))), now.path]


def nodes_of(reference: Reduced) -> list[Reduced]:
    """Its nodes, a node before its children."""
    out, stack = [], [reference]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += node.children[::-1]
    return out


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def observed(tree: Node, reference: Reduced, number: dict[int, int]) -> Iterator[tuple[str, str, int, int]]:
    """What a page says of its host's wrapper, as (kind, key, hash, weight): a node of the reference, the hash of its text here and the length without links; the path of an article and its length; the page itself."""
    for a, b in matching(reference, Reduced([tree], ""))[1]:
        yield "node", str(number[id(a)]), digest(b.text), max(0, len(b.text) - 2 * len(b.links))
    for x in find(tree, ("article",)) or find(tree, ("main",)):
        yield "path", path_of(x), 0, len(squeeze(text_of(x, True)))
    yield "page", str(digest(squeeze(text_of(tree)))), 0, 0


class Counts:
    """By (host, kind, key): how often it was seen, its least and largest hash, and the sum of weights."""

    def __init__(self) -> None:
        self.rows: dict[tuple[str, str, str], list[int]] = {}

    def add(self, host: str, kind: str, key: str, h: int, weight: int) -> None:
        row = self.rows.get((host, kind, key))
        if row is None:
            self.rows[host, kind, key] = [1, h, h, weight]
        else:
            row[0] += 1
            row[1], row[2] = min(row[1], h), max(row[2], h)
            row[3] += weight


def wrapper_of(reference: Reduced, rows: list[tuple[str, str, int, int, int, int]], different: int, n_pages: int) -> dict:
    """The wrapper by the counts (kind, key, n, lo, hi, weight) of all pages: constants of the template, and the paths of the slots that are the article. Copies of one page prove nothing: what counts is how many ``different`` pages agree, or differ."""
    weight = {key: w for kind, key, *_, w in rows if kind == "path"}
    seen = {int(key): (n, lo, hi, w) for kind, key, n, lo, hi, w in rows if kind == "node"}
    nothing = digest("")
    constants: list[tuple[str, str]] = []
    varying: dict[int, int] = {}
    slots: list[str] = []
    for k, node in enumerate(nodes_of(reference)):
        n, lo, hi, w = seen.get(k, (0, nothing, nothing, 0))
        if not node.children and node.text and lo == hi and n >= MET * n_pages:
            constants.append((node.path, node.text))
        elif lo != hi or lo != nothing:
            slots.append(node.path)
            if lo != hi:
                varying[id(node)] = w
    marked = {p: w for p, w in weight.items() if any(s == p or s.startswith(p + "/") for s in slots)} or weight
    article = [max(marked, key=lambda p: (marked[p], p))] if marked else content_of(reference, varying) if different >= DIFFER else []
    inside = lambda path: any(path == p or path.startswith(p + "/") for p in article)
    return {"article": article, "constants": [(p, t) for p, t in constants if different >= (AGREE_INSIDE if inside(p) else AGREE)]}


def induce(pages: list[str]) -> dict:
    """The wrapper of same-host pages."""
    trees = [parse(x) for x in pages]
    if not trees:
        return {"article": [], "constants": []}
    reference = max((Reduced([t], "") for t in trees), key=lambda r: r.size)
    number = {id(x): k for k, x in enumerate(nodes_of(reference))}
    counts = Counts()
    for tree in trees:
        for said in observed(tree, reference, number):
            counts.add("", *said)
    rows = [(kind, key, *row) for (_, kind, key), row in counts.rows.items()]
    return wrapper_of(reference, rows, sum(r[0] == "page" for r in rows), len(trees))


def extract(html: str, wrapper: dict | None) -> str:
    """The article's text."""
    if not html:
        return ""
    root = parse(html)
    constants: dict[str, set[str]] = {}
    for path, text in wrapper["constants"] if wrapper else ():
        constants.setdefault(path, set()).add(text)
    found = {x.order: x for path in (wrapper["article"] if wrapper else ()) for x in at_path(root, path) if not boilerplate(x, True)}
    nodes = [found[k] for k in sorted(found)] or find(root, ("article",)) or find(root, ("main",))
    if nodes:
        return " ".join(x for x in (squeeze(text_of(n, True, constants, path_of(n) if constants else "")) for n in nodes) if x)
    return squeeze(text_of(root, False, constants))


# -- on Spark --------------------------------------------------------------------------


def largest_pages(pages: DataFrame) -> DataFrame:
    """host, html: of each host the page of the largest tree, with which the others are aligned."""
    schema = pa.schema([("host", pa.string()), ("size", pa.int64()), ("h", pa.int64()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[int, int, str]] = {}
        held = 0
        send = lambda: record_batch(schema, [list(best), *([x[k] for x in best.values()] for k in range(3))])
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = (Reduced([parse(html)], "").size, digest(html), html)
                if host not in best or own[:2] > best[host][:2]:
                    held += len(html) - (len(best[host][2]) if host in best else 0)
                    best[host] = own
                if held > HELD_BYTES:
                    yield send()
                    best, held = {}, 0
        yield send()

    found = pages.select("__host", "html").mapInArrow(run, "host string, size long, h long, html string")
    return found.groupBy("host").agg(F.max_by("html", F.struct("size", "h")).alias("html"))


def with_host(rows: DataFrame, learned: DataFrame, *key: str) -> DataFrame:
    """``rows`` with what is ``learned`` (host and one more column) of their host, or null; ``key`` tells rows of a host apart."""
    value = learned.columns[1]
    size = learned.agg(F.sum(F.length("host") + F.length(value))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(learned), F.col("__host") == F.col("host"), "left")
    salted = learned.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("__of", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).join(salted, (F.col("__host") == F.col("host")) & (F.col("__of") == F.col("__salt")), "left")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): induced from all pages of each host, each aligned where it is read."""
    own = pages.where("html is not null and __host is not null").select("__host", "html")
    largest = materialize(largest_pages(own).withColumnRenamed("html", "reference"), "references")
    schema = pa.schema([("host", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("weight", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = Counts(), {}
        send = lambda: record_batch(schema, [*([k[i] for k in counts.rows] for i in range(3)), *([x[i] for x in counts.rows.values()] for i in range(4))])
        for batch in batches:
            for host, html, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if host not in known:
                    if len(known) > 500:
                        known = {}
                    reference = Reduced([parse(text)], "")
                    known[host] = reference, {id(x): k for k, x in enumerate(nodes_of(reference))}
                for said in observed(parse(html), *known[host]):
                    counts.add(host, *said)
            if len(counts.rows) > HELD:
                yield send()
                counts = Counts()
        yield send()

    met = with_host(own, largest, "html").select("__host", "html", "reference").mapInArrow(count, "host string, kind string, key string, n long, lo long, hi long, weight long")
    total = materialize(met.groupBy("host", "kind", "key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("weight").alias("weight")), "counts")
    # of a host's pages only whether a few differ counts, and how many there are
    different = total.where("kind = 'page'").groupBy("host").agg(F.count("*").alias("different"), F.sum("n").alias("pages"))
    rest = total.where("kind <> 'page'").groupBy("host").agg(F.collect_list(F.struct("kind", "key", "n", "lo", "hi", "weight")).alias("rows"))
    joined = largest.join(different, "host").join(rest, "host")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [json.dumps(wrapper_of(Reduced([parse(x)], ""), [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in rows], int(d), int(n))) for x, d, n, rows in zip(batch["reference"], batch["different"], batch["pages"], batch["rows"], strict=True)]
            yield pd.DataFrame({"host": batch["host"], "wrapper": found})

    return joined.select("host", "reference", "different", "pages", "rows").mapInPandas(run, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each page."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    host = F.when(host != "", host)  # pages without one are no site together
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("__host", host)
    learned = materialize(wrappers(rows), "wrappers")
    joined = with_host(rows, learned, "page_id", "url")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            texts = []
            for html, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if wrapper not in known:
                    if len(known) > 10_000:
                        known = {None: None}
                    known[wrapper] = json.loads(wrapper)
                texts.append(extract(html or "", known[wrapper]))
            yield record_batch(schema, [batch.column(0), batch.column(1), texts])

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
