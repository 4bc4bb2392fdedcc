"""Main text of web pages by wrapper induction.

Pages of a host share a layout. One page of each host is its seed; the block tree of every page
is aligned with the seed's by simple tree matching, and the texts found in each aligned slot
are counted over all pages of the host. A text that nearly all of them show in a slot belongs to
the template, inside an article too; slots whose text varies hold content. Elements that HTML
itself sets apart (navigation, footers, asides, forms, hidden ones) are left out wherever they
stand, and an article element, where there is one, bounds the content. Names of classes only
add to that: a block named as advert, menu or comments goes unless nothing would be left.
"""

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import broadcast_if_small

#: A text is template if at least this share of at least so many pages shows it in its slot.
TEMPLATE_SHARE, MIN_PAGES = 0.9, 5
#: The block tree has no deeper nodes; deeper texts belong to their ancestor there, but keep their own marks.
MAX_DEPTH = 100
#: Cells of a table of children held at once, and bytes of alignments that a worker keeps.
TABLE_CELLS, CACHE_BYTES = 400_000_000, 16 << 20
#: First width of the band in which larger tables are worked out, and weights of pairs kept.
BAND, KEPT_WEIGHTS = 64, 1 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[/a-zA-Z!?][^>]*>""",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img input".split()
)
_VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
_DROPPED_TAGS = frozenset("nav footer aside form head title menu button dialog fieldset".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
#: A class or id marks a block if each of its words is in the first or second set, one in the first.
_CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup social share "
    "sharing related recommended comment comments respond reply replies disqus footer masthead toolbar widget search login "
    "disclaimer copyright pagination pager".split()
)
_PLAIN_NAMES = frozenset(
    "area article articles aside bar block bottom box button buttons container div footer form group header holder icons inner item "
    "items left link links list main page panel post posts primary reader right row secondary section site slot stories thread top "
    "unit user wrap wrapper zone".split()
)
#: What stands inside these is no text of the page. The first set ends at a block's start, as HTML has it.
_FOREIGN = frozenset("svg math select".split())
_MUTED = _FOREIGN | frozenset("object template noscript iframe textarea canvas audio video".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A text outside articles of which at least this share is links is a menu.
MENU_SHARE = 0.8
#: Opening one of these ends an open element of the second set, as HTML lets end tags be left out.
_ENDS = {t: frozenset([t]) for t in ("li", "option", "tr")} | {t: frozenset(["dd", "dt"]) for t in ("dd", "dt")} | {t: frozenset(["td", "th"]) for t in ("td", "th")}
_NAME = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "key", "dropped", "marked", "article", "kids", "shape")

    def __init__(self, tag: str, key: str, dropped: bool, marked: bool, article: bool):
        self.tag, self.key, self.dropped, self.marked, self.article = tag, key, dropped, marked, article
        self.kids: list = []


class Text(str):
    """The text of a block. ``holder`` is its element, which may lie below the tree; ``linked`` the
    share of it that is links."""

    __slots__ = ("holder", "linked")


def _open(tag: str, attrs: str, parent: Node) -> Node:
    marked = parent.marked
    dropped = parent.dropped or tag in _DROPPED_TAGS or (tag == "header" and not parent.article)
    article = parent.article or tag in ("article", "main")
    key = tag
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                words = [_NAME.findall(token) for token in value.lower().split()]
                if tag not in ("html", "body", "article", "main"):
                    marked |= any(_CHROME_NAMES.intersection(w) and _CHROME_NAMES.union(_PLAIN_NAMES).issuperset(w) for w in words)
                if name == "class":
                    key = f"{tag}.{'.'.join(sorted({x for w in words for x in w}))}"
            elif name == "role":
                dropped |= value.lower() in _DROPPED_ROLES
                article |= value.lower() == "main"
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                dropped = True
    return Node(tag, key, dropped, marked, article)


def parse(html: str) -> Node:
    """Block tree: texts and blocks in page order. Inline elements are part of the text."""
    root = Node("#root", "#root", False, False, False)
    stack: list[Node] = [root]
    pending: list[str] = []
    is_open: Counter[str] = Counter()  # so that an end tag without a start is passed over at once
    muted, inside, links, linked = "", 0, 0, 0

    def say(piece: str) -> None:
        nonlocal linked
        if not muted:
            pending.append(piece)
            linked += len(piece) if links else 0

    def flush() -> None:
        nonlocal linked
        if pending:
            raw = "".join(pending)
            text = Text(" ".join(entities.unescape(raw).split()))
            if text:
                text.holder, text.linked = stack[-1], linked / len(raw.strip())
                stack[min(len(stack), MAX_DEPTH) - 1].kids.append(text)
            pending.clear()
        linked = 0

    def close() -> str:
        tag = stack.pop().tag
        is_open[tag] -= 1
        return tag

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag, ends = tag.lower(), bool(m[2])
        if muted:
            if tag in (muted, "foreignobject"):  # what it nests
                inside += 0 if m[4].endswith("/") else -1 if ends else 1
                muted = muted if inside > 0 else ""
                continue
            # an element that was left open ends with its block, or where HTML breaks out of it
            over = is_open[tag] > 0 if ends else muted in _FOREIGN and inside == 1 and tag in _BLOCKS
            if not over:
                continue
            muted = ""
        elif tag in _MUTED:
            if not ends and not m[4].endswith("/"):
                muted, inside = tag, 1
            continue
        if tag in _INLINE:
            if tag == "br":
                say(" ")
            elif tag == "a":
                links = 0 if ends else 1
            continue
        flush()
        if ends:
            if is_open[tag]:
                links = 0
                while close() != tag:
                    pass
            continue
        if stack[-1].tag == "p" or stack[-1].tag in _ENDS.get(tag, ()):
            close()
        if tag in _VOID:
            continue
        if tag == "body":  # a head that was never closed ends here
            while len(stack) > 1 and stack[-1].tag != "html":
                close()
        node = _open(tag, m[4], stack[-1])
        if len(stack) < MAX_DEPTH:
            stack[-1].kids.append(node)
        stack.append(node)
        is_open[tag] += 1
    if at < len(html):
        say(html[at:])
    flush()
    return root


def _shape(node: Node) -> str:
    """Structure without texts; equal neighbours count once, so lists of any length look alike."""
    parts, last = [], None
    for kid in node.kids:
        s = "#" if isinstance(kid, str) else _shape(kid)
        if s != last:
            parts.append(s)
        last = s
    node.shape = f"{node.key}({','.join(parts)})"
    return node.shape


def skeleton(root: Node) -> str:
    return _shape(root)


def texts(root: Node) -> list[tuple[int, Text, Node]]:
    """(index in the skeleton, text, its block) in page order; call skeleton() first."""
    out: list[tuple[int, Text, Node]] = []

    def visit(node: Node, index: int) -> int:
        """Index of the next skeleton node after this one's subtree."""
        index += 1
        last, start = None, index
        for kid in node.kids:
            s = "#" if isinstance(kid, str) else kid.shape
            if s != last:
                start = index
            if isinstance(kid, str):
                kid.holder.shape = node.shape  # of the deepest block in the tree
                out.append((start, kid, kid.holder))
                index = start + 1
            else:
                index = visit(kid, start)
            last = s
        return index

    visit(root, 0)
    return out


class _Tree:
    """A skeleton read back: key, children and index of each node, in order. Nodes of the same
    structure share a ``kind``, so that structures are compared once, however often they occur."""

    def __init__(self, shape: str, kinds: dict[tuple, int]):
        self.keys: list[str] = []
        self.kids: list[list[int]] = []
        stack: list[int] = []
        for token in re.findall(r"[^(),]+|[()]", shape):
            if token == ")":
                stack.pop()
            elif token == "(":
                stack.append(len(self.keys) - 1)
            else:
                self.keys.append(token)
                self.kids.append([])
                if stack:
                    self.kids[stack[-1]].append(len(self.keys) - 1)
        self.kind, self.size = [0] * len(self.keys), [1] * len(self.keys)
        for i in range(len(self.keys) - 1, -1, -1):  # children stand behind their parents
            self.kind[i] = kinds.setdefault((self.keys[i], *(self.kind[k] for k in self.kids[i])), len(kinds))
            self.size[i] += sum(self.size[k] for k in self.kids[i])


class _Kept(dict):
    """Results kept by a worker, cleared when their sizes add up to too much."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.used = most, 0

    def keep(self, key, value, size: int):
        if self.used + size > self.most:
            self.clear()
            self.used = 0
        if size <= self.most:
            self[key] = value
            self.used += size
        return value


_aligned = _Kept(CACHE_BYTES)


def align(seed: str, page: str) -> dict[int, int]:
    """Simple tree matching: page node -> seed node of a largest order-preserving matching in
    which matched nodes have equal keys and matched parents.

    Lists of children are matched by a table of seed's times page's children, worked out a row at a
    time. Tables of over TABLE_CELLS cells are not held: lists are parted where a largest matching
    crosses their middle, and each half is matched alone (see ``_matched``).
    """
    found = _aligned.get((seed, page))
    if found is None:
        found = _aligned.keep((seed, page), _align(seed, page), len(seed) + len(page) + 100 * page.count("("))
    return found


def _align(seed: str, page: str) -> dict[int, int]:
    kinds: dict[tuple, int] = {}
    a, b = _Tree(seed, kinds), _Tree(page, kinds)
    weights = _Kept(KEPT_WEIGHTS)

    def weight(i: int, j: int) -> int:
        if a.keys[i] != b.keys[j]:
            return 0
        if a.kind[i] == b.kind[j]:
            return a.size[i]
        pair = a.kind[i], b.kind[j]
        found = weights.get(pair)
        return weights.keep(pair, 1 + _matched(a, b, i, j, weight)[0], 1) if found is None else found

    matched: dict[int, int] = {}
    todo = [(0, 0)] if weight(0, 0) else []
    while todo:
        i, j = todo.pop()
        matched[j] = i
        if a.kind[i] == b.kind[j]:
            todo += zip(a.kids[i], b.kids[j], strict=True)
        else:
            todo += _matched(a, b, i, j, weight)[1]
    return matched


def _matched(a: _Tree, b: _Tree, i: int, j: int, weight: Callable[[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """Weight and pairs of a largest order-preserving matching of two nodes' children.

    Where the table is too large to be held, its middle row is worked out from both ends: a largest
    matching crosses it where the sum is largest, which leaves two smaller tables (Hirschberg).
    """
    pairs: list[tuple[int, int]] = []
    total, todo = 0, [(a.kids[i], b.kids[j])]
    while todo:
        xs, ys = todo.pop()
        # equal structures at both ends belong together in some largest matching
        head = _common(a, b, xs, ys)
        ends = list(zip(xs[:head], ys[:head], strict=True))
        xs, ys = xs[head:], ys[head:]
        tail = _common(a, b, xs[::-1], ys[::-1])
        if tail:
            ends += zip(xs[-tail:], ys[-tail:], strict=True)
            xs, ys = xs[:-tail], ys[:-tail]
        pairs += ends
        total += sum(a.size[x] for x, _ in ends)
        if not xs or not ys:
            continue
        table = _Table(a, b, xs, ys, weight)
        if len(xs) * len(ys) <= TABLE_CELLS or len(xs) == 1:
            score, found = table.pairs(len(xs) + len(ys))
            total += score
            pairs += found
            continue
        width = table.width()
        if len(xs) * table.columns_within(width) <= TABLE_CELLS:
            score, found = table.pairs(width)
            total += score
            pairs += found
            continue
        half = len(xs) // 2
        upper = _Table(a, b, xs[:half], ys, weight, len(xs)).scores(width)
        lower = _Table(a, b, xs[:half - 1 : -1], ys[::-1], weight, len(xs)).scores(width)
        cut = int(np.argmax(upper + lower[::-1]))
        todo += [(xs[:half], ys[:cut]), (xs[half:], ys[cut:])]
    return total, pairs


class _Table:
    """The table of two lists of children: at (x, y) the weight of a largest matching of the first x
    and the first y. ``rows`` is the length of the whole list where xs is a part of it."""

    def __init__(self, a: _Tree, b: _Tree, xs: list[int], ys: list[int], weight: Callable[[int, int], int], rows: int = 0):
        self.a, self.b, self.xs, self.ys, self.weight = a, b, xs, ys, weight
        self.skew = len(ys) - (rows or len(xs))
        # children meet only those of the same key: where these stand, and which kind of the key they are
        self.at: dict[str, list] = {}
        for y, kid in enumerate(ys):
            self.at.setdefault(b.keys[kid], []).append(y)
        self.first: dict[str, list[int]] = {}
        self.place: dict[str, np.ndarray] = {}
        for key, at in self.at.items():
            place: dict[int, int] = {}
            first = self.first[key] = []
            for y in at:
                if place.setdefault(b.kind[ys[y]], len(first)) == len(first):
                    first.append(ys[y])
            self.place[key] = np.array([place[b.kind[ys[y]]] for y in at])
            self.at[key] = np.array(at)
        self.of_kind = _Kept(KEPT_WEIGHTS)

    def _weights(self, x: int, low: int, high: int) -> np.ndarray:
        """Of child x with children low to high: worked out once for each pair of kinds."""
        w = np.zeros(high - low, np.int64)
        key = self.a.keys[x]
        if key in self.at:
            at, first = self.at[key], self.first[key]
            s, e = np.searchsorted(at, (low, high))
            own = self.of_kind.get(self.a.kind[x])
            if own is None:
                own = self.of_kind.keep(self.a.kind[x], np.full(len(first), -1, np.int64), len(first))
            place = self.place[key][s:e]
            found = own[place]
            if len(found) and found.min() < 0:
                for k in np.unique(place[found < 0]).tolist():
                    own[k] = self.weight(x, first[k])
                found = own[place]
            w[at[s:e] - low] = found
        return w

    def columns_within(self, width: int) -> int:
        return min(len(self.ys), abs(self.skew) + 2 * width + 1)

    def _rows(self, width: int, row: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Work out the rows, each in the place of the one before and within the band of this width
        around the corners' diagonals: (first column, diagonal moves, upward moves). Outside it stand
        the weights of smaller matchings, so that none is counted that does not exist."""
        for x, kid in enumerate(self.xs):
            low, high = max(0, x + 1 + min(0, self.skew) - width - 1), min(len(self.ys), x + 1 + max(0, self.skew) + width)
            w = self._weights(kid, low, high)
            above, slanted = row[low + 1 : high + 1], row[low:high] + w
            new = np.maximum(above, slanted)
            np.maximum.accumulate(new, out=new)
            yield low, (w > 0) & (new == slanted), new == above
            row[low + 1 : high + 1] = new

    def scores(self, width: int) -> np.ndarray:
        """The last row."""
        row = np.zeros(len(self.ys) + 1, np.int64)
        for _ in self._rows(width, row):
            pass
        return row

    def width(self) -> int:
        """A band that holds a largest matching. One that leaves a band skips more than its width of
        both lists, so it weighs no more than these without as many of their lightest children."""
        sizes = [np.array([t.size[k] for k in kids]) for t, kids in ((self.a, self.xs), (self.b, self.ys))]
        without = [s.sum() - np.append(np.cumsum(np.sort(s)), s.sum()) for s in sizes]  # at d: without d + 1
        n = min(len(s) for s in without)
        most = np.minimum(without[0][:n], without[1][:n])  # falls with the width
        width = BAND
        while width < n:
            reached = self.scores(width)[-1]
            if most[width] <= reached:
                return width
            enough = int(np.searchsorted(-most, -reached))  # for certain, as weights only grow with the width
            if enough <= 2 * width:
                return enough
            width *= 2
        return len(self.xs) + len(self.ys)

    def pairs(self, width: int) -> tuple[int, list[tuple[int, int]]]:
        """Weight and pairs of a largest matching within the band."""
        row, moves = np.zeros(len(self.ys) + 1, np.int64), []
        for low, diagonal, upward in self._rows(width, row):
            moves.append((low, len(diagonal), np.packbits(diagonal), np.packbits(upward)))
        found = []
        x, y = len(self.xs), len(self.ys)
        while x and y:
            low, n, diagonal, upward = moves[x - 1]
            at, bit = (y - 1 - low) >> 3, 7 - ((y - 1 - low) & 7)
            if y <= low:  # left of the band: the row above's
                x -= 1
            elif y > low + n:  # right of it: nothing yet
                y -= 1
            elif diagonal[at] >> bit & 1:
                found.append((self.xs[x - 1], self.ys[y - 1]))
                x, y = x - 1, y - 1
            elif upward[at] >> bit & 1:
                x -= 1
            else:
                y -= 1
        return int(row[-1]), found


def _common(a: _Tree, b: _Tree, xs: list[int], ys: list[int]) -> int:
    n = 0
    for x, y in zip(xs, ys):
        if a.kind[x] != b.kind[y]:
            break
        n += 1
    return n


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def slotted(html: str, seed: str | None) -> list[tuple[int, Text, Node]]:
    """Texts of a page with the seed's slot each is aligned to. A text with no counterpart gets a
    slot of its own, named by its block's structure."""
    root = parse(html)
    own = skeleton(root)
    to_seed = align(seed, own) if seed else {}
    return [(to_seed.get(i, _hash(node.shape) | 1 << 40), text, node) for i, text, node in texts(root)]


def main_text(html: str | None, seed: str | None, template: frozenset[tuple[int, int]]) -> str:
    items = [x for x in slotted(html or "", seed) if not x[2].dropped]
    if in_article := [x for x in items if x[2].article]:
        items = in_article
    items = [x for x in items if not x[2].marked] or items
    varying = [x for x in items if (x[0], _hash(x[1])) not in template]
    if in_article:
        # pages that have most of an article in common are copies of it, not its template
        if 2 * sum(len(t) for _, t, _ in varying) >= sum(len(t) for _, t, _ in items):
            items = varying
    else:
        items = varying or items
        items = [x for x in items if x[1].linked < MENU_SHARE] or items
    return "\n".join(t for _, t, _ in items)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes = [skeleton(parse(h or "")) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string())], names=["host", "seed"])


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, slot, text hash) once a page."""
    for batch in batches:
        hosts, slots, hashes = [], [], []
        for name, page, seed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            seen = {(slot, _hash(text)) for slot, text, _ in slotted(page or "", seed)}
            hosts += [name] * len(seen)
            slots += [s for s, _ in seen]
            hashes += [h for _, h in seen]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(slots, pa.int64()), pa.array(hashes, pa.int64())], names=["host", "slot", "hash"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates: dict[str, frozenset] = {}
    for batch in batches:
        page_id, url, page, name, seed, listed = (batch.column(i) for i in range(6))
        out = []
        for h, n, s, k in zip(page.to_pylist(), name.to_pylist(), seed.to_pylist(), range(len(batch)), strict=True):
            if n not in templates:
                if len(templates) > 10_000:
                    templates.clear()
                templates[n] = frozenset((t["slot"], t["hash"]) for t in listed[k].as_py() or ())
            out.append(main_text(h, s, templates[n]))
        yield pa.RecordBatch.from_arrays(
            [page_id, url, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(host, seed, template): the seed page's skeleton, and the (slot, hash) of template texts."""
    hosted = pages.select(host(F.col("url")).alias("host"), "page_id", "html").where("host <> '' AND html IS NOT NULL")
    # the least hash of the id names the seed page; of pages that share it, the least text
    first = hosted.groupBy("host").agg(F.min(F.struct(F.xxhash64("page_id").alias("h"), F.xxhash64("html").alias("t"))).alias("first"), F.count("*").alias("pages"))
    first = broadcast_if_small(first, F.length("host") + 64, "hosts")
    found = hosted.join(first, "host").where((F.xxhash64("page_id") == F.col("first.h")) & (F.xxhash64("html") == F.col("first.t")))
    # equal seeds give equal skeletons, and only those meet here
    seeds = found.select("host", "html").mapInArrow(_skeletons, "host string, seed string").groupBy("host").agg(F.min("seed").alias("seed"))
    seeds = broadcast_if_small(seeds, F.length("host") + F.length("seed"), "seeds")
    seen = hosted.join(seeds, "host").select("host", "html", "seed").mapInArrow(_observe, "host string, slot long, hash long")
    shown = seen.groupBy("host", "slot", "hash").agg(F.count("*").alias("n"))
    # only a text in most pages can be template, so a host's list is about one text a slot
    common = shown.join(first, "host").where((F.col("pages") >= MIN_PAGES) & (F.col("n") >= TEMPLATE_SHARE * F.col("pages")))
    templates = common.groupBy("host").agg(F.collect_list(F.struct("slot", "hash")).alias("template"))
    return seeds.join(templates, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row.

    Null html gives an empty text, a null or odd url a page without a wrapper. Repeated rows are
    pages like any other; very long pages are read whole, alignment aside (see ``align``); an empty
    table gives no rows; extra columns are ignored.
    """
    own = pages.select("page_id", "url", "html", F.coalesce(host(F.col("url")), F.lit("")).alias("host"))
    wrappers = broadcast_if_small(induce_wrappers(pages), F.length("host") + F.length("seed") + 16 * F.coalesce(F.size("template"), F.lit(0)), "wrappers")
    # the pages themselves stay where they are unless there are very many hosts
    joined = own.join(wrappers, "host", "left")
    ready = joined.select("page_id", "url", "html", "host", "seed", "template")
    return ready.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
