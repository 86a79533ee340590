"""A small tag-soup reader for page text: structural nodes, text blocks, and compact skeletons for alignment."""

from __future__ import annotations

import re
import zlib
from html import unescape

import numpy as np

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|template|textarea|title|iframe|noframes|noembed|xmp)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*[^>]*>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|</[^>]*>""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio object svg canvas".split())
#: What an opening tag ends implicitly: the tags closed, and those beyond which it does not look.
_SCOPE = frozenset("article aside blockquote body button caption div dialog fieldset figure footer form header html main nav object section table td th ul ol dl li dd dt".split())
_ENDS = {
    **{t: ({"p"}, _SCOPE) for t in BLOCK - {"button", "html", "body", "head", "option", "optgroup"}},
    "li": ({"li"}, frozenset(["ul", "ol", "menu"])),
    "dt": ({"dt", "dd"}, frozenset(["dl"])),
    "dd": ({"dt", "dd"}, frozenset(["dl"])),
    "tr": ({"tr"}, frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": ({"td", "th"}, frozenset(["table", "tr"])),
    "th": ({"td", "th"}, frozenset(["table", "tr"])),
    "option": ({"option"}, frozenset(["select"])),
}
# --- fixed values: names by which pages mark what is not the article ---
OUTSIDE_TAGS = frozenset("nav footer aside form button select dialog menu search noscript head svg canvas video audio object fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu footer sidebar aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup comment comments disqus reply replies respond share sharing social breadcrumb breadcrumbs pagination pager related recommended recommendations toolbar login search topnav sidenav submenu infobar topbar".split()
)
HEADER_NAMES = frozenset("header masthead topheader siteheader".split())
CONTENT_NAMES = frozenset("article content post entry story main".split())
# --- end of fixed values ---


class Page:
    """Nodes in document order (label, parent, depth, outside, kind of root) and blocks of text with their nodes."""

    def __init__(self, html: str):
        self.label: list[str] = ["#"]
        self.parent = [-1]
        self.depth = [0]
        self.outside = [False]
        self.root = [0]  # 3 in an article, 2 in a main element, 1 in something named like content
        self.blocks: list[tuple[int, str, float]] = []  # node, text, share in links
        self._read(html)

    def _open(self, tag: str, attributes: dict[str, str], parent: int) -> int:
        words = {w.lower() for w in _NAME_PART.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")} if attributes else set()
        role = attributes.get("role", "").strip().lower()
        root = self.root[parent]
        outside = self.outside[parent] or "hidden" in attributes
        if tag not in ("html", "body"):
            comment = not words.isdisjoint(("comment", "comments", "reply", "replies", "disqus"))
            outside = outside or comment or tag in OUTSIDE_TAGS or role in OUTSIDE_ROLES
            if tag not in ("article", "main"):
                outside = outside or not words.isdisjoint(OUTSIDE_NAMES) or (root < 2 and (tag == "header" or not words.isdisjoint(HEADER_NAMES)))
            if tag == "article":
                root = 3
            elif tag == "main" or role == "main":
                root = max(root, 2)
            elif not words.isdisjoint(CONTENT_NAMES):
                root = max(root, 1)
        self.label.append(f"{tag} {attributes.get('class', '')} {attributes.get('id', '')}" if attributes else tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.outside.append(outside)
        self.root.append(root)
        return len(self.label) - 1

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]
        pieces: list[str] = []
        linked, links, at = 0, 0, 0

        def flush() -> None:
            nonlocal pieces, linked
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                if text:
                    self.blocks.append((stack[-1][1], text, linked / len(text)))
                pieces, linked = [], 0

        for m in _TOKEN.finditer(html):
            if m.start() > at:
                piece = html[at : m.start()]
                pieces.append(piece)
                linked += len(piece) * (links > 0)
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if m[2]:
                if tag == "a":
                    links = max(0, links - 1)
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        if any(t in BLOCK for t, _ in stack[depth:]):
                            flush()
                        del stack[depth:]
                        break
                    if tag not in BLOCK and stack[depth][0] in BLOCK:
                        break
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            named = m[4] and ("class" in m[4] or "id" in m[4] or "role" in m[4] or "hidden" in m[4])
            attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[4])} if named else {}
            attributes = {k: v for k, v in attributes.items() if k in ("class", "id", "role", "hidden")}
            if tag in BLOCK:
                flush()
                if tag in _ENDS:
                    closed, scope = _ENDS[tag]
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] in closed:
                            del stack[depth:]
                            links = 0
                            break
                        if stack[depth][0] in scope:
                            break
                if tag in ("html", "body") and any(t == tag for t, _ in stack):
                    continue
                if tag == "body" and stack[-1][0] == "head":
                    stack.pop()
            if tag in VOID:
                continue
            if tag == "a":
                links += 1
            node = self._open(tag, attributes, stack[-1][1]) if tag in BLOCK or attributes else stack[-1][1]
            if attributes and tag not in BLOCK and (self.outside[node] and not self.outside[stack[-1][1]]):
                flush()
            stack.append((tag, node))
        if at < len(html):
            pieces.append(html[at:])
        flush()

    def skeleton(self) -> np.ndarray:
        """One record per node in document order: depth, label, own text (hash, characters, those in links) and marks."""
        n = len(self.label)
        own, chars, linked = [0] * n, [0] * n, [0.0] * n
        for node, text, share in self.blocks:
            own[node] = zlib.crc32(text.encode(), own[node]) or 1
            chars[node] += len(text)
            linked[node] += min(1.0, share) * len(text)
        out = np.zeros(n, NODE)
        out["depth"] = self.depth
        out["label"] = [zlib.crc32(x.encode()) for x in self.label]
        out["text"], out["chars"], out["linked"] = own, chars, linked
        out["outside"] = self.outside
        out["heading"] = [x.split(" ", 1)[0] in ("h1", "h2") for x in self.label]
        return out

    def layout(self) -> int:
        """A hash of the kinds of nodes of the upper levels: pages of one layout are aligned with one another."""
        kinds = {(self.depth[i], self.label[i], self.label[self.parent[i]]) for i in range(1, len(self.label)) if self.depth[i] <= 3}
        return zlib.crc32(repr(sorted(kinds)).encode())

    def article(self) -> int:
        """A hash of the longest blocks, which pages with the same article share whatever is around it."""
        longest = sorted((t for _, t, _ in self.blocks), key=lambda t: (-len(t), t))[:3]
        return zlib.crc32("\n".join(longest).encode())

    def content(self, wrapper: "Wrapper | None" = None) -> str:
        """The blocks that belong to the article: within the wrapper's region without its template, as far as marks allow."""
        candidates = [(n, t, share) for n, t, share in self.blocks if not self.outside[n]]
        if wrapper is not None:
            region, template = wrapper.on(Tree(self.skeleton()))
            if region is not None:
                inside = [False] * len(self.label)
                for i in range(region, len(self.label)):
                    inside[i] = i == region or inside[self.parent[i]]
                    if not inside[i] and self.depth[i] <= self.depth[region]:
                        break
                candidates = [c for c in candidates if inside[c[0]]]
            candidates = [c for c in candidates if c[0] not in template]
        best = max((self.root[n] for n, _, _ in candidates), default=0)
        if best == 0:
            candidates = [c for c in candidates if c[2] < 0.7]
        return "\n".join(t for n, t, _ in candidates if self.root[n] >= best)


NODE = np.dtype([("depth", "<u4"), ("label", "<u4"), ("text", "<u4"), ("chars", "<u4"), ("linked", "<u4"), ("outside", "?"), ("heading", "?")])
#: Alignments of child lists keep the whole table of scores up to so many cells, and halve the lists beyond.
CELLS = 1 << 20


class Tree:
    """A skeleton with parents, children, sizes and shapes (a shape is a subtree's labels)."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = nodes
        depth = nodes["depth"].tolist()
        self.label, self.text = nodes["label"].tolist(), nodes["text"].tolist()
        n = len(depth)
        self.parent = [-1] * n
        self.children: list[list[int]] = [[] for _ in range(n)]
        path: list[int] = []
        for i, d in enumerate(depth):
            del path[d:]
            if path:
                self.parent[i] = path[-1]
                self.children[path[-1]].append(i)
            path.append(i)
        self.shape, self.size = list(self.label), [1] * n
        for i in range(n - 1, -1, -1):
            own = self.children[i]
            if own:
                self.shape[i] = hash((self.label[i], *[self.shape[c] for c in own]))
                self.size[i] += sum(self.size[c] for c in own)


class Matcher:
    """Simple tree matching of two trees: the most nodes that can be paired in order with equal labels.

    Weights depend on shapes alone and are remembered by shape; no recursion, so that trees may be of any depth.
    """

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b = a, b
        self.known: dict[tuple[int, int], int] = {}

    def _ready(self, x: int, y: int) -> int | None:
        a, b = self.a, self.b
        if a.label[x] != b.label[y]:
            return 0
        if a.shape[x] == b.shape[y]:
            return a.size[x]
        return self.known.get((a.shape[x], b.shape[y]))

    def weight(self, x: int, y: int) -> int:
        a, b = self.a, self.b
        stack = [(x, y)]
        while stack:
            x, y = stack[-1]
            if self._ready(x, y) is not None:
                stack.pop()
                continue
            left, right = self._middle(a.children[x], b.children[y])[:2]
            one, two = {a.shape[c]: c for c in left}, {b.shape[c]: c for c in right}
            missing = [(c, d) for c in one.values() for d in two.values() if self._ready(c, d) is None]
            if missing:
                stack += missing
                continue
            self.known[a.shape[x], b.shape[y]] = 1 + sum(w for _, _, w in self.pairs(a.children[x], b.children[y]))
            stack.pop()
        return self._ready(x, y)

    def _middle(self, left: list[int], right: list[int]) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
        """The child lists without equal shapes at their ends, and these as pairs."""
        a, b = self.a, self.b
        head, short = 0, min(len(left), len(right))
        while head < short and a.shape[left[head]] == b.shape[right[head]]:
            head += 1
        tail = 0
        while tail < short - head and a.shape[left[-1 - tail]] == b.shape[right[-1 - tail]]:
            tail += 1
        ends = list(zip(left[:head], right[:head])) + (list(zip(left[-tail:], right[-tail:])) if tail else [])
        return left[head : len(left) - tail], right[head : len(right) - tail], [(x, y, a.size[x]) for x, y in ends]

    def _table(self, left: list[int], right: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of the shapes of two lists, and which shape each child has."""
        one, two = {}, {}
        i = np.array([one.setdefault(self.a.shape[c], (len(one), c))[0] for c in left])
        j = np.array([two.setdefault(self.b.shape[c], (len(two), c))[0] for c in right])
        weights = np.array([[self.weight(c, d) for _, d in two.values()] for _, c in one.values()], np.int64)
        return weights, i, j

    def pairs(self, left: list[int], right: list[int]) -> list[tuple[int, int, int]]:
        """The heaviest order-preserving matching of two child lists, with weights."""
        left, right, found = self._middle(left, right)
        if not left or not right:
            return found
        weights, i, j = self._table(left, right)
        parts = [(0, len(left), 0, len(right))]
        while parts:
            a0, a1, b0, b1 = parts.pop()
            if a0 == a1 or b0 == b1:
                continue
            if a1 - a0 > 1 and (a1 - a0) * (b1 - b0) > CELLS:
                # best place to part the right list for the two halves of the left one
                middle = (a0 + a1) // 2
                upper = _last_row(weights, i[a0:middle], j[b0:b1])
                lower = _last_row(weights, i[middle:a1][::-1], j[b0:b1][::-1])[::-1]
                at = b0 + int(np.argmax(upper + lower))
                parts += [(a0, middle, b0, at), (middle, a1, at, b1)]
                continue
            rows = [np.zeros(b1 - b0 + 1, np.int64)]
            for x in i[a0:a1]:
                rows.append(_next_row(rows[-1], weights[x][j[b0:b1]]))
            x, y = a1 - a0, b1 - b0
            while x and y:
                if rows[x][y] == rows[x - 1][y]:
                    x -= 1
                elif rows[x][y] == rows[x][y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    found.append((left[a0 + x], right[b0 + y], int(weights[i[a0 + x], j[b0 + y]])))
        return found

    def align(self) -> list[tuple[int, int]]:
        """Node pairs of the best matching, roots first."""
        a, b = self.a, self.b
        if not a.label or not b.label or a.label[0] != b.label[0]:
            return []
        out, waiting = [], [(0, 0)]
        while waiting:
            x, y = waiting.pop()
            out.append((x, y))
            waiting += [(c, d) for c, d, _ in self.pairs(a.children[x], b.children[y])]
        return out


def _next_row(row: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = row.copy()
    np.maximum(out[1:], row[:-1] + weight, out=out[1:])
    return np.maximum.accumulate(out)


def _last_row(weights: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    row = np.zeros(len(j) + 1, np.int64)
    for x in i:
        row = _next_row(row, weights[x][j])
    return row


def align(a: Tree, b: Tree) -> list[tuple[int, int]]:
    return Matcher(a, b).align()


#: A slot or template is known from so many different articles; a template's commonest text makes up so much of them.
LEAST, CONSTANT = 3, 0.8
#: The region is the smallest part of the page with so much of the weight of all slots.
REGION = 0.75


class Wrapper:
    """A pivot page with the node whose subtree is the article and the nodes that are template."""

    def __init__(self, pivot: bytes, region: int, template: list[int]):
        self.tree, self.region, self.template = Tree(np.frombuffer(pivot, NODE)), region, set(template)

    def on(self, page: Tree) -> tuple[int | None, set[int]]:
        """The region's node in a page, and the page's nodes that are template with the same text."""
        region, template = None, set()
        for x, y in align(page, self.tree):
            if y == self.region:
                region = x
            if y in self.template and page.text[x] == self.tree.text[y]:
                template.add(x)
        return region, template


def induce(pivot: bytes, node: np.ndarray, n: np.ndarray, top: np.ndarray, chars: np.ndarray, linked: np.ndarray) -> tuple[int, list[int]]:
    """(region, template) from what the pages aligned with the pivot say of its nodes.

    ``n`` articles have a text at the node, ``top`` of them the same one; ``chars`` and ``linked`` are means. A node
    of one text nearly everywhere is constant, else a slot. A slot weighs what it has of text outside of links, one
    marked as a menu, form, advert or comment nothing. From the root the region goes down to the child that holds
    REGION of the weight, down to the last that is no single slot, as long as no slot that is a heading stays behind. Constant nodes are template, but
    not where a sibling of the same label is a slot of the region: such lists of blocks are the article's own.
    """
    tree = Tree(np.frombuffer(pivot, NODE))
    outside, heading = tree.nodes["outside"].tolist(), tree.nodes["heading"].tolist()
    size = len(tree.label)
    slot, constant, weight, heads = [False] * size, [False] * size, [0.0] * size, [0] * size
    for y, a, b, c, d in zip(node.tolist(), n.tolist(), top.tolist(), chars.tolist(), linked.tolist()):
        constant[y] = a >= LEAST and b >= CONSTANT * a
        slot[y] = not constant[y] and a >= LEAST
        if slot[y] and not outside[y]:
            weight[y], heads[y] = max(0.0, c - d), int(heading[y])
    held = list(weight)
    for y in range(size - 1, 0, -1):
        up = tree.parent[y]
        held[up] += held[y]
        heads[up] += heads[y]
    region = 0
    while held[region] > 0:
        best = max(tree.children[region], key=held.__getitem__, default=None)
        if best is None or held[best] < REGION * held[region] or heads[best] < heads[region] or 2 * weight[best] > held[best]:
            break
        region = best
    if held[0] == 0:
        region = -1
    lists = {(tree.parent[y], tree.label[y]) for y in range(size) if slot[y] and not outside[y]}
    inside = [False] * size
    for y in range(max(region, 0), size):
        inside[y] = y == region or (y > region >= 0 and inside[tree.parent[y]])
    template = [y for y in range(size) if constant[y] and not (inside[y] and (tree.parent[y], tree.label[y]) in lists)]
    return region, template
