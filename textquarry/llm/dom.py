"""A small tolerant HTML reader: the block elements of a page with their text runs, and features of each."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Mapping

import numpy as np

#: A comment, a tag with its attributes (quotes count only around a value), or what HTML reads as a comment. Possessive
#: quantifiers: no input makes the match go back.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))?+)*+)(?:>|\Z)
    |<[!?/][^>]*+(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""(=?[^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))?+""")
_NAME = re.compile(r"[a-z]+")
# HTML's own vocabulary (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title textarea select button svg iframe object canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body table ul ol dl div article section main nav header footer aside form".split())
NOISE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Open:
    """The open elements, with the places of each tag, of scopes and of blocks, so that no question walks the stack."""

    def __init__(self):
        self.tags, self.nodes = ["#page"], [0]
        self.at: dict[str, list[int]] = {}
        self.scopes, self.blocks, self.links, self.unseen = [0], [0], 0, 0

    def push(self, tag: str, node: int) -> None:
        k = len(self.tags)
        self.tags.append(tag)
        self.nodes.append(node)
        self.at.setdefault(tag, []).append(k)
        if tag in SCOPE:
            self.scopes.append(k)
        if tag not in INLINE:
            self.blocks.append(k)
        self.links += tag == "a"
        self.unseen += tag in UNSEEN

    def cut(self, k: int) -> None:
        """Close all from place k on."""
        while len(self.tags) > k:
            tag = self.tags.pop()
            self.nodes.pop()
            self.at[tag].pop()
            for places in (self.scopes, self.blocks):
                if places[-1] == len(self.tags):
                    places.pop()
            self.links -= tag == "a"
            self.unseen -= tag in UNSEEN

    def last(self, *tags: str) -> int:
        """The place of the last open one of tags, 0 if none is."""
        return max(places[-1] if (places := self.at.get(t)) else 0 for t in tags)


class Page:
    """parent, tag, depth, attribute tokens and truth mark of each node, parents first; runs: (node, text, characters in links)."""

    __slots__ = ("depth", "mark", "parent", "place", "runs", "sizes", "tag", "tokens")

    def __init__(self, text: str | None):
        self.parent, self.tag, self.depth, self.tokens, self.mark, self.place = [-1], ["#page"], [0], [()], [None], [0]
        self.runs: list[tuple[int, str, int]] = []
        self._read(text or "")

    def _node(self, parent: int, tag: str, attrs: str, children: list[int]) -> int:
        tokens, mark = {}, None
        for name, value in _ATTR.findall(attrs) if attrs.strip(" /") else ():
            name = name.lower()
            if name in ("id", "class", "role"):
                tokens.update(dict.fromkeys(_NAME.findall(value.lower())))
            elif name == "hidden":
                tokens["hidden"] = None
            elif name == "data-main":
                mark = value.strip("\"'") == "1"
        self.parent.append(parent)
        self.tag.append(tag)
        self.depth.append(self.depth[parent] + 1)
        self.tokens.append(tuple(tokens))
        self.mark.append(mark)
        self.place.append(children[parent])
        children[parent] += 1
        children.append(0)
        return len(self.parent) - 1

    def _read(self, text: str) -> None:
        stack = _Open()
        children, parts, linked, at = [0], [], 0, 0

        def flush() -> None:
            nonlocal linked
            if parts:
                run = " ".join(entities.unescape("".join(parts)).split())
                if run:
                    self.runs.append((stack.nodes[-1], run, linked))
                parts.clear()
                linked = 0

        for m in iter(lambda: _TOKEN.search(text, at), None):
            if m.start() > at and not stack.unseen:
                parts.append(text[at : m.start()])
                linked += (m.start() - at) if stack.links else 0
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                k = stack.last(tag)
                if not k or (tag in INLINE and stack.scopes[-1] > k):
                    continue
                if stack.blocks[-1] >= k:
                    flush()
                stack.cut(k)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
                close = text.find(">", end.end()) if end else -1
                at = len(text) if close < 0 else close + 1
                if tag in UNSEEN:
                    continue
            if tag == "br" and not stack.unseen:
                parts.append(" ")
            if tag in VOID:
                if tag == "hr" and not stack.unseen:
                    flush()
                continue
            if tag in INLINE:
                stack.push(tag, stack.nodes[-1])
                continue
            if not stack.unseen:
                flush()
            k = stack.last(*CLOSES.get(tag, ("p",)))
            if k > stack.scopes[-1]:
                stack.cut(k)
            if tag == "body" and stack.unseen:  # a head without its end
                stack.cut(1)
            if m[3].rstrip().endswith("/") and tag in UNSEEN:
                continue
            hidden = stack.unseen or tag in UNSEEN
            stack.push(tag, stack.nodes[-1] if hidden else self._node(stack.nodes[-1], tag, m[3], children))
        if at < len(text) and not stack.unseen:
            parts.append(text[at:])
        flush()
        self.sizes = children
        runs = []
        for node, run, n in self.runs:  # text beside blocks is a node of its own
            if self.sizes[node]:
                node = self._node(node, "#run", "", children)
            runs.append((node, run, n))
        self.runs = runs

    def features(self, evidence: Mapping[str, float] | None = None) -> np.ndarray:
        """A row for each node: density of its subtree, place and depth, tags of it and above, its share among its siblings, and
        the least, greatest and summed evidence of the attribute tokens of it and above (none for tokens not known)."""
        n = len(self.parent)
        parent = self.parent
        chars, linked, stops, blocks, subs, heads, up_main, up_noise = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n, [0] * n
        low, high, told, largest = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
        start = [0] * n
        longest = [0] * n
        total = 0
        for node, run, k in self.runs:
            if not chars[node]:
                start[node] = total
            total += len(run)
            chars[node] += len(run)
            linked[node] += min(k, len(run))
            stops[node] += run.count(".") + run.count(",")
            blocks[node] += 1
            longest[node] = max(longest[node], len(run))
        order = range(n - 1, 0, -1)
        for v in order:
            if self.tag[v] == "#run":
                p = parent[v]
                subs[p] += subs[v]
        for v in order:
            p = parent[v]
            heads[v] += self.tag[v] == "h1"
            if self.tag[v] != "#run":
                subs[p] += subs[v]
            chars[p] += chars[v]
            linked[p] += linked[v]
            stops[p] += stops[v]
            blocks[p] += blocks[v]
            heads[p] += heads[v]
            longest[p] = max(longest[p], longest[v])
            largest[p] = max(largest[p], chars[v])
            if chars[v] and (not start[p] or start[v] < start[p]):
                start[p] = start[v]
        for v in range(1, n):
            p = parent[v]
            own = [e for t in self.tokens[v] if (e := evidence.get(t)) is not None] if evidence else ()
            low[v], high[v], told[v] = min([low[p], *own]), max([high[p], *own]), told[p] + sum(own)
            up_main[v] = int(up_main[p] or self.tag[v] in ("article", "main"))
            up_noise[v] = int(up_noise[p] or self.tag[v] in NOISE_TAGS)
        c, k, b = np.array(chars, float), np.array(linked, float), np.array(blocks, float)
        size = np.maximum(c, 1)
        sizes = np.array([self.sizes[p] if p >= 0 else 1 for p in parent], float)
        columns = [
            np.log1p(c),
            k / size,
            np.array(stops) / size * 100,
            np.log1p(c / np.maximum(b, 1)),
            np.log1p(np.array(longest)),
            c / np.array(subs),
            np.log1p(np.array(subs)),
            c / max(total, 1),
            np.array(start) / max(total, 1),
            np.array(self.depth),
            np.array(self.place) / np.maximum(sizes, 1),
            np.log1p(sizes),
            np.array(up_main),
            np.array(up_noise),
            np.array(heads) > 0,
            c / np.maximum([largest[p] if p >= 0 else total for p in parent], 1),
            np.array([chars[p] if p >= 0 else total for p in parent]) / max(total, 1),
            np.array(low),
            np.array(high),
            np.array(told),
            *([t in tags for t in self.tag] for tags in (NOISE_TAGS, ("article", "main"), ("p",), HEADING, ("ul", "ol", "li", "dl"), ("#run",), ("#page", "html", "body"))),
        ]
        return np.stack(columns, axis=1).astype(np.float32)

    def truth(self) -> np.ndarray:
        """1 for what lies in a marked element, or around one; marks of 0 take out what they hold."""
        n = len(self.parent)
        inside, around = [False] * n, [False] * n
        for v in range(1, n):
            inside[v] = inside[self.parent[v]] if self.mark[v] is None else self.mark[v]
        for v in range(n - 1, 0, -1):
            around[self.parent[v]] |= around[v] or inside[v]
        return np.array([i or a for i, a in zip(inside, around, strict=True)], float)

    def decode(self, odds: np.ndarray) -> str:
        """The text of the best choice of nodes under which nothing below a dropped node is kept."""
        n = len(self.parent)
        best = odds.tolist()
        for v in range(n - 1, 0, -1):
            if best[v] > 0:
                best[self.parent[v]] += best[v]
        keep = [True] * n
        for v in range(1, n):
            keep[v] = keep[self.parent[v]] and best[v] > 0
        return "\n".join(run for node, run, _ in self.runs if keep[node])
