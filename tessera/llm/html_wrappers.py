"""HTML main-text extraction with wrappers inferred for each host.

A page's token stream is read into a tree of block elements (tag and class), with inline markup left inside text
slots and unclosed tags closed. Wrapper inference (union-free regular expressions):

* neighbours of one kind fold into one repeated group, so all pages of a layout give one signature;
* every page takes part: its signature, with the hash and the mass of each element's text, is merged by host before
  the shuffle;
* the signatures of a host are aligned: matching elements are merged, elements without a match
  become optional groups, and texts that differ become slots, while a text that is the same on all pages stays a
  constant. A host's signatures are aligned in ``SPLIT`` parts first, then the parts.

A wrapper's main regions are its article (or main) elements outside page furniture that hold most of the variable
text; without such, the innermost element with most of it. Constant blocks other than headings in a
region found that way are dropped as well: they are the host's, not the page's. Furniture is told by tag and by class
words; words that content may bear, too, count only where the element's text is constant or mostly links on the
host. Each page is then matched with the wrapper of its host, and the text blocks of its main regions, without
furniture inside them, make the result, whole and in page order.

Defined results: null or empty html gives an empty text; a null or odd url belongs to the host ''; pages that lack a
main region of their host fall back to what is outside furniture, and if that is empty to what only class words
mark; elements nested deeper than ``DEEPEST`` count as children of that depth; repeated rows are extracted each;
only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, merged, table

#: Wrappers of so many bytes are sent to all executors; more are joined by host.
BROADCAST_BYTES = 32 << 20
#: Parts in which the signatures of a host are aligned first, and bytes of signatures that a worker holds.
SPLIT, HELD_BYTES = 64, 16 << 20
#: Depth of a page's tree, and children that are aligned in order; of more, those of one kind are one group.
DEEPEST, IN_ORDER = 150, 120
#: Pages that must have a text before it counts as the host's own.
CONSTANT = 3
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_RAW = frozenset("script style noscript template textarea svg select iframe object".split())
_QUOTE_FREE = re.compile(r"[^>\"']*")
_CLASS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: An opening tag of the left closes an open element of the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Page furniture by tag, by words of class, id or role, and by words that content may bear, too.
FURNITURE = frozenset("nav header footer aside form menu button dialog head title".split())
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|disqus|sidebar|widget|menu|nav\w*|breadcrumbs?|footer|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|social|share|sharing|pagination|pager|toolbar|login|contentinfo)(?:$|[\s_-])", re.I
)
_DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:side|related|recommend\w*|notice|alert|header|masthead|search|skip|respond|replies|complementary|copyright)(?:$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = ("article", "main")


@dataclass
class Node:
    tag: str
    mark: str = ""
    parts: list = field(default_factory=list)  # texts and nodes
    inside: bool = False  # an article or main element is around it

    @property
    def key(self) -> str:
        return f"{self.tag}.{self.mark}" if self.mark else self.tag

    @property
    def furniture(self) -> int:
        """2 by tag, 1 by class, -1 if only doubtful words tell so, 0 if not. An article's header is none."""
        if self.tag in FURNITURE and not (self.tag == "header" and self.inside):
            return 2
        if not self.mark or self.tag in ("html", "body", *REGIONS):
            return 0
        return 1 if _MARKS.search(self.mark) else -1 if _DOUBTFUL.search(self.mark) else 0


def tags(text: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, tag, whether it closes, attributes) of each tag, with ("", False, "") for comments and the like.

    Linear: an attribute's quote that is never closed counts as a character from there on."""
    at, n, quotes, low = 0, len(text), True, None
    while True:
        m = _OPEN.search(text, at)
        if not m:
            return
        begin = m.start()
        if m.group(1):
            end = text.find("-->", m.end())
            at = n if end < 0 else end + 3
            yield begin, at, "", False, ""
            continue
        end = m.end()
        while quotes and end < n:
            end = _QUOTE_FREE.match(text, end).end()
            if end == n or text[end] == ">":
                break
            close = text.find(text[end], end + 1)
            if close < 0:
                quotes, end = False, m.end()
            else:
                end = close + 1
        if not quotes:
            end = text.find(">", m.end())
        if end < 0 or end >= n:
            return  # no tag is closed any more: the rest is text
        at = end + 1
        tag = (m.group(4) or "").lower()
        if tag in _RAW and not m.group(3):
            low = text.lower() if low is None else low
            close = low.find(f"</{tag}", at)
            stop = n if close < 0 else low.find(">", close)
            at = n if stop < 0 else max(at, stop + (close >= 0))
            tag = ""
        yield begin, at, tag, bool(m.group(3)), text[m.end() : end] if tag else ""


def parse(text: str) -> Node:
    root = Node("#page")
    # open elements, and the node that takes what stands in them: below DEEPEST that of a shallower one
    stack: list[tuple[str, Node]] = [(root.tag, root)]
    open_: Counter = Counter()
    at = inline_links = 0

    def put(s: str) -> None:
        if s:
            stack[-1][1].parts.append(s if not inline_links else _Link(s))

    def close(i: int) -> None:
        for name, _ in stack[i:]:
            open_[name] -= 1
        del stack[i:]

    def close_first(names, stop) -> None:
        """Close the innermost open element of these, unless one of ``stop`` is around it."""
        if any(open_[x] > 0 for x in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    close(i)
                    return
                if stack[i][0] in stop:
                    return

    for begin, end, tag, closes, attrs in tags(text):
        put(text[at:begin])
        at = end
        if not tag:
            continue
        if closes:
            if tag == "a":
                inline_links = max(0, inline_links - 1)
            elif tag in INLINE:
                continue
            if open_[tag] > 0:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
                inline_links = 0
            continue
        if tag == "br" or tag == "hr":
            stack[-1][1].parts.append(BREAK)
            continue
        if tag == "a":
            inline_links += 1
        if tag in INLINE or tag in VOID:
            continue
        inline_links = 0
        if tag in ENDS_P:
            close_first(("p",), ("div", "article", "section", "td", "li", "body"))
        close_first(CLOSES.get(tag, ()), ("ul", "ol", "dl", "table", "select", "body"))
        mark = " ".join(sorted({v for x in _CLASS.findall(attrs) for v in (x[1] or x[2] or x[3]).split()})) if "=" in attrs else ""
        node = Node(tag, re.sub(r"\d+", "#", mark), inside=open_["article"] + open_["main"] > 0)
        stack[min(len(stack), DEEPEST) - 1][1].parts.append(node)
        if not attrs.rstrip().endswith("/"):
            stack.append((tag, node))
            open_[tag] += 1
    put(text[at:])
    return root


class _Link(str):
    """Text inside a link."""


class _Break:
    """A line break: a block ends."""


BREAK = _Break()


#: In place of a text's hash: it differs from page to page.
SLOT = "*"


def fold(node: Node, keep: bool = False) -> dict:
    """Signature: element, whether repeated, hash of its own text, pages with it, text mass, link mass, and folded children.
    With ``keep`` each has the page's elements that it stands for."""
    own: list[str] = []
    link = 0
    kids: list[dict] = []
    for p in node.parts:
        if isinstance(p, Node):
            kids.append(fold(p, keep))
        elif isinstance(p, str) and (t := p.strip()):
            own.append(t)
            link += len(t) if isinstance(p, _Link) else 0
    text = " ".join(own)
    x = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).hexdigest() if text else ""
    out = {"k": node.key, "f": node.furniture, "x": x, "n": 1, "t": sum(map(len, own)), "a": link, "c": _squash(kids)}
    return out | {"p": [node]} if keep else out


def _squash(kids: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in kids:
        if out and out[-1]["k"] == x["k"] and [y["k"] for y in out[-1]["c"]] == [y["k"] for y in x["c"]]:
            out[-1] = align(out[-1], x, max) | {"r": True}
        else:
            out.append(x)
    return out if len(out) <= IN_ORDER else _bag(out)


def _bag(kids: list[dict], pages=max) -> list[dict]:
    """Elements of one kind as one repeated group each, in order of the first."""
    out: dict[str, dict] = {}
    for x in kids:
        out[x["k"]] = align(out[x["k"]], x, pages) | {"r": True} if x["k"] in out else x
    return list(out.values())


def _sum(a: int, b: int) -> int:
    return a + b


def _pairs(x: list[dict], y: list[dict]) -> list[tuple[dict | None, dict | None]]:
    """Two lists of elements side by side: as many as can be of one kind together, in order."""
    rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            rows[i][j] = rows[i + 1][j + 1] + _like(x[i], y[j]) if x[i]["k"] == y[j]["k"] else 0
            rows[i][j] = max(rows[i][j], rows[i + 1][j], rows[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i]["k"] == y[j]["k"] and rows[i][j] == rows[i + 1][j + 1] + _like(x[i], y[j]):
            out.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and rows[i + 1][j] >= rows[i][j + 1]:
            out.append((x[i], None))
            i += 1
        else:
            out.append((None, y[j]))
            j += 1
    return out


def _like(a: dict, b: dict) -> int:
    """How well two elements of one kind fit: better if what stands in them has something in common."""
    x, y = {p["k"] for p in a["c"]}, {p["k"] for p in b["c"]}
    return 4 + 3 * (x == y) + 2 * bool(x & y)


def align(a: dict, b: dict, pages=_sum) -> dict:
    """One expression for both: children are aligned in order, what has no match becomes optional, texts that differ a slot."""
    x, y = a["c"], b["c"]
    if [p["k"] for p in x] == [p["k"] for p in y]:
        kids = [align(p, q, pages) for p, q in zip(x, y, strict=True)]
    elif len(x) + len(y) > 2 * IN_ORDER:
        kids = _bag([*x, *y], pages)
    else:
        kids = [align(p, q, pages) if p and q else (p or q) | {"o": True} for p, q in _pairs(x, y)]
    out = {"k": a["k"], "f": a["f"], "x": a["x"] if a["x"] == b["x"] else SLOT, "n": pages(a["n"], b["n"]), "t": a["t"] + b["t"], "a": a["a"] + b["a"], "c": kids}
    if "p" in a:
        a["p"].extend(b["p"])
        out["p"] = a["p"]
    return out | {m: True for m in ("r", "o") if a.get(m) or b.get(m)}


def shape(sig: dict) -> list:
    """A signature without its texts: equal for all pages of a layout."""
    return [sig["k"], bool(sig.get("r")), [shape(x) for x in sig["c"]]]


def expression(sig: dict) -> str:
    """The wrapper as a union-free regular expression, for people: #text is a slot, #same a constant."""
    own = "" if not sig["x"] else "#same " if sig["x"] != SLOT and sig["n"] >= CONSTANT else "#text "
    inner = own + " ".join(expression(x) for x in sig["c"])
    return f"<{sig['k']}>({inner.strip()})" + ("+" if sig.get("r") else "") + ("?" if sig.get("o") else "")


def constant(sig: dict) -> bool:
    """The same text on all of at least ``CONSTANT`` pages, in the whole element."""
    own = sig["x"] != SLOT and (not sig["x"] or sig["n"] >= CONSTANT)
    return own and sig["n"] >= CONSTANT and all(constant(x) for x in sig["c"])


def _masses(sig: dict) -> tuple[int, int]:
    """Text and link text of a whole element."""
    inner = [_masses(x) for x in sig["c"]]
    return sig["t"] + sum(t for t, _ in inner), sig["a"] + sum(a for _, a in inner)


def is_furniture(sig: dict) -> bool:
    """By its tag or class; where only doubtful words tell so, by the texts that the host has there."""
    if sig["f"] >= 0:
        return sig["f"] > 0
    text, link = _masses(sig)
    return constant(sig) or 2 * link >= text


def mass(sig: dict) -> int:
    """Variable text outside furniture and links."""
    if is_furniture(sig):
        return 0
    own = 0 if sig["x"] not in ("", SLOT) and sig["n"] >= CONSTANT else sig["t"] - sig["a"]
    return own + sum(mass(x) for x in sig["c"])


MAIN, CONTENT, SAME = "main", "content", "same"


def rules(sig: dict) -> dict:
    """The wrapper as a tree of kinds, with marks: main regions, doubtful elements that are content, constant blocks to be dropped."""
    marks: dict[int, str] = {}
    found: list[dict] = []

    def walk(x: dict, region: bool) -> None:
        if is_furniture(x):
            return
        if x["f"] < 0:
            marks[id(x)] = CONTENT
        if not region and x["k"].split(".")[0] in REGIONS and mass(x):
            found.append(x)
            region = True
        for y in x["c"]:
            walk(y, region)

    walk(sig, False)
    if not (found and 2 * sum(map(mass, found)) >= mass(sig)):
        now = sig
        while True:
            best = max((x for x in now["c"] if not is_furniture(x)), key=mass, default=None)
            if best is None or mass(best) * 10 < mass(now) * 9 or not best["c"]:
                break
            now = best
        found = [now]

        def same(x: dict) -> None:
            if constant(x) and x["k"].split(".")[0] not in HEADINGS:
                marks[id(x)] = SAME
            else:
                for y in x["c"]:
                    same(y)

        if mass(now):  # a host whose pages are all alike has no slots, and all of its text is kept
            for y in now["c"]:
                same(y)
    marks |= {id(x): MAIN for x in found}

    def tree(x: dict) -> dict:
        return {"k": x["k"], "m": marks.get(id(x), ""), "c": [tree(y) for y in x["c"]]}

    return tree(sig)


def match(sig: dict, wrapper: dict, roles: dict[int, str]) -> None:
    """Marks of a page's elements, from those of the wrapper's elements that they are aligned with."""
    if wrapper["m"]:
        for node in sig["p"]:
            roles[id(node)] = wrapper["m"]
    x, y = sig["c"], wrapper["c"]
    if len(x) + len(y) > 2 * IN_ORDER:
        first = {w["k"]: w for w in reversed(y)}
        pairs = [(p, first.get(p["k"])) for p in x]
    else:
        pairs = _pairs(x, y)
    for p, w in pairs:
        if p and w:
            match(p, w, roles)


def blocks(node: Node, roles: dict[int, str], strict: bool = True) -> list[str]:
    """Texts of the blocks of an element, without furniture in it; unless ``strict`` only tags count as such."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        s = _SPACE.sub(" ", html_lib.unescape("".join(held))).strip()
        held.clear()
        if s:
            out.append(s)

    def walk(x: Node) -> None:
        for p in x.parts:
            if isinstance(p, str):
                held.append(p)
            elif p is BREAK:
                end()
            else:
                end()
                if roles.get(id(p)) != SAME and _kept(p, roles, strict):
                    walk(p)
                    end()

    walk(node)
    end()
    return out


def _kept(node: Node, roles: dict[int, str], strict: bool) -> bool:
    kind = node.furniture
    return kind == 0 or kind == -1 and id(node) in roles or not strict and kind != 2


def extract(text: str | None, wrapper: dict | None) -> str:
    if not text:
        return ""
    root, roles, found = parse(text), {}, []
    if wrapper:
        match(fold(root, keep=True), wrapper, roles)

    def walk(x: Node) -> None:
        if roles.get(id(x)) == MAIN:
            found.append(x)
            return
        for p in x.parts:
            if isinstance(p, Node) and _kept(p, roles, True):
                walk(p)

    walk(root)
    out = [b for x in found for b in blocks(x, roles)]
    out = out or blocks(root, {k: v for k, v in roles.items() if v != SAME})
    return "\n".join(out or blocks(root, {}, strict=False))


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], dict] = {}
    size = 0

    def send() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.string()), pa.array([s for _, s in held], pa.string()), pa.array([json.dumps(x) for x in held.values()], pa.string())], ["host", "shape", "sig"])
        held.clear()
        return out

    for batch in batches:
        for h, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if text:
                sig = fold(parse(text))
                layout = json.dumps(shape(sig))
                key = (h, hashlib.blake2b(layout.encode(), digest_size=12).hexdigest())
                size += 0 if key in held else 8 * len(layout)
                held[key] = align(held[key], sig) if key in held else sig
                if size > HELD_BYTES:
                    yield send()
                    size = 0
    if held:
        yield send()


def _aligned(table_: pa.Table) -> dict:
    """All signatures of a table as one, the same in any order of rows."""
    rows = sorted(zip(table_.column("shape").to_pylist(), table_.column("sig").to_pylist(), strict=True))
    out = json.loads(rows[0][1])
    for _, s in rows[1:]:
        out = align(out, json.loads(s))
    return out


def _align_part(table_: pa.Table) -> pa.Table:
    return pa.table({"host": table_.column("host")[:1], "shape": [min(table_.column("shape").to_pylist())], "sig": [json.dumps(_aligned(table_))]})


def _infer(table_: pa.Table) -> pa.Table:
    wrapper = _aligned(table_)
    return pa.table({"wrapper_host": [table_.column("host")[0].as_py()], "paths": [json.dumps(rules(wrapper))], "wrapper": [expression(wrapper)]})


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, dict | None] = {None: None}
    for batch in batches:
        texts = []
        for text, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
            if p not in known:
                known[p] = json.loads(p)
            texts.append(extract(text, known[p]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(wrapper_host, paths, wrapper) for every host."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    kinds = "host string, shape string, sig string"
    sigs = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_signatures, kinds)
    parts = scratch.save(sigs.groupBy("host", F.pmod(F.xxhash64("shape"), F.lit(SPLIT)).alias("part")).applyInArrow(_align_part, kinds), "parts")
    return scratch.save(parts.groupBy("host").applyInArrow(_infer, "wrapper_host string, paths string, wrapper string"), "wrappers")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    found = wrappers(pages, url_col, html_col).select("wrapper_host", "paths")
    size = found.agg(F.coalesce(F.sum(F.octet_length("paths") + F.octet_length("wrapper_host") + 64), F.lit(0))).first()[0]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    joined = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else merged(found), host(F.col("url")) == F.col("wrapper_host"), "left")
    ids = rows.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "paths").mapInArrow(_apply, f"page_id {ids}, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
