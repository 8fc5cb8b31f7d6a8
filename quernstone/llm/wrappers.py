"""Operator 7: HTML extraction by union-free regular-expression wrappers.

A page becomes a tree of its block tags, with text as slots.  Neighbours of one
label, and neighbouring groups of two to four labels that repeat, fold into
repeated groups.  Pages of a host are then aligned with the host's expression so
far, level by level (longest common subsequence of labels): what both have is
merged, what one lacks becomes optional, strings that differ become text slots,
equal ones stay constant strings.  Every slot counts its pages and the share of
their unlinked text that stands in it.  The result is the host's wrapper, an
expression of sequences, repeated and optional groups and slots, without unions.

The wrapper decides what the main text is.  An article or main element that holds
a quarter of the text of the slots that vary is it (constant strings of MIN_PAGES
pages or more weigh nothing).  Else, from the root, the element that holds at
least half of that text is entered again and again, down to the one whose text
stands in its own paragraphs; headings beside the way belong to it.  Names help: what is under NEVER or BOILERPLATE never counts, and of the
elements on the way the first by MAIN is the article, if there is one.  In an
article found without such a name, constant strings that stand on half of the
pages are template text and go.  A host of fewer pages tells no slots from
constant strings, so MAIN names come first there; a page without its host's
article (another template) is judged likewise by its own expression, and keeps
all that is no boilerplate if that has no article either.

Each task merges the pages it reads, so a host sends one expression for each
task; these are merged in two steps (by host and salt, then by host), so a hot
host is spread too.  Wrappers go to every task if their measured size is under
BROADCAST_BYTES, else pages meet them in a join.  Alignment is bit-parallel and
keeps at most ALIGN_BITS bits; longer sequences are halved first.

The text of a page: its article's blocks in page order, character references
decoded, white space inside a block as one blank, trimmed, joined by one line
end.  A header element counts as page header only outside of the article; inside
it holds the article's title and stays.

Defined results: null or empty html gives the empty text; null urls form one
host; repeated rows give equal texts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .spark_util import arrow_map, cut, parallelism, table

BROADCAST_BYTES = 64 << 20
SALTS = 16
MIN_PAGES = 3  # pages of a host from which on a constant string is known as such
SHARE = 0.5  # of the varying text, held by the element that is entered
ALIGN_BITS = 1 << 28
# Names of HTML elements and common names of page regions.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg xmp object".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BLOCK_CLOSES_P = set("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NEVER = set("nav footer aside form script style noscript template iframe svg button select textarea dialog menu head title object".split())
BOILERPLATE = re.compile(
    r"(?:^|[^a-z])(?:nav(?:igation|bar)?|menu|footer|sidebar|ads?|advert(?:s|isement|ising)?|banner|promo(?:tion)?|sponsor(?:ed)?|cookies?|notice|consent|popup|modal|newsletter|subscribe|share|sharing|social|comments?(?:list|form)?|replies|respond|related|recommended|breadcrumbs?|pagination|pager|login|signup|widget|masthead|toolbar|skip)(?:$|[^a-z])"
)
PARAGRAPHS = set("p li dt dd ul ol dl blockquote pre table tbody tr td th h1 h2 h3 h4 h5 h6 figcaption caption".split())
MAIN = [re.compile(r"^article(?:$|[.#@])"), re.compile(r"^main(?:$|[.#@])|@main"), re.compile(r"[.# ](?:article|post|entry|story)(?:body|content|text)?(?:$|[^a-z])"), re.compile(r"[.# ](?:content|main|body)(?:$|[^a-z])")]

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_HEADING = re.compile(r"h[1-6](?:$|[.#@])")


class Link(str):
    """Text of a link."""


def label_of(tag: str, attrs: str) -> str:
    """tag, .classes, #id, @role, !hidden, digits as 0."""
    if not attrs or attrs.isspace():
        return tag
    out = {}
    for name, a, b, c in _ATTR.findall(attrs):
        out.setdefault(name.lower(), a or b or c)
    parts = tag
    for name, sign in (("class", "."), ("id", "#"), ("role", "@")):
        if out.get(name):
            parts += sign + " ".join(re.sub(r"\d+", "0", out[name].lower()).split())
    if "hidden" in out or out.get("aria-hidden", "").lower() == "true" or "display:none" in out.get("style", "").replace(" ", "").lower():
        parts += "!hidden"
    return parts


def parse(page: str) -> list:
    """The page's tree: [label, children], children nodes or (raw) strings."""
    root: list = ["", []]
    stack = [("", root)]
    at, n, kind = 0, len(page), str
    for m in _TOKEN.finditer(page):
        a, b = m.span()
        if a < at:
            continue
        if a > at:
            stack[-1][1][1].append(kind(page[at:a]))
        at = b
        close, tag, attrs = m.group(1), m.group(2), m.group(3)
        if tag is None:
            close, tag, attrs = m.group(4), m.group(5), m.group(6)
            if tag is None:
                continue
        tag = tag.lower()
        if tag == "a" or tag not in INLINE:
            kind = Link if tag == "a" and not close else str
        if close:
            if tag in INLINE:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, b)
            at = end.end() if end else n
            continue
        if tag in INLINE:
            if tag == "br":
                stack[-1][1][1].append(" ")
            continue
        shut = CLOSES.get(tag) or ({"p"} if tag in BLOCK_CLOSES_P else ())
        while len(stack) > 1 and stack[-1][0] in shut:
            stack.pop()
        node = [label_of(tag, attrs), []]
        stack[-1][1][1].append(node)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append((tag, node))
    if at < n:
        stack[-1][1][1].append(kind(page[at:]))
    return root


def excluded(label: str) -> bool:
    tag = re.split(r"[.#@!]", label, maxsplit=1)[0]
    return tag in NEVER or "!hidden" in label or (len(label) > len(tag) and bool(BOILERPLATE.search(label[len(tag) :])))


# Expressions: ["#", crc of a constant string or None, pages, share of their
# text], ["t", label, sequence] (the root also with its pages), ["g", sequence]
# (a group), ["+", expression], ["?", expression].


def key(e) -> str:
    if e[0] == "#":
        return "#"
    if e[0] == "t":
        return e[1]
    if e[0] == "g":
        return "(" + " ".join(key(x) for x in e[1]) + ")"
    return key(e[1])


def merge(a, b, within: bool = False):
    """The least expression of this kind for both; their keys are equal.
    within: both are of the same pages."""
    if a[0] in "+?" or b[0] in "+?":
        plus = "+" if a[0] == "+" or b[0] == "+" or (a[0] == "?" and a[1][0] == "+") or (b[0] == "?" and b[1][0] == "+") else ""
        maybe = a[0] == "?" or b[0] == "?"
        x = merge(_bare(a), _bare(b), within)
        x = ["+", x] if plus else x
        return ["?", x] if maybe else x
    if a[0] == "#":
        return ["#", a[1] if a[1] == b[1] else None, max(a[2], b[2]) if within else a[2] + b[2], a[3] + b[3]]
    if a[0] == "t":
        return ["t", a[1], align(a[2], b[2], within), *([a[3] + b[3]] if len(a) > 3 else [])]
    return ["g", [merge(x, y, within) for x, y in zip(a[1], b[1])]]


def _bare(e):
    while e[0] in "+?":
        e = e[1]
    return e


def optional(e):
    return e if e[0] == "?" else ["?", e]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence: rows of the length matrix as
    bits of one number (0 where the length grows), halved where they are too many."""
    begin, n, m = 0, len(a), len(b)
    while begin < min(n, m) and a[begin] == b[begin]:
        begin += 1
    while n > begin and m > begin and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    head = [(i, i) for i in range(begin)]
    tail = [(n + i, m + i) for i in range(len(a) - n)]
    x, y = a[begin:n], b[begin:m]
    if len(x) * len(y) <= ALIGN_BITS or len(x) < 2:
        rows = _rows(x, y)
        i, j, middle = len(x), len(y), []
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                    middle.append((i, j))
        middle.reverse()
    else:
        half = len(x) // 2
        left = _lengths(x[:half], y)
        right = _lengths(x[half:][::-1], y[::-1])[::-1]
        at = max(range(len(y) + 1), key=lambda j: left[j] + right[j])
        middle = common(x[:half], y[:at]) + [(i + half, j + at) for i, j in common(x[half:], y[at:])]
    return head + [(i + begin, j + begin) for i, j in middle] + tail


def _rows(x: list[str], y: list[str], last: bool = False) -> list[int]:
    masks: dict[str, int] = {}
    places: dict[str, list[int]] = {}
    for j, c in enumerate(y):
        places.setdefault(c, []).append(j)
    for c in set(x) & set(places):
        bits = bytearray(len(y) // 8 + 1)
        for j in places[c]:
            bits[j >> 3] |= 1 << (j & 7)
        masks[c] = int.from_bytes(bits, "little")
    full = (1 << len(y)) - 1
    row, rows = full, []
    for c in x:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
        if not last:
            rows.append(row)
    return [row] if last else rows


def _lengths(x: list[str], y: list[str]) -> list[int]:
    """Of the longest common subsequences of x and y[:j], for each j."""
    row, out = _rows(x, y, last=True)[0], [0]
    raw = row.to_bytes(len(y) // 8 + 1, "little")
    for j in range(len(y)):
        out.append(out[-1] + (not raw[j >> 3] >> (j & 7) & 1))
    return out


def align(a: list, b: list, within: bool = False) -> list:
    """Sequences merged along a longest common subsequence of their keys."""
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    if ka == kb:
        return [merge(x, y, within) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for p, q in [*common(ka, kb), (len(a), len(b))]:
        out += [optional(x) for x in a[i:p]] + [optional(x) for x in b[j:q]]
        if p < len(a):
            out.append(merge(a[p], b[q], within))
        i, j = p + 1, q + 1
    return fold(out)


def fold(seq: list) -> list:
    """Neighbours of one key as a repeated element, then repeating groups."""
    out: list = []
    for e in seq:
        if out and key(out[-1]) == key(e):
            x = merge(_bare(out[-1]), _bare(e), True)
            both = out[-1][0] == "?" and e[0] == "?"
            x = x if x[0] == "#" else ["+", x]
            out[-1] = ["?", x] if both else x
        else:
            out.append(e)
    for size in (2, 3, 4):
        keys, new, i = [key(x) for x in out], [], 0
        while i < len(out):
            times = 1
            while i + (times + 1) * size <= len(out) and keys[i : i + size] == keys[i + times * size : i + (times + 1) * size]:
                times += 1
            if times > 1:
                group = out[i : i + size]
                for t in range(1, times):
                    group = [merge(x, y, True) for x, y in zip(group, out[i + t * size : i + (t + 1) * size])]
                new.append(["+", ["g", group]])
                i += times * size
            else:
                new.append(out[i])
                i += 1
        out = new
    return out


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def expression(node: list, total: int = 0) -> list:
    """A page's own expression; total: characters of its unlinked text."""
    top = not total
    if top:
        todo = [node]
        while todo:
            for c in todo.pop()[1]:
                if not isinstance(c, str):
                    todo.append(c)
                elif not isinstance(c, Link):
                    total += len(c)
        total = max(total, 1)
    seq: list = []
    run: list[str] = []

    def slot():
        text = "".join(run).strip()
        if text:
            free = sum(len(x.strip()) for x in run if not isinstance(x, Link))
            seq.append(["#", _crc(text), 1, -(-10_000 * free // total)])
        run.clear()

    for c in node[1]:
        if isinstance(c, str):
            run.append(c)
        else:
            slot()
            seq.append(["t", c[0], expression(c, total)[2]])
    slot()
    return ["t", node[0], fold(seq), *([1] if top else [])]


def shape(e) -> str:
    """The expression written as a regular expression."""
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x[0] == "#":
            out.append("TEXT" if x[1] is None else "CONST")
        elif x[0] in "+?":
            out.append("(")
            todo += [")" + x[0], x[1]]
        else:
            begin, end, parts = (f"<{x[1]}>", "</>", x[2]) if x[0] == "t" else ("(", ")", x[1])
            out.append(begin)
            todo.append(end)
            for k, y in enumerate(reversed(parts)):
                todo += [" ", y] if k else [y]
    return "".join(out)


def dumps(e) -> str:
    """The expression as JSON, however deep it is."""
    try:
        return json.dumps(e, separators=(",", ":"))
    except RecursionError:
        pass
    out, todo = [], [(e, "")]
    while todo:
        x, after = todo.pop()
        if isinstance(x, list) and x:
            out.append("[")
            todo.append((None, "]" + after))
            todo += [(y, "," if k else "") for k, y in enumerate(reversed(x))]
        else:
            out.append(after if x is None and after[:1] == "]" else json.dumps(x) + after)
    return "".join(out)


_JSON = re.compile(r'[\[\]]|"(?:[^"\\]|\\.)*"|[^\[\],"\s]+')


def loads(text: str):
    """dumps() read back."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    stack: list[list] = [[]]
    for m in _JSON.finditer(text):
        t = m.group()
        if t == "[":
            stack.append([])
        elif t == "]":
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(json.loads(t))
    return stack[0][0]


def _step(path: int, label: str) -> int:
    """The number of a path of labels: that of the path before, and one label more."""
    return int.from_bytes(hashlib.blake2b(path.to_bytes(8, "little") + label.encode("utf-8", "replace"), digest_size=8).digest(), "little")


@dataclass(frozen=True)
class Region:
    """paths: the elements whose text is the main text, by path.  template:
    (path, crc) of the constant strings in them that are not."""

    paths: frozenset[int] = frozenset()
    template: frozenset[tuple[int, int]] = frozenset()


class _Element:
    """An element of a wrapper outside boilerplate, with the share of the varying
    text in it, and directly in it."""

    def __init__(self, label: str, path: int):
        self.label, self.path, self.weight, self.own, self.constant = label, path, 0, 0, 0
        self.children: dict[int, _Element] = {}
        self.fixed: list[tuple[int, int, int]] = []  # (path, crc, pages) below it

    @property
    def tag(self) -> str:
        return re.split(r"[.#@!]", self.label, maxsplit=1)[0]

    def named(self, pattern) -> list[_Element]:
        """The outermost elements with text below it of that name."""
        out: list[_Element] = []
        todo = list(self.children.values())
        while todo:
            e = todo.pop()
            if e.weight and pattern.search(e.label):
                out.append(e)
            else:
                todo += e.children.values()
        return out

    def add(self, e, pages: int, every: bool) -> None:
        if e[0] == "#":
            if e[1] is None or every:
                self.own += e[3]
                self.weight += e[3]
            else:
                self.constant += e[3]
                self.fixed.append((self.path, e[1], e[2]))
        elif e[0] == "t":
            if excluded(e[1]):
                return
            at = _step(self.path, e[1])
            child = self.children.get(at)
            if child is None:
                child = self.children[at] = _Element(e[1], at)
            before, fixed, constant = child.weight, len(child.fixed), child.constant
            for x in e[2]:
                child.add(x, pages, every)
            self.weight += child.weight - before
            self.constant += child.constant - constant
            self.fixed += child.fixed[fixed:]
        else:
            for x in e[1] if e[0] == "g" else [e[1]]:
                self.add(x, pages, every)


def region(wrapper: list) -> Region:
    """The wrapper's article."""
    pages = wrapper[3] if len(wrapper) > 3 else 1
    root = _Element("", 0)
    for x in wrapper[2]:
        root.add(x, pages, pages < MIN_PAGES)
    if not root.weight:  # no string varies: the pages are copies, so all text counts
        root = _Element("", 0)
        for x in wrapper[2]:
            root.add(x, pages, True)
    if pages < MIN_PAGES:  # nothing tells slots from constant strings yet
        for p in MAIN:
            if named := root.named(p):
                return Region(frozenset(e.path for e in named))
    for p in MAIN[:2]:  # the elements that HTML has for it, if much of the varying text is in one
        best = max(root.named(p), key=lambda e: e.weight, default=None)
        if best is not None and best.weight >= SHARE / 2 * root.weight:
            return Region(frozenset([best.path]))
    way, heads = [root], [[]]
    while True:
        at = way[-1]
        child = max(at.children.values(), key=lambda c: c.weight, default=None)
        if child is None or not child.weight or child.weight < SHARE * root.weight or child.tag in PARAGRAPHS:
            break
        way.append(child)
        heads.append([c for c in at.children.values() if c.weight and c is not child and _HEADING.match(c.label)])
    for p in MAIN:
        for k, e in enumerate(way):
            if e.label and p.search(e.label):
                return Region(frozenset([e.path]))
    if 2 * (at.own + sum(c.weight for c in at.children.values() if c.tag in PARAGRAPHS)) < at.weight:  # no element has most of the text: names alone can tell
        for p in MAIN:
            if named := at.named(p):
                return Region(frozenset(e.path for e in named))
    if len(way) == 1:
        return Region()
    best, titles = way[-1], [h for some in heads for h in some]
    template = [] if pages < MIN_PAGES or best.constant > best.weight else [(path, crc) for x in (best, *titles) for path, crc, n in x.fixed if 2 * n >= pages]
    return Region(frozenset([best.path, *(h.path for h in titles)]), frozenset(template))


def text_of(tree: list, main: Region) -> str:
    """The page's main text: in the wrapper's article, else in the article of
    its own expression, else all that is no boilerplate."""
    blocks: list[str] = []

    def emit(parts: list[str], path: int):
        whole = "".join(parts)
        if main.template and (path, _crc(whole.strip())) in main.template:
            return
        text = _SPACE.sub(" ", "".join(_html.unescape(p) for p in parts)).strip()
        if text:
            blocks.append(text)

    def take(node, path: int, whole: bool = False):
        parts: list[str] = []
        for c in node[1]:
            if isinstance(c, str):
                parts.append(c)
            else:
                emit(parts, path)
                parts = []
                if not excluded(c[0]) and not (whole and c[0].startswith("header")):
                    take(c, _step(path, c[0]) if main.template else 0, whole)
        emit(parts, path)

    def find(node, path: int) -> bool:
        hit = False
        for c in node[1]:
            if not isinstance(c, str) and not excluded(c[0]):
                at = _step(path, c[0])
                if at in main.paths:
                    take(c, at)
                    hit = True
                else:
                    hit |= find(c, at)
        return hit

    if main.paths and find(tree, 0):
        return "\n".join(blocks)
    own = region(expression(tree))
    if own.paths and own.paths != main.paths:
        main = own
        if find(tree, 0):
            return "\n".join(blocks)
    main = Region()
    take(tree, 0, True)
    return "\n".join(blocks)


def _deep(f):
    """f on a thread whose stack fits deeply nested pages."""
    import sys
    import threading

    def run(batches):
        for batch in batches:
            out: list = []

            def work(batch=batch, out=out):
                try:
                    out.append(f(batch))
                except BaseException as e:  # noqa: BLE001  raised again by the caller
                    out.append(e)

            old, size = sys.getrecursionlimit(), threading.stack_size(512 << 20)
            sys.setrecursionlimit(1_000_000)
            t = threading.Thread(target=work)
            t.start()
            t.join()
            threading.stack_size(size)
            sys.setrecursionlimit(old)
            if isinstance(out[0], BaseException):
                raise out[0]
            yield out[0]

    return run


def _merged(rows) -> dict[str, list]:
    """host -> expression, from (host, expression) pairs."""
    hosts: dict[str, list] = {}
    for host, e in rows:
        have = hosts.get(host)
        hosts[host] = e if have is None else merge(have, e)
    return hosts


def _as_batch(hosts: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([dumps(e) for e in hosts.values()], pa.string())], ["host", "wrapper"])


def _infer(batch):
    seen: dict[tuple[str, str], list] = {}
    for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        e = expression(parse(page or ""))
        k = (host, shape(e))
        have = seen.get(k)
        seen[k] = e if have is None else merge(have, e)
    return _as_batch(_merged((h, e) for (h, _), e in sorted(seen.items())))


def _merge_sorted(batches):
    import sys

    sys.setrecursionlimit(1_000_000)  # merge() and align() go as deep as the pages
    at, have = None, None
    for batch in batches:
        for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            e = loads(text)
            if host != at:
                if have is not None:
                    yield _as_batch({at: have})
                at, have = host, e
            else:
                have = merge(have, e)
    if have is not None:
        yield _as_batch({at: have})


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one expression (JSON) for each host of pages (host, html)."""
    n = parallelism(pages.sparkSession)
    each = arrow_map(pages.select("host", "html"), _deep(_infer), "host string, wrapper string")
    salted = each.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = arrow_map(salted.repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper"), _merge_sorted, "host string, wrapper string")
    return arrow_map(some.repartition(n, "host").sortWithinPartitions("host", "wrapper"), _merge_sorted, "host string, wrapper string")


def _extract(batch):
    known: dict[str | None, Region] = {None: Region()}
    out = []
    for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        if wrapper not in known:
            known[wrapper] = region(loads(wrapper))
        out.append(text_of(parse(page), known[wrapper]) if page else "")
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(df: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text) for each row of df (page_id, url, html)."""
    pages = df.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of())
    wrappers = cut(infer(pages))
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + 200)).first()[0] or 0
    side = F.broadcast(wrappers) if size <= broadcast_bytes else wrappers.hint("merge")
    met = pages.join(side, "host", "left").select("page_id", "url", "html", "wrapper")
    kind = met.schema["page_id"].dataType.simpleString()
    return arrow_map(met, _deep(_extract), f"page_id {kind}, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
