"""Main text of web pages by template deduction over pages of one host.

A page is a sequence of tokens, each a tag or a block of text with the path of its open elements. Over a group of pages of one
host, tokens that occur equally often on every page share an occurrence vector and form an equivalence class. A class
is valid if its vector has support (occurs on enough pages), and on each page its members come in one order, cycle by
cycle; each cycle lies inside one gap of the classes before it, or holds whole cycles of theirs. A text with support is
a class of its own if it fits in no other. Valid classes are the template; inside article elements a text needs the
support of INSIDE pages, so what repeats in the articles of a group of fewer pages stays. What lies between two
template tokens is a slot; gaps between the same two tokens are one slot.

Tokens that are equally often on every page are told apart by their number, so elements with the same labels are different
borders. Slots are scored over the group: the characters that a slot holds, times the share of its texts that differ from
page to page. Roles weigh in: text under an element of another role than the article's counts an OTHERth, by tag, ARIA role,
hiding, or a word of its id or class. A slot counts for the innermost element around all its texts on all pages, not of text
level, or for the article element around that. The best element is the main element; if that is no more than the body, texts
with the labels of its slots' texts are. The page's main text is the text in there that is not template, less what roles
inside the main element drop.

Inside the main element, and on a whole page that lacks it or whose group has no template: texts under elements of other roles
are dropped, and of the rest the texts in article elements are the main text. Words of ids and classes don't
count there for html, body, main and article, nor for what is around the largest article element if no article element is
free of them and it holds more than any free slot. If one slot outside holds more than all articles, several articles are
cards and what is outside is the main text; a single one stays beside it. Without articles all the rest is taken.

Groups: a host's pages are dealt into groups of about GROUP pages by a hash of page_id, so that no host is one task.
Equal pages count once. A group of fewer than SUPPORT different pages has no vectors to compare: nothing is template
then, and the texts of elements with the same labels around them are one slot.

Blocks are texts between block-level tags; white space inside a block becomes one space, blocks are joined by one line
feed, character references are decoded. Nulls: null html is empty; a null url is a host of its own; a null page_id
stays. Pages without main text give an empty string. Repeated rows are pages of their own; very long pages are
read whole; empty tables give empty results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP, SUPPORT = 48, 4
#: Pages that a text inside an article must be on: there it is presumed to be content.
INSIDE = 8
#: Text under elements of other roles counts so many times less.
OTHER = 16
#: Hosts of more than GROUP pages that may be broadcast.
MANY_HOSTS = 100_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPACE = re.compile(r"\s+")

# Elements of HTML by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OTHER_ROLE = set("nav header footer aside form dialog menu button select option datalist fieldset input label head title object audio video canvas map".split())
OTHER_ARIA = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status note".split())
OTHER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsbygoogle|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|menu|nav|navbar|navigation|breadcrumbs?|sidebar|sidenav|rail|widget|"
    r"header|masthead|topbar|footer|bottombar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|"
    r"comments?|commentlist|disqus|discussion|replies|reply|respond|share|sharing|social|related|recommended|recommendations|pagination|pager|toolbar|skip|legal|copyright)(?:$|[\s_-])",
    re.I,
)
ARTICLE_NAME = re.compile(r"(?:^|[\s_-])(?:article|entry|post|story)(?:[_-]?(?:body|content|text))?(?:$|[\s_-])", re.I)
CLOSES_PARAGRAPH = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
TEXT_LEVEL = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot ul ol dl table blockquote pre figure figcaption caption".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "article", "div", "section", "body"}


class Element:
    """An open element: its label and those around it, how many before it on its page have the same, and the roles that its tag or attributes (other, article) or its class or id (named) give it."""

    __slots__ = ("article", "cost", "label", "labels", "main", "named", "nth", "other")

    def __init__(self, name: str, tag: str, around: tuple):
        marks, other, article, named, called = "", name in OTHER_ROLE, name in ("article", "main"), False, False
        self.main = name == "main"
        if len(tag) > len(name) + 2:
            for key, value in ATTRIBUTE.findall(tag):
                key, value = key.lower(), value.strip("\"'")
                if key == "role":
                    other |= value.lower() in OTHER_ARIA
                    article |= value.lower() in ("main", "article")
                    self.main |= value.lower() == "main"
                elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                    other = True
                elif key == "style":
                    other |= "display:none" in value.replace(" ", "").lower()
                elif key in ("class", "id") and value:
                    marks += "." + value
                    named |= bool(OTHER_NAME.search(value))
                    called |= key == "class" and bool(ARTICLE_NAME.search(value))
        self.label, self.other = name + marks, other
        self.named = named and not article and name not in ("html", "body")
        self.article = (article or (called and not named and name not in ("html", "body"))) and not other
        self.labels = (*(around[-1].labels if around else ()), self.label)
        self.cost = (around[-1].cost if around else 0) + self.named
        self.nth = 0


def tokens(page: str) -> list[tuple[str, str, tuple]]:
    """(kind, value, open elements) in page order; kind is a tag's '<' or '>', or 't' for a block's text."""
    out, path, at = [], (), 0
    parts: list[str] = []
    names: list[str] = []
    stack: list[tuple] = []
    alike: Counter = Counter()

    def close() -> None:
        value = "".join(parts)
        parts.clear()
        if value and not value.isspace():
            out.append(("t", value, path))

    def pop(to: int) -> None:
        nonlocal path
        del names[to:]
        path = stack[to]
        del stack[to:]

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m.group()
        found = NAME.match(tag)
        if not found or m.group(1):
            continue
        name = found.group(1).lower()
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        close()
        if tag[1] == "/":
            if name in names:
                to = len(names) - 1 - names[::-1].index(name)
                out.append((">", path[to].label, path[:to]))
                pop(to)
            continue
        if name in CLOSES_PARAGRAPH and "p" in names:
            pop(len(names) - 1 - names[::-1].index("p"))
        for i in range(len(names) - 1, -1, -1):
            if names[i] in CLOSED_BY.get(name, ()):
                pop(i)
                break
            if names[i] in SCOPES:
                break
        opened = Element(name, tag, path)
        opened.nth = alike[opened.labels]
        alike[opened.labels] += 1
        out.append(("<", opened.label, path))
        if name not in VOID and not tag.endswith("/>"):
            names.append(name)
            stack.append(path)
            path = (*path, opened)
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def key_of(kind: str, value: str, path: tuple) -> tuple:
    return kind, SPACE.sub(" ", value).strip() if kind == "t" else value, path[-1].labels if path else ()


class Template:
    """Template tokens of a group, and the keys that are equally often on all its pages: their occurrences are tokens apart."""

    def __init__(self, even: dict[tuple, int]):
        self.even, self.tokens = even, set()

    def marks(self, page: list[tuple]) -> list[tuple]:
        """Each token's key, with its number on the page or 0."""
        seen: Counter = Counter()
        out = []
        for token in page:
            key = key_of(*token)
            if key in self.even:
                seen[key] += 1
            out.append((key, seen.get(key, 0)))
        return out


def deduce(pages: list[list[tuple]]) -> Template:
    """The template of a group."""
    often: dict[tuple, list[int]] = defaultdict(list)
    for page in pages:
        for key, n in Counter(key_of(*token) for token in page).items():
            often[key].append(n)
    template = Template({key: n[0] for key, n in often.items() if len(n) == len(pages) and min(n) == max(n)})
    articles: set[tuple] = set()
    vectors: dict[tuple, dict[int, int]] = defaultdict(dict)
    places: dict[tuple, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for p, page in enumerate(pages):
        for i, (mark, (kind, _, path)) in enumerate(zip(template.marks(page), page, strict=True)):
            if kind == "t" and any(x.article for x in path):
                articles.add(mark)
            vectors[mark][p] = vectors[mark].get(p, 0) + 1
            places[mark][p].append(i)
    half = (len(pages) + 1) // 2
    classes: dict[tuple, list[tuple]] = defaultdict(list)
    for mark, v in vectors.items():
        if len(v) >= max(INSIDE if mark in articles else SUPPORT, half):
            classes[tuple(sorted(v.items()))].append(mark)
    template.tokens = {mark for members in classes.values() for mark in members if mark[0][0] == "t"}
    spans: list[tuple[int, dict[int, list[int]]]] = []
    for vector, members in sorted(classes.items(), key=lambda c: (-len(c[0]), -len(c[1]))):
        good = ordered(vector, members, places)
        if len(good) >= 2 and nested(vector, good, places, spans):
            template.tokens.update(good)
            spans.append((len(good), {p: sorted(i for mark in good for i in places[mark][p]) for p, _ in vector}))
    return template


def ordered(vector: tuple, members: list[tuple], places: dict) -> list[tuple]:
    """Members in the one order that they keep on every page, cycle by cycle; those that break it are left out."""
    first = vector[0][0]
    members = sorted(members, key=lambda k: places[k][first][0])
    good = members[:1]
    for key in members[1:]:
        before = good[-1]
        if all(all(b < a for b, a in zip(places[before][p], places[key][p], strict=True)) and all(a < b for a, b in zip(places[key][p], places[good[0]][p][1:], strict=False)) for p, _ in vector):
            good.append(key)
    return good


def nested(vector: tuple, members: list[tuple], places: dict, spans: list) -> bool:
    """Each cycle of the class lies inside one gap of every class that is in the template already, or holds whole cycles of it."""
    for size, marks in spans:
        for p, n in vector:
            own = marks.get(p, [])
            for c in range(n):
                lo, hi = bisect_right(own, places[members[0]][p][c]), bisect_left(own, places[members[-1]][p][c])
                if lo < hi and (lo % size or hi % size):
                    return False
    return True


def slots(page: list[tuple], template: Template | None) -> list[tuple]:
    """(index, slot, path, length) of each text that is not template: slots have a name from the template tokens on both sides."""
    if template is None:
        return [(i, key_of(*token)[2], token[2], len(token[1])) for i, token in enumerate(page) if token[0] == "t"]
    out: list[tuple] = []
    held: list[tuple] = []
    last = None
    for i, (mark, (kind, value, path)) in enumerate(zip(template.marks(page), page, strict=True)):
        if mark in template.tokens:
            out.extend((j, (last, mark), at, n) for j, at, n in held)
            held, last = [], mark
        elif kind == "t":
            held.append((i, path, len(value)))
    out.extend((j, (last, None), at, n) for j, at, n in held)
    return out


def largest(texts: list[tuple]) -> int:
    sizes: Counter = Counter()
    for _, slot, _, n in texts:
        sizes[slot] += n
    return max(sizes.values(), default=0)


def chosen(texts: list[tuple]) -> set[int]:
    """Indices of the main text's tokens among those of all slots."""
    texts = [t for t in texts if not any(x.other for x in t[2])]
    free = [t for t in texts if not t[2] or not t[2][-1].cost]
    inner: Counter = Counter()
    around: dict[Element, tuple] = {}
    for _, _, path, n in texts:
        at = next((k for k in range(len(path) - 1, -1, -1) if path[k].article), None)
        if at is not None:
            inner[path[at]] += n
            around[path[at]] = path[:at]
    open_to: set[Element] = set()
    if inner and not any(not x.cost and not x.main for x in inner):
        wrapped = max(inner, key=lambda x: (inner[x], -x.cost))
        if wrapped.cost and inner[wrapped] > largest(free):
            open_to = set(around[wrapped])
    kept = [t for t in texts if not any(x.named and x not in open_to for x in t[2])]
    first = [next((x for x in path if x.article), None) for _, _, path, _ in kept]
    inside = [t for t, x in zip(kept, first, strict=True) if x]
    outside = [t for t, x in zip(kept, first, strict=True) if not x]
    if inside and largest(outside) <= sum(t[3] for t in inside):
        kept = inside
    elif len({x for x in first if x}) > 1:
        kept = outside
    return {t[0] for t in kept}


class Main:
    """Where a group's main text is: under the element with these labels and this number among those alike on its page (none
    if pages differ in it), or in texts of these labels."""

    def __init__(self, labels: tuple, nth: int | None, texts: set[tuple]):
        self.labels, self.nth, self.texts = labels, nth, texts

    def inner(self, path: tuple) -> tuple | None:
        """The open elements from the main element on; none if the text is not in there."""
        n = len(self.labels)
        if not n:
            return path if path and path[-1].labels in self.texts else None
        if len(path) < n or path[n - 1].labels != self.labels:
            return None
        return path[n - 1 :] if self.nth is None or path[n - 1].nth == self.nth else None


def shared(one: tuple, other: tuple) -> int:
    return next((k for k, (x, y) in enumerate(zip(one, other)) if x is not y), min(len(one), len(other)))


def main_element(pages: list[list[tuple]], template: Template) -> Main | None:
    """Of the best slot over a group's pages."""
    size: Counter = Counter()
    count: Counter = Counter()
    weight: Counter = Counter()
    texts: dict[tuple, set[str]] = defaultdict(set)
    labels: dict[tuple, set[tuple]] = defaultdict(set)
    around: dict[tuple, list[tuple]] = {}
    for page in pages:
        common: dict[tuple, tuple] = {}
        for i, slot, path, n in slots(page, template):
            size[slot] += n
            count[slot] += 1
            weight[slot] += n / (OTHER if any(x.other or x.named for x in path) else 1)
            texts[slot].add(page[i][1])
            labels[slot].add(path[-1].labels if path else ())
            before = common.get(slot, path)
            common[slot] = before[: shared(before, path)]
        for slot, path in common.items():
            own = [(x.label, x.nth, x.article) for x in path]
            before = around.get(slot, own)
            around[slot] = [(x, a if a == b else None, one and other) for (x, a, one), (y, b, other) in zip(before, own) if x == y] if before[: len(own)] else []
            cut = next((k for k, (x, y) in enumerate(zip(before, own)) if x[0] != y[0]), len(around[slot]))
            around[slot] = around[slot][:cut]
    scores: Counter = Counter()
    held: dict[tuple, tuple[bool, set[tuple]]] = {}
    for slot, path in around.items():
        while path and path[-1][0].split(".")[0] in TEXT_LEVEL:
            path = path[:-1]
        article = next((k for k, x in enumerate(path) if x[2]), len(path) - 1)
        path = path[: article + 1]
        plain = all(x.split(".")[0] in ("html", "body") for x, _, _ in path)
        name = ((), None) if plain else (tuple(x for x, _, _ in path), path[-1][1])
        scores[name] += weight[slot] * len(texts[slot]) / count[slot]
        one, all_labels = held.get(name, (False, set()))
        held[name] = (one or any(x[2] for x in path), all_labels | labels[slot])
    if not scores:
        return None
    # the body is the main element only where no element in it has as much
    best = max(scores, key=lambda n: (scores[n], held[n][0], bool(n[0]), n[0]))
    return Main(*best, held[best][1])


def in_main(texts: list[tuple], main: Main) -> set[int]:
    """Indices of the main element's texts that roles inside it leave; what is around it doesn't count."""
    return chosen([(i, slot, inner, n) for i, slot, path, n in texts if (inner := main.inner(path)) is not None])


def extract(page: list[tuple], template: Template | None, main: Main | None = None) -> str:
    held = slots(page, template)
    taken = (in_main(held, main) if main else None) or chosen(held)
    lines = (SPACE.sub(" ", entities.unescape(page[i][1])).strip() for i in sorted(taken))
    return "\n".join(x for x in lines if x)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def group(rows: list[dict]) -> pa.RecordBatch:
        pages = [tokens(x["html"] or "") for x in rows]
        own = list({x["html"] or "": p for x, p in zip(rows, pages, strict=True)}.values())
        template = deduce(own) if len(own) >= SUPPORT else None
        main = main_element(own, template) if template else None
        texts = [extract(p, template, main) for p in pages]
        return pa.record_batch([pa.array([x["page_id"] for x in rows], pa.int64()), pa.array([x["url"] for x in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    held: list[dict] = []
    for batch in batches:
        for x in batch.to_pylist():
            if held and (x["host"], x["part"]) != (held[0]["host"], held[0]["part"]):
                yield group(held)
                held = []
            held.append(x)
    if held:
        yield group(held)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    large = rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("host", F.ceil(F.col("n") / GROUP).cast("int").alias("parts"))
    if large.count() <= MANY_HOSTS:
        large = F.broadcast(large)
    dealt = rows.join(large, "host", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int"), F.lit(0)))
    return dealt.select("host", "part", "page_id", "url", "html").repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(_run, "page_id bigint, url string, text string, n_chars bigint")
