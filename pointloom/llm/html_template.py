"""Main text of web pages by equivalence-class template deduction over the pages of a host.

A page is a set of tokens: an element token for each path of block elements on it (tags with their classes and ids), and a text token
for each block of text in its element (path, text and the number of the occurrence, so that a token is on a page once or not at all).
A token's occurrence vector over the host's pages is folded into an exclusive-or of page hashes, so hosts of any number of pages are
summed where their pages lie. Tokens of a host with equal vectors form an equivalence class. Classes are nested into a template from
the one of most pages on: a class stands in the slots of the elements that hold its outermost ones, and is valid if those are elements
of one class. A text token that is on nearly all pages, or of the valid class of its element (always there when that is), is the
template's own text: menus, notices, an owner's line. What the pages say beyond that, element by element, are the slots' contents.

Slots are judged by their occurrence vectors first. A slot whose texts take few values (the texts on several pages are `repeats` of its
characters or more) holds the template's choices: menus of sections, adverts that change. Those, and slots that hold nothing but the
template's text, or nearly so, say nothing of a page's own. What two vectors can't tell apart, tag names and a fixed word list do: of
the slots left, those under elements that serve navigation, adverts, forms, comments and the like go. Where the template has an article
or main element, only what it holds stays; elsewhere the container with most text that isn't links. Of the slots that stay the page's
own text is extracted, with the template's text in its midst, such as a heading that every article has; whole containers (a list, a
division) in which a page says nothing of its own go, and so does the template's text before and after all that is the page's own.

Pages of one host may be copies of each other: a text counts as one of several pages only if these differ in their longest block of text,
and a slot takes few values only if it repeats itself COPIES times as much as the slot with most text does. Evidence
starts at `least` pages, two, and grows with them: a host's one page is judged by its own elements. If the template's text would be
`most` of the host's prose or more, text counts as contents, and elements alone decide.

Tokens are counted by (host, token), so a host of a third of all pages spreads over all tasks. What reaches one row of a host are the
tokens on a tenth of its pages or more, of which there are at most ten times as many as a page has on average. A page is parsed twice,
for its tokens and for its text: storing its blocks would cost more disk than parsing costs time.

Defined results: null and empty html, and pages without main text, give an empty text; an url without a host and a null url are judged
by the page's own elements alone; unclosed, misplaced and unknown tags never fail; equal pages of a host are extracted alike; other
columns pass through.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|noscript|template|svg|iframe)\b[^>]*+>(?:(?<=[\s\"']/>)|(?<=<svg/>)|.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Elements that start a block of text; those that text can't be inside of; those that end when another starts.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}}
# Elements and words of classes, ids and roles that mark what isn't main text.
ASIDE_TAGS = frozenset("nav footer aside form head title select option dialog menu fieldset legend".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "share sharing social comment comments commentlist disqus respond reply replies discussion sidebar sidebars widget widgets menu navbar nav navigation breadcrumb breadcrumbs pagination pager footer masthead "
    "topbar toolbar related recommended login signin signup search searchbox copyright disclaimer contentinfo complementary".split()
)
ARTICLE_WORDS = frozenset("main article".split())
# Elements that hold several blocks, of which one alone may be a page's part.
CONTAINERS = frozenset(" html body main article section div aside nav header footer form blockquote dl ul ol menu table tbody thead tfoot figure details dialog fieldset address hgroup".split(" "))
# Elements that hold a whole page or text, whose classes and ids differ from page to page.
WHOLE = frozenset("html body main article".split())
#: Share of a host's pages that an element or a text of a class with it covers at least; that from which a text is the template's
#: without its element; the share of a slot's text that varies at least; the largest share of link text in a slot that stays where no
#: element says article; the share of repeated text from which a slot in an article takes few values (lists there may repeat words that
#: are a page's own); how much more a slot with few values repeats itself than the slot with most text; the depth below which paths list each element once.
SUPPORT, OPTIONAL, ALWAYS, VARIES, LINKS, INSIDE, COPIES, DEEP = 0.1, 0.5, 0.9, 0.05, 0.5, 0.9, 3, 64
#: Characters of all templates up to which they are broadcast; beyond, pages are joined with them by host.
BROADCAST_CHARS = 16 << 20
#: Hosts up to which their numbers of pages (16 bytes each) are broadcast; beyond, tokens are joined with them by host.
BROADCAST_HOSTS = 500_000


def purposes(attrs: str) -> list[str]:
    """Words of classes, ids and roles that say what an element is for.

    Aside words count where all words of a class do, as in cookie-notice: no-sidebar, with-comments and menu-open say how it looks.
    """
    found = []
    for _, a, b, c in ATTRIBUTE.findall(attrs):
        for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", a or b or c).lower().split():
            words = [w for w in re.split(r"[_-]+", name) if w]
            whole = all(w in ASIDE_WORDS or w in ARTICLE_WORDS for w in words)
            found += [w for w in words if w in ARTICLE_WORDS or (whole and w in ASIDE_WORDS)]
    return found


def look(attrs: str) -> str:
    """A mark of an element's classes and id, digits apart, or nothing where it has none: it tells plain elements with other roles apart."""
    names = {n for kind, a, b, c in ATTRIBUTE.findall(attrs) if kind.lower() != "role" for n in re.sub(r"\d+", "0", a or b or c).split()}
    return f":{zlib.crc32(' '.join(sorted(names)).encode()):08x}" if names else ""


def blocks(page: str | None, nodes: list[tuple[int, str]] | None = None) -> Iterator[tuple[str, str, int, int]]:
    """(path, text, characters inside links, node) of each block with text, in page order; nodes gets (parent, tag) of each element.

    A path lists the open block elements, an element's purposes after dots and its look after a colon: "html/body/div.ad:5cc0e8b4";
    below DEEP elements only those that the path doesn't list yet, so that deep nests have short paths. Elements that may stay open end by
    the rules of HTML for p, li, dt, dd, td, th, tr and option; an end tag closes up to its element, or nothing if none is open.
    """
    nodes = [] if nodes is None else nodes
    nodes.append((-1, ""))
    stack: list[str] = []
    paths: list[str] = []
    open_nodes: list[int] = [0]
    text: list[str] = []
    linked = links = 0

    def flush() -> tuple[str, str, int, int] | None:
        nonlocal linked
        whole = " ".join("".join(text).split())
        text.clear()
        out = (paths[-1] if paths else "", whole, linked, open_nodes[-1]) if whole else None
        linked = 0
        return out

    for m in TOKEN.finditer(page or ""):  # linear: a tag's unquoted part ends at the next '<', and nothing is tried twice
        tag = m["tag"]
        if tag is None:
            said = m.group()
            if said[0] != "<" or len(said) == 1:
                said = html_lib.unescape(said)
                text.append(said)
                linked += len(said) if links else 0
            elif m["raw"] is None or m["raw"].lower() in ("textarea", "noscript", "iframe"):
                text.append(" " if m["raw"] else "")
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m["end"] else 1
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        if (found := flush()) is not None:
            yield found
        if m["end"]:
            if tag in stack:
                while stack.pop() != tag:
                    paths.pop()
                    open_nodes.pop()
                paths.pop()
                open_nodes.pop()
            continue
        closing = ENDS.get(tag, {"p"} if tag not in ("html", "head", "body") else set())
        scope = SCOPES.get(tag, set())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in scope or (stack[i] not in closing and stack[i] in ("article", "section", "div", "td", "body", "li", "blockquote")):
                break
            if stack[i] in closing:
                del stack[i:], paths[i:], open_nodes[i + 1 :]
                break
        if tag not in VOID:
            attrs = m["attrs"]
            name = ".".join([tag, *purposes(attrs)]) + (look(attrs) if tag not in WHOLE else "") if attrs else tag
            above = paths[-1] if paths else ""
            listed = len(stack) >= DEEP and f"/{name}/" in f"/{above}/"
            nodes.append((open_nodes[-1], tag))
            open_nodes.append(len(nodes) - 1)
            stack.append(tag)
            paths.append(above if listed else f"{above}/{name}" if above else name)
    if (found := flush()) is not None:
        yield found


def words_of(element: str) -> tuple[str, list[str]]:
    tag, *words = element.partition(":")[0].split(".")
    return tag, words


def is_aside(path: str) -> bool:
    """Whether an element of the path serves something else than the main text; a header does unless it is an article's.

    The words of html, body, main, an outermost article and whatever contains a main element say nothing about the main text; nor does
    a form that contains an article or main element.
    """
    inside = False
    elements = [words_of(e) for e in path.split("/")]
    main = max((i for i, (tag, _) in enumerate(elements) if tag == "main"), default=-1)
    held = max((i for i, (tag, _) in enumerate(elements) if tag in ("main", "article")), default=-1)
    for i, (tag, words) in enumerate(elements):
        named = i > main and tag not in ("html", "body") and not (tag == "article" and not inside)
        serves = tag in ASIDE_TAGS and not (tag == "form" and i < held)
        if serves or (named and any(w in ASIDE_WORDS for w in words)) or (tag == "header" and not inside):
            return True
        inside = inside or tag in ("article", "main") or any(w in ARTICLE_WORDS for w in words)
    return False


def in_article(path: str) -> bool:
    return any(tag in ("article", "main") or any(w in ARTICLE_WORDS for w in words) for tag, words in map(words_of, path.split("/")))


def text_key(path: str, text: str, seen: dict[int, int]) -> int:
    """63 bits that name a text token: the path, the text and how often this page has said it there before."""
    key = xxhash.xxh64_intdigest(f"{path}\0{text}")
    times = seen[key] = seen.get(key, 0) + 1
    return (key + (times - 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 1


def path_key(path: str) -> int:
    return xxhash.xxh64_intdigest(path, 1) >> 1


TOKEN_FIELDS = T.StructType([
    T.StructField("path", T.ArrayType(T.StringType())), T.StructField("key", T.ArrayType(T.LongType())), T.StructField("element", T.ArrayType(T.LongType())),
    T.StructField("chars", T.ArrayType(T.LongType())), T.StructField("links", T.ArrayType(T.LongType())), T.StructField("longest", T.LongType()),
])


def page_tokens(page: Column) -> Column:
    """The tokens of a page, in arrays of equal length: those of elements have a path; chars and links are of text directly in it.

    longest is a hash of the page's longest block of text.
    """

    def tokens(page: str | None) -> tuple[list, ...]:
        elements: dict[str, list[int]] = {"": [0, 0]}  # the page itself
        texts: list[tuple[int, str, int, int]] = []
        seen: dict[int, int] = {}
        longest = ""
        for path, text, linked, _ in blocks(page):
            longest = max(longest, text, key=len)
            if path not in elements:
                cut = len(path)
                while cut > 0 and path[:cut] not in elements:
                    elements[path[:cut]] = [0, 0]
                    cut = path.rfind("/", 0, cut)
            at = elements[path]
            linked = min(linked, len(text))
            at[0] += len(text)
            at[1] += linked
            texts.append((text_key(path, text, seen), path, len(text), linked))
        keys = {p: path_key(p) for p in elements}
        return (
            [*elements, *[None] * len(texts)], [*keys.values(), *[t[0] for t in texts]], [*keys.values(), *[keys[t[1]] for t in texts]],
            [*[c for c, _ in elements.values()], *[t[2] for t in texts]], [*[k for _, k in elements.values()], *[t[3] for t in texts]],
            path_key(longest),
        )

    @F.pandas_udf(TOKEN_FIELDS)
    def run(pages: pd.Series) -> pd.DataFrame:
        found = [tokens(p) for p in pages]
        return pd.DataFrame({f.name: [t[i] for t in found] for i, f in enumerate(TOKEN_FIELDS)})

    return run(page)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


class Template:
    """Classes of a host nested into each other: for each class the elements of others in whose slots it stands.

    tokens: (vector, pages, path or None, key, element's key, characters, link characters), the page itself with path ""; texts are of
    pages that aren't copies. shared: characters of an element's texts that are on several pages.
    """

    def __init__(
        self, tokens: list[tuple[int, int, str | None, int, int, int, int]], shared: dict[int, int] | None = None,
        least: int = 2, repeats: float = 0.25, most: float = 0.5,
    ):
        self.least, self.most = least, most
        self.pages = max((n for _, n, p, *_ in tokens if p == ""), default=0)
        self.elements = {key: (p, vector, n, chars, links) for vector, n, p, key, _, chars, links in tokens if p is not None}
        self.texts = {key: (e, vector, n, chars, links) for vector, n, p, key, e, chars, links in tokens if p is None and e in self.elements}
        path_to = {p: k for k, (p, *_) in self.elements.items()}
        self.slots: dict[int, set[int]] = {}  # of each class, the elements in whose slots it stands
        for k, (p, vector, *_) in self.elements.items():
            above = path_to.get(p.rpartition("/")[0], k)  # an element above is on all pages of p, so it is among the tokens
            if above != k and self.elements[above][1] != vector:
                self.slots.setdefault(vector, set()).add(above)
        repeated = {k: c / self.elements[k][3] for k, c in (shared or {}).items() if k in self.elements and c}
        most_text = max(self.elements, key=lambda k: (self.elements[k][3] - self.elements[k][4], k), default=0)
        bound = max(repeats, COPIES * repeated.get(most_text, 0))
        few = {k for k, share in repeated.items() if share >= (max(bound, INSIDE) if in_article(self.elements[k][0]) else bound)}
        self.few = few if self.is_minor([self.elements[k] for k in few]) else set()

    def is_minor(self, parts: Iterable[tuple]) -> bool:
        """Whether elements' own text, outside elements that serve something else, is less than `most` of the host's prose."""
        prose = lambda xs: sum(chars - links for p, _, _, chars, links in xs if not is_aside(p))
        found = prose(parts)
        return not found or found < self.most * prose(self.elements.values())

    def valid(self, vector: int) -> bool:
        """Whether a class nests: it stands in slots of one class, or is the outermost."""
        return len({self.elements[e][1] for e in self.slots.get(vector, ())}) <= 1

    def own_texts(self) -> set[int]:
        """Text tokens that are the template's: on nearly all pages, or of the valid class of their element, outside articles.

        Elements with few values are the template's whatever they say, so their texts aren't listed.
        """
        out = set()
        for key, (e, vector, n, *_) in self.texts.items():
            path = self.elements[e][0]
            with_element = vector == self.elements[e][1] and self.valid(vector) and n >= OPTIONAL * self.pages and not in_article(path)
            if e not in self.few and n >= self.least and (n >= ALWAYS * self.pages or with_element):
                out.add(key)
        parts = [(self.elements[self.texts[k][0]][0], *self.texts[k][1:]) for k in out]
        return out if self.is_minor([*parts, *[self.elements[k] for k in self.few]]) else set()

    def contents(self, own: set[int]) -> dict[str, tuple[int, int]]:
        """(characters, link characters) beyond the template's text of each slot: an element with such contents, or one beside it."""
        fixed: dict[int, list[int]] = {}
        for key in own:
            e, _, _, chars, links = self.texts[key]
            f = fixed.setdefault(e, [0, 0])
            f[0] += chars
            f[1] += links
        left, inside = {}, {}
        for k, (p, _, _, chars, links) in self.elements.items():
            c, l = (chars, links) if k in self.few else fixed.get(k, (0, 0))
            left[p] = (chars - c, links - l)
            at = p
            while True:
                total = inside.setdefault(at, [0, 0])
                total[0] += chars
                total[1] += chars - c
                if not at:
                    break
                at = at.rpartition("/")[0]
        varies = {p for p, (chars, new) in inside.items() if new > VARIES * chars}
        return {p: x for p, x in left.items() if p and (p in varies or p.rpartition("/")[0] in varies)}


def judged(contents: dict[str, tuple[int, int]]) -> list[str]:
    """Paths of the slots that stay, of all slots' contents."""
    slots = {p: x for p, x in contents.items() if not is_aside(p)}
    if any(in_article(p) for p in slots):
        return sorted(p for p in slots if in_article(p))
    # No element says article: the container with most text that isn't links, and every slot inside it.
    totals: dict[str, int] = {}
    for p, (c, k) in slots.items():
        if k <= LINKS * c:
            parent = p.rpartition("/")[0] or p
            totals[parent] = totals.get(parent, 0) + c - k
    if not totals:
        return []
    best = max(sorted(totals), key=totals.get)
    return sorted(p for p, (c, k) in slots.items() if (p.startswith(best + "/") or p == best) and k <= LINKS * c)


TEMPLATE = T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in (("slots", T.StringType()), ("gone", T.StringType()), ("own", T.LongType()), ("few", T.StringType()))])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: int = 2, repeats: float = 0.25, most: float = 0.5) -> DataFrame:
    """(host, template): for each host with a name (as a hash) the slots that stay, those that go, the template's own text tokens, and
    the slots that take few values."""
    key = F.xxhash64(F.col(url_col), F.col(html_col))
    host = host_of(F.col(url_col))
    found = pages.where(host != "").select(F.xxhash64(host).alias("host"), key.alias("page"), page_tokens(F.col(html_col)).alias("t"))
    arrays = [F.col(f"t.{f.name}") for f in TOKEN_FIELDS if isinstance(f.dataType, T.ArrayType)]
    tokens = found.select("host", "page", "t.longest", F.explode(F.arrays_zip(*arrays)).alias("t")).select("host", "page", "longest", "t.*")
    # A token is on a page once at most, so equal occurrence vectors have equal exclusive-ors of page hashes, summed in any order.
    summed = cut(
        tokens.groupBy("host", "key")
        .agg(
            F.bit_xor("page").alias("vector"), F.count("*").alias("n"), F.max("path").alias("path"), F.max("element").alias("element"), F.sum("chars").alias("chars"),
            F.sum("links").alias("links"), (F.min("longest") != F.max("longest")).alias("apart"),
        )
        .where((F.col("apart") & (F.col("n") >= least)) | F.col("path").isNotNull())
        .drop("apart")
    )
    shared = summed.where("path is null").groupBy("host", F.col("element").alias("key")).agg(F.sum("chars").alias("shared"))
    counts = summed.where("path = ''").select("host", F.col("n").alias("pages"))
    few = counts.count() <= BROADCAST_HOSTS
    often = summed.join(F.broadcast(counts) if few else counts, "host").where(F.col("n") >= F.when(F.col("path").isNull(), OPTIONAL).otherwise(SUPPORT) * F.col("pages"))
    often = often if few else often.repartition("host", "key")  # the join may then split a host's rare tokens
    often = often.join(shared, ["host", "key"], "left")  # a text's key is no element's
    members = often.groupBy("host").agg(F.collect_list(F.struct("vector", "n", "path", "key", "element", "chars", "links", "shared")).alias("tokens"))

    @F.pandas_udf(TEMPLATE)
    def deduce(rows: pd.Series) -> pd.DataFrame:
        out = []
        for row in rows:
            found = [tuple(m.values()) for m in row]
            t = Template([m[:7] for m in found], {m[3]: m[7] for m in found if m[2] is not None and m[7]}, least, repeats, most)
            own = t.own_texts()
            slots = judged(t.contents(own))
            out.append((slots, sorted({x[0] for x in t.elements.values()} - {""} - set(slots)), sorted(own), sorted(t.elements[k][0] for k in t.few)))
        return pd.DataFrame(out, columns=TEMPLATE.names)

    return members.select("host", deduce("tokens").alias("template"))


class Kept:
    """Which blocks of a host's pages are main text: by the innermost element of theirs that the template has."""

    def __init__(self, slots: list[str], gone: list[str], own: list[int], few: list[str] | None = None):
        self.slots, self.gone, self.own, self.few = frozenset(slots), frozenset(gone), frozenset(own), frozenset(few or ())
        self.article = any(in_article(p) for p in slots)
        self.decided: dict[str, bool] = {}

    def stays(self, path: str) -> bool:
        if path not in self.decided:
            if len(self.decided) > 10_000:
                self.decided.clear()
            at = path
            while at and at not in self.slots and at not in self.gone:
                at = at.rpartition("/")[0]
            # An element too rare for the template stands in a slot that stays, or in an element with such slots: it belongs to it.
            rare = at != path and not is_aside(path) and (in_article(path) if self.article else any(p == at or p.startswith(at + "/") for p in self.slots))
            self.decided[path] = path in self.slots or rare
        return self.decided[path]


def without_template(found: list[tuple[str, str, int, int]], new: list[bool], nodes: list[tuple[int, str]]) -> list[str]:
    """The texts of a page's blocks without those that are the template's: whole containers that say nothing new, and what stands before
    and after all that is new in the container of the new, unless that is in an article."""
    said = [False] * len(nodes)
    for (_, _, _, node), is_new in zip(found, new, strict=True):
        while is_new and node >= 0 and not said[node]:
            said[node] = True
            node = nodes[node][0]
    holder = lambda node: node if nodes[node][1] in CONTAINERS else nodes[node][0]
    kept = [(t, n, is_new, in_article(p)) for (p, t, _, n), is_new in zip(found, new, strict=True) if is_new or said[max(holder(n), 0)]]
    depth = [0] * len(nodes)
    for i, (parent, _) in enumerate(nodes[1:], 1):
        depth[i] = depth[parent] + 1
    # The innermost element that holds all that is new: elements are numbered as they open, so those that hold all are a chain downwards.
    held = [0] * len(nodes)
    for _, node, is_new, _ in kept:
        held[max(holder(node), 0)] += is_new
    for i in range(len(nodes) - 1, 0, -1):
        held[nodes[i][0]] += held[i]
    common = max(i for i, n in enumerate(held) if n == held[0])
    edge = lambda x: not x[2] and not x[3] and depth[max(holder(x[1]), 0)] <= depth[common]
    while kept and edge(kept[0]):
        kept.pop(0)
    while kept and edge(kept[-1]):
        kept.pop()
    return [t for t, *_ in kept]


def page_text(page: str | None, template: Kept | None) -> str:
    """The main text of a page: the new text of the host's slots, or, where it has none there, the page's own slots as judged alone."""
    nodes: list[tuple[int, str]] = []
    found = list(blocks(page, nodes))
    if template is not None:
        seen: dict[int, int] = {}
        new = [text_key(p, t, seen) not in template.own and p not in template.few for p, t, *_ in found]
        stays = [template.stays(p) for p, *_ in found]
        if any(map(bool.__and__, new, stays)):
            return "\n".join(without_template([f for f, s in zip(found, stays, strict=True) if s], [n for n, s in zip(new, stays, strict=True) if s], nodes))
        found = [f for f, n in zip(found, new, strict=True) if n]
    chars: dict[str, list[int]] = {}
    for p, t, k, _ in found:
        c = chars.setdefault(p, [0, 0])
        c[0] += len(t)
        c[1] += min(k, len(t))
    own = set(judged({p: (c, k) for p, (c, k) in chars.items()}))
    return "\n".join(t for p, t, *_ in found if p in own)


def extract(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", least: int = 2, repeats: float = 0.25, most: float = 0.5
) -> DataFrame:
    """pages with the main text of each; `least`, `repeats` and `most` are the evidence on text described above."""
    found = cut(templates(pages, url_col, html_col, least, repeats, most)).select(F.col("host").alias("_host"), F.col("template").alias("_template"))
    length = F.aggregate(F.concat("template.slots", "template.gone", "template.few"), F.lit(0).cast("long"), lambda n, p: n + F.length(p)) + 8 * F.size("template.own")
    size = found.select(F.col("_template").alias("template")).agg(F.sum(length)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_CHARS else found

    @F.pandas_udf(T.StringType())
    def run(html: pd.Series, hosts: pd.Series, template: pd.DataFrame) -> pd.Series:
        held: dict[int, Kept] = {}
        out = []
        for i, (h, host) in enumerate(zip(html, hosts, strict=True)):
            slots = template["slots"].iat[i]
            if slots is not None and host not in held:
                held[host] = Kept(*[list(template[n].iat[i]) for n in TEMPLATE.names])
            out.append(page_text(h, None if slots is None else held[host]))
        return pd.Series(out)

    rows = pages.select(F.struct("*").alias("_row"), F.xxhash64(host_of(F.col(url_col))).alias("_host"))
    joined = rows.join(found, "_host", "left")
    text = run(F.col("_row")[html_col], F.col("_host"), F.col("_template")).alias(text_col)
    return joined.select(*[F.col("_row")[c].alias(c) for c in pages.columns if c != text_col], text)


def digest(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
