"""Main text of pages by equivalence-class template deduction.

The pages of a host are read as tokens: each place of the page tree (a path of block elements with their class and id)
and each text at its place. A token's occurrence vector says how often it occurs on each page of the host. It is never
built: two sums of hashes of (page, count) and the number of pages stand for it, and add up task by task, so a host with
a third of all pages is a few partial sums. Tokens with equal vectors form a class; a class is valid if it occurs on
enough of the host's pages and has two tokens or more, or a place.

Valid classes nest into the host's template, those of most pages first: tokens of a class that fall into one gap between
the tokens around them belong together, and a text that falls into a gap alone is no template. On a page a class counts
only if its texts stand there in the class's order. What is between the tokens are the slots.

Slots have the role of the elements around them: menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are no content. Of the others the host's main slot is taken: articles, else main areas, else elements named
as content, else every slot whose text isn't mostly links. Each page's text is what fills these slots, in order, less
the template's texts. Of an article those go that have their place to themselves (FILLED); a line that recurs among the
article's own, at one place with them, is the article's. Where they are most of an article's text (ARTICLE_SHARE), the
host's pages are copies of one article rather than different ones in one frame, and the article stays whole.

Defined results: null and empty html and pages without content have empty text; pages of hosts with too few pages for
a template, and pages that don't have the host's main slot, are read by the roles of their own elements; a null url
is a host of its own; repeated rows are pages of their own; unclosed, misnested and stray markup is read leniently; no
text is cut. Result columns replace columns of the input of their names; other columns stay, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import checkpointed, in_chunks, renamed

#: A valid class occurs on this many pages of its host, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 4, 0.5
#: Template texts go from articles in which other text has this share of the characters, and from places of which
#: template texts have that share.
ARTICLE_SHARE, FILLED = 1 / 3, 0.9
#: Templates up to this size in all are broadcast; beyond it pages are joined to them by host.
BROADCAST_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HEADING = re.compile(r"(^|>)(h[1-6]|hgroup)\b[^>]*(>[^>]*)?$")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in "script style textarea title xmp noembed noframes".split()}
#: Their text is dropped wherever they stand.
SILENT = frozenset("script style textarea title noscript template iframe object svg math canvas video audio button select datalist label meter progress map xmp noembed noframes".split())
#: Block elements that are no content; a header inside an article belongs to it.
NO_CONTENT = frozenset("head nav footer aside form menu dialog fieldset legend option optgroup".split())
CLOSES_P = BLOCKS - frozenset("body html head caption dd dt li tbody td tfoot th thead tr option optgroup legend summary".split())
CLOSES_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div main body".split())
#: Parts of class, id and role names that say an element is no content.
NO_CONTENT_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation navi menu menubar breadcrumb breadcrumbs sidebar rail aside complementary footer foot contentinfo masthead topbar comment comments commentlist reply replies respond discussion disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog subscribe subscription newsletter signup signin login search social share sharing related recommended recommendations widget pagination pager paging toolbar skip legal copyright disclaimer side announcement warning toast responses feedback tags".split()
)
#: Elements that their names don't put out, but for articles that are reader comments.
WHOLE_PAGE, COMMENTS = frozenset("html body main article".split()), frozenset("comment comments commentlist reply replies respond responses discussion disqus feedback".split())
#: Smaller elements that hold this share of a page's text, or an article or main, aren't put out by their names either.
FREE_SHARE = 0.5
HEADER_NAMES = frozenset("header head".split())
CONTENT_NAMES = frozenset("article post entry story content main text".split())


@lru_cache(maxsize=20_000)
def element(tag: str, attributes: str) -> tuple[str, bool, bool, int, bool, bool]:
    """(label in paths, whether it is no content, whether it is a header, level as content: 3 article … 0 none, whether
    only names say that it is no content, whether it is of reader comments)."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    named = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    # Both as written in parts and as one word: "side-bar" is a sidebar.
    whole = {n.lower() for n in named.split()}
    parts = {p.lower() for p in NAME_PARTS.findall(named)} | {re.sub("[^a-z]", "", n.lower()) for n in named.split()}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    comments = bool((whole if tag in WHOLE_PAGE else parts) & COMMENTS) and tag not in ("html", "body", "main")
    named_out = comments if tag in WHOLE_PAGE else bool(parts & NO_CONTENT_NAMES)
    hard = tag in NO_CONTENT or hidden
    header = tag == "header" or (bool(parts & HEADER_NAMES) and tag not in WHOLE_PAGE)
    level = 0
    if tag == "article" or found.get("itemprop", "").lower() == "articlebody" or found.get("role") == "article":
        level = 3
    elif tag == "main" or found.get("role") == "main":
        level = 2
    elif parts & CONTENT_NAMES and tag not in ("body", "html"):
        level = 1
    label = tag + "".join(f".{c}" for c in sorted(found.get("class", "").split())) + (f"#{found['id']}" if "id" in found else "")
    return label, hard or named_out, header, level, not hard and tag != "header", comments


class Unit:
    """A block's text: path, text, characters in links, whether it is no content, level as content."""

    __slots__ = ("path", "text", "links", "out", "level")

    def __init__(self, path: str, text: str, links: int, out: bool, level: int) -> None:
        self.path, self.text, self.links, self.out, self.level = path, text, links, out, level


def units_of(html: str) -> list[Unit]:
    """The blocks of a page that have text, in order."""
    units: list[Unit] = []
    buffer: list[str] = []
    #: tag, label (None: not a block), out, level, silent, number if only names put it out (else 0)
    stack: list[tuple[str, str | None, bool, int, bool, int]] = []
    #: By number: whether it holds an article or main, whether it is of reader comments. By unit: the numbers around it.
    holds, of_comments, around = [True], [False], []
    silent = anchors = links = 0
    out, level, path = False, 0, ""

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                units.append(Unit(path, text, links, out, level))
                around.append([e[5] for e in stack if e[5]])
            buffer.clear()
        links = 0

    def settle() -> None:
        nonlocal out, level, path
        out = any(e[2] and not e[5] for e in stack)
        level = max((e[3] for e in stack), default=0)
        path = ">".join(e[1] for e in stack if e[1] is not None)

    def pop(to: int) -> None:
        nonlocal silent, anchors
        if any(e[1] is not None for e in stack[to:]):
            flush()
        for e in stack[to:]:
            silent -= e[4]
            anchors -= e[0] == "a"
        del stack[to:]
        settle()

    def last(tags: Iterable[str], scopes: frozenset[str] = frozenset()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in scopes:
                break
        return -1

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        begin = m.start() if m else n
        if begin > at and not silent:
            piece = html[at:begin]
            buffer.append(piece)
            if anchors:
                links += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            i = last((tag,), frozenset(("article", "td", "th")) - {tag} if tag not in BLOCKS else frozenset())
            if i >= 0:
                pop(i)
            elif tag in BLOCKS:
                flush()
            continue
        block = tag in BLOCKS
        if block:
            if stack and tag not in ("head", "html") and (i := last(("head",))) >= 0:
                pop(i)
            if tag in CLOSES_P and (i := last(("p",), frozenset(("td", "th", "li", "article", "section")))) >= 0:
                pop(i)
            if tag in CLOSES_LIKE and (i := last(CLOSES_LIKE[tag], SCOPES)) >= 0:
                pop(i)
            flush()
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input") and not silent:
                buffer.append(" " if tag != "wbr" else "")
            continue
        attributes = m[3] or ""
        if tag in RAW:
            end = RAW[tag].search(html, at)
            at = end.end() if end else n
            continue
        label, no_content, header, own, by_name, comments = element(tag, attributes)
        no_content = no_content or (header and level < 3 and own < 3)
        number = 0
        if block and no_content and by_name:
            number = len(holds)
            holds.append(False)
            of_comments.append(comments)
        elif own >= 2 and not no_content:
            for e in stack:
                holds[e[5]] = True
        quiet = tag in SILENT or (not block and no_content)
        if attributes.rstrip().endswith("/") and not block:
            continue
        stack.append((tag, label if block else None, no_content, own, quiet, number))
        silent += quiet
        anchors += tag == "a"
        if block:
            settle()
    flush()
    sizes: Counter = Counter()
    for u, numbers in zip(units, around):
        if not u.out:
            sizes.update({k: len(u.text) for k in [0, *numbers]})
    free = {k for k in range(len(holds)) if not of_comments[k] and (holds[k] or sizes[k] >= FREE_SHARE * sizes[0])}
    for u, numbers in zip(units, around):
        u.out = u.out or any(k not in free for k in numbers)
    return units


def key_of(*parts: str | bytes) -> int:
    return xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))


# ------------------------------------------------------------------------------------------ occurrence vectors

TOKEN_SCHEMA = "host string, token long, path string, is_text boolean, vector0 long, vector1 long, pages long, places long, chars long, links long, level int, out boolean"
SUMS = ("vector0", "vector1", "pages", "places", "chars", "links")


def scan_tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of a task's pages by host: sums that stand for occurrence vectors, pages and characters."""
    sums: dict[tuple, list[int]] = defaultdict(lambda: [0] * len(SUMS))

    def put() -> pa.RecordBatch:
        rows = [(k[0], _signed(k[1]), *k[2:4], *v, *k[4:]) for k, v in sums.items()]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * len(SUMS), pa.int32(), pa.bool_())
        names = [f.split()[0] for f in TOKEN_SCHEMA.split(", ")]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        sums.clear()
        return made

    for batch in in_chunks(batches, "html", CHUNK_BYTES):
        for host, page, html in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
            for token, (count, place, chars, links) in page_tokens(units_of(html)).items():
                held = sums[(host, *token)]
                cell = key_of(page, str(count))
                for i, x in enumerate((cell >> 32, cell & 0xFFFFFFFF, 1, place, chars, links)):
                    held[i] += x
        if len(sums) > 100_000:
            yield put()
    if sums:
        yield put()


def page_tokens(units: list[Unit]) -> dict[tuple, list[int]]:
    """(token, path, whether it is a text, level, whether it is no content) of a page, with how often it occurs, its
    first place, and its characters in all and in links."""
    found: dict[tuple, list[int]] = {}
    for at, u in enumerate(units):
        place = (key_of("path", u.path), u.path, False, u.level, u.out)
        text = (text_key(u), u.path, True, u.level, u.out)
        for own in (found.setdefault(place, [0, 2 * at, 0, 0]), found.setdefault(text, [0, 2 * at + 1, 0, 0])):
            own[0] += 1
            own[2] += len(u.text)
            own[3] += min(u.links, len(u.text))
    return found


def text_key(u: Unit) -> int:
    return key_of("text", u.path, u.text)


_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def classes_of(pages: DataFrame) -> DataFrame:
    """(host, class, pages, members): the valid classes of each host, from pages (host, page, html)."""
    scanned = pages.mapInArrow(scan_tokens, TOKEN_SCHEMA)
    sums = scanned.groupBy("host", "token", "path", "is_text", "level", "out").agg(*(F.sum(c).alias(c) for c in SUMS))
    sizes = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    frequent = sums.where(F.col("pages") >= LEAST_PAGES).join(sizes, "host").where(F.col("pages") >= LEAST_SHARE * F.col("host_pages"))
    member = F.struct((F.col("places") / F.col("pages")).alias("place"), "token", "path", "is_text", "chars", "links", "level", "out")
    classes = frequent.groupBy("host", "vector0", "vector1", "pages").agg(F.array_sort(F.collect_list(member)).alias("members"))
    # A text needs another token with its vector; a place is its own proof, having an opening and an end.
    valid = classes.where((F.size("members") > 1) | F.exists("members", lambda m: ~m["is_text"]))
    return valid.select("host", F.xxhash64("vector0", "vector1", "pages").alias("class"), "pages", "members")


def templates(pages: DataFrame) -> DataFrame:
    """(host, classes): the valid classes of each host, those of most pages first."""
    return classes_of(pages).groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("pages"), (-F.size("members")).alias("size"), "class", "members"))).alias("classes"))


def nested(classes: list[dict]) -> list[list[dict]]:
    """The parts of the classes, as lists of members in order, that nest: each lies in one gap of those before it."""
    bounds: list[float] = []
    parts: list[list[dict]] = []
    for c in classes:
        by_gap: dict[int, list[dict]] = defaultdict(list)
        for m in c["members"]:
            by_gap[bisect_left(bounds, m["place"])].append(m)
        kept = [p for p in by_gap.values() if len(p) > 1 or not p[0]["is_text"]]
        parts += kept
        bounds = sorted([*bounds, *(m["place"] for p in kept for m in p)])
    return parts


class Template:
    """A host's template: the texts that belong to it, the level of its main slot and its places of links."""

    def __init__(self, classes: list[dict] | None) -> None:
        parts = nested(classes or [])
        #: The part of each text, and its number in the part.
        self.texts = {m["token"] & _ALL: (k, i) for k, p in enumerate(parts) for i, m in enumerate(p) if m["is_text"]}
        slots = [m for p in parts for m in p if not m["is_text"] and not m["out"]]
        whole = sum(t["chars"] for t in slots)
        self.level = max((t["level"] for t in slots if 5 * sum(s["chars"] for s in slots if s["level"] >= t["level"]) >= whole), default=None)
        #: Places whose text is mostly links on the host's pages, or not.
        self.linked = {t["path"]: 2 * t["links"] > t["chars"] for t in slots}
        said: Counter = Counter()
        for m in (m for p in parts for m in p if m["is_text"]):
            said[m["path"]] += m["chars"]
        #: Places that have the template's texts to themselves, but for headings, which name what they head.
        self.filled = {t["path"] for t in slots if said[t["path"]] >= FILLED * t["chars"] and not HEADING.search(t["path"])}

    def fresh(self, units: list[Unit]) -> list[bool]:
        """Which units of a page are not the template's: a part's texts are if they stand here in its order."""
        where = [self.texts.get(text_key(u)) for u in units] if self.texts else [None] * len(units)
        last: dict[int, int] = {}
        broken, seen = set(), set()
        for at in where:
            if at is None or at in seen:
                continue
            seen.add(at)
            if at[1] < last.get(at[0], -1):
                broken.add(at[0])
            last[at[0]] = at[1]
        return [at is None or at[0] in broken for at in where]


def main_text(units: list[Unit], template: Template) -> str:
    """The text of the main slot of one page."""
    content = [(u, f) for u, f in zip(units, template.fresh(units)) if not u.out]
    best = max((u.level for u, _ in content), default=0)
    wanted = best if template.level is None else min(template.level, best)
    fresh = [u for u, f in content if f]
    if wanted > 0:
        whole = [u for u, _ in content if u.level >= wanted]
        picked = [u for u, f in content if u.level >= wanted and (f or (wanted == 3 and u.path not in template.filled))] or whole
        if wanted == 3 and sum(len(u.text) for u in picked) < ARTICLE_SHARE * sum(len(u.text) for u in whole):
            picked = whole
    else:
        picked = [u for u in fresh if not template.linked.get(u.path, 2 * u.links > len(u.text))]
    return "\n\n".join(u.text for u in picked)


def extract(pages: DataFrame, url_column: str = "url", html_column: str = "html", id_column: str = "page_id", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of every page with text and n_chars."""
    added = {"text": T.StringType(), "n_chars": T.LongType()}
    keep = [c for c in (pages.columns if keep is None else keep) if c not in added]
    host = F.coalesce(F.lower(F.regexp_extract(url_column, r"^[a-zA-Z][-a-zA-Z0-9+.]*://([^/?#]+)", 1)), F.lit(""))
    html = F.coalesce(F.col(html_column).cast("string"), F.lit(""))
    page = F.coalesce(F.col(id_column).cast("string"), F.lit("")) if id_column in pages.columns else F.lit("")
    known = checkpointed(templates(pages.select(host.alias("host"), F.concat_ws("\n", page, F.col(url_column)).alias("page"), html.alias("html"))))
    size = known.agg(F.sum(F.aggregate("classes", F.lit(0).cast("long"), lambda a, c: a + F.aggregate(c["members"], F.lit(0).cast("long"), lambda b, t: b + F.length(t["path"]) + 72)))).first()[0] or 0
    fields = [pages.schema[c] for c in keep]
    columns, own = renamed(pages, keep)
    rows = pages.select(*columns, host.alias("host"), html.alias("html"))
    ins = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left").select(*own, "host", "html", "classes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Template] = {}
        for batch in in_chunks(batches, "html", CHUNK_BYTES):
            hosts = batch.column("host").to_pylist()
            classes = batch.column("classes")
            if len(held) > 2000:
                held.clear()
            for i, h in enumerate(hosts):
                if h not in held:
                    held[h] = Template(classes[i].as_py())
            texts = [main_text(units_of(x), held[h]) for h, x in zip(hosts, batch.column("html").to_pylist())]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.select(own).columns, *made], names=[*keep, *added])

    return ins.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, k) for n, k in added.items())]))
