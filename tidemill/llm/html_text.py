"""Main text of web pages by template deduction from equivalence classes of tokens."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEND_BYTES, drop, join_hot, keep, send_if_small

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|canvas|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*[\"']?\s*([^\s\"'>/]+)", re.I)
#: Elements without content, elements within a line, and elements that are no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOISE = frozenset("nav header footer aside form button select menu dialog head fieldset".split())
#: Names (class, id, role) of menus, headers, footers, sidebars, notices, adverts, forms and reader comments; and what such a name may be put together with.
NOISE_NAMES = frozenset("ad ads adv advert advertisement banner sponsor sponsored promo navigation nav navbar menu menubar breadcrumb breadcrumbs header masthead footer contentinfo sidebar complementary cookie cookies consent notice notices gdpr popup newsletter subscribe subscription signup login comment comments disqus reply replies respond search".split())
PLACES = frozenset("area bar block bottom box container first form group inner item items last left link links list main outer panel primary right secondary section slot text thread top unit widget wrap wrapper".split())
#: Elements that hold the page or the article: their names tell of a state, as in ``nav-open``, and make no noise of them.
WHOLE = frozenset("html body main article".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES_ITSELF = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",), "dt": ("dl",), "dd": ("dl",)}

#: A class of a template has so many tokens at least, is on so many different pages of a host and such a share of them: more than the third that a
#: group of copies may hold. Its texts are less than this part of all text on its pages, else it is what copies share.
MIN_CLASS, MIN_PAGES, MIN_SHARE, MAX_TEXT = 2, 8, 0.4, 0.5
#: On pages without an article element: a slot goes whose text is less than such a part of that of the host's largest slot and comes again on other pages, so
#: that there are at most so many different texts for each one found; headings stay.
MIN_SLOT, MAX_DIFFERENT = 0.1, 0.75


def _noise_name(name: str) -> bool:
    """A name of the list as a whole, or one put together with others of it and with places: ``ad-slot``, ``cookie_notice``; not ``ad-hoc``."""
    first, *more = re.split("[-_]+", name)
    return first in NOISE_NAMES and all(x in NOISE_NAMES or x in PLACES or x.isdigit() for x in more)


def _is_noise(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in WHOLE:
        return False
    if tag in NOISE and not (tag == "header" and in_article):
        return True
    if "=" in attrs:
        for m in _NAMED.finditer(attrs):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                if _noise_name(name) and not (in_article and name.startswith("header")):
                    return True
    return False


def parse(page: str, slots=frozenset()):
    """Blocks of text in page order (path, text, noise, within an article, slot, heading), and the paths of all tags that hold blocks or tags.

    A path is a hash of the path above and a tag with its class, so its size doesn't grow with the depth. The slot of a block is the innermost path around it
    that ``slots`` has (else 0); ``heading``: whether that is a heading's.
    """
    stack: list[tuple[str, tuple]] = []  # tag, state of what it holds
    held: Counter = Counter()  # open tags by name
    blocks, tags, text = [], [], []
    state = (0, False, False, 0, False)  # path, noise, article, slot, heading

    def flush():
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                blocks.append((state[0], whole, *state[1:]))
            text.clear()

    def cut(k: int):
        held.subtract(x for x, _ in stack[k:])
        del stack[k:]

    def pop(k: int):
        nonlocal state
        flush()
        cut(k)
        state = stack[-1][1] if stack else (0, False, False, 0, False)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
        elif m["end"]:
            if held[tag] > 0:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        marked = tag in INLINE and any(x[1] for _, x in stack[k:]) and not (k and stack[k - 1][1][1])
                        if tag in INLINE and not marked:
                            cut(k)
                        else:
                            pop(k)  # what follows a marked stretch of a line is text again
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in INLINE:
            if not state[1] and _is_noise(tag, m["attrs"], state[2]):
                flush()
                state = (state[0], True, *state[2:])
            stack.append((tag, state))
            held[tag] += 1
        else:
            flush()
            if tag in _CLOSES_P and held["p"] > 0:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            elif tag in _CLOSES_ITSELF and held[tag] > 0:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if stack[k][0] in _CLOSES_ITSELF[tag]:
                        break
            path, noise, article, slot, heading = state
            noise = noise or _is_noise(tag, m["attrs"], article)
            article = article or tag in ("article", "main") or 'role="main"' in m["attrs"]
            named = _CLASS.search(m["attrs"])
            path = _key(path, f"{tag}.{named[1]}" if named else tag)
            if path in slots:
                slot, heading = path, tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            state = (path, noise, article, slot, heading)
            stack.append((tag, state))
            held[tag] += 1
            tags.append(path)
    if at < len(page):
        text.append(page[at:])
    flush()
    return blocks, tags


def _key(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - 2**63


def slots_of(page: str, texts=frozenset(), tags=frozenset()) -> tuple[bool, list[tuple[int, bool, str]]]:
    """Whether a page has an article (or main) element, and its slots: blocks (slot, heading, text) that neither the template (``texts``, ``tags``) nor marked regions hold."""
    kept = [b for b in parse(page, tags)[0] if not b[2]]
    marked = any(b[3] for b in kept)
    return marked, [(slot, heading, text) for path, text, _, article, slot, heading in kept if (article or not marked) and not (texts and _key(path, text) in texts)]


def main_text(page: str) -> str:
    """The text of a page whose host has no template."""
    return "\n".join(text for *_, text in slots_of(page)[1])


_TOKENS = "host string, token long, page long, part long, place int, chars long, page_chars long"


def page_tokens(pages: DataFrame) -> DataFrame:
    """A row for each different token of a page, and one (token 0) for the page.

    Tokens are tags with their paths (no length) and texts with theirs (``chars``: their length). ``part`` tells how often
    the page holds it, ``place`` where first. A page stands by a hash of its content, so copies count once.
    """

    def tokens(batches):
        for batch in batches:
            rows = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                blocks, tags = parse(page)
                one = xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))
                found: dict = {}
                for path in tags:
                    found.setdefault(path, [0, len(found), None])[0] += 1
                for path, text, *_ in blocks:
                    found.setdefault(_key(path, text), [0, len(found), len(text)])[0] += 1
                rows.append((host, 0, one - 2**63, 0, 0, None, sum(len(b[1]) for b in blocks)))
                rows += [(host, k, one - 2**63, (xxhash.xxh64_intdigest(f"{one}/{n}") >> 24) - 2**39, place, chars, None) for k, (n, place, chars) in found.items()]
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in _TOKENS.split(", ")])

    return pages.select("host", "html").filter("html != ''").mapInArrow(tokens, _TOKENS)


def templates(pages: DataFrame) -> DataFrame:
    """host, texts (keys of the texts of its template) and tags (keys of its tags).

    A token's occurrence vector over the different pages of its host is held as a sum of hashes of (page, count), so it is built by partial
    sums and no host is ever gathered, however many pages it has. Tokens with equal vectors form a class. A class is valid if it has enough tokens,
    enough pages of the host, if its tokens come in one order on all its pages, and if its texts are not the bulk of them. Valid classes nest by
    their paths (a tag is wherever a token below it is) and together are the template, whose tags part a page into slots.
    A page has a bounded number of tokens, of which at most 1 / MIN_SHARE times as many can be in the template, so arrays are bounded too.
    """
    rows = keep(page_tokens(pages).dropDuplicates(["host", "token", "page"]), "page-tokens")
    seen = rows.groupBy("host", "token").agg(F.sum("part").alias("vector"), F.count(F.lit(1)).alias("support"), F.sum("chars").alias("chars"))
    seen = keep(seen.filter(f"support >= {MIN_PAGES}"), "tokens")
    hosts = send_if_small(keep(seen.filter("token = 0").select("host", F.col("support").alias("pages")), "hosts"))
    frequent = seen.filter("token != 0").join(hosts, "host").filter(F.col("support") >= F.col("pages") * MIN_SHARE)
    frequent = keep(frequent.select("host", "token", "vector", "support", "chars"), "frequent")
    # the order of a class's tokens, and the text of its pages
    classes = frequent.groupBy("host", "vector", "support").agg(F.count(F.lit(1)).alias("size"), F.sum(F.coalesce("chars", F.lit(0))).alias("chars")).filter(F.col("size") >= MIN_CLASS)
    members = keep(frequent.join(classes.select("host", "vector", F.col("chars").alias("class_chars")), ["host", "vector"]).select("host", "token", "vector", "chars", "class_chars"), "members")
    placed = join_hot(rows.filter("token != 0").select("host", "token", "page", "place"), members.select("host", "token", "vector"), ["host", "token"], ["page"])
    order = F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]))
    orders = keep(placed.groupBy("host", "vector", "page").agg(order.alias("o")), "orders")
    sizes = rows.filter("token = 0").select("host", "page", "page_chars")
    whole = join_hot(orders, sizes, ["host", "page"], ["vector"]).groupBy("host", "vector").agg(F.min("o").alias("o1"), F.max("o").alias("o2"), F.sum("page_chars").alias("page_chars"))
    valid = members.join(whole.filter("o1 = o2"), ["host", "vector"]).filter(F.col("class_chars") <= F.col("page_chars") * MAX_TEXT)
    of = valid.groupBy("host").agg(*[F.collect_list(F.when(F.col("chars").isNotNull() == text, F.col("token"))).alias(name) for name, text in (("texts", True), ("tags", False))])
    found = keep(of, "templates")
    drop(rows, seen, frequent, members, orders)
    return found


_SLOTS = "page_id long, url string, host string, page long, marked boolean, blocks array<struct<slot:long,heading:boolean,text:string>>"


def page_slots(pages: DataFrame, found: DataFrame, send_bytes: int) -> DataFrame:
    """The slots of every page by the template of its host: see :func:`slots_of`. ``page`` is a hash of its content."""
    size = sum(F.coalesce(F.size(c), F.lit(0)) for c in ("texts", "tags"))
    few = 8 * (found.agg(F.sum(size)).first()[0] or 0) <= send_bytes
    joined = pages.join(F.broadcast(found), "host", "left") if few else join_hot(pages, found, "host", ["page_id", "url"], "left")
    kind = pa.list_(pa.struct([("slot", pa.int64()), ("heading", pa.bool_()), ("text", pa.string())]))

    def part(batches):
        known: dict = {}
        for batch in batches:
            out = []
            for k, (h, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = [frozenset(batch.column(c)[k].as_py() or ()) for c in ("texts", "tags")]
                marked, blocks = slots_of(page, *known[h])
                one = xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass")) - 2**63
                out.append((one, marked, [{"slot": x, "heading": y, "text": z} for x, y, z in blocks]))
            columns = list(zip(*out)) if out else [[]] * 3
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), kind))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), *made], [x.split()[0] for x in _SLOTS.split(", ", 5)])

    return joined.select("page_id", "url", "host", "html", "texts", "tags").mapInArrow(part, _SLOTS)


def repeated_slots(parts: DataFrame) -> DataFrame:
    """host and out: slots of pages without an article element that hold little text, and texts that come again on other pages of the host.

    Different pages of a host count, so copies of one do not repeat a text. Sums are made before any shuffle but of texts' hashes.
    """
    blocks = parts.filter("NOT marked").select("host", "page", F.explode("blocks").alias("b")).select("host", "page", "b.slot", "b.heading", F.length("b.text").cast("long").alias("chars"), F.xxhash64("b.text").alias("text"))
    texts = blocks.groupBy("host", "slot", "text", "page").agg(F.max("heading").alias("heading"), F.max("chars").alias("chars"))
    texts = texts.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"), F.max("heading").alias("heading"), F.sum("chars").alias("chars"))
    slots = keep(texts.groupBy("host", "slot").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("n"), F.max("heading").alias("heading"), F.sum("chars").alias("chars")), "slots")
    largest = slots.groupBy("host").agg(F.max("chars").alias("most"))
    small = slots.join(largest, "host").filter((F.col("chars") < F.col("most") * MIN_SLOT) & (F.col("different") <= F.col("n") * MAX_DIFFERENT) & ~F.col("heading"))
    return small.groupBy("host").agg(F.collect_list("slot").alias("out"))


def extract_main_text(pages: DataFrame, send_bytes: int = SEND_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Marked regions (menus, headers, footers, sidebars, notices, adverts, forms, comments: by element
    or by class, id or role), scripts and styles are left out; if a page has an article (or main) element, so is all
    outside it, else what is in slots of the template with little text that comes again on other pages, but headings. Texts of the template of the page's host go as well. Others are
    decoded, their white space made single blanks, and joined by line feeds.

    Pages are parsed for their tokens and once more, with the templates, for their blocks, which are written. Templates are sent to all executors if
    they have at most ``send_bytes`` bytes in all, else joined by host, hosts of many pages in parts.
    Null html: empty text. Null url: a host of its own. Null or repeated ids: a row each. Malformed or cut
    markup is read as far as it goes, very long and deeply nested pages whole. An empty table gives no rows. Other columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract(pages["url"], "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), host.alias("host"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    parts = keep(page_slots(rows, templates(rows), send_bytes), "page-slots")
    out = keep(repeated_slots(parts), "slots-out")
    few = 8 * (out.agg(F.sum(F.size("out"))).first()[0] or 0) <= send_bytes
    joined = parts.join(F.broadcast(out), "host", "left") if few else join_hot(parts, out, "host", ["page_id", "url"], "left")
    left_out = ~F.col("marked") & F.col("out").isNotNull()
    kept = F.when(left_out, F.filter("blocks", lambda b: ~F.array_contains("out", b["slot"]))).otherwise(F.col("blocks"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
