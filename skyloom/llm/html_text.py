"""The main text of web pages by two passes over their blocks.

A page is cut into blocks at its block elements. The first pass decides blocks by the density of their
links, their length and the density of stop words, and by where they stand: blocks in a menu, header,
footer, sidebar, notice, advert, form or list of comments (by element, role, class or id) are bad. The
second pass gives every ambiguous block, headings and short ones, the label of its nearest decided
neighbour; a heading looks ahead. Where a page names its article or main element, only blocks in it are
candidates, links and length decide there (a paragraph without links is good, however short), and a
tie is good.

Pages are handled in the tasks that read them, whole and without a shuffle; passes are vectorised over
the blocks of a batch. Time is linear in the length of a page, broken markup included.

Defined results: null or empty html, and pages without text, have the text '' and 0 characters; an
unfinished tag, comment, script or style at the end of a page is no text; repeated rows stay repeated;
page_id and url may be null; no pages, no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = {
    w
    for line in (
        "the of and to in a is that it for on with as be at this by are was or an from not have but they which you all we can her his has had one if would there their will when who more no out so up",
        "le la les de des du un une et est que qui dans pour pas sur au aux avec ne se par plus il elle ce sont ou mais nous vous leur on être avoir cette son ses comme tout",
        "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis",
        "el los las del y que en un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está",
    )
    for w in line.split()
}
# Elements.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = set("noscript template svg canvas object video audio select button datalist map head".split())
ASIDE = set("nav footer aside form dialog fieldset menu".split())
#: An element that starts ends an open one of these kinds, unless one of the others is in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
}
# Parts of class names and ids of what is no article, and roles.
HINTS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification notifications alert popup modal overlay newsletter subscribe subscription signup login paywall comment comments commentlist respond reply replies disqus discussion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related recommended recommendations teaser widget pagination pager copyright disclaimer hidden skip".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
ARTICLES, BODIES = {"article", "post", "entry", "story"}, {"body", "content", "text"}

#: Where a block stands.
PLAIN, MAIN, ARTICLE, BOILER, NOWHERE = 0, 1, 2, 8, 9
#: Labels of the first pass.
BAD, GOOD, OPEN = 0, 1, 2
#: Characters from which a block is not short, and is long; shares of words and of characters.
SHORT, LONG = 70, 200
STOPS, STOPS_LOW, STOPS_NONE = 0.3, 0.12, 0.05
LINKS, LINKS_ARTICLE = 0.33, 0.5

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}


def _hints(value: str) -> list[list[str]]:
    """The parts of each name: 'postMeta ad-box' gives post, meta and ad, box."""
    return [re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", name).lower()) for name in value.split()]


def _place(tag: str, attributes: str, above: int) -> int:
    """Where the text of an element stands, given where its parent does."""
    if above >= BOILER or tag in ("html", "body"):
        return above
    if tag in UNSEEN:
        return NOWHERE
    at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    if "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower():
        return NOWHERE
    role = at.get("role", "").lower()
    names = _hints(f"{at.get('class', '')} {at.get('id', '')}")
    if tag in ("article", "main") or role in ("main", "article"):
        # Its class may speak of comments that it has; only a name that starts so says that it is one.
        if any(n and n[0] in HINTS - {"header"} for n in names):
            return BOILER
        return max(above, MAIN if "main" in (tag, role) else ARTICLE)
    if tag in ASIDE or role in ROLES or tag == "header" and above == PLAIN:
        return BOILER
    parts = {x for n in names if not {"has", "no", "with", "without"} & set(n) for x in n}
    found = parts & HINTS
    if found == {"header"} and (above > PLAIN or parts & (ARTICLES | BODIES)):
        found = set()
    if found:
        return BOILER
    if at.get("itemprop") == "articleBody" or any(ARTICLES & set(n) and BODIES & set(n) for n in names):
        return ARTICLE
    return above


def blocks_of(page: str | None) -> list[tuple[str, int, str, int]]:
    """(text, characters in links, element, place) of each block with text, in the page's order."""
    out: list[tuple[str, int, str, int]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    buffer: list[str] = []
    links, own, pos, page = 0, "", 0, page or ""

    def flush() -> None:
        nonlocal links
        if text := " ".join("".join(buffer).split()):
            if (place := stack[-1][1] if stack else PLAIN) != NOWHERE:
                out.append((text, links, own, place))
        buffer.clear()
        links = 0

    def pop(size: int) -> None:
        for tag, _ in stack[size:]:
            opened[tag] -= 1
        del stack[size:]

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = html.unescape(raw)
            buffer.append(text)
            if opened["a"]:
                links += len("".join(text.split()))

    while (m := _TOKEN.search(page, pos)) is not None:
        add(page[pos : m.start()])
        pos, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        block = tag in BLOCKS
        if m[1]:
            if block:
                flush()
            if opened[tag]:
                at = max(i for i, (t, _) in enumerate(stack) if t == tag)
                if stack[at][1] != (stack[at - 1][1] if at else PLAIN):
                    flush()
                pop(at)
            own = "" if block else own
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in RAW:
            end = _RAW_END[tag].search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if block:
            flush()
            own = tag
            for ends, within in (({"p"} | HEADINGS, BLOCKS), ENDS.get(tag, (set(), BLOCKS))):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        pop(i)
                        break
                    if stack[i][0] in within:
                        break
        if tag in VOID:
            continue
        above = stack[-1][1] if stack else PLAIN
        place = _place(tag, m[3], above)
        if place != above:
            flush()
        if block or place != above or tag == "a":
            stack.append((tag, place))
            opened[tag] += 1
    add(page[pos:])
    flush()
    return out


def decide(b: pd.DataFrame) -> pd.DataFrame:
    """Blocks with label (first pass) and kept (second pass), given page, text, links, element and place in order of pages."""
    page, place = b["page"].to_numpy(), b["place"].to_numpy()
    heading, paragraph = b["element"].isin(HEADINGS).to_numpy(), (b["element"] == "p").to_numpy()
    words = [_WORD.findall(t.lower()) for t in b["text"]]
    n_words = np.array([len(w) for w in words], float)
    n_stops = np.array([sum(x in STOP_WORDS for x in w) for w in words], float)
    chars = np.array([len(t) for t in b["text"]], float)
    solid = np.array([len(t.replace(" ", "")) for t in b["text"]], float)

    best = np.zeros(page.max() + 1 if len(page) else 0, int)
    np.maximum.at(best, page[place <= ARTICLE], place[place <= ARTICLE])
    inside = best[page] > PLAIN
    candidate = np.where(inside, place == best[page], place <= ARTICLE)
    # In a language of which no stop words are known, their density says nothing.
    known = np.bincount(page, n_stops, len(best)) >= STOPS_NONE * np.bincount(page, n_words, len(best))
    links, stops = b["links"].to_numpy() / np.maximum(solid, 1), n_stops / np.maximum(n_words, 1)

    free = np.select([heading | (chars < SHORT), ~known[page] & (chars >= LONG), ~known[page], stops >= STOPS, (stops >= STOPS_LOW) & (chars >= LONG), stops >= STOPS_LOW], [OPEN, GOOD, OPEN, GOOD, GOOD, OPEN], BAD)
    in_article = np.where(heading | (chars < SHORT) & ~(paragraph & (links == 0)), OPEN, GOOD)
    label = np.where(inside, np.where(links > LINKS_ARTICLE, BAD, in_article), np.where(links > LINKS, BAD, free))
    label = np.where(candidate, label, BAD)

    # Blocks outside a named article are no neighbours; its own are.
    at = np.arange(len(b))
    decided = (label != OPEN) & (candidate | ~inside)
    before = np.maximum.accumulate(np.where(decided, at, -1)) if len(b) else at
    after = np.minimum.accumulate(np.where(decided, at, len(b))[::-1])[::-1] if len(b) else at
    has_before = (before >= 0) & (page[np.maximum(before, 0)] == page)
    has_after = (after < len(b)) & (page[np.minimum(after, len(b) - 1)] == page)
    good_before = has_before & (label[np.maximum(before, 0)] == GOOD)
    good_after = has_after & (label[np.minimum(after, len(b) - 1)] == GOOD)
    nearer = np.sign(np.where(has_before, at - before, len(b)) - np.where(has_after, after - at, len(b)))
    tie = np.where(inside, good_before | good_after, good_before & good_after)
    inherited = np.select([heading & has_after, nearer < 0, nearer > 0], [good_after, good_before, good_after], tie)
    # Without one good block there is nothing to inherit: a named article stays, elsewhere its paragraphs and headings.
    any_good = np.bincount(page, label == GOOD, len(best)) > 0
    inherited = np.where(any_good[page], inherited, inside | paragraph | heading)
    return b.assign(words=n_words.astype(int), stop_words=n_stops.astype(int), label=label, kept=(label == GOOD) | (label == OPEN) & inherited & candidate)


def _decided(pages: list[str | None]) -> pd.DataFrame:
    rows = [(i, *b) for i, p in enumerate(pages) for b in blocks_of(p)]
    return decide(pd.DataFrame(rows, columns=["page", "text", "links", "element", "place"]).astype({"page": int, "links": int, "place": int}))


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block (from 0 in its page), element, text, words, stop_words, link_chars, label ('bad', 'good', 'open'), kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b = _decided(list(pdf["html"]))
            yield pd.DataFrame({"page_id": pdf["page_id"].take(b["page"]).to_numpy(), "block": b.groupby("page").cumcount(), "element": b["element"], "text": b["text"], "words": b["words"], "stop_words": b["stop_words"], "link_chars": b["links"], "label": np.array(["bad", "good", "open"])[b["label"]], "kept": b["kept"]})

    return pages.select("page_id", F.col("html").cast("string").alias("html")).mapInPandas(run, "page_id long, block int, element string, text string, words int, stop_words int, link_chars int, label string, kept boolean")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: kept blocks joined by line ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b = _decided(list(pdf["html"]))
            texts = b[b["kept"]].groupby("page")["text"].agg("\n".join)
            yield pdf[["page_id", "url"]].assign(text=texts.reindex(range(len(pdf)), fill_value="").to_numpy())

    found = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInPandas(run, "page_id long, url string, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def oracle_sql() -> str:
    """The text between an article's tags, for pages whose article holds headings, paragraphs and inline markup alone."""
    article = "regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's')"
    cut = f"regexp_replace({article}, '</?(p|h[1-6])>', chr(1), 'g')"
    bare = f"regexp_replace(regexp_replace({cut}, '<br>', ' ', 'g'), '</?[a-z][^>]*(>|$)|</?$', '', 'g')"
    decoded = f"replace(replace(replace(regexp_replace({bare}, '&quot;?', '\"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    decoded = f"regexp_replace({decoded}, '&amp', '&', 'g')"
    return f"""with b as (select page_id, url, list_filter(list_transform(string_split({decoded}, chr(1)), lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))), lambda t: t <> '') as parts from pages)
select page_id, url, coalesce(array_to_string(parts, chr(10)), '') as text, cast(length(coalesce(array_to_string(parts, chr(10)), '')) as bigint) as n_chars from b"""
