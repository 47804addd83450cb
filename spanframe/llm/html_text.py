"""Main text of web pages by two-pass block rules.

A page is read once into blocks (text between block-level tags) that know their words,
stop words, characters in links and the region they stand in. The first pass decides
blocks by region, link density, stop-word density and length; short blocks stay open. In
the second pass open blocks take the label of the nearest decided neighbour in their
region. A long block without links that reads as sentences is text in any language, so
none is lost for want of a stop-word list; inside a main region an open block goes only if
the decided blocks on both sides do. Pages are independent: no shuffle, memory is one page.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.registry import query, table

#: Frequent function words of the languages served, about forty each.
STOP_WORDS = {
    "en": "the of and to a in is it that was for on are as with he she they be at by this have from or had not but what all were when we there can an which do",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont ou avec son aux d l s cette mais comme elle nous on leur",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre es son fue",
}
#: Parts of class names and ids that mark furniture of a page.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login sidebar widget widgets related recommended recommendations comment comments respond reply replies "
    "disqus share sharing social menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead toolbar search".split()
)
FURNITURE_TAGS = frozenset("nav aside footer form dialog menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN_TAGS = frozenset(("article", "main"))
NO_TEXT = "script|style|title|noscript|template|textarea|iframe|object|svg|canvas|select|button|audio|video"
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK_TAGS = HEADINGS | FURNITURE_TAGS | MAIN_TAGS | frozenset(
    "address blockquote body center dd details dir div dl dt fieldset figcaption figure header hgroup hr html head legend li ol p pre section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset(("hr",))
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({NO_TEXT})\b(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>?",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z]+")
#: A sentence mark at the end of a word or of the block; the wide marks need no space after them.
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*(?:\s|\Z)|[。！？｡।؟۔]")

GOOD, BAD, OPEN = 1, 0, None


class Rules:
    """Thresholds of the first pass, in characters and shares."""

    def __init__(self, short: int = 70, long: int = 200, stop_low: float = 0.2, stop_high: float = 0.3, link_high: float = 0.5, stop_words: dict[str, str] | None = None):
        self.short, self.long, self.stop_low, self.stop_high, self.link_high = short, long, stop_low, stop_high, link_high
        self.stop = frozenset(w for words in (stop_words or STOP_WORDS).values() for w in words.split())


class Block:
    __slots__ = ("heading", "link", "main", "furniture", "text", "label")

    def __init__(self, text: str, link: int, main: bool, furniture: bool, heading: bool):
        self.text, self.link, self.main, self.furniture, self.heading, self.label = text, link, main, furniture, heading, OPEN


def _is_furniture(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in FURNITURE_TAGS or (tag == "header" and not in_main):
        return True
    if not attributes.strip() or tag in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name == "role" and value in FURNITURE_ROLES:
            return True
        if name in ("class", "id"):
            for one in value.split():
                parts = _NAME.findall(one)
                if in_main and parts and parts[-1] == "header" and (tag == "header" or len(parts) > 1):
                    continue  # the head of an article holds its title
                if parts and not {"has", "with", "no"} & set(parts) and (parts[0] in FURNITURE or parts[-1] in FURNITURE):
                    return True
    return False


def blocks_of(html: str) -> list[Block]:
    """Blocks in page order; white space is collapsed and empty blocks are left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, in main, in furniture
    parts: list[str] = []
    linked = 0
    depth_a, heading, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, main, furniture = stack[-1] if stack else ("", False, False)
                out.append(Block(text, linked, main, furniture, heading))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw)
            parts.append(text)
            if depth_a:
                linked += len("".join(text.split()))

    for m in _TOKEN.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            depth_a = 0 if m[2] else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            if m[2]:
                if tag in HEADINGS:
                    heading = False
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            else:
                if stack and stack[-1][0] == "p":
                    stack.pop()  # a block ends an open paragraph
                heading = tag in HEADINGS
                if tag not in VOID:
                    _, main, furniture = stack[-1] if stack else ("", False, False)
                    furniture = furniture or _is_furniture(tag, m[4], main)
                    main = main or tag in MAIN_TAGS or "main" in re.findall(r"role\s*=\s*[\"']?(\w+)", m[4])
                    stack.append((tag, main, furniture))
    say(html[at:])
    flush()
    return out


def decide(blocks: list[Block], rules: Rules) -> None:
    """First pass: label by region, link density, stop-word density and length."""
    for b in blocks:
        size = len(b.text) - b.text.count(" ")
        if b.furniture:
            b.label = BAD
        elif b.link > rules.link_high * size:
            b.label = BAD
        elif b.heading or len(b.text) < rules.short:
            b.label = OPEN
        else:
            words = [w.lower() for w in _WORD.findall(b.text)]
            density = sum(w in rules.stop for w in words) / len(words) if words else 0.0
            if density >= rules.stop_high or (density >= rules.stop_low and len(b.text) > rules.long):
                b.label = GOOD
            elif b.main or (b.link == 0 and _SENTENCE.search(b.text)):
                b.label = GOOD  # prose of a language without a list, or of few function words
            elif density < rules.stop_low:
                b.label = BAD


def settle(blocks: list[Block]) -> None:
    """Second pass: open blocks take the label of the nearest decided block of their region.

    On a tie, or with none decided, main regions count as text; others do only on a page
    without a main region that has nothing decided in them. In a main region a block of
    links counts against an open block only if the decided blocks on both sides are such.
    """
    for main in (True, False):
        region = [b for b in blocks if b.main == main and not b.furniture]
        first = [b.label for b in region]
        known = [i for i, label in enumerate(first) if label is not OPEN]
        alone = main or not (known or any(b.main for b in blocks))
        k = 0
        for i, b in enumerate(region):
            if k < len(known) and known[k] == i:
                k += 1
                continue
            left = known[k - 1] if k else None
            right = known[k] if k < len(known) else None
            sides = [first[j] for j in (left, right) if j is not None]
            if not sides:
                b.label = GOOD if alone else BAD
            elif main:
                b.label = BAD if sides == [BAD, BAD] else GOOD
            elif len(sides) == 1 or sides[0] == sides[1]:
                b.label = sides[0]
            elif i - left == right - i:
                b.label = BAD
            else:
                b.label = sides[0] if i - left < right - i else sides[1]


def main_text(html: str | None, rules: Rules | None = None) -> str:
    blocks = blocks_of(html or "")
    decide(blocks, rules or Rules())
    settle(blocks)
    kept = [b for b in blocks if b.label == GOOD]
    if any(b.main for b in kept):
        kept = [b for b in kept if b.main]
    return "\n".join(b.text for b in kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",), rules: Rules | None = None) -> DataFrame:
    """One row per page: id, the carried columns, text, n_chars (code points).

    A null or empty page, or one without text, has the empty text. Ids may be null or
    repeat: every row gets its own result. An empty table gives no rows; columns that are
    not carried are not read.
    """
    kept = [id_col, *carry]
    rows = pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col(html_col).cast("string").alias("html"))
    schema = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)) + ", text string, n_chars bigint"

    def run(batches):
        own = rules or Rules()
        for b in batches:
            texts = [main_text(h.as_py(), own) for h in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*[f"c{i}" for i in range(len(kept))], "text", "n_chars"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "text", "n_chars")


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract_main_text(table(spark, sf, "pages"))
