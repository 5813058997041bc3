"""Main text of web pages by equivalence-class template deduction.

A token is an element's open tag, or a block of text, in the context of its open ancestors. Tokens of one host with the same occurrence vector over
its pages form an equivalence class; vectors are compared by a sum of per-page hashes times counts, so they are built by partial sums and
no host's pages ever meet in one task. A class is valid when it has several tokens, enough pages hold it, not all alike, and nearly all of them once. Valid
classes nest by their tokens' contexts and make the host's template: its text is the same wherever a page holds the class, its regions of link text are navigation,
and what is between its tokens are slots, the pages' own text. Roles are deduced over whole pages, whatever their tags and names say: of a host's slots those with the most
text of their own a page are its main slots, and what lies in them is extracted. Tags and names come second: a smaller slot is kept where it lies in an article or main region, a
heading outside the main slots where there is no such region, and a region that says by tag, class, id or role that it is no article is left out. Hosts without a template go by tags and names alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import keyed, stored
from graftline.llm.exact_dedup import probe
from graftline.llm.url_filter import host_and_path

#: A class is valid when it has so many tokens and so many pages hold it, whatever the host's number, and at most this share of them more than once.
CLASS_TOKENS, SUPPORT_PAGES, REPEAT_SHARE = 2, 5, 0.05
#: A region with this share of its text in links is navigation.
LINK_SHARE = 0.6
#: A slot is a main one with so much of the text a page that the host's largest slot has.
SLOT_SHARE = 0.5

#: Fixed values of HTML: elements without content, elements whose content is no text, and elements that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "object")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Containers make up the path; other elements are markup inside a block.
CONTAINER = frozenset("html head body article aside details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
SKIPPED = frozenset("head nav footer aside form menu dialog button".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role that name a region which is not the article.
SKIP_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation navigationbar newsletter notice notices pagination popup promo promoted promotion related reply replies search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget".split())

#: No part is read twice, whatever is left open: a tag ends before another begins, what follows an open comment or raw element belongs to it.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(RAW)})\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|[^<]++|<",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECES = re.compile(r"[a-zA-Z]+")
SPACE = re.compile(r"\s+")


class Node:
    """An open element: its tag, its token's hash, whether its text is left out, belongs to the article or to a main slot (None: in no slot), and its text's characters, those in
    links among them."""

    __slots__ = ("tag", "key", "above", "skip", "main", "slot", "chars", "links", "holds")

    def __init__(self, tag: str, key: int, above: int | None, skip: bool, main: bool, slot: bool | None = None):
        self.tag, self.key, self.above, self.skip, self.main, self.slot = tag, key, above, skip, main, slot
        self.chars, self.links, self.holds = 0, 0, main


def label(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """The element's name in a path (digits of class and id are not told apart), and whether its names say to leave it out;
    inside an article, and of headings, header is no such word."""
    if not attributes or "=" not in attributes:
        return tag, tag in SKIPPED
    words, out = [], []
    for kind, *values in NAMES.findall(attributes):
        value = "".join(values)
        words += [w.lower() for w in PIECES.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value))]
        out.append(f"{kind.lower()[0]}={re.sub(r'[0-9]+', '0', SPACE.sub(' ', value.strip()))}")
    title = inside or tag in HEADINGS
    named = tag not in MAIN and tag not in ("html", "body") and any(w in SKIP_WORDS and not (title and w == "header") for w in words)
    return f"{tag}[{','.join(sorted(out))}]" if out else tag, tag in SKIPPED or named


class Page:
    """Reads a page once, in time and memory in proportion to it. skip: hashes of template tokens to leave out; slots: hash of a template container -> whether it is a main slot.
    tags: go by what tags and names say; whole: leave nothing out, to learn from. tokens: hash -> [number, hash of the container above, is text, characters,
    those in links, holds an article]; blocks: the text that is not left out, whether in an article, in a main slot, a heading."""

    def __init__(self, source: str, skip: frozenset | set = frozenset(), slots: dict | None = None, tags: bool = True, whole: bool = False):
        self.skip, self.slots, self.tags, self.whole = skip, slots or {}, tags, whole
        self.blocks, self.parts, self.has_main, self.heading, self.raw = [], [], False, False, [0, 0]
        self.stack = [Node("", 0, None, False, False)]
        self.open: Counter = Counter()
        self.tokens: dict[int, list] = {}
        self.links = 0
        for m in TOKEN.finditer(source):
            kind = m[3]
            if kind is None:
                text = m[0]
                if m[1] is None and (text[0] != "<" or text == "<"):
                    self._text(text)
            elif m[2]:
                self._close(kind.lower())
            else:
                self._open(kind.lower(), m[4])
        self._flush()
        self._pop(1)

    def _text(self, text: str) -> None:
        top = self.stack[-1]
        if not top.skip:
            self.parts.append(text)
        n = len(text.strip())
        top.chars += n
        top.links += n * (self.links > 0)
        self.raw[0] += n
        self.raw[1] += n * (self.links > 0)

    def _token(self, key: int, above: int, text: bool, chars: int, links: int, holds: bool) -> None:
        t = self.tokens.setdefault(key, [0, above, text, 0, 0, False])
        t[0], t[3], t[4], t[5] = t[0] + 1, t[3] + chars, t[4] + links, t[5] or holds

    def _flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                top = self.stack[-1]
                key = xxhash.xxh3_64_intdigest(text, seed=top.key ^ 1)
                if not top.main:
                    self._token(key, top.key, True, self.raw[0], self.raw[1], False)
                if key not in self.skip or top.main:
                    self.blocks.append((text, top.main, top.slot, self.heading))
            self.parts = []
        self.raw, self.heading = [0, 0], False

    def _push(self, node: Node) -> None:
        self.stack.append(node)
        self.open[node.tag] += 1

    def _pop(self, to: int) -> None:
        """Ends the elements from place to on."""
        while len(self.stack) > to:
            node = self.stack.pop()
            self.open[node.tag] -= 1
            below = self.stack[-1]
            below.chars, below.links, below.holds = below.chars + node.chars, below.links + node.links, below.holds or node.holds
            if node.above is not None:
                self._token(node.key, node.above, False, node.chars, node.links, node.holds)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._flush()
            while self.stack[-1].tag in ("p", tag) and tag not in CONTAINER or self.stack[-1].tag == "p":
                self._pop(len(self.stack) - 1)  # left out and never closed
            self.heading = tag in HEADINGS
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID or attributes.rstrip().endswith("/"):
            return
        if tag == "a":
            self.links += 1
            return
        top = self.stack[-1]
        name, skip = label(tag, attributes, top.main)
        skip = skip and self.tags and not self.whole
        if tag not in CONTAINER and tag not in SKIPPED:
            if skip:  # p, li, span and the like only count where they are left out
                self._push(Node(tag, top.key, None, True, top.main, top.slot))
            return
        key = xxhash.xxh3_64_intdigest(name, seed=top.key)
        if tag == "header" and skip:
            skip = not top.main  # the header of an article holds its title
        main = top.main or (tag in MAIN and self.tags)
        skip = top.skip or skip or (key in self.skip and not main)
        self.has_main |= main and not skip
        slot = top.slot or self.slots[key] if key in self.slots else top.slot  # a slot inside a main one is part of it
        self._push(Node(tag, key, top.key, skip, main, slot))

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCK:
            self._flush()
        if self.open[tag]:
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self._pop(at)
            self.links = 0 if tag in CONTAINER else self.links

    def text(self) -> str:
        """The blocks of the main slots, and those that tags hold to be the article's; where the page has no main slot, only what tags say."""
        title = self.tags and not self.has_main
        if any(slot for _, _, slot, _ in self.blocks):
            return "\n\n".join(t for t, main, slot, heading in self.blocks if main or slot or (title and heading))
        return "\n\n".join(t for t, main, _, _ in self.blocks if main or not self.has_main)


#: Roles of a template's tokens.
LEAVE, MAIN_SLOT, SLOT = 0, 1, 2


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def observations(pages: DataFrame, tags: bool = True) -> DataFrame:
    """(host, tag, token, above, is_text, mark, page, n, chars, link_chars, holds) of every token on every page, menus and notices included; mark and page are hashes of the page, with
    and without its id. Text in an article region is no token: where many pages of a host copy one article, it would be taken for the template's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 100):
                part, rows = b.iloc[at : at + 100], []
                for i, host, tag, source in part[["id", "host", "tag", "html"]].itertuples(index=False):
                    if not source:
                        continue
                    page, read = xxhash.xxh3_64_intdigest(source), Page(source, tags=tags, whole=True)
                    mark = xxhash.xxh32_intdigest(f"{i}\n{page}")
                    for key, (n, above, text, chars, links, holds) in read.tokens.items():
                        rows.append((host, tag, _signed(key), _signed(above), text, mark, _signed(page), n, chars, links, holds))
                yield pd.DataFrame(rows, columns=["host", "tag", "token", "above", "is_text", "mark", "page", "n", "chars", "link_chars", "holds"])

    return pages.mapInPandas(run, "host string, tag long, token long, above long, is_text boolean, mark long, page long, n int, chars long, link_chars long, holds boolean")


def templates(seen: DataFrame) -> DataFrame:
    """(host, token, role) of each host's template: LEAVE for what a page that holds it leaves out, text, and regions of link text that hold no article; MAIN_SLOT or SLOT for the
    other containers, whose own text is what their template text and the containers nested in them leave.

    A token belongs if its class is valid and it nests: the container that it stands in belongs to a valid class, this or another. A class whose pages are copies of
    one another cannot be told from content, nor one that is a single token.
    """
    tokens = seen.groupBy("host", "token").agg(
        F.sum((F.col("mark") * F.col("n")).cast("decimal(38,0)")).alias("vector"),
        F.count(F.lit(1)).alias("support"),
        F.count(F.when(F.col("n") > 1, 1)).alias("repeats"),
        (F.min("page") != F.max("page")).alias("vary"),
        F.min("above").alias("above"),
        F.max("is_text").alias("is_text"),
        F.sum("chars").alias("chars"),
        F.sum("link_chars").alias("link_chars"),
        F.max("holds").alias("holds"),
    )
    tokens = stored(tokens.where((F.col("support") >= SUPPORT_PAGES) & F.col("vary") & (F.col("repeats") <= REPEAT_SHARE * F.col("support"))), "html-tokens")
    classes = tokens.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= CLASS_TOKENS)
    members = stored(tokens.join(classes, ["host", "vector"]), "html-classes")
    around = members.where(~F.col("is_text")).select("host", F.col("token").alias("above"), F.lit(True).alias("held"))
    nested = members.join(around, ["host", "above"], "left").where(F.col("held") | (F.col("above") == 0))
    nested = stored(nested.select("host", "token", "above", "support", "is_text", "chars", "link_chars", "holds"), "html-nested")
    links = (F.col("chars") > 0) & (F.col("link_chars") >= LINK_SHARE * F.col("chars")) & ~F.col("holds")
    inner = nested.groupBy("host", F.col("above").alias("token")).agg(F.sum(F.col("chars") - F.col("link_chars")).alias("inner"))
    free = F.greatest(F.col("chars") - F.col("link_chars") - F.coalesce("inner", F.lit(0)), F.lit(0))
    own = nested.join(inner, ["host", "token"], "left").select("host", "token", (F.col("is_text") | links).alias("out"), (free / F.col("support")).alias("own"))
    largest = own.where(~F.col("out")).groupBy("host").agg(F.max("own").alias("most"))
    main = (F.col("own") > 0) & (F.col("own") >= SLOT_SHARE * F.col("most"))
    return own.join(largest, "host", "left").select("host", "token", F.when(F.col("out"), LEAVE).when(main, MAIN_SLOT).otherwise(SLOT).alias("role"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tags: bool = True) -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
    order by two line feeds. A null or empty page, or one with no text outside left-out regions, has an empty text. Pages with a
    null URL or none with ://, share the empty host. Hosts with fewer than SUPPORT_PAGES pages have no template and go by what the
    regions say of themselves; so does a page of which the template would leave nothing. Repeated rows give their row each; other columns are not read; no row gives no row. Broken
    markup is read as far as it goes: unclosed elements end with their container. tags=False takes no notice of what tags and names say: what the template alone finds.
    """
    slim = keyed(pages, id_col, url_col, html_col).toDF("id", "url", "html")
    hosted = slim.withColumn("host", host_and_path(F.col("url"))[0]).withColumn("tag", F.xxhash64("host", "html"))  # pages of one host and source are read alike
    seen = stored(observations(hosted.select(F.col("id").cast("string").alias("id"), "host", "tag", "html"), tags), "html-tokens")
    known = stored(templates(seen), "html-template")
    held = probe(seen.select("host", "tag", "token", F.xxhash64("host", "token").alias("digest")), known.select(F.xxhash64("host", "token").alias("digest")))
    skips = stored(held.join(known, ["host", "token"]).groupBy("tag").agg(F.collect_set(F.struct("token", "role")).alias("template")), "html-skips")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def text(source: str | None, template) -> str:
            roles = {int(t["token"]) & 0xFFFFFFFFFFFFFFFF: t["role"] for t in template} if template is not None else {}
            left_out = frozenset(k for k, role in roles.items() if role == LEAVE)
            slots = {k: role == MAIN_SLOT for k, role in roles.items() if role != LEAVE}
            return (roles and Page(source, left_out, slots, tags).text() or Page(source, tags=tags).text()) if source else ""

        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                yield pd.DataFrame({"id": part["id"].values, "url": part["url"].values, "text": [text(h, t) for h, t in zip(part["html"], part["template"], strict=True)]})

    joined = hosted.join(skips, "tag", "left").select("id", "url", "html", "template")
    out = joined.mapInPandas(run, f"id {slim.schema['id'].dataType.simpleString()}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
