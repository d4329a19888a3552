"""Main-text extraction from web pages by consensus host paths.

Each page is parsed once to score its containers (text, commas and few links
speak for one; half of a score goes to the parent) and votes with the
generalised tag-class path of its best one, e.g. ``html>body>div.post-#``. Spark
counts the votes per host; paths with a fair share of the host's pages win, most
voted first. Every page is then extracted again by the first winning path that
occurs on it, or by its own best container if none does.

Blocks are the text runs between block-level tags. Character references are
decoded, white space inside a block becomes one space, and blocks are joined in
page order by a line feed; nothing is capped. A class or id marks furniture only if
all its words do (``cookie-notice``, not ``notice-period``; words of several
languages), inside an article only on grouping elements and not by a word that is
a topic as well (``promotion``). A header outside an article is the page's, unless
it is right inside a part named as content (``div.main``) and holds a first
heading that is no link. Left out: menus, page headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments.

A null or empty page gives an empty text; a page without a container gives what
its body holds. Pages without a host vote under the empty host. Repeated rows,
empty tables and extra columns are allowed.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, set_aside

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([a-zA-Z-]+)""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
MARKS = re.compile(r"[\u0300-\u036f]")

# Element names of the HTML standard by role here, and usual names of page furniture.
RAW = {"script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes", "template", "svg"}
INLINE_FORM = {"button", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "body", "head", "article", "section", "main", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol",
    "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre",
    "figure", "figcaption", "address", "details", "summary", "center", "fieldset", "hgroup", "nav", "header", "footer",
    "aside", "form", "menu", "dialog", "object", "optgroup", "option", "legend",
}
SKIP = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "object"}
FURNITURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "promo", "promotion", "sponsor", "sponsored", "banner",
    "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "comment", "comments",
    "disqus", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "share",
    "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "login", "masthead",
    "topbar", "alert", "gdpr", "respond", "replies",
    "werbung", "anzeige", "anzeigen", "reklame", "kommentar", "kommentare", "seitenleiste", "fusszeile", "kopfzeile",
    "publicite", "annonce", "annonces", "commentaire", "commentaires", "publicidad", "anuncio", "anuncios",
    "comentario", "comentarios", "publicidade", "pubblicita", "annuncio", "annunci", "commento", "commenti", "reclame",
    "advertentie", "advertenties", "reacties",
}
# Words of the list above that articles are about as well; inside an article they don't mark furniture.
TOPICS = {"promotion", "sponsor", "consent", "annonce", "anzeige"}
# Words by which pages name the part that holds the article.
CONTENT = {"main", "content", "article", "post", "entry", "story"}
# Words that add nothing to the ones above in the name of a class or an id.
NEUTRAL = {
    "main", "site", "page", "global", "post", "posts", "article", "articles", "entry", "blog", "top", "bottom", "left",
    "right", "primary", "secondary", "inner", "outer", "box", "block", "bar", "area", "list", "link", "links", "item",
    "items", "container", "wrapper", "wrap", "section", "content", "panel", "group", "buttons", "button", "icons", "title",
    "heading", "form", "text", "body", "row", "slot", "unit", "media", "header", "x", "id", "module", "overlay", "message",
}
#: Elements that pages use to group: inside an article only these are taken for furniture by their name alone.
GROUPS = {"div", "section", "ul", "ol", "dl", "table", "center", "fieldset", "details", "span"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "menu", "menubar", "form"}
CONTAINER = {"article", "section", "main", "div", "td", "body", "blockquote", "html"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
LISTS = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "select"}


def words_of(label: str) -> set[str]:
    """The lower-cased words of a class or id, without accents and numbers."""
    if not label.isascii():
        label = MARKS.sub("", unicodedata.normalize("NFD", label)).replace("ß", "ss")
    return {w.lower() for w in WORD.findall(label) if not w.isdigit()}


@lru_cache(maxsize=4096)
def is_furniture(label: str, inside: bool = False) -> bool:
    """Whether a class or id names page furniture: with all its words, not with one among others.

    ``inside`` an article, words that are also topics don't count.
    """
    words = words_of(label)
    named = FURNITURE - TOPICS if inside else FURNITURE
    return not named.isdisjoint(words) and words <= FURNITURE | NEUTRAL


@lru_cache(maxsize=4096)
def is_content(label: str) -> bool:
    """Whether a class or id names the part of the page that holds the article."""
    words = words_of(label)
    return not CONTENT.isdisjoint(words) and words <= CONTENT | NEUTRAL


class Page:
    """The block-level elements and text blocks of one page."""

    def __init__(self, source: str):
        self.name: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.path: list[str] = [""]
        self.skip: list[bool] = [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.content: set[int] = set()  # elements named as the part that holds the article
        self.headers: list[int] = []  # headers right inside those, kept if they hold the title
        self._parse(source)
        self._drop_headers()

    def _attributes(self, text: str) -> dict[str, str]:
        out: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(text):
            out.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
        return out

    def _open(self, name: str, text: str, parent: int) -> tuple[str, bool]:
        """The path step of an element, and whether it is page furniture."""
        skip = name in SKIP
        inside = self._inside
        if name == "header" and not inside:
            if parent in self.content:
                self.headers.append(len(self.name))
            else:
                skip = True
        step = name
        if "=" in text or "hidden" in text:
            a = self._attributes(text)
            classes = a.get("class", "").split()
            if classes:
                step += "." + ".".join(sorted(re.sub(r"\d+", "#", c) for c in classes))
            if name not in ("html", "body"):
                labels = (*classes, a.get("id", ""))
                if not inside or name in GROUPS:
                    skip = skip or any(is_furniture(x, inside > 0) for x in labels)
                if name in CONTAINER and any(map(is_content, labels)):
                    self.content.add(len(self.name))
                if not inside and name != "article" and "header" in a.get("id", "").lower().split():
                    skip = True
                skip = skip or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true"
                skip = skip or "display:none" in a.get("style", "").replace(" ", "").lower()
        return step, skip

    def _parse(self, source: str) -> None:
        name_, parent_, path_, skip_ = self.name, self.parent, self.path, self.skip
        stack, pieces, links = [0], [], 0
        in_link = False
        self._inside = 0  # depth of article and main
        end = source.rfind(">") + 1
        at, find = 0, TAG.search

        def flush():
            nonlocal links
            if pieces:
                text = " ".join("".join(pieces).split())
                if text and not skip_[stack[-1]]:
                    self.blocks.append((stack[-1], text, links))
                pieces.clear()
                links = 0

        def pop_to(depth: int):
            for e in stack[depth:]:
                if name_[e] in ("article", "main"):
                    self._inside -= 1
            del stack[depth:]

        while True:
            m = find(source, at, end)
            stop = m.start() if m else len(source)
            if stop > at:
                text = source[at:stop]
                if "&" in text:
                    text = _html.unescape(text)
                pieces.append(text)
                if in_link:
                    links += len(text)
            if not m:
                break
            at = m.end()
            close, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if close:
                if name == "a":
                    in_link = False
                    if not skip_[stack[-1]] or name_[stack[-1]] != "a":
                        continue
                for depth in range(len(stack) - 1, 0, -1):
                    if name_[stack[depth]] == name:
                        flush()
                        pop_to(depth)
                        break
                continue
            if name in RAW:
                if not rest.endswith("/") or name != "svg":
                    done = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                    at = done.end() if done else len(source)
                    end = max(end, at)
                pieces.append(" ")
                continue
            if name in INLINE_FORM:  # a control inside a block goes without cutting the block
                done = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                at = done.end() if done else at
                pieces.append(" ")
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    pieces.append(" ")
                continue
            if name == "a":
                in_link = True
            block = name in BLOCK or "-" in name
            if not block and not ("class" in rest or "id" in rest or "hidden" in rest or "role" in rest):
                continue
            step, skip = self._open(name, rest, stack[-1])
            if not block and not skip:
                continue
            flush()
            if block and name_[stack[-1]] == "p":
                pop_to(len(stack) - 1)
            if name in CLOSES:
                for depth in range(len(stack) - 1, 0, -1):
                    top = name_[stack[depth]]
                    if top in CLOSES[name]:
                        pop_to(depth)
                    elif top in LISTS:
                        break
            up = stack[-1]
            name_.append(name)
            parent_.append(up)
            skip_.append(skip or skip_[up])
            path_.append(f"{path_[up]}>{step}" if path_[up] else step)
            stack.append(len(name_) - 1)
            if name in ("article", "main"):
                self._inside += 1
            if rest.endswith("/") and "-" in name:
                stack.pop()
        flush()

    def _drop_headers(self) -> None:
        """Drop the headers of content parts that hold no first heading, or mostly links."""
        if not self.headers:
            return
        under = [0] * len(self.name)  # the outermost such header around an element
        heads = set(self.headers)
        for e in range(1, len(self.name)):
            under[e] = under[self.parent[e]] or (e if e in heads else 0)
        size, links, titled = dict.fromkeys(heads, 0), dict.fromkeys(heads, 0), set()
        for e, text, linked in self.blocks:
            if h := under[e]:
                size[h] += len(text)
                links[h] += linked
                if self.name[e] == "h1":
                    titled.add(h)
        kept = {h for h in titled if 2 * links[h] <= size[h]} | {0}
        self.blocks = [b for b in self.blocks if under[b[0]] in kept]

    def best(self) -> tuple[int, float]:
        """The best container and its score; the root if there is none."""
        score = [0.0] * len(self.name)
        for e, text, links in self.blocks:
            plain = max(len(text) - links, 0)
            value = (1 + text.count(",") + min(plain / 100, 3)) * plain / len(text)
            while e > 0 and self.name[e] not in CONTAINER:
                e = self.parent[e]
            share = 1.0
            for _ in range(3):
                score[e] += value * share
                e, share = self.parent[e], share / 2
                if e < 0:
                    break
        top, best = 0, score[0]
        for e in range(1, len(score)):
            if score[e] and self.name[e] in CONTAINER:
                # the elements named for the purpose win over generic ones around them
                value = score[e] * {"article": 3.0, "main": 1.5}.get(self.name[e], 1.0)
                if value > best:
                    top, best = e, value
        return top, best

    def text_of(self, elements: set[int]) -> str:
        """The blocks under any of the elements, joined."""
        inside: dict[int, bool] = {-1: False}

        def is_in(e: int) -> bool:
            chain = []
            while e not in inside:
                if e in elements:
                    inside[e] = True
                    break
                chain.append(e)
                e = self.parent[e]
            for c in chain:
                inside[c] = inside[e]
            return inside[e]

        return "\n".join(text for e, text, _ in self.blocks if is_in(e))


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without user, port and leading ``www.``; empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def vote(pages: DataFrame, min_share: float = 0.05) -> DataFrame:
    """(host, paths array<string>): the paths that at least ``min_share`` of a host's pages vote for, most votes first.

    A page has one vote, so a host has at most 1 / min_share paths.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for host, source in zip(pdf["host"], pdf["html"]):
                page = Page(source or "")
                top, score = page.best()
                if score > 0 and top > 0:
                    rows.append((host, page.path[top]))
            yield pd.DataFrame(rows, columns=["host", "path"])

    votes = pages.select("host", "html").mapInPandas(run, "host string, path string")
    counts = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    # per host the total, then only paths with their share: a bounded list
    totals = counts.groupBy("host").agg(F.sum("n").alias("total"))
    fair = counts.join(totals, "host").filter(F.col("n") >= F.col("total") * min_share)
    ranked = fair.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("p"))
    return ranked.select("host", F.transform("p", lambda p: p["path"]).alias("paths"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All columns of ``pages`` but the html, with the main text, which replaces a column of its name."""
    extra = [c for c in pages.columns if c not in (html_col, text_col)]
    pages, back = set_aside(pages, "_host", "_paths")
    away = {old: new for new, old in back.items()}
    hosted = pages.withColumn("_host", host_of(F.col(url_col)))
    winners = vote(hosted.select(F.col("_host").alias("host"), F.col(html_col).alias("html")))
    # stored first, so that its size is known: a small table is broadcast and no page is shuffled, in the join with a
    # large one the pages of a very common host can be split
    winners = materialize(winners.select(F.col("host").alias("_host"), F.col("paths").alias("_paths")), "host-paths")
    joined = hosted.join(winners, "_host", "left")

    @F.pandas_udf("string")
    def main_text(source: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for s, ps in zip(source, paths):
            page = Page(s or "")
            chosen: set[int] = set()
            for p in ps if ps is not None else ():
                chosen = {e for e, path in enumerate(page.path) if path == p and e and not page.skip[e]}
                if chosen and (text := page.text_of(chosen)):
                    out.append(text)
                    break
            else:
                out.append(page.text_of({page.best()[0]}))
        return pd.Series(out, dtype=object)

    text = main_text(F.col(html_col), F.col("_paths")).alias(text_col)
    return joined.select(*[F.col(away.get(c, c)).alias(c) for c in extra], text)
