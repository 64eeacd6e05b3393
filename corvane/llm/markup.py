"""Clean text out of documents that mix HTML, Markdown, wiki notation and LaTeX.

The converter reads a text once for what must stay as it is (code, formulas), then notation by
notation, and records an event for each construct that it turns into plain structure. What
comes out keeps headings ("# "), lists ("- ", "1. "), code (fenced), tables ("a | b") and
formulas ($...$). Which containers of a host's HTML pages hold content is a matter of consensus:
every page scores its containers, the scores are summed per host and generalised path of tags and
classes, and paths that lose the vote, such as bars of links, are left out by the converter.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import session

# HTML elements that count as markup wherever they stand.
TAGS = "a abbr article aside b big blockquote body br button caption center code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img ins kbd li main mark meta nav nobr ol p pre q s samp script small span strike strong style sub summary sup svg table tbody td tfoot th thead tr tt u ul wbr"
# Elements that make a container, and those that end a line.
CONTAINERS = frozenset("article aside body div footer form header main nav table ul ol section details".split())
BREAKS = frozenset("article aside blockquote body br caption center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead title tr ul".split())
# Wiki macros in braces.
MACROS = "toc code noformat info note warning tip panel quote color status expand section column anchor excerpt children"

#: a path loses the vote of its host if so large a share of its text is links, on so few characters a container
LINK_SHARE, THIN = 0.6, 200

_FENCE = re.compile(r"^[ \t]*(?P<f>```|~~~)[^\n`]*\n(?P<body>.*?)(?:^[ \t]*(?P=f)[ \t]*$|\Z)", re.S | re.M)
# every alternative begins with a literal, so a scan stops only there
_HIDE = re.compile(
    r"(?P<pre><[pP][rR][eE]\b[^<>]*>(?P<pb>.*?)(?:</[pP][rR][eE]\s*>|\Z))"
    r"|(?P<macro>\{(?P<m>code|noformat)(?::[^{}\n]*)?\}\n?(?P<mb>.*?)\{(?P=m)\})"
    r"|(?P<verb>\\begin\{(?P<v>verbatim|lstlisting|minted)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?\n?(?P<vb>.*?)\\end\{(?P=v)\})"
    r"|(?P<env>\\begin\{(?P<e>equation|align|gather|multline|eqnarray|displaymath|math)\*?\}(?P<eb>.*?)\\end\{(?P=e)\*?\})"
    r"|(?P<dollars>\$\$(?P<db>[^$]+?)\$\$)|(?P<square>\\\[(?P<sb>.*?)\\\])|(?P<round>\\\((?P<rb>[^\n]*?)\\\))"
    r"|(?P<inline>\$(?<![\w$\\]\$)(?P<ib>[^$\n]*\\[a-zA-Z]+[^$\n]*)\$(?!\w))"
    r"|(?P<tick>`(?<!``)(?P<tb>[^`\n]+)`(?!`))",
    re.S,
)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(rf"(</?(?:{'|'.join(TAGS.split())})\b[^<>]*>|<!doctype[^<>]*>)", re.I)
_NAME = re.compile(r"</?([a-z0-9]+)", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*[\"']?([\w\- ]+)", re.I)
_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<head\b[^<>]*>.*?</head\s*>", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|([a-z][a-z0-9]{1,30}));", re.I)

_ATX = re.compile(r"^(#{1,6})[ \t]+(\S.*?)[ \t]*#*$", re.M)
_SETEXT = re.compile(r"(?:(?<=\n\n)|\A)([^\s|>\-=+*].*)\n(={3,}|-{3,})[ \t]*$", re.M)
_MD_TABLE = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*\n?", re.M)
_PIPES = re.compile(r"^[ \t]*\|(?![|}\-+])(.*?)\|[ \t]*$", re.M)
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*\)")
_LINK = re.compile(r"(?<!!)\[([^\[\]\n]+)\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)")
_REF = re.compile(r"^\[[^\[\]\n^]+\]:[ \t]+\S+.*\n?", re.M)
_REF_LINK = re.compile(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]")
_NOTE = re.compile(r"\[\^[\w\-]+\]:?")
_TASK = re.compile(r"^([ \t]*[-*+][ \t])\[[ xX]\][ \t]", re.M)
_BOLD = re.compile(r"\*\*(?<!\*\*\*)(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*\*(?!\*)|__(?<![\w_]__)(?=[^\s_])(?![A-Z]+__)([^_\n]+?)(?<=[^\s_])__(?![\w_])")
_EMPHASIS = re.compile(r"\*(?<![\w*\\/]\*)(?=[^\W\d_])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|_(?<![\w_\\/.$]_)(?=[^\W\d_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
_STRIKE = re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~")
_QUOTE = re.compile(r"(?:(?<=\n\n)|\A)>[ \t](?=[^\W\d_\[*\x00\"'`~])", re.M)
_BULLET = re.compile(r"^([ \t]*)[*+][ \t]+(?=\S)", re.M)

_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]+(\S.*?)[ \t]+\1[ \t]*$", re.M)
_CONF_HEAD = re.compile(r"^h([1-6])\.[ \t]+(\S.*)$", re.M)
_WIKI_TABLE = re.compile(r"^\{\|[^\n]*\n(.*?)^\|\}[ \t]*$", re.S | re.M)
_CONF_TABLE = re.compile(r"^\|\|(.+?)\|\|[ \t]*$", re.M)
_FILE = re.compile(r"\[\[(?:file|image|datei|fichier|archivo|bild)\s*:[^\[\]|\n]*(?:\|[^\[\]|\n]*)*?\|([^\[\]|\n]*)\]\]", re.I)
_CATEGORY = re.compile(r"^\[\[(?:category|kategorie|catégorie|categoría)\s*:[^\[\]\n]*\]\][ \t]*\n?", re.I | re.M)
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]")
_EXTERNAL = re.compile(r"\[https?://[^\s\[\]]+[ \t]+([^\[\]\n]+)\]")
_CONF_LINK = re.compile(r"\[([^\[\]|\n]*[^\W\d_][^\[\]|\n]*)\|([^\[\]\n|]+)\]")
_QUOTES = re.compile(r"'''(?<!'''')(?!')([^'\n]+)'''(?!')|''(?<!''')(?!')([^'\n]+)''(?!')")
_MONO = re.compile(r"\{\{([^\W\d_][^{}|\n]*)\}\}")
_TEMPLATE = re.compile(r"\{\{[^\W\d_][^{}]*\|[^{}]*\}\}")
_MACRO = re.compile(rf"\{{(?:{'|'.join(MACROS.split())})(?::[^{{}}\n]*)?\}}")
_MAGIC = re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__[ \t]*\n?")
_BQ = re.compile(r"^bq\.[ \t]+", re.M)
_REFERENCE = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|</?(?:nowiki|noinclude|includeonly|gallery)\b[^<>]*>", re.S | re.I)

_SECTION = re.compile(r"\\(part|chapter|(?:sub)*section|paragraph)\*?(?:\[[^\]\n]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}")
_TITLE = re.compile(r"\\title\{((?:[^{}]|\{[^{}]*\})*)\}")
_HIDDEN = re.compile(r"~?\\(?:label|ref|eqref|pageref|cite[a-z]*|index|usepackage|documentclass|input|include|bibliography[a-z]*|vspace|hspace|includegraphics|author|date)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}")
_HREF = re.compile(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}")
_TABULAR = re.compile(r"\\begin\{tabular[x*]?\}(?:\{[^{}]*\})*(.*?)\\end\{tabular[x*]?\}", re.S)
_LISTS = re.compile(r"\\begin\{(itemize|enumerate|description)\}(?:\[[^\]\n]*\])?|\\end\{(itemize|enumerate|description)\}|\\item\b(?:\[([^\]\n]*)\])?[ \t]*")
_ENV = re.compile(r"\\(?:begin|end)\{[a-zA-Z*]+\}(?:\[[^\]\n]*\])?")
_COMMAND = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{((?:[^{}\n]|\{[^{}\n]*\})*)\}")
_BARE = re.compile(r"\\(?:maketitle|tableofcontents|newpage|clearpage|noindent|centering|hline|toprule|midrule|bottomrule|par|medskip|bigskip|smallskip|ldots|dots|LaTeX|TeX)\b[ \t]*")
_SECTIONS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


class Page:
    """One conversion: the text at its stage, the notations met, and hidden code and formulas."""

    def __init__(self, text: str, lost: frozenset[str]):
        self.text, self.lost = text.replace("\r\n", "\n").replace("\r", "\n"), lost
        self.met: set[str] = set()
        self.hidden: list[str] = []

    def put(self, pattern: re.Pattern, by, kind: str, *need: str) -> None:
        """Replaces what ``pattern`` finds; ``need`` are strings of which a match has one."""
        if need and not any(x in self.text for x in need):
            return
        self.text, n = pattern.subn(by, self.text)
        if n:
            self.met.add(kind)

    def hide(self) -> None:
        def keep(m: re.Match) -> str:
            g = m.lastgroup if m.lastgroup in _KINDS else next(k for k in _KINDS if m[k] is not None)
            kind, body = _KINDS[g]
            self.met.add(kind)
            inner = m[body]
            if g in ("macro", "verb"):
                inner = "\n```\n" + inner.strip("\n") + "\n```\n"
            elif g == "pre":
                if _ENTITY.search(inner):
                    self.met.add("html")
                inner = "\n```\n" + html.unescape(_TAG.sub("", inner)).strip("\n") + "\n```\n"
            elif g in ("env", "dollars", "square"):
                inner = "\n$$" + inner.strip() + "$$\n"
            elif g in ("round", "inline"):
                inner = "$" + inner.strip() + "$"
            self.hidden.append(inner)
            return f"\0{len(self.hidden) - 1}\0"

        def fence(m: re.Match) -> str:
            self.met.add("markdown")
            self.hidden.append("\n```\n" + m["body"].strip("\n") + "\n```\n")
            return f"\0{len(self.hidden) - 1}\0"

        if "```" in self.text or "~~~" in self.text:
            self.text = _FENCE.sub(fence, self.text)
        if any(x in self.text for x in ("`", "$$", "\\", "{code", "{noformat")) or "<pre" in self.text.lower():
            self.text = _HIDE.sub(keep, self.text)

    def show(self) -> None:
        while "\0" in self.text:
            self.text = re.sub("\0(\\d+)\0", lambda m: self.hidden[int(m[1])], self.text)

    def elements(self) -> None:
        """HTML elements into lines; the text of containers that lost their host's vote goes."""
        self.put(_COMMENT, "", "html")
        self.put(_DROP, "\n", "html")
        pieces = _TAG.split(self.text)
        if len(pieces) == 1:
            return
        self.met.add("html")
        out, lists, path, out_of = [pieces[0]], [], [], 0
        for tag, text in zip(pieces[1::2], pieces[2::2]):
            m = _NAME.match(tag)
            name, closing = (m[1].lower() if m else "html"), tag.startswith("</")
            if name in CONTAINERS:
                if not closing:
                    path.append(step(name, tag))
                    out_of += "/".join(path) in self.lost
                elif path and any(p.split(".")[0] == name for p in path):
                    while path:
                        out_of -= "/".join(path) in self.lost
                        if path.pop().split(".")[0] == name:
                            break
            if name in ("ul", "ol"):
                if closing:
                    del lists[-1:]
                else:
                    lists.append([name, 0])
            if name == "li" and not closing:
                if lists:
                    lists[-1][1] += 1
                mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                out.append("\n" + "  " * max(0, len(lists) - 1) + mark)
            elif name[0] == "h" and name[1:].isdigit():
                out.append("\n\n" if closing else "\n\n" + "#" * int(name[1:]) + " ")
            elif name in ("td", "th"):
                out.append(" | " if closing else "")
            elif name == "p" or name == "table":
                out.append("\n\n")
            elif name in BREAKS and name != "li":
                out.append("\n")
            if not out_of:
                out.append(text.lstrip() if name == "li" and not closing else text)
        self.text = re.sub(r"(?m)[ \t]*\|[ \t]*$", "", "".join(out))

    def entities(self) -> None:
        def decode(m: re.Match) -> str:
            if m[1] and m[1] + ";" not in html5:
                return m[0]
            self.met.add("html")
            return html.unescape(m[0])

        self.text = _ENTITY.sub(decode, self.text)

    def wiki(self) -> None:
        self.put(_REFERENCE, "", "wiki", "<")
        self.put(_CONF_HEAD, lambda m: "#" * int(m[1]) + " " + m[2], "wiki", *(f"h{i}. " for i in range(1, 7)))
        self.put(_WIKI_HEAD, lambda m: "\n" + "#" * len(m[1]) + " " + m[2] + "\n", "wiki", " =")
        self.put(_WIKI_TABLE, lambda m: "\n".join(re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", " | ", x[1:].strip()) for x in m[1].split("\n") if x[:1] in "|!" and x[:2] not in ("|-", "|+") and x.strip()), "wiki", "{|")
        self.put(_CONF_TABLE, lambda m: re.sub(r"[ \t]*\|\|[ \t]*", " | ", m[1]), "wiki", "||")
        self.put(_CATEGORY, "", "wiki", "[[")
        self.put(_FILE, r"\1", "wiki", "[[")
        self.put(_WIKI_LINK, r"\1", "wiki", "[[")
        self.put(_TEMPLATE, "", "wiki")
        self.put(_MONO, r"\1", "wiki")
        self.put(_EXTERNAL, r"\1", "wiki")
        self.put(_CONF_LINK, r"\1", "wiki")
        self.put(_QUOTES, lambda m: m[1] or m[2], "wiki", "''")
        self.put(_MACRO, "", "wiki")
        self.put(_MAGIC, "", "wiki", "__")
        self.put(_BQ, "", "wiki", "bq.")

    def markdown(self) -> None:
        wiki = "wiki" in self.met
        self.put(_SETEXT, lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], "markdown", "\n===", "\n---")
        self.put(_MD_TABLE, "", "markdown", "---")
        for x in (_IMAGE, _LINK, _REF_LINK):
            self.put(x, r"\1", "markdown")
        self.put(_REF, "", "markdown", "]: ")
        self.put(_NOTE, "", "markdown", "[^")
        self.put(_TASK, r"\1", "markdown", " [ ] ", " [x] ", " [X] ")
        self.put(_BOLD, lambda m: m[1] or m[2], "markdown", "**", "__")
        self.put(_STRIKE, r"\1", "markdown", "~~")
        self.put(_QUOTE, "", "markdown", "> ")
        self.put(_EMPHASIS, lambda m: m[1] or m[2], "wiki" if wiki and "markdown" not in self.met else "markdown", "*", "_")
        if "|" in self.text:
            self.text = _PIPES.sub(lambda m: re.sub(r"[ \t]*\|[ \t]*", " | ", m[1].strip()), self.text)
        if self.met & {"wiki", "markdown"}:
            self.text = _BULLET.sub(r"\1- ", self.text)

    def latex(self) -> None:
        if "\\" not in self.text:
            return
        self.put(_SECTION, lambda m: "\n" + "#" * _SECTIONS.get(m[1], 3) + " " + m[2] + "\n", "latex")
        self.put(_TITLE, r"\n# \1\n", "latex")
        self.put(_TABULAR, lambda m: "\n".join(re.sub(r"\s*&\s*", " | ", r.strip()) for r in re.split(r"\\\\|\\hline", m[1]) if r.strip()), "latex")
        marks: list[list] = []

        def item(m: re.Match) -> str:
            if m[1]:
                marks.append([m[1], 0])
                return ""
            if m[2]:
                del marks[-1:]
                return ""
            if marks:
                marks[-1][1] += 1
            lead = f"{marks[-1][1]}. " if marks and marks[-1][0] == "enumerate" else "- "
            return lead + (m[3] + ": " if m[3] else "")

        self.put(_LISTS, item, "latex")
        self.put(_HIDDEN, "", "latex")
        self.put(_HREF, r"\1", "latex")
        self.put(_ENV, "", "latex")
        for _ in range(3):
            self.put(_COMMAND, r"\1", "latex")
        self.put(_BARE, "", "latex")
        if "latex" in self.met:
            self.text = re.sub(r"\\([%&#_{}$])", r"\1", self.text)


_KINDS = {
    "pre": ("html", "pb"), "macro": ("wiki", "mb"), "verb": ("latex", "vb"), "env": ("latex", "eb"),
    "dollars": ("latex", "db"), "square": ("latex", "sb"), "round": ("latex", "rb"), "inline": ("latex", "ib"), "tick": ("markdown", "tb"),
}
_ANY = re.compile(r"[<&*`#\[{\\$='~_|]|^(?:h[1-6]\.|bq\.|>)|^-{3,}", re.M)


def step(name: str, tag: str) -> str:
    """A step of a container's path: tag and classes, numbers generalised."""
    c = _CLASS.search(tag)
    return name + "".join("." + re.sub(r"\d+", "0", x) for x in (c[1].split() if c else ()))


def _headings(page: Page, had: str) -> None:
    """Lines of one "#": headings of Markdown where they stand alone, items of a wiki's numbered
    list where the text is a wiki's or where several follow each other."""
    conf = bool(_CONF_HEAD.search(had))
    n = 0

    def line(m: re.Match) -> str:
        nonlocal n
        above = page.text[: m.start()].rstrip("\n").rpartition("\n")[2] if m.start() else ""
        below = page.text[m.end() :].lstrip("\n").partition("\n")[0]
        alone = (m.start() == 0 or page.text[m.start() - 1 : m.start()] == "\n") and page.text[m.end() : m.end() + 2] in ("\n\n", "\n", "")
        run = above.startswith("# ") or below.startswith("# ")
        if len(m[1]) == 1 and (conf or run or not alone):
            n = n + 1 if above.startswith("# ") else 1
            if conf or run:
                page.met.add("wiki")
                return f"{n}. {m[2]}"
            return m[0]
        if not (conf and len(m[1]) > 1):
            page.met.add("markdown")
        return f"{m[1]} {m[2]}"

    page.text = _ATX.sub(line, page.text)


def convert(text: str, lost: frozenset[str] = frozenset()) -> tuple[str, set[str]]:
    """Clean text, and the notations of which constructs were converted."""
    if not _ANY.search(text):
        return text, set()
    page = Page(text.replace("\0", ""), lost)
    page.hide()
    if "#" in page.text:
        _headings(page, page.text)
    if "<" in page.text:
        page.elements()
    page.latex()
    page.wiki()
    page.markdown()
    if "&" in page.text:
        page.entities()
    page.show()
    out = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", page.text.replace("\xa0", " ").replace("\xad", "")))
    return out.strip("\n"), page.met


def containers(text: str) -> dict[str, list[int]]:
    """Path -> containers, characters, characters in links, of the text directly in each container."""
    if "<" not in text:
        return {}
    pieces = _TAG.split(_DROP.sub("", _COMMENT.sub("", text)))
    got: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    path: list[str] = []
    link = 0
    for tag, piece in zip(pieces[1::2], pieces[2::2]):
        m = _NAME.match(tag)
        name, closing = (m[1].lower() if m else ""), tag.startswith("</")
        if name in CONTAINERS:
            if not closing:
                path.append(step(name, tag))
                got["/".join(path)][0] += 1
            elif any(p.split(".")[0] == name for p in path):
                while path.pop().split(".")[0] != name:
                    pass
        elif name == "a":
            link = 0 if closing else 1
        n = len(piece.strip())
        if path and n:
            got["/".join(path)][1] += n
            got["/".join(path)][2] += n * link
    return got


def _site(documents: DataFrame) -> Column:
    if "url" not in documents.columns:
        return F.lit(None).cast("string")
    return F.nullif(F.lower(F.regexp_extract("url", r"^\s*[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def vote(documents: DataFrame) -> DataFrame:
    """(site, path, containers, chars, link_chars, content) of the containers of each host's pages:
    whether the path holds content. Hosts of a single page decide nothing and lose no path."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(s, p, 1, *n) for s, t in zip(b["site"], b["text"]) for p, n in containers(t).items()]
            yield pd.DataFrame(got, columns=["site", "path", "pages", "containers", "chars", "link_chars"])

    pages = documents.select(_site(documents).alias("site"), "text").where("site is not null and text is not null and contains(text, '<')")
    each = pages.mapInPandas(score, "site string, path string, pages long, containers long, chars long, link_chars long")
    sums = each.groupBy("site", "path").agg(*[F.sum(c).alias(c) for c in ("pages", "containers", "chars", "link_chars")])
    lost = (F.col("pages") > 1) & (F.col("chars") > 0) & (F.col("link_chars") >= LINK_SHARE * F.col("chars")) & (F.col("chars") < THIN * F.col("containers"))
    return sums.withColumn("content", ~lost)


def clean(documents: DataFrame) -> DataFrame:
    """(doc_id, text, markup) of ``documents`` (doc_id, text, url): the clean text and the array of
    notations found, of html, latex, markdown and wiki, in this order.

    Nulls: rows without doc_id are ignored, a null text stays null and has no markup, without a url
    no container is left out. Repeated rows count once; kind and other columns are not read. Empty
    tables give no rows. Texts are converted whole.

    Scale: two passes without a shuffle of texts; what is summed are counts per host and path. The
    losing paths of a host come back as one array per host, by a join on the host that is broadcast
    where the planner finds it small.
    """
    lost = vote(documents).where(~F.col("content")).groupBy("site").agg(F.collect_set("path").alias("lost"))
    lost = session.stored(lost, "lost")
    rows = documents.where("doc_id is not null").select("doc_id", "text", _site(documents).alias("site"))
    none = F.lit(None).cast("array<string>")
    placed = rows.where("site is not null").join(lost, "site", "left").select("doc_id", "text", "lost")
    placed = placed.union(rows.where("site is null").select("doc_id", "text", none.alias("lost")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for doc, text, paths in zip(b["doc_id"], b["text"], b["lost"]):
                new, met = convert(text, frozenset(paths) if paths is not None else frozenset()) if text is not None else (None, ())
                got.append((doc, new, sorted(met)))
            yield pd.DataFrame(got, columns=["doc_id", "text", "markup"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return placed.mapInPandas(run, f"doc_id {kind}, text string, markup array<string>")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, markup) of the notations that the converter met."""
    return clean(documents).select("doc_id", F.explode("markup").alias("markup")).distinct()
