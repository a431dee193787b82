"""Main text of web pages by a site style tree.

Pages of a host are merged into one tree of style nodes (tag, class and id from
the root).  A node's presentation importance is the entropy of its child
sequences over the host's pages: a template looks alike everywhere, an article
does not.  Its content importance is one minus the mean entropy of its text
blocks: a block that stands on every page says nothing.  A branch's importance
is the mean over its nodes at any depth, deeper ones counting less.  Branches
of low importance without any branch of more below are cut from each page, besides elements whose tag, role or class
name declares them page furniture; what an article element declares as text
(paragraphs, headings, quotes) is never cut by statistics.

Pages with equal text count once in the statistics.  A branch is judged with
``PRIOR_PAGES`` more pages on which it says all it can, so that few pages
weigh little and no number of pages switches the tree on.  A class name alone
removes neither a declared article nor the last text of a page.

Defined results: null or empty html gives an empty text; a null url is a host
of its own without statistics; broken markup is read as browsers do (open
paragraphs end at the next block, an open comment ends the page); repeated
rows are extracted alike; other columns are not looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import record, settle, slices

#: Branches under this importance are cut; pages of full importance that each branch is taken to have besides its own;
#: weight of one level of depth.
LEAST_IMPORTANCE, PRIOR_PAGES, DEPTH_WEIGHT = 0.3, 1.0, 0.9
#: Most low branches that are sent to every executor.
BROADCAST_PATHS = 500_000
SALTS = 32
#: Ancestors in one Arrow batch of node values.
BATCH_ANCESTORS = 1 << 20

# Elements and names by their meaning in pages.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead title tr ul".split())
DECLARED_TEXT = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
FURNITURE = set("head nav aside footer form script style noscript template iframe object svg canvas button select textarea dialog menu audio video title".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar rail widget widgets cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup "
    "login search share sharing social related recommended recommendations comment comments commentlist disqus replies reply respond pagination pager toolbar skiplink "
    "copyright disclaimer".split())
COMMENT_NAMES = set("comment comments commentlist disqus replies reply respond".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAG = re.compile(r"""<(?:!--(?:.*?(?:-->|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)[^>]*+>|[!?/][^>]*+>)""", re.S)
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """One open element: its style key, whether it is dropped or inside declared content, its child sequence."""

    __slots__ = ("tag", "key", "parent", "depth", "dropped", "inside", "children", "named", "content")

    def __init__(self, tag, key, parent, depth, dropped, inside, named=None, content=False):
        self.tag, self.key, self.parent, self.depth, self.dropped, self.inside = tag, key, parent, depth, dropped, inside
        self.children: list[str] = []
        #: The outermost element that nothing but its name removes, if nothing else removes this one.
        self.named: Node | None = named
        self.content = content


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _style(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """Style name of a start tag, whether it is furniture by role or name, whether by name alone, whether it declares the article.

    An element that declares the article is never furniture by a name, but for
    those of reader comments.
    """
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(attrs):
        found.setdefault(name.lower(), value.strip("\"'"))
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = [w.lower() for w in _NAME.findall(names)]
    role = found.get("role", "").lower()
    furniture = role in FURNITURE_ROLES or "hidden" in found
    content = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody"
    named = tag not in ("html", "body", "main") and not {"has", "with", "no", "without"} & set(words) and bool((COMMENT_NAMES if content else FURNITURE_NAMES) & set(words))
    only = named and not furniture and not COMMENT_NAMES & set(words)
    return f"{tag}.{'.'.join(words)}", furniture or named, only, content


def read(html: str | None, low: frozenset | set = frozenset()) -> tuple[list[tuple[Node, str]], list[Node], bool]:
    """Text blocks with their nodes, all nodes in page order, and whether an article is declared."""
    root = Node("#", 0, None, 0, False, False)
    stack, nodes, blocks, parts = [root], [], [], []
    declared, html, at = False, html or "", 0

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                holder = next((n for n in reversed(stack) if n.tag in BLOCKS), stack[-1])
                blocks.append((holder, text))

    def close(i):
        if any(n.tag in BLOCKS for n in stack[i:]):
            flush()
        del stack[i:]

    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        tag = name.lower()
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            else:
                if tag in BLOCKS:
                    flush()
            continue
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
        elif tag == "br" or tag in ("td", "th"):
            parts.append(" ")
        if tag in ENDS:
            ends, scope = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in ends and (tag != "tr" or stack[i].tag == "tr"):
                    close(i)
                    break
        if tag in VOID:
            continue
        attrs = m["attrs"] or ""
        style, furniture, only_named, content = _style(tag, attrs)
        up = stack[-1]
        key = _signed(xxhash.xxh64_intdigest(f"{up.key}>{style}"))
        inside = up.inside or content
        cut = tag in FURNITURE or furniture or tag == "header" and not up.inside
        if tag == "header" and up.inside and not {"comment", "comments"} & set(style.split(".")):
            cut = False
        if not cut and key in low and not content and not (inside and tag in DECLARED_TEXT) and tag not in ("html", "body"):
            cut = True
        node = Node(tag, key, up, up.depth + 1, up.dropped or cut, inside, content=content)
        hard = cut and not (only_named and tag not in FURNITURE and tag != "header" and key not in low)
        if not hard and (up.named or cut and not up.dropped):
            node.named = up.named or node
        declared = declared or content and not node.dropped
        up.children.append(style)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"(?i)</{tag}[\s/>]").search(html, at)
            at = end.start() if end else len(html)
        if not attrs.rstrip().endswith("/") or tag in BLOCKS or tag in RAW:
            stack.append(node)
    flush()
    return blocks, nodes, declared


def extract(html: str | None, low: frozenset | set = frozenset()) -> str:
    """Main text: blocks of the article, or of the page where none is declared, joined by empty lines."""
    blocks, nodes, declared = read(html, low)
    kept = [t for n, t in blocks if not n.dropped and (n.inside or not declared)]
    if not kept:
        # a class name alone does not empty a page: of the branches that only names remove the one
        # with most declared text (paragraphs, headings, quotes) comes back
        sizes: dict[int, int] = {}
        inside = any(n.content and (n.named or not n.dropped) for n in nodes)
        back = [(n, t) for n, t in blocks if n.named and (n.inside or not inside)]
        for n, t in back:
            if n.tag in DECLARED_TEXT:
                sizes[id(n.named)] = sizes.get(id(n.named), 0) + len(t)
        most = max(sizes, key=sizes.get, default=None)
        kept = [t for n, t in back if id(n.named) == most]
    return "\n\n".join(kept)


# ---------------------------------------------------------------- the tree of a host

_ROWS = pa.schema([("host", pa.string()), ("path", pa.int64()), ("kind", pa.int8()), ("value", pa.int64()), ("ancestors", pa.list_(pa.int64())), ("page", pa.int64())])


def host(url) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def _chain(n: Node) -> list[int]:
    """Keys from below the root to the node, however deep."""
    keys = []
    while n.parent is not None:
        keys.append(n.key)
        n = n.parent
    return keys[::-1]


def nodes_of(pages: DataFrame) -> DataFrame:
    """Presentation (kind 0) and content (kind 1) values of each page's nodes that no role removes."""

    def run(batches):
        for b in slices(batches, "html"):
            out, held = [], 0
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks, nodes, _ = read(text)
                page = _signed(xxhash.xxh64_intdigest("\n".join(t for _, t in blocks)))
                looks: dict[int, list[str]] = {}
                holders: dict[int, Node] = {}
                for n in nodes:
                    if n.dropped:
                        continue
                    looks.setdefault(n.key, []).append(" ".join(n.children))
                    holders.setdefault(n.key, n)
                values = [(key, 0, "|".join(seen)) for key, seen in looks.items()]
                values += dict.fromkeys((n.key, 1, t) for n, t in blocks if not n.dropped and n.key in holders)
                for key, kind, value in values:
                    chain = _chain(holders[key])
                    out.append((h, key, kind, _signed(xxhash.xxh64_intdigest(value)), chain, page))
                    held += len(chain)
                    if held >= BATCH_ANCESTORS:
                        yield record(_ROWS, list(zip(*out)))
                        out, held = [], 0
            yield record(_ROWS, list(zip(*out)) if out else [[]] * len(_ROWS))

    return pages.select(host("url").alias("host"), "html").where("host <> ''").mapInArrow(
        run, "host string, path long, kind byte, value long, ancestors array<long>, page long")


def importance(rows: DataFrame) -> DataFrame:
    """``host, branch, pages, importance`` of every branch of every host's style tree."""
    # pages with the same text count once; the hot host leaves both steps combined
    seen = rows.groupBy("host", "path", "kind", "value").agg(F.count_distinct("page").alias("n"), F.first("ancestors").alias("ancestors"))
    n = F.col("n")
    node = seen.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, n)).alias("m"),
        F.sum(F.when(F.col("kind") == 0, n * F.log(n))).alias("styles"),
        F.sum(F.when(F.col("kind") == 1, n)).alias("texts"),
        F.sum(F.when(F.col("kind") == 1, n * F.log(n))).alias("repeats"),
        F.first("ancestors").alias("ancestors"))
    m = F.col("m")
    # -sum p log p = log m - sum n log n / m, in units of log m
    looks = F.when(m > 1, 1 - F.col("styles") / (m * F.log(m))).otherwise(1.0)
    says = F.when(m > 1, 1 - F.least(F.lit(1.0), F.col("repeats") / (F.col("texts") * F.log(m)))).otherwise(1.0)
    node = node.select("host", "ancestors", "m", F.when(F.col("texts").isNotNull(), says).otherwise(looks).alias("own"), F.coalesce("texts", "m").alias("weight"))
    up = node.select("host", "m", "own", "weight", F.size("ancestors").alias("depth"), F.posexplode("ancestors").alias("place", "branch"))
    w = F.col("weight") * F.pow(F.lit(DEPTH_WEIGHT), F.col("depth") - 1 - F.col("place"))
    return up.groupBy("host", "branch").agg(
        F.max(F.when(F.col("place") == F.col("depth") - 1, F.col("m"))).alias("pages"), (F.sum(w * F.col("own")) / F.sum(w)).alias("importance"))


def low_branches(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """``host, branch`` to cut: of low importance, as is every branch below."""
    rows = settle(nodes_of(pages), "nodes")
    n = F.coalesce("pages", F.lit(0))
    smooth = (F.col("importance") * n + PRIOR_PAGES) / (n + PRIOR_PAGES)
    found = settle(importance(rows).withColumn("importance", smooth), "importance")
    high = found.where(F.col("importance") >= least).select("host", F.col("branch").alias("path"))
    chains = rows.where("kind = 0").groupBy("host", "path").agg(F.first("ancestors").alias("ancestors"))
    above = chains.join(high, ["host", "path"]).select("host", F.explode("ancestors").alias("branch")).distinct()
    low = found.where(F.col("importance") < least).select("host", "branch")
    return low.join(above, ["host", "branch"], "left_anti")


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    low = settle(low_branches(pages), "low")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host("url").alias("host"))
    if low.count() <= BROADCAST_PATHS:
        cut: dict[str, set] = {}
        for r in low.collect():
            cut.setdefault(r.host, set()).add(r.branch)
        known = pages.sparkSession.sparkContext.broadcast(cut)
        rows = rows.withColumn("low", F.lit(None).cast("array<long>"))
    else:
        known = None
        own = low.groupBy("host").agg(F.collect_set("branch").alias("low")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(own, ["host", "salt"], "left")

    def run(batches):
        for b in slices(batches, "html"):
            ids, urls, htmls, hosts, lows = (b.column(c).to_pylist() for c in ("page_id", "url", "html", "host", "low"))
            cuts = [known.value.get(h, ()) if known else set(c or ()) for h, c in zip(hosts, lows)]
            texts = [extract(t, c) for t, c in zip(htmls, cuts)]
            yield record(_TEXTS, [ids, urls, texts, [len(t) for t in texts]])

    return rows.select("page_id", "url", "html", "host", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long")
