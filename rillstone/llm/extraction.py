"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive and tags negative; a linear scan finds the
contiguous run with the highest sum, the content region. Weights are log odds learned from labelled
pages: those that mark their article themselves. Words inside page furniture (menus, adverts and the
like) score negative and never enter the text. Furniture is known by its element, by a name (class, id
or role) whose head is one of few fixed words, and by names that labelled pages show outside articles only.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, slices, stage

#: At most so many labelled pages are learned from: those whose hashed ids are smallest.
SAMPLE = 1000

# Kinds of HTML elements.
RAW = "script style noscript template textarea select svg iframe object canvas head title"
VOID = "area base br col embed hr img input link meta param source track wbr"
BLOCK = "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody thead tfoot tr ul caption"
FURNITURE = "nav footer aside form button menu dialog"
OPTIONAL_END = "p li td th tr dd dt option"
INLINE = "a abbr b bdi bdo cite code data del dfn em i ins kbd mark q s samp small span strong sub sup time u var"
RUNNING = "p li td th dd dt h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption"
HINTS = (
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert "
    "sidebar aside widget nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond "
    "related recommended recommendations share sharing social newsletter subscribe signup login popup modal overlay pagination pager "
    "toolbar copyright legal disclaimer skip search"
)
#: Last parts of a name that say where or how, not what: the part before them is its head.
PLACES = (
    "list area wrapper wrap container box section block link links button buttons bar post posts article articles story stories item items left right top bottom "
    "unit slot inner outer content panel pane title heading header body text form group row column col main bg js break zone region label"
)
#: A name counts as furniture's if it is on so many labelled pages and none of its words is in an article.
SHOWN = 5
TAGS = " ".join(dict.fromkeys(f"{RAW} {VOID} {BLOCK} {FURNITURE} {OPTIONAL_END} header a b i em strong span u s small sub sup code q cite font label time mark".split()))

_RAW, _VOID, _BLOCK, _FURNITURE, _OPTIONAL, _HINTS, _PLACES, _TAGS, _INLINE, _RUNNING = (frozenset(x.split()) for x in (RAW, VOID, BLOCK, FURNITURE, OPTIONAL_END, HINTS, PLACES, TAGS, INLINE, RUNNING))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+>)|([^<>]*(?:>|\Z))|([^<>]*))",
    re.S,
)
#: The same without regard to quotes, for what follows a quote that is never closed.
_PLAIN_TOKEN = re.compile(_TOKEN.pattern.replace(r"""(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+>""", "(?!)"), re.S)
#: What may stand in a head; the first other element ends it, as its end tag may be left out.
IN_HEAD = "base basefont bgsound link meta noframes noscript script style template title"
_IN_HEAD = frozenset(IN_HEAD.split())
#: End tags of raw elements, in a page of any letters: lower() would move places behind U+0130.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in _RAW}
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]\S*)))?""")
#: Parts of a name: letters, with digits behind them at most.
_PART = re.compile(r"(?<![a-z0-9])[a-z]+(?=[0-9]*(?![a-z0-9]))")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_CONTENT = frozenset(["article", "main"])
#: Weights without labelled pages: a tag costs a word, one of running text far less, a piece of furniture two words.
DEFAULT = {"word": 1.0, "furniture": -2.0, "tag": -1.0} | dict.fromkeys("p a b i em strong u span br h1 h2 h3 h4 h5 h6 li sup sub q code".split(), -0.1)


def _attributes(rest: str) -> Iterator[tuple[str, str]]:
    """Names, in lower case, and values of a tag's attributes, one after another."""
    for m in _ATTRIBUTE.finditer(rest):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


def _names(rest: str) -> Iterator[tuple[str, list[str]]]:
    """The names in an element's class, id and role, in lower case, with their parts."""
    for attribute, value in _attributes(rest):
        if attribute in ("class", "id", "role"):
            for name in value.split():
                yield name.lower(), _PART.findall(re.sub("([a-z])([A-Z])", r"\1 \2", name).lower())


def _is_text(m: re.Match) -> bool:
    """Whether what looks like a tag is text, as in ``a<b and c``: it does not close before the next ``<`` and has no attributes."""
    return m[5] is not None and not m[1] and "=" not in m[5] and not (m[2].lower() in _BLOCK | _FURNITURE and not m[5].strip())


def _is_hidden(rest: str) -> bool:
    return any(a == "hidden" or (a == "aria-hidden" and v.strip().lower() == "true") or (a == "style" and _UNSEEN.search(v)) for a, v in _attributes(rest))


def _is_furniture(name: str, rest: str, in_content: bool, running: bool, outside: Collection[str]) -> bool:
    """Whether an element is a piece of furniture. In running text an inline element is none for its names."""
    if name in _FURNITURE or (name == "header" and not in_content):
        return True
    if name in _CONTENT or name in ("html", "body") or len(rest) < 5:
        return False
    if _is_hidden(rest):
        return True
    if running and name in _INLINE:
        return False
    for own, parts in _names(rest):
        while len(parts) > 1 and parts[-1] in _PLACES:
            parts.pop()
        if own in outside or (parts and parts[-1] in _HINTS):
            return True
    return False


class _Open:
    """Open elements from the outermost piece of furniture on."""

    def __init__(self):
        self.names, self.count = [], Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1

    def close(self, name: str) -> None:
        """End the innermost element of the name, and with it all inside; nothing if none is open."""
        while self.count[name]:
            last = self.names.pop()
            self.count[last] -= 1
            if last == name:
                return

    def clear(self) -> None:
        self.names.clear()
        self.count.clear()


def _raw_end(page: str, at: int, name: str) -> int:
    """The place after the end tag of a raw element whose content begins at ``at``."""
    close = _RAW_END[name].search(page, at)
    return page.find(">", close.start()) + 1 or len(page) if close else len(page)


def _head_end(page: str, at: int) -> int:
    """The place after a head's end tag, or of the first tag or text that cannot stand in a head."""
    while m := _TOKEN.search(page, at):
        if page[at : m.start()].strip():
            return at
        name = (m[2] or "").lower()
        if name and _is_text(m):
            return m.start()
        if m[1] and name == "head":
            return m.end()
        if name and not m[1] and name not in _IN_HEAD or m[1] and name in ("body", "html"):
            return m.start()
        at = m.end()
        if name in _RAW and not m[1] and not (m[3] or m[4] or m[5]).endswith("/>"):
            at = _raw_end(page, at, name)
    return at if page[at:].strip() else len(page)


def tokens(page: str, outside: Collection[str] = ()) -> Iterator[tuple[str, str, bool, bool]]:
    """Tokens of a page: (kind, value, in furniture, in a marked article). Kind is ``text`` or the tag's
    name; value is the text, or what the tag does: ``block`` ends a block, ``space`` parts words, else empty.
    ``outside`` are names of furniture. Every character is looked at a few times at most."""
    at, end, pattern = 0, len(page), _TOKEN
    furniture = _Open()
    content, running = 0, False
    while at < end:
        m = pattern.search(page, at)
        start = m.start() if m else end
        if text_too := bool(m and m[2] and _is_text(m)):
            start = m.end()
        if start > at:
            text = page[at:start]
            running = running or not text.isspace()
            yield "text", text, bool(furniture.names), content > 0
        if not m:
            return
        at = m.end()
        if m[3] is None and m[2]:  # a quote may be left open: later tags are read without regard to quotes
            pattern = _PLAIN_TOKEN
        if not m[2] or text_too:
            continue
        closing, name, rest = bool(m[1]), m[2].lower(), m[3] or m[4] or m[5]
        if name in _RAW:
            if not closing and not rest.endswith("/>"):
                at = _head_end(page, at) if name == "head" else _raw_end(page, at, name)
            continue
        held = bool(furniture.names)  # the end of a piece of furniture belongs to it
        if closing:
            furniture.close(name)
            content -= name in _CONTENT and content > 0
        elif name not in _VOID and not rest.endswith("/>"):
            if name in _OPTIONAL and furniture.count[name]:
                furniture.close(name)
            elif furniture.names and furniture.names[0] in _OPTIONAL and name in _BLOCK:
                furniture.clear()
            if furniture.names or _is_furniture(name, rest, content > 0, running, outside):
                furniture.push(name)
            content += name in _CONTENT
        if name not in _INLINE and name not in _VOID:
            running = name in _RUNNING and not closing
        does = "block" if name in _BLOCK or name in _FURNITURE or name == "header" else "space" if name in ("br", "td", "th", "img", "option") else ""
        yield (name if name in _TAGS else "other"), does, bool(furniture.names) or (closing and held), content > 0


def names_of(page: str) -> Counter:
    """Words of text under each name (class, id or role) of a page with a marked article, inside and outside it.

    Words are counted once; a name gets those between its first open element and its last end.
    """
    out, marked, at, end, pattern = Counter(), False, 0, len(page), _TOKEN
    stack: list[tuple[str, tuple[str, ...]]] = []  # open elements and their names
    held: dict[str, list[int]] = {}  # per name its open elements, and words inside and outside articles before them
    words = [0, 0]
    content = 0

    def leave(names: tuple[str, ...]) -> None:
        for name in names:
            held[name][0] -= 1
            if not held[name][0]:
                _, outer, inner = held.pop(name)
                for side, n in ((False, words[0] - outer), (True, words[1] - inner)):
                    if n:
                        out[name, side] += n

    while at < end:
        m = pattern.search(page, at)
        start = m.start() if m else end
        if text_too := bool(m and m[2] and _is_text(m)):
            start = m.end()
        if held:
            words[content > 0] += len(page[at:start].split())
        if not m:
            break
        at = m.end()
        if m[3] is None and m[2]:
            pattern = _PLAIN_TOKEN
        if not m[2] or text_too:
            continue
        tag, rest = m[2].lower(), m[3] or m[4] or m[5]
        if tag in _RAW:
            if not m[1] and not rest.endswith("/>"):
                at = _head_end(page, at) if tag == "head" else _raw_end(page, at, tag)
        elif m[1]:
            content -= tag in _CONTENT and content > 0
            if any(t == tag for t, _ in stack[-64:]):
                while stack:
                    last, own = stack.pop()
                    leave(own)
                    if last == tag:
                        break
        elif tag not in _VOID and not rest.endswith("/>"):
            content += tag in _CONTENT
            marked |= content > 0
            own = tuple({name for name, _ in _names(rest)}) if len(rest) > 5 else ()
            stack.append((tag, own))
            for name in own:
                held.setdefault(name, [0, *words])[0] += 1
    for _, own in stack:
        leave(own)
    return out if marked else Counter()


def learn(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Weights from how often each kind of token stands inside and outside marked articles.

    They are log odds; those of words are held above zero and those of tags below, as the method has
    it. A piece of furniture costs its log odds as a whole, two words at least, so a region may reach
    over one, but not begin or end with it.
    """
    inside, outside = (sum(n for (_, own), n in counts.items() if own == side) for side in (True, False))
    if not inside:
        return dict(DEFAULT)
    kinds = {k for k, _ in counts}
    odds = {k: math.log((counts.get((k, True), 0) + 1) / (inside + len(kinds))) - math.log((counts.get((k, False), 0) + 1) / (outside + len(kinds))) for k in kinds}
    word = max(odds.get("word", 1.0), 0.5)
    out = {k: min(w, -0.5) for k, w in odds.items() if k not in ("word", "furniture")}
    return out | {"word": word, "furniture": min(odds.get("furniture", 0.0), -2 * word), "tag": DEFAULT["tag"]}


def token_counts(page: str, outside: Collection[str] = ()) -> Counter:
    """Tokens of each kind inside and outside the marked article; none if the page marks none."""
    out, marked = Counter(), False
    for kind, value, furniture, content in tokens(page, outside):
        marked |= content
        if kind != "text":
            out[kind, content] += 1
        elif n := len(value.split()):
            out["furniture" if furniture else "word", content] += n
    return out if marked else Counter()


def main_text(page: str | None, weights: dict[str, float], outside: Collection[str] = ()) -> str:
    """The text of the best region: blocks in page order, joined by newlines. Null and empty pages give ""."""
    if not page:
        return ""
    seen = list(tokens(page, outside))
    default = weights.get("tag", DEFAULT["tag"])
    best, total, begin, region = 0.0, 0.0, 0, (0, 0)
    inside = False
    for i, (kind, value, furniture, _) in enumerate(seen):
        if furniture:
            score = 0.0 if inside else weights["furniture"]
        else:
            score = len(value.split()) * weights["word"] if kind == "text" else weights.get(kind, default)
        inside = furniture
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, region = total, (begin, i + 1)
    blocks, own = [], []
    for kind, value, furniture, _ in seen[region[0] : region[1]]:
        if kind == "text":
            if not furniture:
                own.append(value)
        elif value == "block":
            blocks.append("".join(own))
            own = []
        elif value == "space":
            own.append(" ")
    blocks.append("".join(own))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


Model = tuple[dict[str, float], frozenset[str]]


def _counted(count, kinds: str):
    """Sums of a page's counts over each batch, as rows (what, inside, n, pages)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total, pages = Counter(), Counter()
        for page in batch.column(0).to_pylist():
            own = count(page or "")
            total.update(own)
            pages.update(own.keys())
        rows = [(what, inside, n, pages[what, inside]) for (what, inside), n in total.items()]
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["what", "inside", "n", "pages"])

    return per_batch(run), kinds


def fit(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """Weights, and names of furniture, from at most ``sample`` pages, one row per page_id.

    What is collected is a count per kind of tag, a fixed list, and names that stand outside articles
    only on SHOWN of the sampled pages or more.
    """
    kinds = "what string, inside boolean, n long, pages long"
    chosen = pages.where(F.col("page_id").isNotNull()).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    own = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).select("html")
    own = stage(own, "labelled-pages")
    words = own.mapInArrow(*_counted(names_of, kinds)).groupBy("what").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("n"), F.sum("pages").alias("pages"))
    outside = frozenset(r["what"] for r in words.where((F.col("n") == 0) & (F.col("pages") >= SHOWN)).collect())
    counted = own.mapInArrow(*_counted(lambda page: token_counts(page, outside), kinds)).groupBy("what", "inside").agg(F.sum("n").alias("n"))
    return learn({(r["what"], r["inside"]): r["n"] for r in counted.collect()}), outside


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html, any others).

    A null or empty page has an empty text. Rows that repeat get equal results; an empty table gives no rows.
    """
    weights, outside = fit(pages) if model is None else model

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 2, 4 << 20):
            texts = [main_text(p, weights, outside) for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = pages.select("page_id", "url", "html").mapInArrow(per_batch(run), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
