"""Main text of web pages by host suffix arrays and structure.

A tolerant scan of the tags, linear in the page, sorts a page's blocks into three kinds: main (inside an article or main
element), dropped (inside menus, headers, footers, sidebars, notices, adverts, forms or comments, told by element, role or
class words) and loose. Class words drop no article or main element and nothing that has one inside. The main and the loose
token streams of a host's pages are concatenated, and a suffix array finds the runs of tokens that distinct pages share:

- loose tokens go where a run covers them that another page of the host has too; the unique runs stay. Pages without a main
  element whose loose text is the same are one page, and such a page keeps its text if one other has taken all of it;
- a main block goes where runs cover it wholly that nine of ten of the host's articles have (WIDE of them at least). Pages
  with equal main text are one article, so copies of an article don't make it boilerplate. A lower share can't be asked for:
  sentences and passages that many articles quote are text of each of them.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import shuffle_width

#: Tokens of a run that counts as repeated; bytes of html that one group of a host's pages holds; most hosts dealt to several.
RUN, GROUP_BYTES, LARGE_HOSTS = 8, 4_000_000, 65_536
#: Articles of a host that have a run for it to be boilerplate in their main text: so many, and this share.
WIDE, SHARE = 8, 0.9

# Elements and class words of the scan.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp svg math object".split())
DROPPED = frozenset("head nav header footer aside form button select option dialog menu fieldset audio video canvas map".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset("address blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup html legend li ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_ITSELF = frozenset("li dt dd td th tr option".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments respond cookie cookies consent disclaimer footer form"
    " header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted related search share sharing"
    " sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
# What a dropped word may stand before, as in comment-list; and what a class begins with that only speaks of such a part.
#: Words that make even an article one of a reader's.
READERS = frozenset("comment comments respond response responses reply replies".split())
TAILS = frozenset(
    "area author bar block body bottom box buttons column container content count form group holder icons inner item items label left link links list main"
    " meta outer panel pane post posts primary reply right row secondary section slot text thread top unit widget wrap wrapper zone".split()
)
ABOUT = frozenset("has have no not with without is hide show enable disable open closed fixed sticky of".split())
KNOWN = INLINE | VOID | RAW | DROPPED | MAIN | BLOCKS

NAME = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
STOP = re.compile(r"[<>\"']")
ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
TELLING = re.compile(r"class|\bid\b|role|hidden|itemprop|style", re.I)


@lru_cache(maxsize=20_000)
def _drops(value: str) -> bool:
    """Whether a class or id names a part that isn't main text: a whole class word, its last piece, or its first before a tail."""
    for word in value.split():
        pieces = [x for x in re.split(r"[-_]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", word).lower()) if x]
        if not pieces or not ABOUT.isdisjoint(pieces):
            continue
        if pieces[-1] in DROPPED_WORDS or pieces[0] in DROPPED_WORDS and pieces[-1] in TAILS | {x for x in pieces[-1:] if x.isdigit()}:
            return True
    return False


@lru_cache(maxsize=20_000)
def _readers(value: str) -> bool:
    """Whether a class or id names a reader's comment."""
    return any(not READERS.isdisjoint(re.split(r"[-_]+", word.lower())) for word in value.split()) and _drops(value)


def _kind(tag: str, attributes: str, within: bool = False) -> int:
    """1: a container of the main text, -1: one of boilerplate, -2: one of boilerplate by a class word alone, 0: neither.

    An article that a class word names is dropped inside an article (``within``), and everywhere if it is a reader's.
    """
    if tag in DROPPED:
        return -1
    found, named, readers = int(tag in MAIN), False, False
    if attributes and TELLING.search(attributes):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return -1
            if name == "role":
                if value.lower() in DROPPED_ROLES:
                    return -1
                found = found or int(value.lower() == "main")
            elif name == "itemprop":
                found = found or int(value.lower() == "articlebody")
            elif name in ("class", "id") and tag not in ("html", "body") and tag not in HEADINGS:
                named, readers = named or _drops(value), readers or _readers(value)
    if tag == "article" and (readers or named and within):
        return -2
    return -2 if named and not found else found


class _Named:
    """A container that a class word would drop; it is kept if an article or main element opens inside, unless it lies in an
    article itself."""

    def __init__(self, outer: _Named | None, within: bool):
        self.outer, self.within, self.wraps = outer, within, False

    def opened(self) -> None:
        at: _Named | None = self
        while at and not at.wraps:
            at.wraps, at = not at.within, at.outer


def _tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, value, attributes, end) with kind text, open or close, in page order; send() a place to go on from there.

    A tag with an unquoted ``<`` inside, or that the page's end cuts, is one only if its name is known and it has
    attributes; else its ``<`` is text.
    """
    at, end, last = 0, len(page), {'"': page.rfind('"'), "'": page.rfind("'")}
    while at < end:
        begin = page.find("<", at)
        if begin != at:
            stop = begin if begin >= 0 else end
            yield "text", page[at:stop], "", stop
            at = stop
            continue
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            at = close + 3 if close >= 0 else end
            continue
        if page.startswith(("<!", "<?"), at):
            close = page.find(">", at)
            at = close + 1 if close >= 0 else end
            continue
        name = NAME.match(page, at + 1)
        place, closed = (name.end() if name else end), False
        while name:
            m = STOP.search(page, place)
            if m is None:
                place = end
                break
            place = m.start()
            if m[0] == ">":
                closed = True
                break
            if m[0] == "<":
                break
            quoted = page[max(name.end(), place - 40) : place].rstrip().endswith("=")
            if not quoted:
                place += 1
            elif place < last[m[0]]:
                place = page.index(m[0], place + 1) + 1
            else:
                place = end
                break
        if name is None or not closed and not (name[2].lower() in KNOWN and (name[1] or "=" in page[name.end() : place])):
            yield "text", "<", "", at + 1
            at += 1
            continue
        after = place + 1 if closed else place
        moved = yield "close" if name[1] else "open", name[2].lower(), page[name.end() : place], after
        at = after if moved is None else moved


def blocks(page: str | None) -> tuple[list[tuple[bool, str]], bool]:
    """The kept blocks in page order (whether main, or loose; text with white space made single), and whether there is a main element."""
    parts: list[tuple[int, _Named | None, str]] = []
    stack: list[tuple[str, int, int, _Named | None, bool]] = []  # tag, and the states outside it
    opened: dict[str, int] = {}  # how often each tag is on the stack
    dropped = inside = 0  # dropped: 2 where headings stay
    named: _Named | None = None
    has_main = within = free = False  # within an article; an article that nothing names
    page = page or ""
    tokens, moved = _tokens(page), None
    while True:
        try:
            kind, tag, attributes, after = tokens.send(moved)
        except StopIteration:
            break
        moved = None
        if kind == "text":
            if not dropped:
                parts.append((inside, named, tag))
            continue
        if tag not in INLINE and not dropped:
            parts.append((inside, named, "\0"))
        if kind == "close":
            if opened.get(tag):
                while True:
                    name, dropped, inside, named, within = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, after)
            if close or tag not in ("svg", "math", "object"):
                moved = close.end() if close else len(page)
            continue
        if tag in VOID or attributes.endswith("/") and tag in ("path", "use"):
            continue
        if stack and (stack[-1][0] == "p" and tag not in INLINE or stack[-1][0] == tag and tag in CLOSED_BY_ITSELF):
            name, dropped, inside, named, within = stack.pop()  # its end tag was left out
            opened[name] -= 1
        what = _kind(tag, attributes, within)
        if what or tag not in ("p", "li", "td", "tr", "th", "dt", "dd"):
            stack.append((tag, dropped, inside, named, within))
            opened[tag] = opened.get(tag, 0) + 1
        if what == -1:
            # An article's own title may stand in a header of it.
            dropped = 2 if tag == "header" and within and not dropped else dropped or 1
        elif dropped == 2 and tag in HEADINGS:
            parts.append((inside, named, "\0"))
            dropped = 0
        elif what == -2 and not dropped:
            named = _Named(named, within)
        elif what > 0 and not dropped:
            inside, has_main = 1, True
            if named:
                named.opened()
            elif tag == "article":
                free = True
            within = within or tag == "article"
    # A container wraps if one inside it does, so the innermost one decides; beside a free article it holds others' teasers.
    kept = [(inside, text) for inside, named, text in parts if named is None or named.wraps and not free]
    out = []
    for inside, run in itertools.groupby(kept, key=lambda x: x[0]):
        out += [(bool(inside), x) for b in "".join(t for _, t in run).split("\0") if (x := " ".join(html.unescape(b).split()))]
    return out, has_main


def host_of(url: str | None) -> str:
    m = re.match(HOST, url or "")
    return m[1].lower().rpartition("@")[2] if m else ""


HOST = r"[a-zA-Z][\w+.-]*://([^/?#]+)"


def window_hash(tokens: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(tokens).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class HostArray:
    """The suffix array over the token streams (owner, tokens) of a host's pages, ordered by ``run`` tokens.

    It comes by doubling: after each round the ranks order the suffixes by twice as many tokens.
    """

    def __init__(self, streams: list[tuple[int, list[str]]], run: int = RUN):
        self.tokens, self.run = [t for _, s in streams for t in s], run
        lengths = [len(s) for _, s in streams]
        self.owner = np.repeat(np.array([o for o, _ in streams], np.int64), lengths)
        stop = np.repeat(np.cumsum(lengths), lengths).astype(np.int64)
        ids: dict[str, int] = {}
        rank, have, n = np.array([ids.setdefault(t, len(ids)) for t in self.tokens], np.int64), 1, len(self.tokens)
        order = np.argsort(rank, kind="stable")
        while have < run and n:
            step = min(have, run - have)
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[True, key[order][1:] != key[order][:-1]]) - 1
            have += step
        #: Starts of whole runs in suffix order, and where each group of equal runs begins among them.
        self.starts = order[order + run <= stop[order]] if n else np.zeros(0, np.int64)
        self.heads = np.flatnonzero(np.r_[True, rank[self.starts][1:] != rank[self.starts][:-1]]) if len(self.starts) else self.starts
        self.sizes = np.diff(np.r_[self.heads, len(self.starts)])

    def distinct(self, identity: np.ndarray) -> np.ndarray:
        """Of each group of equal runs the number of different identities (one an owner; negative: none) of its owners."""
        group = np.repeat(np.arange(len(self.heads)), self.sizes)
        own = identity[self.owner[self.starts]]
        group, own = group[own >= 0], own[own >= 0]
        if not len(group):
            return np.zeros(len(self.heads), np.int64)
        width = int(own.max()) + 1
        return np.bincount(np.unique(group * width + own) // width, minlength=len(self.heads))

    def covered(self, groups: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Which tokens of the owners (a mask) the runs of the groups (a mask) cover."""
        chosen = np.repeat(groups, self.sizes) & owners[self.owner[self.starts]]
        edge = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(edge, self.starts[chosen], 1)
        np.add.at(edge, self.starts[chosen] + self.run, -1)
        return np.cumsum(edge[:-1]) > 0

    def windows(self, groups: np.ndarray) -> list[tuple[int, int]]:
        """Number and hash of each of the groups (a mask)."""
        return [(int(g), window_hash(self.tokens[i : i + self.run])) for g, i in zip(np.flatnonzero(groups), self.starts[self.heads[groups]].tolist(), strict=True)]

    def texts(self, groups: np.ndarray) -> list[str]:
        """The run of each of the groups (a mask), its tokens joined by spaces."""
        return [" ".join(self.tokens[i : i + self.run]) for i in self.starts[self.heads[groups]].tolist()]

    def among(self, runs: set[str]) -> np.ndarray:
        """Which groups (a mask) have one of these runs."""
        words = {t for r in runs for t in r.split(" ")}
        before = np.r_[0, np.cumsum(np.fromiter((t in words for t in self.tokens), np.int64, len(self.tokens)))]
        first = self.starts[self.heads]
        found = before[first + self.run] - before[first] == self.run
        found[found] = [r in runs for r in self.texts(found)]
        return found


def window_pages(streams: list[tuple[int, list[str]]], run: int = RUN) -> list[tuple[int, int, int, int]]:
    """Of all runs of ``run`` tokens in the streams (page, tokens): hash, smallest and largest page that have it, and one
    between them, or the smallest again if no other has it."""
    array = HostArray([(i, s) for i, (_, s) in enumerate(streams)], run)
    page = np.array([p for p, _ in streams], np.int64)
    if not len(array.heads):
        return []
    own = page[array.owner[array.starts]]
    least, most = np.minimum.reduceat(own, array.heads), np.maximum.reduceat(own, array.heads)
    first = np.repeat(least, array.sizes)
    between = np.maximum.reduceat(np.where(own < np.repeat(most, array.sizes), own, first), array.heads).tolist()
    least, most = least.tolist(), most.tolist()
    return [(h, least[g], most[g], between[g]) for g, h in array.windows(np.ones(len(array.heads), bool))]


def distinct_windows(streams: list[tuple[int, list[str]]], run: int = RUN) -> list[tuple[int, int, int]]:
    """Of all runs of ``run`` tokens in the streams (page, tokens): hash, smallest and largest page that have it."""
    return [found[:3] for found in window_pages(streams, run)]


def stretches(streams: list[list[str]], words: set[str], run: int = RUN) -> list[tuple[int, list[str]]]:
    """(number of the stream, tokens) of the longest stretches, of ``run`` tokens at least, whose tokens all are in words."""
    out = []
    for i, tokens in enumerate(streams):
        for kept, piece in itertools.groupby(tokens, words.__contains__):
            if kept and len(found := list(piece)) >= run:
                out.append((i, found))
    return out


def loose_identity(page_id: int, page: str, loose: list[str]) -> int:
    """What a page counts as among those that have a loose run: itself, or, where its loose text is all it has, that text.

    So copies of a page without a main element count once, and none of them makes the others' text repeated.
    """
    return page_id if page[:1] == "M" else window_hash(loose)


def _streams(page: str) -> tuple[list[str], list[str]]:
    """The main and the loose tokens of a page as _parse gives it: a line a block, with its kind before it.

    A loose stream of less than RUN tokens beside a main element is filled up with empty ones: it is repeated if it is so as a whole.
    """
    lines = page.split("\n")
    main = [t for x in lines if x[:1] == "m" for t in x[1:].split(" ")]
    loose = [t for x in lines if x[:1] == "l" for t in x[1:].split(" ")]
    if lines[0] == "M" and 0 < len(loose) < RUN:
        loose += [""] * (RUN - len(loose))
    return main, loose


def extract_group(ids: list[int | None], pages: list[str], common: dict[int, bool] | None = None, boilerplate: set[str] | None = None) -> list[str]:
    """The texts of a host's pages. For a part of them ``common`` has the loose runs that two of the host's pages share, and
    whether more than two do, and ``boilerplate`` the main runs that enough of the host's articles have."""
    split = [_streams(p) for p in pages]
    array = HostArray([(2 * i + loose, s) for i, pair in enumerate(split) for loose, s in enumerate(pair) if s])
    owner_id = np.repeat(np.array([-1 if x is None else x for x in ids], np.int64), 2)
    page_id = np.where(owner_id >= 0, owner_id, -1)
    article: dict[tuple[str, ...], int] = {}
    article_of = np.full(2 * len(pages), -1, np.int64)
    for i, (main, _) in enumerate(split):
        if main and ids[i] is not None:
            article_of[2 * i] = article.setdefault(tuple(main), len(article))
    gone, everywhere = np.zeros(len(array.tokens), bool), np.zeros(len(array.tokens), bool)
    if len(array.heads):
        loose, main = np.arange(2 * len(pages)) % 2 == 1, article_of >= 0
        named = loose & (page_id >= 0)
        counts_as = np.full(2 * len(pages), -1, np.int64)
        own = [loose_identity(i, page, rest) if i is not None and rest else None for i, page, (_, rest) in zip(ids, pages, split, strict=True)]
        seen: dict[int, int] = {}
        counts_as[1::2] = [-1 if x is None else seen.setdefault(x, len(seen)) for x in own]
        pages_of = array.distinct(counts_as)
        repeated, wide = pages_of > 1, pages_of > 2
        if common:
            for g, h in array.windows((pages_of > 0) & (pages_of <= 2)):
                repeated[g] |= h in common
                wide[g] = common.get(h, False)
        gone |= array.covered(repeated, named)
        everywhere = array.covered(wide, named)
        if boilerplate:
            gone |= array.covered(array.among(boilerplate), main)
        elif boilerplate is None and len(article) >= WIDE:
            gone |= array.covered(array.distinct(article_of) >= max(WIDE, SHARE * len(article)), main)
    out, at = [], 0
    for page, (main, loose) in zip(pages, split, strict=True):
        m, rest, text = at, at + len(main), []
        at = rest + len(loose)
        for line in page.split("\n"):
            n = line.count(" ") + 1 if len(line) > 1 else 0
            if line[:1] == "m":
                if not gone[m : m + n].all():
                    text.append(line[1:])
                m += n
            elif line[:1] == "l":
                text += [t for t, g in zip(line[1:].split(" "), gone[rest : rest + n].tolist(), strict=True) if not g]
                rest += n
        if not text and not main and any(loose) and not everywhere[rest - len(loose) : rest].any():
            # One other page, nearly the same, has taken all of it: two pages' text is no boilerplate.
            text = [line[1:] for line in page.split("\n") if line[:1] == "l"]
        out.append(" ".join(text))
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (page_id, url, host, salt, html): html becomes a line (M if there is a main element) and a line a block, m or l before it."""
    for batch in batches:
        pages = []
        for page in batch.column(4):
            found, has_main = blocks(page.as_py())
            pages.append("\n".join(["M" if has_main else "", *(("m" if main else "l") + text for main, text in found)]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(pages, pa.string())], names=["page_id", "url", "host", "salt", "page"])


OUT, PARSED = "page_id long, url string, text string", "page_id long, url string, host string, salt int, page string"


def _texts_of(ids: list, urls: list, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _extract_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over parsed pages sorted by host: their texts. A batch's worth of small hosts is given out at once."""
    host, held, done, size = None, [], [[], [], []], 0

    def close() -> None:
        if held:
            ids, urls, pages = zip(*held, strict=True)
            for into, more in zip(done, (ids, urls, extract_group(list(ids), list(pages))), strict=True):
                into += more
            held.clear()

    for batch in batches:
        for page_id, url, own, _, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != host:
                close()
                host = own
                if size > GROUP_BYTES:
                    yield _texts_of(*done)
                    done, size = [[], [], []], 0
            held.append((page_id, url, page))
            size += len(page)
    close()
    if done[0]:
        yield _texts_of(*done)


def _table(schema: str, *columns: list) -> pa.Table:
    names = [x.split(" ") for x in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.table([pa.array(c, types[t]) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])


WINDOWS, ARTICLES, COUNTS = "host string, window long, page long", "host string, salt int, article long", "host string, run string, n long"


def _group_windows(group: pa.Table) -> pa.Table:
    """The runs of a part's loose blocks with the pages that have them, three of them if there are more."""
    pages = zip(group.column("page_id").to_pylist(), group.column("page").to_pylist(), strict=True)
    found = window_pages([(loose_identity(i, page, loose), loose) for i, page in pages if i is not None and (loose := _streams(page)[1])])
    rows = [(h, p) for h, *own in found for p in set(own)]
    return _table(WINDOWS, [group.column("host")[0].as_py()] * len(rows), [h for h, _ in rows], [p for _, p in rows])


def _articles(pages: pa.Table, elsewhere: set[int] = frozenset()) -> dict[int, list[str]]:
    """The main tokens of a part's different articles, by their hash, but for those that another part counts."""
    out: dict[int, list[str]] = {}
    for i, page in zip(pages.column("page_id").to_pylist(), pages.column("page").to_pylist(), strict=True):
        if i is not None and (main := _streams(page)[0]) and (h := window_hash(main)) not in elsewhere:
            out.setdefault(h, main)
    return out


def _group_articles(group: pa.Table) -> pa.Table:
    found = list(_articles(group))
    return _table(ARTICLES, [group.column("host")[0].as_py()] * len(found), [group.column("salt")[0].as_py()] * len(found), found)


def _values(notes: pa.Table, name: str) -> set:
    return set(notes.column(name).drop_null().to_pylist())


def _candidates(pages: pa.Table, notes: pa.Table) -> pa.Table:
    """The main runs that most of the articles which a part counts have, with the number of these articles.

    Twice as many may lack a run as in the host, so that runs of the asked share are found in parts with half of all articles.
    """
    own = list(_articles(pages, _values(notes, "article")).values())
    need, runs = (2 * SHARE - 1) * len(own) - 1e-6, []
    if own:
        articles_with = Counter(t for main in own for t in set(main))
        array = HostArray(stretches(own, {t for t, n in articles_with.items() if n >= need}))
        runs = array.texts(array.distinct(np.arange(len(own))) >= need) if len(array.heads) else []
    return _table(COUNTS, [pages.column("host")[0].as_py()] * len(runs) if runs else [], runs, [len(own)] * len(runs))


def _run_counts(pages: pa.Table, notes: pa.Table) -> pa.Table:
    """How many of the articles that a part counts have each of the host's candidates; and, at the empty run, how many they are."""
    runs = _values(notes, "run")
    if not runs or not pages.num_rows:
        return _table(COUNTS, [], [], [])
    own = list(_articles(pages, _values(notes, "article")).values())
    rows = [("", len(own))]
    array = HostArray(stretches(own, {t for r in runs for t in r.split(" ")}))
    if len(array.heads):
        found = array.among(runs)
        rows += zip(array.texts(found), array.distinct(np.arange(len(own)))[found].tolist(), strict=True)
    return _table(COUNTS, [pages.column("host")[0].as_py()] * len(rows), [r for r, _ in rows], [n for _, n in rows])


def _extract_part(pages: pa.Table, notes: pa.Table) -> pa.Table:
    ids, urls = pages.column("page_id").to_pylist(), pages.column("url").to_pylist()
    common, counts = {}, {}
    for window, many, run, n in zip(*(notes.column(c).to_pylist() for c in ("window", "many", "run", "n")), strict=True):
        if run is None:
            common[window] = many
        else:
            counts[run] = n
    articles = counts.pop("", 0)
    boilerplate = {r for r, n in counts.items() if n >= max(WIDE, SHARE * articles)}
    texts = extract_group(ids, pages.column("page").to_pylist(), common, boilerplate)
    return pa.Table.from_batches([_texts_of(ids, urls, texts)])


def large_hosts(pages: DataFrame) -> dict[str, int]:
    """The parts of each host whose pages are too many for one group. Above LARGE_HOSTS hosts' worth of bytes groups grow instead."""
    sizes = pages.groupBy("host").agg(F.sum(F.octet_length("html") + 1).alias("bytes"))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    most = max(GROUP_BYTES, total // LARGE_HOSTS)
    return {r["host"]: -(-r["bytes"] // most) for r in sizes.filter(F.col("bytes") > most).collect()}


def _extract_dealt(dealt: DataFrame, parts: DataFrame) -> DataFrame:
    """The texts of hosts dealt to parts, by counts over all parts of a host.

    Loose runs: how many pages have each, told up to three. Main runs: an article counts in the first part that has a copy of it.
    Runs that most articles have in parts with half of the host's articles are the candidates (a run of the asked share is one
    of them), and all parts count them.
    """
    group = dealt.groupBy("host", "salt")
    every = F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("salt")
    to_parts = lambda rows, *cols: rows.join(F.broadcast(parts), "host").select("host", every, *cols)
    gather = lambda notes, run, schema: group.cogroup(notes.groupBy("host", "salt")).applyInArrow(run, schema)
    void = lambda kind, name: F.lit(None).cast(kind).alias(name)

    windows = group.applyInArrow(_group_windows, WINDOWS).repartition("host", "window")
    shared = windows.groupBy("host", "window").agg(F.count_distinct("page").alias("pages")).filter("pages > 1")
    common = to_parts(shared, "window", (F.col("pages") > 2).alias("many"))

    articles = group.applyInArrow(_group_articles, ARTICLES).groupBy("host", "article").agg(F.min("salt").alias("home"), F.collect_set("salt").alias("salts"))
    elsewhere = articles.filter(F.size("salts") > 1).select("host", F.explode("salts").alias("salt"), "article", "home").filter("salt > home").drop("home")
    sizes = articles.groupBy("host").agg(F.count_if((F.size("salts") > 0) & (F.col("home") >= 0)).alias("articles")).filter(F.col("articles") >= WIDE)
    runs = gather(elsewhere, _candidates, COUNTS).groupBy("host", "run").agg(F.sum("n").alias("n")).join(F.broadcast(sizes), "host")
    candidates = to_parts(runs.filter(F.col("n") * 2 >= F.col("articles")).select("host", "run"), "run")
    notes = elsewhere.select("*", void("string", "run")).unionByName(candidates.select("host", "salt", void("long", "article"), "run"))
    counts = gather(notes, _run_counts, COUNTS).groupBy("host", "run").agg(F.sum("n").alias("n")).filter((F.col("run") == "") | (F.col("n") >= WIDE))

    found = common.select("*", void("string", "run"), void("long", "n"))
    found = found.unionByName(to_parts(counts, void("long", "window"), void("boolean", "many"), "run", "n"))
    return gather(found, _extract_part, OUT)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; null or empty html gives the empty text.

    Every page's blocks go through its host's suffix array. Hosts of more than GROUP_BYTES are dealt to parts by page, and
    what repeats is counted over all parts, so the texts don't depend on how a host is dealt. Rows that share a page id don't
    count as distinct pages; rows with a null id are kept whole but for what structure drops, and make nothing repeated.
    Pages without a host are one host's.
    """
    spark = pages.sparkSession
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)), "^.*@", "")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    large = large_hosts(rows)
    parts = spark.createDataFrame(list(large.items()), "host string, parts long")
    order = ["page_id", "url", "host", "salt", "html"]
    small = rows.join(F.broadcast(parts), "host", "left_anti") if large else rows
    parsed = small.withColumn("salt", F.lit(-1)).select(*order).mapInArrow(_parse, PARSED)
    out = parsed.repartition(shuffle_width(spark), "host").sortWithinPartitions("host").mapInArrow(_extract_hosts, OUT)
    if large:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int")
        dealt = rows.join(F.broadcast(parts), "host").withColumn("salt", salt).select(*order).mapInArrow(_parse, PARSED)
        out = out.unionByName(_extract_dealt(dealt, parts))
    return out.withColumn("n_chars", F.length("text").cast("long"))
