"""Main text of web pages by wrappers: union-free regular expressions over a host's token streams.

A page becomes a stream of tags and text slots.  Neighbouring equal stretches become one repeated group, at every level
(menus, paragraphs).  The streams of one host are aligned one after another: what does not match becomes optional or, where the one side
has a group that the other has once, repeated; texts that differ become variable slots, equal ones stay constant.
The result is the host's wrapper.  Each slot collects evidence over all the host's pages: a sketch of its different texts, and how many
of its characters stood in an article, in links, under tags that are not main text (menus, footers, forms) and under names that
say so.  From that evidence the wrapper labels its slots: a slot that has few different texts for its pages belongs to the template;
others follow the majority of their characters; where a host's tags and names leave no main text at all, its varied, unlinked slots are it.
A page's text is what its own stream, aligned with the wrapper, has in the slots labelled as main text; only what no slot matches is judged
by the page alone.  Without a wrapper all text stays.

Wrappers are folded per task, then FOLD at a time in rounds until a host has one, so no task reads more than FOLD wrappers of a host,
however many pages it has.  Optional parts on less than one of SUPPORT pages are left to the pages that have them.  Pages meet the
wrappers' guides by host and, for hosts of more than PAGES pages, by as many salts as give PAGES pages each.

Defined cases: null and empty pages give empty text; pages without a host share one wrapper; broken markup
(unclosed, cut off, quotes that never close) is read as far as it goes; repeated rows are extracted each on their own; a very long page is
read, grouped and aligned like any other; an empty table gives an empty result; columns of any name pass unchanged.
"""

from __future__ import annotations

import json
import re
from base64 import b64decode, b64encode
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .line_dedup import patience
from .textcore import cut, free_name, trimmed

#: A group's longest unit, in tokens.
UNIT = 12
#: Pages from which a slot's texts tell template from content: it is template with one different text in SAME pages or fewer.
CONSTANT_FROM, SAME = 3, 3
#: Hashes of different texts that a slot keeps; from so many on their number is estimated.
SKETCH = 16
#: An optional part of a wrapper is on one of so many pages at least.
SUPPORT = 1000
#: Wrappers folded at once, pages of one host that meet under one key, and pages of a task.
FOLD, PAGES, TASK_PAGES = 16, 200, 1000
#: Hosts of more than PAGES pages whose salts are broadcast; beyond that they are joined by a shuffle.
BROADCAST = 100_000

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Content that is no text of the page; that of the first kind goes on to the page's end if it is never closed.
_RAW = {"script", "style", "noscript", "textarea", "title", "iframe"}
_UNSEEN = {"template", "svg", "select", "video", "audio", "canvas", "annotation", "annotation-xml"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img math object".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINER = set("html head body nav header footer aside form article main section div ul ol dl table tr td th tbody thead figure fieldset button dialog menu details blockquote pre center a".split())
_SKIP = {"head", "nav", "footer", "aside", "form", "button", "fieldset", "dialog", "menu"}
_SKIP_ROLE = set("navigation banner complementary contentinfo search form menu menubar dialog alert".split())
_SKIP_WORD = re.compile(
    r"^(ad|ads|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|newsletter|subscri\w*|signup|popup|modal|overlay|sidebar\w*|"
    r"widget\w*|menu\w*|nav|navbar|navi\w*|breadcrumb\w*|footer\w*|masthead|topbar|toolbar|comment\w*|respond|reply|replies|disqus|discussion|share|sharing|social\w*|"
    r"related|recommend\w*|login|search\w*|pagination|pager|copyright|legal|disclaimer|skip)$"
)


class Text:
    """A stretch of text: its block, the decoded text, where it stood, and whether the page alone takes it for main text."""

    __slots__ = ("block", "hard", "inside", "linked", "main", "text")

    def __init__(self, text: str, block: int, hard: bool, soft: bool, linked: bool, inside: bool) -> None:
        self.text, self.block, self.hard, self.linked, self.inside = text, block, hard, linked, inside
        self.main = not hard and not soft


def _skipped(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is not main text by what it is, and by what it is called."""
    if name in _SKIP or (name == "header" and not in_article):
        return True, False
    for key, value in _ATTRIBUTE.findall(attributes) if "=" in attributes or "hidden" in attributes else ():
        value = value.strip("\"'").lower()
        if key.lower() == "hidden":
            return True, False
        if key.lower() == "role":
            if value in _SKIP_ROLE:
                return True, False
        elif name not in ("html", "body", "article", "main") and any(_SKIP_WORD.match(w) for w in re.split(r"[\s_-]+", value)):
            return False, True
    return False, False


def _label(name: str, attributes: str) -> str:
    if "=" not in attributes:
        return name
    own = sorted({w for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "role") for w in v.strip("\"'").lower().split()})
    return f"{name}.{'.'.join(own)}" if own else name


def tags(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag; comments and declarations have no name.

    A tag that the page's end cuts off ends there.  Quotes hide a ``>``; from a tag on whose quotes never close, quotes are plain characters.
    The caller may send a position to go on from.
    """
    at, size, quotes = 0, len(html), True
    while (lt := html.find("<", at)) >= 0:
        found = None
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            found = (lt, end + 3 if end >= 0 else size, None, False, "")
        elif html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            found = (lt, end + 1 if end >= 0 else size, None, False, "")
        elif m := _NAME.match(html, lt):
            end, i = -1, m.end()
            while quotes:
                q = _MARK.search(html, i)
                if q is None:
                    break
                if q[0] == ">":
                    end = q.start()
                    break
                close = html.find(q[0], q.end())
                if close < 0:
                    break
                i = close + 1
            if end < 0:
                end = html.find(">", m.end())
                quotes = quotes and end < 0
            found = (lt, end + 1, m[2].lower(), bool(m[1]), html[m.end() : end]) if end >= 0 else (lt, size, None, False, "")
        if found is None:
            at = lt + 1
            continue
        go = yield found
        at = found[1] if go is None else go


def read(html: str) -> tuple[list[str], list[Text]]:
    """A page's token stream (tags, and ``#`` for a text) and its texts."""
    stream: list[str] = []
    texts: list[Text] = []
    stack: list[tuple[str, bool, bool]] = []  # open containers: name, not main text by tag, by name
    opened: Counter[str] = Counter()
    hard = soft = articles = links = formula = 0
    block, at, seen_article = 0, 0, False
    odd_hard = odd_soft = False  # of the paragraph or heading that is open
    unclosed: set[str] = set()

    def text(upto: int) -> None:
        raw = html[at:upto]
        if not raw or raw.isspace():
            if raw and texts and texts[-1].block == block:
                texts[-1].text += " "
            return
        stream.append("#")
        texts.append(Text(unescape(raw), block, hard > 0 or odd_hard, soft > 0 or odd_soft, links > 0, articles > 0))

    found = tags(html)
    go = None
    while True:
        try:
            start, end, name, close, attributes = found.send(go)
        except StopIteration:
            break
        go = None
        text(start)
        at = end
        if name is None:
            continue
        if not close and (name in _RAW or (name in _UNSEEN and name not in unclosed)) and not attributes.endswith("/"):
            over = re.compile(rf"</{name}(?=[\s>/])[^>]*>|</{name}\Z", re.I).search(html, at)
            if over or name in _RAW:
                at = go = over.end() if over else len(html)
                continue
            unclosed.add(name)
        if name in _UNSEEN:
            continue
        if name == "math":
            formula = max(0, formula + (-1 if close else not attributes.endswith("/")))
        if name not in _INLINE and not formula:
            block += 1
            odd_hard, odd_soft = _skipped(name, attributes, True) if not close and name not in _CONTAINER and "=" in attributes else (False, False)
        elif name == "br" and texts and texts[-1].block == block:
            texts[-1].text += " "
        stream.append(f"</{name}>" if close else f"<{_label(name, attributes)}>")
        if name in _VOID or name not in _CONTAINER:
            continue
        if not close:
            by_tag, by_name = _skipped(name, attributes, articles > 0)
            stack.append((name, by_tag, by_name))
            opened[name] += 1
            hard += by_tag
            soft += by_name
            articles += name in ("article", "main")
            seen_article |= name in ("article", "main")
            links += name == "a"
        elif opened[name]:
            if name == "a" and stack[-1][0] != "a":
                continue  # an inline tag does not close containers
            while True:
                n, by_tag, by_name = stack.pop()
                opened[n] -= 1
                hard -= by_tag
                soft -= by_name
                articles -= n in ("article", "main")
                links -= n == "a"
                if n == name:
                    break
    text(len(html))
    if seen_article:
        for t in texts:
            t.main &= t.inside
    else:  # blocks of links alone are menus
        linked: dict[int, bool] = {}
        for t in texts:
            linked[t.block] = linked.get(t.block, True) and t.linked
        for t in texts:
            t.main &= not linked[t.block]
    return stream, texts


# ------------------------------------------------------------------------------------------- grouping


class Item:
    """A token of a grouped stream: a tag, a text slot or a repeated group; ``slots`` has the text numbers of each slot in it."""

    __slots__ = ("key", "slots", "unit")

    def __init__(self, key: str, slots: list[list[int]], unit: tuple[str, ...] | None = None) -> None:
        self.key, self.slots, self.unit = key, slots, unit


def _name(unit: tuple[str, ...]) -> str:
    return f"({''.join(unit)})+"


def _by_size(units) -> list[tuple[int, set[tuple[str, ...]]]]:
    """Units by their number of tokens, the shorter first."""
    out: dict[int, set[tuple[str, ...]]] = {}
    for u in units:
        out.setdefault(len(u), set()).add(tuple(u))
    return sorted(out.items())


def _apply(items: list[Item], n: int, units: set[tuple[str, ...]]) -> list[Item]:
    """Every maximal run of a unit, of one occurrence or more, as one repeated group; all units have n tokens."""
    keys = [x.key for x in items]
    firsts = {u[0] for u in units}
    out: list[Item] = []
    i = 0
    while i < len(items):
        unit = tuple(keys[i : i + n]) if keys[i] in firsts else None
        if unit is not None and unit in units:
            slots: list[list[int]] | None = None
            while tuple(keys[i : i + n]) == unit:
                own = [s for x in items[i : i + n] for s in x.slots]
                if slots is None:
                    slots = [list(s) for s in own]
                else:
                    for a, b in zip(slots, own, strict=True):
                        a += b
                i += n
            out.append(Item(_name(unit), slots or [], unit))
        else:
            out.append(items[i])
            i += 1
    return out


def group(stream: list[str]) -> list[Item]:
    """The stream with neighbouring equal stretches as repeated groups, shorter units first, until none is left."""
    items, k = [], 0
    for t in stream:
        items.append(Item(t, [[k]] if t == "#" else []))
        k += t == "#"
    numbers: dict[str, int] = {}
    coded = lambda: np.array([numbers.setdefault(x.key, len(numbers)) for x in items], np.int64)
    again = True
    while again:
        again, codes = False, coded()
        for n in range(1, UNIT + 1):
            same = codes[:-n] == codes[n:]
            if same.sum() < n:
                continue
            stops = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
            starts = stops[:-1][np.diff(stops) > n]  # runs of n or more
            if len(starts):
                items = _apply(items, n, {tuple(x.key for x in items[i : i + n]) for i in starts.tolist()})
                again, codes = True, coded()
    return items


# ------------------------------------------------------------------------------------------- wrappers

#: A wrapper: a list of [key, unit or null, optional, slots, pages].
#: A slot: [pages, least hashes of its different texts, characters that pages take for main text, characters not by name, characters not by tag,
#: characters in an article, characters in links].


def of_page(items: list[Item], texts: list[Text]) -> list[list]:
    """The wrapper of one page."""
    out = []
    for x in items:
        slots = []
        for own in x.slots:
            t = [texts[i] for i in own]
            whole = " ".join(" ".join(y.text.split()) for y in t)
            size = lambda keep, t=t: sum(len(y.text) for y in t if keep(y))
            good, by_tag = size(lambda y: y.main), size(lambda y: y.hard)
            slots.append([1, [crc32(whole.encode())], good, size(lambda y: not y.main) - by_tag, by_tag, size(lambda y: y.inside), size(lambda y: y.linked)])
        out.append([x.key, list(x.unit) if x.unit else None, False, slots, 1])
    return out


def _regroup(wrapper: list[list], units: list[tuple[int, set[tuple[str, ...]]]]) -> list[list]:
    """Repeated groups that either side knows, also where this side has their unit only once."""
    for n, some in units:
        out, i = [], 0
        while i < len(wrapper):
            own = wrapper[i : i + n]
            unit = tuple(x[0] for x in own)
            if unit in some:
                out.append([_name(unit), list(unit), any(x[2] for x in own), [s for x in own for s in x[3]], max(x[4] for x in own)])
                i += n
            else:
                out.append(own[0])
                i += 1
        wrapper = out
    return wrapper


def _slot(a: list, b: list) -> list:
    return [a[0] + b[0], sorted({*a[1], *b[1]})[:SKETCH], *(x + y for x, y in zip(a[2:], b[2:], strict=True))]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places that two token lists have in common, in order: equal ends, then a longest run of k-th occurrences, then the same between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        places: dict[str, list[int]] = {}
        for y in range(m - 1, k - 1, -1):
            places.setdefault(b[y], []).append(y)
        pairs = [(x, places[a[x]].pop()) for x in range(i, j) if places.get(a[x])]
        run = [pairs[x] for x in patience(pairs)]
        out += run
        for (x, y), (z, w) in zip([(i - 1, k - 1), *run], [*run, (j, m)], strict=True):
            if run and z - x > 1 and w - y > 1:
                todo.append((x + 1, z, y + 1, w))
    return sorted(out)


def align(a: list[list], b: list[list]) -> list[list]:
    """One wrapper for what either wrapper matches."""
    if [x[0] for x in a] != [x[0] for x in b]:
        units = _by_size(x[1] for x in a + b if x[1])
        a, b = _regroup(a, units), _regroup(b, units)
    pages = max((x[4] for x in a), default=0) + max((x[4] for x in b), default=0)
    out = []
    i = k = 0
    same = matches([x[0] for x in a], [x[0] for x in b])
    for x, y in [*same, (len(a), len(b))]:  # what either side lacks is optional
        out += [[*z[:2], True, *z[3:]] for z in a[i:x] + b[k:y]]
        if x < len(a):
            p, q = a[x], b[y]
            out.append([p[0], p[1], p[2] or q[2], [_slot(s, t) for s, t in zip(p[3], q[3], strict=True)], p[4] + q[4]])
        i, k = x + 1, y + 1
    return out if len(same) == len(a) == len(b) else squeeze([x for x in out if not x[2] or x[4] * SUPPORT >= pages])


def squeeze(wrapper: list[list]) -> list[list]:
    """Neighbouring equal stretches of groups or optional parts as one: a repeated group holds its own repetitions."""
    for n in (1, 2, 3):
        out: list[list] = []
        for x in wrapper:
            out.append(x)
            a, b = out[-2 * n : -n], out[-n:]
            if len(a) == n and all(p[0] == q[0] and (p[1] or p[2]) and (q[1] or q[2]) for p, q in zip(a, b, strict=True)):
                del out[-2 * n :]
                out += [[p[0], p[1], p[2] and q[2], [_slot(s, t) for s, t in zip(p[3], q[3], strict=True)], max(p[4], q[4])] for p, q in zip(a, b, strict=True)]
        wrapper = out
    return wrapper


def fold(wrappers: list[str]) -> str:
    """One wrapper from several, aligned in a fixed order."""
    if len(wrappers) == 1:
        return wrappers[0]
    ordered = sorted(wrappers, key=lambda w: (-len(w), w))
    out = json.loads(ordered[0])
    for w in ordered[1:]:
        out = align(out, json.loads(w))
    return json.dumps(out, separators=(",", ":"))


def expression(wrapper: list[list]) -> str:
    """The wrapper as a regular expression without unions, for people."""
    return "".join(f"({x[0]})?" if x[2] else x[0] for x in wrapper)


def _repeated(slot: list) -> bool:
    """Whether a slot has few different texts for its pages."""
    seen, least = slot[0], slot[1]
    different = len(least) if len(least) < SKETCH else (SKETCH - 1) * 2**32 / max(1, least[-1])
    return seen >= CONSTANT_FROM and different * SAME <= seen


def labels(wrapper: list[list]) -> tuple[list[list[bool | None]], bool]:
    """Of each slot whether it is main text, None where no page has a character in it; and whether that goes against tags and names."""
    every = [s for x in wrapper for s in x[3]]
    main = [s for s in every if s[2] > s[3] + s[4] and not _repeated(s)]
    pages = max((x[4] for x in wrapper), default=0)
    against = not main and pages >= CONSTANT_FROM and any(not _repeated(t) for t in every)

    def label(s: list) -> bool | None:
        _, _, good, by_name, by_tag, inside, linked = s
        size = good + by_name + by_tag
        if not size:
            return None
        if main:  # few texts for many pages are the template's, unless an article has them
            return good >= by_name + by_tag and not (_repeated(s) and not inside)
        if against:  # names and tags leave nothing: what varies is the text
            return by_tag * 2 < size and linked * 2 < size and not _repeated(s)
        return good >= by_name + by_tag

    return [[label(s) for s in x[3]] for x in wrapper], against


def guide(wrapper: str) -> str:
    """What extraction needs of a wrapper, as packed JSON: keys, units, each slot's label, and whether labels go against tags and names."""
    w = json.loads(wrapper)
    return b64encode(compress(json.dumps([[x[0] for x in w], [x[1] for x in w if x[1]], *labels(w)], separators=(",", ":")).encode())).decode()


@lru_cache(256)
def _parsed(guided: str) -> tuple[list[str], list[tuple[int, set[tuple[str, ...]]]], list[list[bool | None]], bool]:
    keys, units, own, against = json.loads(decompress(b64decode(guided)))
    return keys, _by_size(units), own, against


@lru_cache(512)
def _matches(guided: str, own: tuple[str, ...]) -> list[tuple[int, int]]:
    """Places that a guide and a page's grouped stream have in common; pages of one template have the same."""
    return matches(_parsed(guided)[0], list(own))


def page_wrapper(html: str) -> str:
    """The wrapper of a page alone."""
    stream, texts = read(html)
    return json.dumps(of_page(group(stream), texts), separators=(",", ":"))


def extract(html: str, guided: str | None) -> str:
    """The main text of a page, by the guide of its host's wrapper; without one, all of its text."""
    stream, texts = read(html)
    if not texts:
        return ""
    if guided is None:
        keep = [True] * len(texts)
    else:
        keep = [t.main for t in texts]
        _, units, own, against = _parsed(guided)
        items = group(stream)
        for n, some in units:
            items = _apply(items, n, some)
        for a, b in _matches(guided, tuple(x.key for x in items)):
            for numbers, label in zip(items[b].slots, own[a], strict=True):
                if label is not None:
                    for k in numbers:  # in a slot of main text a page may still have an advert of its own
                        keep[k] = label and (texts[k].main or (against and not texts[k].hard))
    out: list[list[str]] = []
    last = None
    for t, good in zip(texts, keep, strict=True):
        if good:
            if t.block == last:
                out[-1].append(t.text)
            else:
                out.append([t.text])
            last = t.block
    lines = (" ".join("".join(x).split()) for x in out)
    return "\n".join(x for x in lines if x)


# ------------------------------------------------------------------------------------------- operator


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit(""))


def _packed(wrapper: str) -> bytes:
    return compress(wrapper.encode())


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers of a task's pages by host."""
    found: dict[str, list[list]] = {}
    pages: Counter[str] = Counter()
    part = TaskContext.get().partitionId()

    def out() -> pa.RecordBatch:
        hosts = list(found)
        wrappers = [_packed(json.dumps(w, separators=(",", ":"))) for w in found.values()]
        rows = pa.RecordBatch.from_arrays([pa.array(hosts), pa.array([part] * len(hosts), pa.int64()), pa.array([pages[h] for h in hosts], pa.int64()), pa.array(wrappers, pa.binary())], names=["host", "part", "pages", "wrapper"])
        found.clear()
        pages.clear()
        return rows

    for batch in batches:
        for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not html:
                continue
            stream, texts = read(html)
            own = of_page(group(stream), texts)
            found[name] = align(found[name], own) if name in found else own
            pages[name] += 1
        if len(found) > 20_000:
            yield out()
    if found:
        yield out()


def _fold_group(frame):
    import pandas as pd

    first = frame.iloc[0]
    folded = fold([decompress(x).decode() for x in frame["wrapper"]])
    return pd.DataFrame({"host": [first["host"]], "part": [first["part"]], "pages": [int(frame["pages"].sum())], "wrapper": [_packed(folded)]})


def _guides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [decompress(x).decode() for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.string()), pa.array([guide(w) for w in own], pa.string())], names=["host", "pages", "wrapper", "guide"])


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, pages, wrapper, guide) of every host, the wrapper as JSON, the guide packed."""
    rows = pages.select(host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    schema = "host string, part bigint, pages bigint, wrapper binary"
    parts = cut(rows.mapInArrow(trimmed(_infer), schema))
    last = parts.agg(F.max("part")).first()[0] or 0
    several = True
    while several:  # rounds: one more than the logarithm of the tasks; at least one, as a task may give a host's wrapper in parts
        several = last > 0
        parts = parts.withColumn("part", F.floor(F.col("part") / FOLD)).groupBy("host", "part").applyInPandas(_fold_group, schema)
        last //= FOLD
    return parts.select("host", "pages", "wrapper").mapInArrow(_guides, "host string, pages bigint, wrapper string, guide string")


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """Every row with a string column: the page's main text."""
    spark = pages.sparkSession
    name = free_name(pages, "main_text")
    salts = F.greatest(F.lit(1), F.ceil(F.col("pages") / PAGES)).cast("int")
    guides = cut(infer(pages, url, html).select(F.col("host").alias("_h"), "pages", "guide", salts.alias("_n")))
    size = guides.agg(F.sum("pages").alias("pages"), F.count_if(F.col("_n") > 1).alias("large")).first()
    left = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host(F.col(f"`{url}`")).alias("host"), F.xxhash64(F.col(f"`{url}`"), F.length(F.col(f"`{html}`"))).alias("hash"))
    large = guides.where("_n > 1").select(F.col("_h").alias("_l"), "_n")
    left = left.join(F.broadcast(large) if size["large"] <= BROADCAST else large, F.col("host") == F.col("_l"), "left")
    left = left.select("row", "host", F.pmod("hash", F.coalesce("_n", F.lit(1))).cast("int").alias("salt"))
    own = guides.select("_h", "guide", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_s"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["pages"] or 0) // TASK_PAGES))
    joined = left.repartition(tasks, "host", "salt").join(own.repartition(tasks, "_h", "_s").hint("merge"), (F.col("host") == F.col("_h")) & (F.col("salt") == F.col("_s")), "left")
    joined = joined.select("row", "guide", F.col("row")[html].alias("html"))
    schema = StructType([*pages.schema.fields, StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            guides = batch.column(1).dictionary_encode()  # one string a host, not one a page
            known = [None, *guides.dictionary.to_pylist()]
            which = guides.indices.fill_null(-1).to_pylist()
            text = [extract(h.as_py() or "", known[k + 1]) for h, k in zip(batch.column(2), which, strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(text, pa.string())], names=[*[f.name for f in rows.type], name])

    return joined.mapInArrow(trimmed(run), schema), name


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found, name = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("bigint").alias("n_chars"))
