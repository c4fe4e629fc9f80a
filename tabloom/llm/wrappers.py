"""HTML extraction by wrappers: union-free expressions inferred from all pages of a host."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import map_rows, map_stream, prepare, stored

# How elements of HTML behave.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr input picture source".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe xmp template svg math canvas object audio video".split())
NEVER_SHOWN = set("head button select menu".split())
HIDDEN_TAGS = set("nav header footer aside form dialog fieldset".split())
HIDDEN_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
# Words in class names and ids of parts that are not the article.
HIDDEN_WORDS = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar
navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets related recommended share sharing social
comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices popup modal overlay newsletter
subscribe subscription signup login search pagination pager toolbar copyright disclaimer""".split())
# Elements that a start tag of these ends, if one is the innermost block.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
MAIN = ("article", "main")
# Elements whose text stays, however often it is the same: it names or is what the article says.
SAID = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "dt", "dd", "th", "td", "caption", "figcaption", "blockquote", "pre", "legend", "summary"}
HOSTS_HELD = 1000
# Bits of one alignment's table that are held; larger ones are halved.
TABLE_BITS = 1 << 27
# Texts up to this length stand in the wrapper as they are, longer ones by their digest.
TEXT_CHARS = 200

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """A block element: its symbol (tag, id, classes), whether it is left out, and its elements and text blocks.

    Names, roles and most tags are hints (``soft``): they leave out no
    element that holds an article, or most of what varies on a host's pages.
    """

    __slots__ = ("tag", "symbol", "hidden", "soft", "main", "kids")

    def __init__(self, tag: str, attributes: str = ""):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        role = found.get("role", "").lower()
        self.tag, self.kids = tag, []
        self.symbol = tag + ("." + re.sub(r"\d+", "0", ".".join(names.split())) if names else "")
        self.main = tag in MAIN or role == "main"
        self.hidden = tag in NEVER_SHOWN or bool(found) and (
            found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""))
        self.soft = not self.hidden and (tag in HIDDEN_TAGS or role in HIDDEN_ROLES)
        if names and not self.hidden and not self.main and tag not in ("html", "body"):
            self.soft = self.soft or any(w.lower() in HIDDEN_WORDS for w in _WORD.findall(names))
        self.hidden = self.hidden or self.soft


def parse(page: str | None) -> Element:
    """The tree of block elements; text blocks are (text, characters in links)."""
    page = page or ""
    root = Element("#root")
    open_ = [root]
    parts: list[str] = []
    links = [0, 0]  # open links, characters in them

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            open_[-1].kids.append((text, links[1]))
        parts.clear()
        links[1] = 0

    def add(text: str) -> None:
        text = html.unescape(text)
        parts.append(text)
        if links[0]:
            links[1] += len(text)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if not m[1]:
            continue
        tag, closing = m[1].lower(), page[m.start() + 1] == "/"
        if tag in RAW:
            if not closing and not m[2].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links[0] = 0 if closing else 1
        elif closing:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    flush()
                    del open_[k:]
                    break
            else:
                flush()
        else:
            flush()
            links[0] = 0
            if open_[-1].tag == "p" or open_[-1].tag in ENDED_BY.get(tag, ()):
                open_.pop()
            new = Element(tag, m[2])
            if new.main and not new.hidden:
                for above in open_:
                    above.hidden = above.hidden and not above.soft
            open_[-1].kids.append(new)
            if tag not in VOID:
                open_.append(new)
    flush()
    return root


# A wrapper node is a dict: s symbol, n pages that have it, o optional, r repeated, m main, h hidden on all of them, w by
# a hint alone, k nodes inside;
# for text (s is "#"): c characters, l of them in links, t the texts while all pages agree, else None.

def expression(element: Element) -> dict:
    """One page as an expression: repeated neighbours are already one group."""
    kids = []
    if not element.hidden or element.soft:
        for kid in element.kids:
            kids.append({"s": "#", "n": 1, "c": len(kid[0]), "l": kid[1], "t": token(kid[0])} if isinstance(kid, tuple)
                        else expression(kid))
    out = {"s": element.symbol, "n": 1, "k": squares(kids)}
    return out | ({"h": 1} if element.hidden else {}) | ({"w": 1} if element.soft else {}) | ({"m": 1} if element.main else {})


def token(text: str) -> str:
    return text if len(text) <= TEXT_CHARS else "#" + xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def several(a: str, b: str) -> str:
    """The texts of a repeated group, one a line, or a digest of many: other pages may have the same list."""
    text = f"{a}\n{b}"
    return text if len(text) <= 10 * TEXT_CHARS else token(text)


def squares(kids: list[dict]) -> list[dict]:
    """Fold neighbours that repeat, single ones and pairs, into repeated groups."""
    one: list[dict] = []
    for kid in kids:
        if one and kid["s"] == one[-1]["s"] != "#":
            one[-1] = align(one[-1], kid, same_page=True) | {"r": 1}
        else:
            one.append(kid)
    two, i = [], 0
    while i < len(one):
        names = [k["s"] for k in one[i:i + 4]]
        if len(names) == 4 and names[:2] == names[2:]:
            pair, at = one[i:i + 2], i + 2
            while [k["s"] for k in one[at:at + 2]] == names[:2]:
                pair = [align(a, b, same_page=True) for a, b in zip(pair, one[at:at + 2])]
                at += 2
            two.append({"s": f"({names[0]} {names[1]})", "n": 1, "r": 1, "g": 1, "k": pair})
            i = at
        else:
            two.append(one[i])
            i += 1
    return two


def align(a: dict, b: dict, same_page: bool = False) -> dict:
    """One expression for both: what only one of them has is optional, texts that differ become slots."""
    out = {"s": a["s"], "n": max(a["n"], b["n"]) if same_page else a["n"] + b["n"]}
    out |= {f: 1 for f in "ormgw" if a.get(f) or b.get(f)} | ({"h": 1} if a.get("h") and b.get("h") else {})
    if a["s"] == "#":
        same = several(a["t"], b["t"]) if same_page else a["t"] if a["t"] == b["t"] else None
        return out | {"c": a["c"] + b["c"], "l": a["l"] + b["l"], "t": same}
    kids, i, j = [], 0, 0
    for x, y in matches([k["s"] for k in a["k"]], [k["s"] for k in b["k"]]):
        kids += [k | {"o": 1} for k in a["k"][i:x]] + [k | {"o": 1} for k in b["k"][j:y]]
        kids.append(align(a["k"][x], b["k"][y], same_page))
        i, j = x + 1, y + 1
    kids += [k | {"o": 1} for k in a["k"][i:]] + [k | {"o": 1} for k in b["k"][j:]]
    return out | {"k": kids}


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    out = [(i, i) for i in range(start)]
    left = [(a[start:len(a) - end], b[start:len(b) - end], start, start)]
    while left:
        x, y, i, j = left.pop()
        if len(x) > 1 and len(x) * len(y) > TABLE_BITS:
            # Where to cut y, so that both halves of x share most: only two rows are held.
            half = len(x) // 2
            fore, back = shared(rows_of(x[:half], y)[-1], len(y)), shared(rows_of(x[:half - 1:-1], y[::-1])[-1], len(y))
            cut = max(range(len(y) + 1), key=lambda k: fore[k] + back[len(y) - k])
            left += [(x[half:], y[cut:], i + half, j + cut), (x[:half], y[:cut], i, j)]
            continue
        rows, n, m = rows_of(x, y, True), len(x), len(y)
        found = []
        while n and m:
            if rows[n] >> (m - 1) & 1:
                m -= 1
            elif not rows[n - 1] >> (m - 1) & 1:
                n -= 1
            else:
                n, m = n - 1, m - 1
                found.append((i + n, j + m))
        out += found[::-1]
    return out + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]


def rows_of(a: list[str], b: list[str], every: bool = False) -> list[int]:
    """The last or every row of the table of common lengths: bit j is 0 where b[:j + 1] shares more than b[:j]."""
    at: dict[str, int] = {}
    for j, s in enumerate(b):
        at[s] = at.get(s, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    rows = [row]
    for s in a:
        met = row & at.get(s, 0)
        row = (row + met | row - met) & full
        if every:
            rows.append(row)
    return rows if every else [row]


def shared(row: int, n: int) -> list[int]:
    """The common lengths that a row stands for, from the empty part of b on."""
    out = [0]
    for bit in f"{row:0{n}b}"[::-1] if n else "":
        out.append(out[-1] + (bit == "0"))
    return out


def held(node: dict, inside: Callable[[dict], bool], memo: dict[int, int]) -> int:
    """Variable characters outside links in ``node``, in elements that ``inside`` lets in."""
    if node["s"] == "#":
        # What one page alone has is not known to be the same on others.
        return 0 if node["t"] is not None and node["n"] > 1 else node["c"] - node["l"]
    if id(node) not in memo:
        memo[id(node)] = sum(held(k, inside, memo) for k in node["k"] if k["s"] == "#" or inside(k))
    return memo[id(node)]


def shown(wrapper: dict) -> list[str]:
    """Paths of elements that hints would leave out, but that hold an article or most of the host's variable text."""
    memo: dict[int, int] = {}
    every = lambda k: not k.get("h") or bool(k.get("w"))
    whole, by, plain = held(wrapper, every, memo), {}, set()

    def walk(node: dict, path: str) -> None:
        for kid in node["k"]:
            if kid["s"] != "#":
                own = path if kid.get("g") else f"{path}/{kid['s']}"
                if kid.get("w"):
                    by[own] = by.get(own, 0) + held(kid, every, memo)
                    if not kid.get("h"):
                        plain.add(own)
                walk(kid, own)

    walk(wrapper, "")
    return sorted(plain | {p for p, m in by.items() if 2 * m > whole})


def template(wrapper: dict, paths: list[str]) -> list[str]:
    """Path and text of the template's blocks, if others vary inside the containers.

    Being the same on all pages is one sign, and standing mostly in links is
    the other that is asked for; headings, paragraphs and the like never go.
    """
    found, varies = set(), False

    def walk(node: dict, path: str, inside: bool) -> None:
        nonlocal varies
        for kid in node["k"]:
            if kid["s"] != "#":
                own = path if kid.get("g") else f"{path}/{kid['s']}"
                walk(kid, own, inside or own in paths)
            elif kid["t"] is None:
                varies = varies or inside
            elif (kid["n"] == wrapper["n"] > 1 and 2 * kid["l"] >= kid["c"]
                  and re.split(r"[.\0]", path.rsplit("/", 1)[-1])[0] not in SAID):
                found.update(f"{path}\n{t}" for t in kid["t"].split("\n"))

    walk(wrapper, "", not paths)
    return sorted(found) if varies else []


def containers(wrapper: dict) -> list[str]:
    """Paths of the elements that hold the article, by what the whole host's pages have in common.

    The outermost ``article`` or ``main`` elements that half of the pages
    have; else the innermost element with all variable text that stands
    neither in links nor in parts that are left out, as long as more text
    stands inside than outside.
    """
    # Alignment may leave several optional nodes with one path, so counts and masses are added up by path.
    pages: dict[str, int] = {}
    marked: list[str] = []

    visible = set(shown(wrapper))

    def label(node: dict, path: str) -> dict:
        """The wrapper without what is left out."""
        kids = []
        for kid in node["k"]:
            own = path if kid["s"] == "#" or kid.get("g") else f"{path}/{kid['s']}"
            if kid["s"] == "#":
                kids.append(kid)
            elif not kid.get("h") or own in visible:
                kids.append(label(kid, own))
        return node | {"k": kids}

    def walk(node: dict, path: str, pick: bool) -> None:
        for kid in node["k"]:
            if kid["s"] == "#":
                continue
            own = path if kid.get("g") else f"{path}/{kid['s']}"
            if pick and kid.get("m") and 2 * pages[own] >= wrapper["n"]:
                marked.append(own)
                continue
            if kid.get("m"):
                pages[own] = pages.get(own, 0) + kid["n"]
            walk(kid, own, pick)

    wrapper, memo = label(wrapper, ""), {}
    mass = lambda k: held(k, lambda _: True, memo)
    walk(wrapper, "", False)
    walk(wrapper, "", True)
    if marked:
        return sorted(set(marked))
    def text(node: dict) -> int:
        """Characters outside links, whether they vary or not."""
        return node["c"] - node["l"] if node["s"] == "#" else sum(map(text, node["k"]))

    nodes, path, whole, total = [wrapper], "", mass(wrapper), text(wrapper)
    while whole:
        inner: dict[str, list[dict]] = {}
        for kid in (k for n in nodes for k in n["k"]):
            if kid["s"] != "#":
                inner.setdefault(kid["s"], []).append(kid)
        inside = {s: sum(map(mass, kids)) for s, kids in inner.items() if not any(k.get("r") for k in kids)}
        down = [s for s, m in inside.items() if m == whole and 2 * sum(map(text, inner[s])) >= total]
        if not down:
            break
        nodes, path, whole = inner[down[0]], f"{path}/{down[0]}", inside[down[0]]
    return [path] if path else []


def main_text(page: str | None, paths: list[str], visible: list[str] = (), constant: list[str] = ()) -> str:
    """The text blocks inside the containers; those of the whole page if it has none of them.

    ``visible`` are paths that hints don't leave out; ``constant`` blocks belong to the template.
    """
    wanted, visible, constant = set(paths), set(visible), set(constant)

    def collect(element: Element, path: str, inside: bool, out: list[str]) -> bool:
        met = False
        for kid in element.kids:
            if isinstance(kid, tuple):
                if inside and not (constant and f"{path}\n{token(kid[0])}" in constant):
                    out.append(kid[0])
            else:
                own = f"{path}/{kid.symbol}"
                if not kid.hidden or kid.soft and own in visible:
                    here = own in wanted
                    met = collect(kid, own, inside or here, out) or here or met
        return met

    root, out = parse(page), []
    if not collect(root, "", False, out):
        collect(root, "", True, out := [])
    return "\n".join(out)


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, pages, wrapper as JSON, containers, visible, constant) from all pages of every host.

    A task aligns the pages that it reads into one expression for each host;
    these are aligned over tasks in two steps, one row at a time, so a host
    with most of the pages is no group in memory: it gives one row for each
    task at most.
    """
    prepare(pages.sparkSession)

    def fold(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held: dict[str, dict] = {}

        def out() -> dict[str, list]:
            rows = list(held.items())
            held.clear()
            return {"host": [h for h, _ in rows], "wrapper": [json.dumps(w) for _, w in rows]}

        for batch in batches:
            for host, text in zip(batch["host"], batch["html"]):
                own = expression(parse(text))
                held[host] = align(held[host], own) if host in held else own
                if len(held) >= HOSTS_HELD:
                    yield out()
        yield out()

    def join(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        now, whole = None, None
        for batch in batches:
            done: dict[str, list] = {"host": [], "wrapper": []}
            for host, text in zip(batch["host"], batch["wrapper"]):
                own = json.loads(text)
                if whole is not None and host == now:
                    whole = align(whole, own)
                    continue
                if whole is not None:
                    done["host"].append(now)
                    done["wrapper"].append(json.dumps(whole))
                now, whole = host, own
            yield done
        if whole is not None:
            yield {"host": [now], "wrapper": [json.dumps(whole)]}

    def finish(rows: dict[str, list]) -> dict[str, list]:
        every = [json.loads(w) for w in rows["wrapper"]]
        paths = [containers(w) for w in every]
        return rows | {"pages": [w["n"] for w in every], "containers": paths, "visible": [shown(w) for w in every],
                       "constant": [template(w, p) for w, p in zip(every, paths)]}

    kind = "host string, wrapper string"
    parts = map_stream(pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("html")), fold, kind)
    parts = stored(parts.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(32))), "wrappers")
    some = map_stream(parts.repartition("host", "slot").sortWithinPartitions("host", "wrapper").select("host", "wrapper"), join, kind)
    # Whether a task saw one slot or several, each host's rows stand together.
    whole = map_stream(some.repartition("host").sortWithinPartitions("host", "wrapper"), join, kind)
    return map_rows(whole, finish, "host string, pages long, wrapper string, containers array<string>, visible array<string>, constant array<string>")


def host_of(url):
    """The lower-case host of an address; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def extract_pages(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url and main text of every page, by its host's wrapper.

    A null or empty page has an empty text; a null url is a host of its own;
    pages are read whole; repeated rows give repeated results; an empty table
    gives an empty table; other columns are ignored.
    """
    rows = pages.select("page_id", F.col(url).alias("url"), F.col(page).alias("html")).withColumn("host", host_of(F.col("url")))
    learnt = ["containers", "visible", "constant"]
    learned = stored(infer_wrappers(rows, "url", "html").select("host", *learnt), "containers")

    def run(batch: dict[str, list]) -> dict[str, list]:
        texts = [main_text(t, *(x or [] for x in own)) for t, *own in zip(batch["html"], *(batch[c] for c in learnt))]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(rows.join(learned, "host", "left").select("page_id", "url", "html", *learnt), run,
                    "page_id long, url string, text string, n_chars long")
