"""Main text of web pages: a recurrent labeller of the sequence of text blocks.

A page is cut in blocks: runs of text between tags that are not inline, in page order, with the path of open elements.
Scripts, styles, comments and other elements without text are no blocks.  Each block is a vector: hashed tags, classes
and ids of its path, hashed words, and its shape (length, links, punctuation, place).  A bidirectional LSTM reads the
vectors of the whole page in both directions and labels every block as main text or not.

There are no labels of pages, so the labeller learns from rules on tag and class names over a bounded sample of pages,
each also in rewritten layouts (other containers, and added menus, notices, sidebars, forms and comments around and in
the article).  The rules teach only; the network alone decides.

Null and empty pages give an empty text, as do pages without text.  Broken and cut markup is read as far as it goes.
Repeated rows give equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overgrid.llm import lstm
from overgrid.llm.common import sampled, text_of

#: Documented bound of the training sample: pages (by a hash of the page), and blocks kept of each.
TRAINING_PAGES, TRAINING_BLOCKS = 300, 200

TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(?:/?[a-zA-Z]|[!?])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<[/!?a-zA-Z][^>]*>?", re.DOTALL)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PART = re.compile(r"[a-z]+")

# HTML elements by how they are read.
SILENT = frozenset("script style noscript template svg math iframe object textarea select option title head canvas audio video button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# Names that teach what is not main text.
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal newsletter "
    "subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget comment comments reply replies disqus respond "
    "footer header masthead logo share social related recommended more tags meta pagination pager toolbar search form copyright legal".split()
)


@dataclass(frozen=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order.  Path entries are ``tag`` or ``tag.names``."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked, in_link, at, silent = 0, 0, 0, 0

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, tuple(entry for _, entry in stack), min(linked, len(text))))
        held.clear()
        linked = 0

    def pop(upto: int) -> None:
        nonlocal silent
        silent -= sum(tag in SILENT for tag, _ in stack[upto:])
        del stack[upto:]

    position = 0
    while position <= len(page):
        match = TAG.search(page, position)
        piece = page[at : match.start()] if match else page[at:]
        if piece and not silent:
            decoded = html.unescape(piece) if "&" in piece else piece
            held.append(decoded)
            linked += len(decoded.strip()) if in_link else 0
        if not match:
            break
        position = at = match.end()
        token = match[0]
        name = NAME.match(token)
        if not name:
            continue
        tag = name[1].lower()
        closing = token[1] == "/"
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                held.append(" ")
            continue
        end()
        in_link = 0
        if closing:
            found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if found is not None:
                pop(found)
            continue
        if tag in CLOSES_P and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in CLOSES.get(tag, ()):
                pop(k)
                break
            if stack[k][0] in ("ul", "ol", "table", "dl", "div", "section", "article"):
                break
        if tag in VOID or token.endswith("/>"):
            continue
        if tag in RAW:  # up to its own end tag, whatever stands between
            close = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            position = at = close.end() if close else len(page)
            continue
        names = " ".join("".join(groups) for groups in NAMED.findall(token)).lower()
        stack.append((tag, f"{tag}.{names}" if names else tag))
        silent += tag in SILENT
    end()
    return out


PATH_BUCKETS, WORD_BUCKETS, SHAPE = 128, 16, 10
WIDTH = PATH_BUCKETS + WORD_BUCKETS + SHAPE
_PATHS: dict[tuple[str, ...], np.ndarray] = {}
_WORDS: dict[str, int] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    had = _PATHS.get(path)
    if had is None:
        had = np.zeros(PATH_BUCKETS)
        for depth, entry in enumerate(reversed(path)):
            tag, _, names = entry.partition(".")
            weight = max(0.5, 1 - 0.1 * depth)
            for token in {tag, *(f"#{n}" for n in PART.findall(names))} | ({f"^{tag}"} if depth == 0 else set()):
                code = zlib.crc32(token.encode())
                had[code % PATH_BUCKETS] += weight if code >> 16 & 1 else -weight
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        _PATHS[path] = had
    return had


def vectors(blocks: list[Block]) -> np.ndarray:
    """``(blocks, WIDTH)``."""
    out = np.zeros((len(blocks), WIDTH))
    for k, block in enumerate(blocks):
        words = block.text.lower().split()
        codes = [_WORDS[w] if w in _WORDS else _remember(w) for w in words]
        out[k, :PATH_BUCKETS] = _path_vector(block.path)
        out[k, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = np.sqrt(np.bincount(codes, minlength=WORD_BUCKETS) / len(words))
        size = len(block.text)
        last = block.path[-1].partition(".")[0] if block.path else ""
        out[k, PATH_BUCKETS + WORD_BUCKETS :] = (
            np.log1p(size) / 6, np.log1p(len(words)) / 4, block.linked / size, float(block.text[-1] in ".!?…\"'"),
            block.text.count(",") / len(words), float(last[:1] == "h" and last[1:].isdigit()), float(last == "p"), float(last == "li"),
            k / len(blocks), len(block.path) / 8,
        )
    return out


def _remember(word: str) -> int:
    if len(_WORDS) > 300_000:
        _WORDS.clear()
    _WORDS[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
    return _WORDS[word]


def taught(block: Block) -> bool:
    """What the rules say: main text unless some name on the path says otherwise; a heading in an article's header stays."""
    tags = [entry.partition(".")[0] for entry in block.path]
    names = {n for entry in block.path for n in PART.findall(entry.partition(".")[2])}
    if OUTSIDE & set(tags) or OUTSIDE_NAMES & names:
        return False
    return "header" not in tags or ("article" in tags and tags[-1] == "h1")


def layouts(page: str, seed: int) -> Iterator[str]:
    """The page, and the page in other layouts: renamed containers and added sections of its own words."""
    yield page
    random = np.random.default_rng(seed)
    words = " ".join(b.text for b in blocks_of(page)).split() or ["more"]

    def some(low: int, high: int) -> str:
        n = int(random.integers(low, high))
        at = int(random.integers(0, max(1, len(words) - n)))
        return html.escape(" ".join(words[at : at + n]))

    def pick(choices: list[str]) -> str:
        return choices[int(random.integers(0, len(choices)))]

    def section(choices: list[str]) -> str:
        if random.random() < 0.6:  # any of the teaching names
            tag, name = pick(["div", "section", "ul", "div", "p"]), pick(sorted(OUTSIDE_NAMES)) + pick(["", "", "-box", " block", "-wrap"])
            head, tail = f"<{tag} {pick(['class', 'id'])}='{name}'>", f"</{tag}>"
        else:
            head, tail = pick(choices).split("|")
        inner = pick(["<p>{}</p>", "<ul><li><a href=x>{}</a></li><li><a href=y>{}</a></li></ul>", "<h3>{}</h3><div>{}</div>", "{}", "<div><p>{}</p><p>{}</p></div>"])
        return head + re.sub(r"\{\}", lambda _: some(1, 30), inner) + tail

    before = ["<header>|</header>", "<div class='header'>|</div>", "<div class='site-header'>|</div>", "<div class='cookie-notice'>|</div>", "<div id=cookies>|</div>", "<div class='notice'>|</div>", "<div class='menu'>|</div>", "<div id='nav'>|</div>", "<div class='breadcrumbs'>|</div>", "<div class='banner ad'>|</div>", "<div role='banner'>|</div>"]
    beside = ["<aside>|</aside>", "<div class='sidebar'>|</div>", "<div id='sidebar'>|</div>", "<form>|</form>", "<div class='advert'>|</div>", "<div class='ad'>|</div>", "<div class='newsletter'>|</div>", "<div class='share'>|</div>", "<div class='related'>|</div>", "<div class='promo'>|</div>", "<aside class='widget'>|</aside>", "<form class='subscribe'>|</form>"]
    after = ["<section class='comments'>|</section>", "<div class='comment'>|</div>", "<div id='comments'>|</div>", "<ul class='comments'><li class='comment'>|</li></ul>", "<footer>|</footer>", "<div class='footer'>|</div>", "<div id='footer'>|</div>"]
    for _ in range(4):
        box = pick(["article", "main", "div class='content'", "div class='post'", "div id='main'", "section class='story'", "div class='article-body'", "article class='entry'"])
        made = page.replace("<article>", f"{''.join(section(before) for _ in range(random.integers(0, 3)))}<{box}>{section(beside) if random.random() < 0.2 else ''}")
        made = re.sub(r"</p>(?=<p>)", lambda m: m[0] + (section(beside) if random.random() < 0.06 else ""), made)
        inside = "".join(section([*after[:4], beside[5], beside[8]]) for _ in range(random.integers(0, 3)))
        made = made.replace("</article>", f"{inside}</{box.split()[0]}>{''.join(section(beside + after) for _ in range(random.integers(0, 4)))}")
        if random.random() < 0.4:
            made = made.replace("<nav>", "<div class='menu'>").replace("</nav>", "</div>")
        if random.random() < 0.4:
            made = made.replace("<footer>", "<div class='footer'>").replace("</footer>", "</div>")
        yield made


def lessons(page: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for made in layouts(page, zlib.crc32(page.encode("utf-8", "surrogatepass"))):
        blocks = blocks_of(made)
        if blocks:
            yield vectors(blocks)[:TRAINING_BLOCKS], np.array([taught(b) for b in blocks], dtype=float)[:TRAINING_BLOCKS]


def train(pages: DataFrame, column: str = "html") -> lstm.Labeller | None:
    """Fit on a bounded sample of pages; blocks and vectors are made on the executors and come as bytes."""
    total = pages.count()
    value = text_of(F.col(f"`{column}`"))
    share = sampled(value, TRAINING_PAGES, total)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for page in part["html"]:
                rows = [(x.astype(np.float32).tobytes(), y.astype(np.float32).tobytes()) for x, y in lessons(page)]
                yield pd.DataFrame(rows, columns=["x", "y"])

    found = pages.select(value.alias("html")).filter(share).distinct().mapInPandas(run, "x binary, y binary").toPandas()
    if found.empty:
        return None
    rows = sorted(zip(found["x"], found["y"], strict=True), key=lambda row: zlib.crc32(row[0]))
    numbers = [tuple(np.frombuffer(part, dtype=np.float32) for part in row) for row in rows]
    return lstm.fit([x.reshape(-1, WIDTH) for x, _ in numbers], [y for _, y in numbers])


def main_text(pages: list[str | None], model: lstm.Labeller | None) -> list[str]:
    """The blocks that the model labels as main text, one a line.  Without a model all blocks stay."""
    cut = [blocks_of(page) for page in pages]
    if model is None:
        return ["\n".join(b.text for b in blocks) for blocks in cut]
    chances = lstm.label(model, [vectors(blocks) for blocks in cut])
    return ["\n".join(b.text for b, p in zip(blocks, chance, strict=True) if p >= 0.5) for blocks, chance in zip(cut, chances, strict=True)]


def extract(pages: DataFrame, model: lstm.Labeller | None, column: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page."""

    @F.pandas_udf(T.StringType())
    def extracted(values: pd.Series) -> pd.Series:
        out: list[str] = []
        for at in range(0, len(values), 256):
            out += main_text(values.iloc[at : at + 256].tolist(), model)
        return pd.Series(out, dtype=object)

    return pages.withColumn(text, extracted(F.col(f"`{column}`")))


def op9_main_text(spark, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
