"""HTML extraction by a bidirectional LSTM over a page's leaf blocks.

A page is cut into blocks at block-level tags. A block's vector has its tag path, the hints that its elements'
attributes give, and a hashed bag of its words; the LSTM reads the whole page in both directions and labels every block. It is
trained here: its pages are made up from a seed, with articles, menus, adverts, comments and so on in many kinds of markup, over words
drawn from the pages to read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgrove.llm.common import mix64, pieces, read, sample_ids

PATH = 48  # hashed places of tags on a block's path
HINTS = 32  # hashed places of words in class, id and role of the path's elements
BAG = 16  # hashed places of a block's words
HIDDEN = 24
TRAIN_PAGES = 900
EPOCHS = 12
WORDS_FROM = 200  # pages whose words the training pages are made of, chosen by hash of their id
MOST_WORDS = 20_000  # of these pages' words that are taken, chosen by hash of the page and the place

# Elements of HTML that break text into blocks, that have no end tag, and whose content isn't text.
BLOCK_TAGS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul option select button label textarea caption iframe noscript template video audio object canvas svg".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes")
# Ended by the start of another of the group, where its end tag is left out.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
PARAGRAPH_ENDS = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "p": set()}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*?)(?:>|\Z)", re.S)
_HINT = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.A)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in RAW_TAGS}


def small_hash(word: str, places: int) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % places


class Block:
    __slots__ = ("hints", "links", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], hints: tuple[str, ...], links: int):
        self.text, self.path, self.hints, self.links = text, path, hints, links


def blocks(page: str | None) -> list[Block]:
    """The non-empty text blocks of a page in order, character references decoded and white space made one space.

    Comments, scripts, styles and other raw content are no blocks, but for title and textarea.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    links = in_link = 0

    def flush() -> None:
        nonlocal links
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), tuple(h for _, hs in stack for h in hs), links))
            held.clear()
        links = 0

    def close(at: int) -> None:
        del stack[at:]

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            piece = page[at : m.start() if m else len(page)]
            held.append(entities.unescape(piece))
            if in_link:
                links += len(piece)
            if m is None:
                break
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m[1]
        if m[1]:  # an end tag
            if tag in BLOCK_TAGS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag == "br":
            held.append(" ")
        if tag in BLOCK_TAGS:
            flush()
        if tag in PARAGRAPH_ENDS or tag in IMPLIED:
            ended = {"p"} if tag in PARAGRAPH_ENDS else IMPLIED[tag]
            limit = SCOPES.get(tag, set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    close(k)
                    break
                if stack[k][0] in limit or (tag in PARAGRAPH_ENDS and stack[k][0] in BLOCK_TAGS):
                    break
        if tag in VOID_TAGS or m[3].endswith("/"):
            continue
        hints = tuple(w.lower() for g in _HINT.findall(m[3]) for w in _NAME.findall("".join(g)))
        if tag in RAW_TAGS:
            found = _RAW_END[tag].search(page, at)
            end = found.start() if found else len(page)
            if tag in ("title", "textarea"):
                stack.append((tag, hints))
                held.append(entities.unescape(page[at:end]))
                flush()
                stack.pop()
            gt = page.find(">", end)
            at = len(page) if gt < 0 else gt + 1
            continue
        stack.append((tag, hints))
    flush()
    return out


WIDTH = PATH + HINTS + BAG + 8
_WORD = re.compile(r"\w+")


class Places(dict):
    """Hashed places of words, kept until there are too many."""

    def __init__(self, places: int, most: int = 200_000):
        super().__init__()
        self.places, self.most = places, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = small_hash(word, self.places)
        return value


class Reader:
    """Vectors of blocks."""

    def __init__(self):
        self.tags, self.names, self.bag = Places(PATH), Places(HINTS), Places(BAG)

    def vectors(self, page: list[Block]) -> np.ndarray:
        x = np.zeros((len(page), WIDTH), np.float32)
        for k, b in enumerate(page):
            row = x[k]
            for t in b.path:
                row[self.tags[t]] = 1
            if b.path:
                row[self.tags["last " + b.path[-1]]] += 1
            for h in b.hints:
                row[PATH + self.names[h]] = 1
            found = _WORD.findall(b.text.lower())
            if found:
                row[PATH + HINTS : PATH + HINTS + BAG] = np.bincount([self.bag[w] for w in found], minlength=BAG) / len(found)
            n = len(b.text)
            row[-8:] = (np.log1p(n) / 8, np.log1p(len(found)) / 6, min(1, b.links / max(1, n)), b.text[-1] in ".!?…", b.text[:1].isupper(), k / len(page), (len(page) - k) / len(page), "©" in b.text)
        return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """A bidirectional LSTM with one sigmoid output a step, trained by Adam on padded batches."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden, self.p = hidden, {}
        for side in "fb":
            self.p[f"w{side}"] = (rng.standard_normal((width, 4 * hidden)) / np.sqrt(width)).astype(np.float32)
            self.p[f"u{side}"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p[f"b{side}"] = bias
        self.p["v"] = (rng.standard_normal((2 * hidden + width, 1)) * 0.1).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """Hidden states of (batch, time, width); padding, at the end of a page, leaves the state as it was."""
        h_size = self.hidden
        pre = x @ self.p[f"w{side}"] + self.p[f"b{side}"]
        n, steps = mask.shape
        h, c = np.zeros((n, h_size), np.float32), np.zeros((n, h_size), np.float32)
        out, kept = np.zeros((n, steps, h_size), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.p[f"u{side}"]
            gates = sigmoid(z[:, : 3 * h_size])
            g = np.tanh(z[:, 3 * h_size :])
            i, f, o = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[:, t, None]
            if keep:
                kept.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            out[:, t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        hf, kf = self._run(x, mask, "f", keep)
        hb, kb = self._run(x, mask, "b", keep)
        both = np.concatenate([hf, hb, x], axis=2)
        return sigmoid((both @ self.p["v"])[..., 0] + self.p["c"]), both, kf, kb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, kf, kb = self.forward(x, mask, True)
        d = np.where(mask, p - y, 0).astype(np.float32) / max(1, mask.sum())
        grad = {"v": np.einsum("nth,nt->h", both, d)[:, None], "c": np.array([d.sum()], np.float32)}
        h_size = self.hidden
        for side, kept, lo in (("f", kf, 0), ("b", kb, h_size)):
            dh_out = d[..., None] * self.p["v"][lo : lo + h_size, 0]
            du, dpre = np.zeros_like(self.p[f"u{side}"]), np.zeros((*mask.shape, 4 * h_size), np.float32)
            dh, dc = np.zeros((len(x), h_size), np.float32), np.zeros((len(x), h_size), np.float32)
            for t, h0, c0, i, f, o, g, tc, m in reversed(kept):
                dh = dh + dh_out[:, t]
                a = np.where(m, dh, 0)
                dct = np.where(m, dc, 0) + a * o * (1 - tc * tc)
                dz = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), a * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                dpre[:, t] = dz
                du += h0.T @ dz
                dh = np.where(m, 0, dh) + dz @ self.p[f"u{side}"].T
                dc = np.where(m, dct * f, dc)
            grad[f"u{side}"], grad[f"b{side}"], grad[f"w{side}"] = du, dpre.sum((0, 1)), np.einsum("ntw,ntz->wz", x, dpre, optimize=True)
        return grad

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 16, seed: int = 5) -> None:
        rng, step = np.random.default_rng(seed), 0
        m, v = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                x, mask = padded([pages[k] for k in some])
                y = np.zeros(mask.shape, np.float32)
                for r, k in enumerate(some):
                    y[r, : len(labels[k])] = labels[k]
                step += 1
                lr = rate * (1 - epoch / epochs * 0.9) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in self.gradients(x, mask, y).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - (lr * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray], most: int = 20_000) -> list[np.ndarray]:
        """The probability of every block; pages of like length go together, about `most` blocks at once."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            some = [order[at]]
            while at + len(some) < len(order) and len(pages[order[at + len(some)]]) * (len(some) + 1) <= most:
                some.append(order[at + len(some)])
            p = self.forward(*padded([pages[k] for k in some]))[0]
            for r, k in enumerate(some):
                out[k] = p[r, : len(pages[k])]
            at += len(some)
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), longest, pages[0].shape[1]), np.float32), np.zeros((len(pages), longest), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return x, mask


class PageMaker:
    """Made-up pages with known labels: each block of the article begins with a mark that is taken off after parsing."""

    MARK = "\ue000"
    # Kinds of wrapping, by what they hold; {} is the content.
    MENUS = ("<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="navigation">{}</div>', '<ul class="nav breadcrumb">{}</ul>', '<div role="navigation">{}</div>')
    HEADERS = ("<header>{}</header>", '<div class="header masthead">{}</div>', '<div id="top banner">{}</div>')
    ADVERTS = ('<div class="ad">{}</div>', '<div class="advert sponsored">{}</div>', '<aside class="promo">{}</aside>', '<ins class="adsbygoogle">{}</ins>', '<div id="ads banner">{}</div>')
    SIDES = ("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="related widget">{}</div>', '<section class="related recommended">{}</section>')
    NOTICES = ('<div class="cookie notice">{}</div>', '<div id="cookie-banner consent">{}</div>', '<div role="dialog" class="popup">{}</div>', '<div class="alert newsletter subscribe">{}</div>', '<div role="alert">{}</div>')
    FORMS = ("<form>{}<input type=text><button>{}</button></form>", '<form class="search"><label>{}</label><select><option>{}<option>x</select></form>')
    COMMENTS = ('<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="comment-list">{}</ol>', '<div class="discussion replies">{}</div>')
    FOOTERS = ("<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer copyright">{}</div>')
    ARTICLES = ("<article>{}</article>", "<main>{}</main>", '<main><article class="post">{}</article></main>', '<div class="content">{}</div>', '<div id="main article-body entry">{}</div>', '<div class="story text">{}</div>', "<section>{}</section>", "<div>{}</div>")

    def __init__(self, words: list[str], seed: int = 11):
        self.words, self.rng = words or ["lorem", "ipsum", "dolor", "sit", "amet"], np.random.default_rng(seed)

    def pick(self, options):
        return options[self.rng.integers(len(options))]

    def text(self, low: int, high: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high))))
        found = [self.words[k] for k in self.rng.integers(len(self.words), size=n)]
        if self.some(0.1):  # shouting, and signs after each word
            found = [w.upper() if self.some(0.9) else w for w in found]
        if self.some(0.1):
            found = [w + self.pick(("!!", "***", "###", "?", " |", "...")) for w in found]
        return " ".join(found).replace("&", "&amp;").replace("<", "&lt;")

    def some(self, chance: float) -> bool:
        return self.rng.random() < chance

    def links(self) -> str:
        each = [f'<a href="/{k}">{self.text(1, 4)}</a>' for k in range(self.rng.integers(2, 9))]
        return "<ul>" + "".join(f"<li>{e}</li>" for e in each) + "</ul>" if self.some(0.7) else " ".join(f"<p>{e}</p>" if self.some(0.3) else e for e in each)

    def prose(self, low: int = 3, high: int = 60) -> str:
        return "".join(f"<p>{self.text(low, high)}</p>" if self.some(0.7) else f"<div>{self.text(low, high)}</div>" for _ in range(self.rng.integers(1, 4)))

    def article(self) -> str:
        out = []
        if self.some(0.85):
            out.append(self.pick(("{}", "{}", "{}", "<header>{}</header>")).format(f"<h1>{self.MARK}{self.text(2, 14)}</h1>"))
        for _ in range(self.rng.integers(1, 14)):
            t = self.MARK + self.text(1, 160)
            out.append(self.pick((f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<h2>{t}</h2>", f"<blockquote>{t}</blockquote>", f"<ul><li>{t}</li><li>{self.MARK}{self.text(1, 20)}</li></ul>", f"<div>{t}</div>", f"<pre>{t}</pre>", f"<table><tr><td>{t}<td>{self.MARK}{self.text(1, 9)}</table>", f"<p>{t} <a href=x>{self.text(1, 4)}</a> {self.text(1, 9)}</p>", f"<figure><img src=x><figcaption>{t}</figcaption></figure>")))
            if self.some(0.08):
                out.append(self.pick(self.ADVERTS).format(self.text(2, 40)))
            if self.some(0.04):
                out.append(self.pick(self.SIDES).format(self.prose()))
        return "".join(out)

    def page(self) -> str:
        head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.text(2, 12)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
        before, after = [], []
        for chance, made in ((0.3, lambda: self.pick(self.HEADERS).format(self.prose(1, 12) + (self.links() if self.some(0.5) else ""))), (0.8, lambda: self.pick(self.MENUS).format(self.links())), (0.25, lambda: self.pick(self.NOTICES).format(self.prose(2, 40))), (0.6, lambda: self.pick(self.ADVERTS).format(self.text(2, 60))), (0.2, lambda: self.pick(self.FORMS).format(self.text(1, 8), self.text(1, 4)))):
            if self.some(chance):
                before.append(made())
        for chance, made in ((0.35, lambda: self.pick(self.SIDES).format(self.prose() + self.links())), (0.35, lambda: self.pick(self.COMMENTS).format("".join(f'<div class="comment"><span>{self.text(1, 3)}</span>{self.prose(2, 80)}</div>' if self.some(0.7) else f"<li>{self.text(2, 60)}</li>" for _ in range(self.rng.integers(1, 6))))), (0.3, lambda: self.pick(self.ADVERTS).format(self.prose(2, 40))), (0.2, lambda: self.pick(self.NOTICES).format(self.text(2, 40))), (0.15, lambda: self.pick(self.FORMS).format(self.text(1, 8), self.text(1, 4))), (0.85, lambda: self.pick(self.FOOTERS).format("&copy; " + self.text(1, 30) if self.some(0.6) else self.prose(1, 20)))):
            if self.some(chance):
                after.append(made())
        if self.some(0.15):
            before.append(self.pick(self.SIDES).format(self.prose() + self.links()))
        wrap = self.pick(("{}", "{}", "<div class=page>{}</div>", "<div><div>{}</div></div>"))
        body = "".join(before) + self.pick(self.ARTICLES).format(self.article()) + "".join(after)
        return head + wrap.format(body) + ("</body></html>" if self.some(0.7) else "")

    def labelled(self) -> tuple[list[Block], np.ndarray]:
        page = blocks(self.page())
        y = np.array([b.text.startswith(self.MARK) for b in page], np.float32)
        return [Block(b.text.replace(self.MARK, "").strip() or "x", b.path, b.hints, b.links) for b in page], y


def train(words: list[str], pages: int = TRAIN_PAGES, seed: int = 11) -> BiLstm:
    """A labeller trained on made-up pages of these words."""
    maker, reader, model = PageMaker(words, seed), Reader(), BiLstm()
    made = [maker.labelled() for _ in range(pages)]
    made = [(b, y) for b, y in made if b]
    model.train([reader.vectors(b) for b, _ in made], [y for _, y in made])
    return model


def main_text(model: BiLstm, reader: Reader, pages: list[str | None], threshold: float = 0.5) -> list[str]:
    """Each page's blocks that the model takes for the article, joined by one space."""
    cut = [blocks(p) for p in pages]
    found = model.label([reader.vectors(b) for b in cut])
    return [" ".join(b.text for b, q in zip(page, p, strict=True) if q >= threshold) for page, p in zip(cut, found, strict=True)]


def sample_words(pages: DataFrame, html: str, key: str, most: int = WORDS_FROM, most_words: int = MOST_WORDS) -> list[str]:
    """At most `most_words` words of `most` whole pages and their repeated rows, those of the smallest hashes; only training pages are made of them."""
    there = pages.where(F.col(html).isNotNull() & F.col(key).isNotNull())
    chosen = sample_ids(there.select(key), key, most).distinct()
    rows = there.select(F.col(key).alias("_p"), F.col(html).alias("_h")).join(F.broadcast(chosen.withColumnRenamed(key, "_p")), "_p").select(F.xxhash64("_p").alias("p"), "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_h", 1 << 20):
            for p, h in zip(b.column("p").to_pylist(), b.column("_h").to_pylist(), strict=True):
                found = [w for x in blocks(h) for w in x.text.split()]
                order = mix64(np.arange(len(found), dtype=np.uint64) + np.uint64(p & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(1)
                first = np.argsort(order, kind="stable")[:most_words]
                yield pa.RecordBatch.from_pydict({"u": pa.array(order[first].astype(np.int64)), "w": pa.array([found[k] for k in first], pa.string())})

    return [r["w"] for r in rows.mapInArrow(run, "u bigint, w string").orderBy("u", "w").limit(most_words).collect()]


def extract(pages: DataFrame, model: BiLstm, html: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text of each page; a null or empty page has none, and gives empty text.

    Character references are decoded, white space within a block is one space, and blocks are joined by one space in
    page order. Nothing is cut off, pages of any length are read whole, repeated rows are all returned, and an empty table gives none. The model, about 20,000 numbers, is broadcast. A column of the name is replaced.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    pages = pages.drop(name) if name != html else pages
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in pieces(batches, html, 1 << 20):
            found = main_text(sent.value, reader, b.column(html).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, name])

    return pages.mapInArrow(run, f"{fields}, `{name}` string")


def op5_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    model = train(sample_words(pages, "html", "page_id"))
    return extract(pages, model).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
