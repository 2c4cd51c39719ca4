"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, each with its tag path (tags, classes, ids, roles). A bidirectional LSTM
in numpy reads every page's whole sequence of block vectors (hashed path, hashed words, a few
figures) and labels each block. It is trained on a bounded sample of the table's own pages, drawn among those
that mark their main text and read whole: blocks are labelled by the semantic elements that pages carry, and their
texts are also set anew into other layouts, so that the labeller meets notices, adverts, forms, sidebars and comments
under many names. Where no page of the table marks its main text, only such layouts are learned from.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.sample import sigmoid

# HTML element names by their role in cutting a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Never rendered: iframe holds what browsers without frames showed, annotations hold a formula's source beside the formula.
HIDDEN = set("script style template iframe head title annotation annotation-xml".split())
#: Formulas and drawings stay within their line of text; their cells (mtd) and labels (text) are blocks.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr "
             "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup "
             "msubsup munder mover munderover mmultiscripts mprescripts none "
             "svg g defs symbol use path rect circle ellipse line polyline polygon tspan".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("div article section main aside nav header footer form ul ol dl table blockquote body td th object".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>|[^<]+|<""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[^a-z0-9]+")
# Names of elements, classes and ids that mark main text and the other parts of a page.
MAIN = "article main".split()
OTHER = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar pagination".split(),
    "header": "header masthead banner branding logo".split(),
    "footer": "footer copyright colophon legal".split(),
    "side": "aside sidebar widget related recommended trending popular tags share social".split(),
    "notice": "cookie cookies notice consent gdpr alert popup modal disclaimer".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion".split(),
    "form": "form newsletter subscribe signup login search".split(),
    "comments": "comments comment reply replies discussion responses".split(),
}
WRAPPERS = [["article"], ["main"], ["main", "article"], ["div", "content"], ["div", "main", "content"], ["div", "post", "body"],
            ["section", "entry", "content"], ["div", "article", "body"], ["div", "story"], ["div", "text"], ["div", "page", "article"], []]
PATH, WORD, FIGURES, HIDDEN_SIZE = 512, 32, 6, 16
INPUT = PATH + WORD + FIGURES
WINDOW = 2_000  # blocks; longer training pages are learned from in consecutive windows of so many


# -- pages to blocks -------------------------------------------------------------------------------

def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """(path tokens, text, share of its characters in links) of every leaf block with text, in page order."""
    page, out, stack, buffer, linked = page or "", [], [], [], 0
    names: list[list[str]] = []

    def flush():
        nonlocal buffer, linked
        text = " ".join("".join(buffer).split())
        if text:
            keep = [k for k, tag in enumerate(stack) if tag not in INLINE]
            path = [t for k in keep for t in names[k]]
            out.append((("leaf " + (stack[keep[-1]] if keep else ""), *path), text, min(1.0, linked / len(text))))
        buffer, linked = [], 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        token, tag = m.group(), m.group(2)
        if tag is None:
            if not token.startswith("<") or token == "<":
                text = entities.unescape(token)
                buffer.append(text)
                if "a" in stack:
                    linked += len(text)
            continue
        tag = tag.lower()
        if m.group(1):
            if tag not in INLINE:
                flush()
            if tag in stack:
                k = len(stack) - 1 - stack[::-1].index(tag)
                del stack[k:], names[k:]
            continue
        if tag in HIDDEN and not m.group(3).rstrip().endswith("/"):
            if tag == "head":  # its own elements are skipped one by one; an unclosed head must not hide the page
                continue
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else (end if tag in ("script", "style") else at)
            continue
        if tag not in INLINE:
            if tag == "br" or tag == "wbr":
                buffer.append(" ")
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in CLOSES.get(tag, ()):
                    del stack[k:], names[k:]
                    break
                if stack[k] in SCOPES:
                    break
        elif tag == "wbr":
            continue
        if tag not in VOID:
            stack.append(tag)
            found = " ".join("".join(g) for g in NAMES.findall(m.group(3))).lower() if m.group(3) else ""
            names.append([tag, *[w for w in WORDS.split(found) if w and not w.isdigit()]])
    flush()
    return out


# -- block vectors ---------------------------------------------------------------------------------

class Buckets(dict):
    """word -> its bucket, remembered for at most ``limit`` words."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD
        return value


class Vectors:
    """Block vectors; hashes of path tokens and words are remembered in bounded tables."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.paths, self.words = limit, {}, Buckets(limit)

    def path(self, path: tuple[str, ...]) -> list[int]:
        if path not in self.paths:
            if len(self.paths) >= self.limit // 10:
                self.paths.clear()
            self.paths[path] = sorted({zlib.crc32(t.encode("utf-8", "surrogatepass")) % PATH for t in path})
        return self.paths[path]

    def word(self, text: str) -> np.ndarray:
        own = text.lower().split()
        return np.bincount(list(map(self.words.__getitem__, own)), minlength=WORD) / len(own)

    def __call__(self, page: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
        x = np.zeros((len(page), INPUT), np.float32)
        for k, (path, text, linked) in enumerate(page):
            x[k, self.path(path)] = 1
            x[k, PATH:PATH + WORD] = self.word(text)
            n = len(text)
            x[k, PATH + WORD:] = (np.log1p(n) / 8, linked, sum(map(text.count, ".,!?")) * 20 / (n + 20),
                                  k / len(page), 1 - k / len(page), text[-1] in ".!?")
        return x


# -- the network -----------------------------------------------------------------------------------

def initial(seed: int) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(seed), HIDDEN_SIZE
    p = {}
    for d in "fb":  # forwards, backwards; gates: input, forget, output, candidate
        p[f"w{d}"] = rng.normal(0, 0.1, (INPUT, 4 * h))
        p[f"u{d}"] = rng.normal(0, 0.2, (h, 4 * h))
        p[f"c{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
    p["v"], p["o"] = rng.normal(0, 0.2, (2 * h, 1)), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def lstm(z: np.ndarray, mask: np.ndarray, u: np.ndarray, tape: list | None = None) -> np.ndarray:
    """Hidden states (batch, time, h) over the projected inputs ``z``; padding keeps the state."""
    n, time, h = *z.shape[:2], HIDDEN_SIZE
    state, cell, out = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, time, h), np.float32)
    for t in range(time):
        a = z[:, t] + state @ u
        gates, cand = sigmoid(a[:, :3 * h]).astype(np.float32), np.tanh(a[:, 3 * h:])
        i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
        new = f * cell + i * cand
        m = mask[:, t, None]
        if tape is not None:
            tape.append((state, cell, i, f, o, cand, new))
        state, cell = m * (o * np.tanh(new)) + (1 - m) * state, m * new + (1 - m) * cell
        out[:, t] = state
    return out


def lstm_back(grad: np.ndarray, mask: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u``."""
    n, time, h = grad.shape
    dz, du = np.zeros((n, time, 4 * h), np.float32), np.zeros_like(u)
    ds, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(time - 1, -1, -1):
        state, cell, i, f, o, cand, new = tape[t]
        m, squashed = mask[:, t, None], np.tanh(new)
        ds = ds + grad[:, t]
        dn = (dc + ds * o * (1 - squashed ** 2)) * m
        da = np.concatenate([dn * cand * i * (1 - i), dn * cell * f * (1 - f),
                             ds * squashed * o * (1 - o) * m, dn * i * (1 - cand ** 2)], axis=1)
        dz[:, t], du = da, du + state.T @ da
        ds, dc = da @ u.T + (1 - m) * ds, dn * f + (1 - m) * dc
    return dz, du


def windows(x: np.ndarray, own: list[int]) -> list[tuple[np.ndarray, list[int]]]:
    """All blocks of a training page, in consecutive windows of at most WINDOW blocks."""
    return [(x[k:k + WINDOW], own[k:k + WINDOW]) for k in range(0, len(own), WINDOW)]


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block vectors with their path bits packed; a thirteenth to a tenth of the size."""
    return np.packbits(x[:, :PATH] > 0, axis=1), x[:, PATH:].copy()


def unpacked(bits: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return np.concatenate([np.unpackbits(bits, axis=1).astype(np.float32), rest], axis=1)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    time = max(map(len, pages))
    x, mask = np.zeros((len(pages), time, INPUT), np.float32), np.zeros((len(pages), time), np.float32)
    for k, p in enumerate(pages):
        x[k, :len(p)], mask[k, :len(p)] = p, 1
    return x, mask


def flipped(a: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each page's own blocks in reverse order, padding left behind."""
    n, at = mask.sum(axis=1).astype(int)[:, None], np.arange(a.shape[1])[None, :]
    return np.take_along_axis(a, np.where(at < n, n - 1 - at, at)[:, :, None], axis=1)


def forward(p: dict, x: np.ndarray, mask: np.ndarray, tapes: list | None = None):
    f = lstm(x @ p["wf"] + p["cf"], mask, p["uf"], None if tapes is None else tapes[0])
    xb = flipped(x, mask)
    b = flipped(lstm(xb @ p["wb"] + p["cb"], mask, p["ub"], None if tapes is None else tapes[1]), mask)
    both = np.concatenate([f, b], axis=2)
    return (both @ p["v"] + p["o"])[:, :, 0], both, xb


def train(pages: list[tuple[np.ndarray, np.ndarray]], labels: list[np.ndarray], seed: int, epochs: int, batch: int = 32,
          limit: int = 30_000) -> dict[str, np.ndarray]:
    """Adam on the mean log loss of the blocks; ``pages`` are packed, at most ``limit`` padded blocks are unpacked at once."""
    p, rng = initial(seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    groups: list[list[int]] = []
    for k in np.argsort([len(y) for y in labels], kind="stable"):
        if not groups or len(groups[-1]) == batch or (len(groups[-1]) + 1) * len(labels[k]) > limit:
            groups.append([])
        groups[-1].append(k)
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = padded([unpacked(*pages[k]) for k in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for row, k in enumerate(groups[g]):
                y[row, :len(labels[k])] = labels[k]
            tapes = [[], []]
            score, both, xb = forward(p, x, mask, tapes)
            d = ((sigmoid(score) - y) * mask / mask.sum())[:, :, None].astype(np.float32)
            grads = {"v": np.einsum("bth,bto->ho", both, d), "o": d.sum(axis=(0, 1))}
            back = d @ p["v"].T
            h = HIDDEN_SIZE
            for way, inputs, gradient, tape in (("f", x, back[:, :, :h], tapes[0]), ("b", xb, flipped(back[:, :, h:], mask), tapes[1])):
                dz, grads[f"u{way}"] = lstm_back(gradient, mask, p[f"u{way}"], tape)
                grads[f"w{way}"] = np.tensordot(inputs, dz, ((0, 1), (0, 1)))
                grads[f"c{way}"] = dz.sum(axis=(0, 1))
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for k, gradient in grads.items():
                gradient = np.clip(gradient, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * gradient, 0.999 * v[k] + 0.001 * gradient ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p


def label(p: dict, pages: list[np.ndarray], batch: int = 64, limit: int = 60_000) -> list[np.ndarray]:
    """Probability of main text for every block; pages of similar length are read together."""
    out: list = [np.zeros(0)] * len(pages)
    order, at = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k])), 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and stop - at < batch and (stop - at + 1) * len(pages[order[stop]]) <= limit:
            stop += 1
        own = order[at:stop]
        scores = forward(p, *padded([pages[k] for k in own]))[0]
        for row, k in enumerate(own):
            out[k] = sigmoid(scores[row, :len(pages[k])])
        at = stop
    return out


# -- training pages --------------------------------------------------------------------------------

def marked(page: list) -> list[int] | None:
    """Labels by the semantic elements of the page; None where it has no element for main text."""
    other = {w for names in OTHER.values() for w in names}
    own = [0 if other & set(path) else 1 if set(MAIN) & set(path) else 0 for path, *_ in page]
    return own if any(own) else None


def laid_out(page: list, own: list[int], texts: list[str], rng: np.random.Generator) -> tuple[list, list[int]]:
    """The page's main blocks in another layout among other parts, filled with texts of the corpus."""
    pick = lambda items: items[int(rng.integers(len(items)))]
    wrapper, out, labels = pick(WRAPPERS), [], []

    def some(kind: str, inside: list[str] | None = None):
        name, element = pick(OTHER[kind]), OTHER[kind][0]
        holder = pick(["div", "section", "ul", element if element in SCOPES else "div"])
        for _ in range(int(rng.integers(1, 7 if kind in ("menu", "side", "comments") else 3))):
            leaf, text = pick(["p", "li", "div", "h3", "span"]), pick(texts)
            if kind in ("menu", "footer", "advert") and rng.random() < 0.7:
                text = " ".join(text.split()[:int(rng.integers(1, 12))])
            linked = 1.0 if kind in ("menu", "side") and rng.random() < 0.7 else 0.0
            out.append((("leaf " + leaf, "html", "body", *(inside or []), holder, name, leaf), text, linked))
            labels.append(0)

    for kind in ("header", "menu", "notice", "advert", "side"):
        if rng.random() < 0.5:
            some(kind)
    blocks_ = [b for b, y in zip(page, own) if y]
    for k, (path, text, linked) in enumerate(blocks_):
        leaf = "h1" if k == 0 and rng.random() < 0.8 else pick(["p", "p", "p", "h2", "li", "blockquote", path[0][5:] or "p"])
        out.append((("leaf " + leaf, "html", "body", *wrapper, leaf), text, linked))
        labels.append(1)
        if rng.random() < 0.15:
            some(pick(["advert", "side", "form", "notice"]), wrapper)
    if rng.random() < 0.5:
        some("comments", wrapper if rng.random() < 0.5 else None)
    for kind in ("side", "form", "advert", "notice", "footer"):
        if rng.random() < 0.5:
            some(kind)
    return out, labels


def presumed(page: list) -> list[int]:
    """Labels for a page without an element for main text, to fill layouts with: its prose outside parts that are
    named as something else, or all such blocks, or all blocks."""
    other = {w for names in OTHER.values() for w in names}
    outside = [int(not other & set(path)) for path, *_ in page]
    prose = [int(y and len(text) >= 80 and linked < 0.3 and text[-1] in ".!?") for y, (_, text, linked) in zip(outside, page)]
    return prose if any(prose) else outside if any(outside) else [1] * len(page)


def fit(pages: list[str], seed: int = 7, layouts: int = 3, least: int = 400, epochs: int = 12) -> dict[str, np.ndarray] | None:
    """The labeller trained on whole pages; None where no page has a block."""
    return fit_blocks([b for b in map(blocks, pages) if b], seed, layouts, least, epochs)


def fit_blocks(pages: list[list], seed: int = 7, layouts: int = 3, least: int = 400, epochs: int = 12) -> dict[str, np.ndarray] | None:
    """The labeller trained on the block sequences of pages with an element for main text, each also in ``layouts``
    others (more where that makes fewer than ``least`` training pages). Without any, the main text is presumed and
    only seen in other layouts. None without pages."""
    rng, vectors = np.random.default_rng(seed), Vectors()
    cut = [(b, y) for b in pages if b and (y := marked(b))]
    own = [(packed(x), k) for b, y in cut for x, k in windows(vectors(b), y)]
    if not cut:
        cut = [(b, presumed(b)) for b in pages if b]
    if not cut:
        return None
    texts = [text for b, _ in cut for _, text, _ in b]
    many = sum(-(-len(b) // WINDOW) for b, _ in cut)
    for b, y in cut:
        for _ in range(max(layouts, -(-least // many))):
            page, labels = laid_out(b, y, texts, rng)
            own += [(packed(x), k) for x, k in windows(vectors(page), labels)]
    return train([x for x, _ in own], [np.array(y, np.float32) for _, y in own], seed, epochs)


def drawn_pages(html: DataFrame, sample: int) -> list[list]:
    """Block sequences of at most ``sample`` distinct pages of the one column ``html``, those that mark their main text first.

    Pages are read whole inside tasks in the order of their hash: first those under a bound that holds about four times the
    sample, then eight times as many, until enough marked ones are found or the whole table is read. Only hashes and flags, and
    then the drawn pages' blocks, are collected.
    """
    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cut = [blocks(p) for p in part.column(1).to_pylist()]
                found = pa.RecordBatch.from_arrays([part.column(0), pa.array([marked(b) is not None for b in cut], pa.bool_())], ["key", "marked"])
                yield found.filter(pa.array([len(b) > 0 for b in cut], pa.bool_()))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("text", pa.string()), ("linked", pa.float64())]))
        for batch in batches:
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cut = [{"path": list(path), "text": text, "linked": linked} for path, text, linked in blocks(page)]
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([cut], kind)], ["key", "blocks"])

    n, share = html.count(), 0.0
    keyed, drawn = html.where("html is not null").select(F.xxhash64("html").alias("key"), "html"), []
    while n and share < 1:
        share = min(1.0, share * 8 or 4 * sample / n)
        under = keyed if share == 1 else keyed.where(F.col("key") < F.lit(int((share - 0.5) * 2.0 ** 64)))
        # at most ``sample`` hashes and flags
        drawn = under.mapInArrow(flags, "key long, marked boolean").distinct().orderBy(F.desc("marked"), "key").limit(sample).collect()
        if sum(r.marked for r in drawn) >= sample:
            break
    keys = [r.key for r in drawn if r.marked] or [r.key for r in drawn]
    if not keys:
        return []
    rows = keyed.where(F.col("key").isin(keys)).groupBy("key").agg(F.min("html").alias("html")) \
        .mapInArrow(sequences, "key long, blocks array<struct<path: array<string>, text: string, linked: double>>").collect()
    return [[(tuple(b.path), b.text, b.linked) for b in r.blocks] for r in sorted(rows, key=lambda r: r.key)]


def main_text(pages: DataFrame, sample: int = 250, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_blocks, n_main) of every row; the text is empty where no block is main text.

    Trained on at most ``sample`` whole pages drawn by a hash of the page among all that mark their main text. In a table
    where none does, it is trained on other layouts of the texts of at most ``sample`` pages. Null and empty pages have an
    empty text; repeated rows are labelled each; null ids and urls stay null; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    model = fit_blocks(drawn_pages(rows.select("html"), sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cut = [blocks(p) for p in part.column(2).to_pylist()]
                scores = label(model, [vectors(b) for b in cut]) if model else [np.zeros(len(b)) for b in cut]
                keep = [[text for (_, text, _), s in zip(b, own) if s >= 0.5] for b, own in zip(cut, scores)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([" ".join(k) for k in keep], pa.string()),
                                                  pa.array([len(b) for b in cut], pa.int64()), pa.array([len(k) for k in keep], pa.int64())],
                                                 ["page_id", "url", "text", "n_blocks", "n_main"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_blocks long, n_main long")
