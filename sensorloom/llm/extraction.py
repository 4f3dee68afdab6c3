"""Main text of web pages: a linear-chain conditional random field over the leaf blocks.

Every block has features of the tags and names around it and of its text; a block's label, main text or not, depends on
them and on the label before it. Weights are trained by the gradient of the pages' likelihood (forward-backward)
on labelled pages, which a generator writes in many layouts with known main text. Viterbi decoding labels a page.

Pages are independent, so the work is one pass over the table in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.html_blocks import PAGE, Block, Level, leaf_blocks

TRAIN_PAGES = 500
STEPS = 150
PENALTY = 0.002
SENTENCE_ENDS = tuple(".!?:;…。\"»”")


def features(block: Block) -> list[str]:
    """Names of the features that a block has."""
    return [name for level in block.level.outwards() for name in _of_level(level)] + _own_features(block)


def _of_level(level: Level) -> list[str]:
    """What an element adds to the features of the elements around it."""
    tags = [f"tag:{level.tag}"] if level.new_tag else []
    return tags + [f"name:{name}" for name in level.new_names]


def _own_features(block: Block) -> list[str]:
    text, words = block.text, block.text.count(" ") + 1
    found = [f"near:{name}" for name in block.nearest]
    found.append(f"leaf:{block.level.tag}")
    found.append(f"words:{min(words.bit_length(), 7)}")
    found.append(f"linked:{min(3, int(block.linked * 4))}")
    found.append(f"ended:{text.endswith(SENTENCE_ENDS)}")
    if "©" in text or "|" in text or "»" in text:
        found.append("sign")
    return found


@dataclass(frozen=True)
class BlockLabels:
    """Weights of features by label (other, main), of the first label, and of each label after each."""

    places: dict[str, int]
    weights: np.ndarray
    first: np.ndarray
    moves: np.ndarray

    def scores(self, blocks: Sequence[Block]) -> np.ndarray:
        """Sum of the weights of each block's features. What elements add is summed once for each, outermost first."""
        found = np.zeros((len(blocks), 2))
        levels: dict[Level, np.ndarray] = {PAGE: np.zeros(2)}
        for row, block in enumerate(blocks):
            missing = list(takewhile(lambda level: level not in levels, block.level.outwards()))
            for level in reversed(missing):
                levels[level] = levels[level.parent] + self._sum(_of_level(level))
            found[row] = levels[block.level] + self._sum(_own_features(block))
        return found

    def _sum(self, names: list[str]) -> np.ndarray:
        known = [place for name in names if (place := self.places.get(name)) is not None]
        return self.weights[known].sum(axis=0)

    def decode(self, blocks: Sequence[Block]) -> list[bool]:
        """The most likely labels (Viterbi)."""
        if not blocks:
            return []
        scores = self.scores(blocks)
        (stay0, to1), (to0, stay1) = self.moves.tolist()
        a, b = (self.first + scores[0]).tolist()
        back = []
        for other, main in scores[1:].tolist():
            back.append((a + stay0 < b + to0, a + to1 < b + stay1))
            a, b = max(a + stay0, b + to0) + other, max(a + to1, b + stay1) + main
        label = b > a
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        return "\n\n".join(block.text for block, main in zip(blocks, self.decode(blocks), strict=True) if main)


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    most = values.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(values - most).sum(axis=axis, keepdims=True))).squeeze(axis)


class Likelihood:
    """The penalised negative log-likelihood of labelled pages, a mean over them, and its slope.

    Parameters are one array: the weights of every feature by label, then of the first label, then of each label after each.
    """

    def __init__(self, pages: Sequence[tuple[Sequence[Block], Sequence[bool]]]) -> None:
        names = sorted({name for blocks, _ in pages for block in blocks for name in features(block)})
        self.places = {name: i for i, name in enumerate(names)}
        self.longest, self.count = max(len(blocks) for blocks, _ in pages), len(pages)
        # Blocks of all pages on a grid of page and place; the rest of a row is padding.
        rows, columns = [], []
        truth, self.real = np.zeros((self.count, self.longest), int), np.zeros((self.count, self.longest), bool)
        for p, (blocks, labels) in enumerate(pages):
            self.real[p, : len(blocks)] = True
            truth[p, : len(blocks)] = labels
            for t, block in enumerate(blocks):
                for name in features(block):
                    rows.append(p * self.longest + t)
                    columns.append(self.places[name])
        self.rows, self.columns = np.array(rows), np.array(columns)
        both = self.real[:, 1:]
        self.seen_moves = np.zeros((2, 2))
        np.add.at(self.seen_moves, (truth[:, :-1][both], truth[:, 1:][both]), 1)
        self.one_hot = np.eye(2)[truth] * self.real[..., None]
        self.size = 2 * len(names) + 6

    def parts(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return theta[:-6].reshape(-1, 2), theta[-6:-4], theta[-4:].reshape(2, 2)

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and slope by the forward-backward sums."""
        weights, first, moves = self.parts(theta)
        count, longest, real = self.count, self.longest, self.real
        unary = np.stack([np.bincount(self.rows, weights[self.columns, k], count * longest) for k in (0, 1)], axis=1)
        unary = unary.reshape(count, longest, 2)
        ahead = np.zeros((count, longest, 2))
        ahead[:, 0] = first + unary[:, 0]
        for t in range(1, longest):
            new = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + unary[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        whole = _log_sum(ahead[:, -1], 1)
        behind = np.zeros((count, longest, 2))
        expected = np.zeros((2, 2))
        for t in range(longest - 1, 0, -1):
            after = unary[:, t] + behind[:, t]
            on = real[:, t]
            pair = np.exp(ahead[:, t - 1, :, None] + moves + after[:, None, :] - whole[:, None, None])
            expected += pair[on].sum(axis=0)
            behind[:, t - 1] = np.where(on[:, None], _log_sum(moves + after[:, None, :], 2), 0.0)
        likely = np.exp(ahead + behind - whole[:, None, None]) * real[..., None]
        error = (likely - self.one_hot).reshape(-1, 2)
        slope = np.concatenate(
            [
                np.stack([np.bincount(self.columns, error[self.rows, k], len(weights)) for k in (0, 1)], axis=1).ravel(),
                error.reshape(count, longest, 2)[:, 0].sum(axis=0),
                (expected - self.seen_moves).ravel(),
            ]
        )
        reached = (unary * self.one_hot).sum() + (first * self.one_hot[:, 0]).sum() + (moves * self.seen_moves).sum()
        shrink = PENALTY / count**0.5
        return (whole.sum() - reached) / count + shrink / 2 * (theta**2).sum(), slope / count + shrink * theta


def train(pages: Sequence[tuple[Sequence[Block], Sequence[bool]]]) -> BlockLabels:
    """Fit on pages of blocks with their labels by full gradient steps (Adam)."""
    likelihood = Likelihood([page for page in pages if len(page[0])])
    theta = np.zeros(likelihood.size)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, slope = likelihood(theta)
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        theta = theta - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return BlockLabels(likelihood.places, *likelihood.parts(theta))


# Layouts of the labelled pages: elements and the names that sites give to parts which are not main text.
OTHER_PARTS = {
    "nav": ("nav ul menu div", "nav navbar menu navigation breadcrumb breadcrumbs pagination toc topnav"),
    "header": ("header div", "header masthead banner logo top topbar site"),
    "footer": ("footer div section", "footer copyright legal bottom colophon imprint"),
    "sidebar": ("aside div section", "sidebar aside widget related recommended popular trending more rail"),
    "notice": ("div section dialog p", "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe paywall warning"),
    "advert": ("div aside section p", "ad ads advert advertisement sponsor sponsored promo promotion banner adsbygoogle"),
    "form": ("form div", "form search login signup register contact"),
    "comments": ("section div ol ul", "comment comments reply replies discussion disqus respond feedback reader"),
    "share": ("div ul", "share social sharing follow tags meta byline"),
}
MAIN_TAGS = "article main div section"
MAIN_NAMES = "content article post entry story body text main"
_LEAF = {"nav": "li", "share": "li", "comments": "p", "form": "label"}


class _Writer:
    """Writes labelled pages."""

    def __init__(self, seed: int) -> None:
        self.random = np.random.Generator(np.random.PCG64(seed))
        self.blocks: list[tuple[str, bool]] = []

    def pick(self, values: str | Sequence[str]) -> str:
        values = values.split() if isinstance(values, str) else values
        return values[int(self.random.integers(len(values)))]

    def chance(self, share: float) -> bool:
        return bool(self.random.random() < share)

    def words(self, least: int, most: int) -> str:
        syllables = "ba cu do fe gi lo ma ne or pi ra su te un vi xa th en is ou er".split()
        count = int(self.random.integers(least, most + 1))
        return " ".join("".join(self.pick(syllables) for _ in range(int(self.random.integers(1, 4)))) for _ in range(count))

    def sentence(self, least: int = 1, most: int = 60) -> str:
        text = self.words(least, most).capitalize()
        return text + self.pick([".", ".", ".", ".", "!", "?", ""])

    def odd(self) -> str:
        """A paragraph as noisy articles have: signs between or behind its words, or a notice of rights."""
        words = self.words(1, 40).split()
        return self.pick(
            [" | ".join(words) + " |", " ".join(w + self.pick("*** ### %%% $$$") for w in words), f"&copy; {self.sentence(2, 8)}"]
        )

    def element(self, tag: str, inside: str, names: str = "") -> str:
        shown = f' {self.pick(["class", "id", "class"])}="{names}"' if names else ""
        return f"<{tag}{shown}>{inside}</{tag}>"

    def main(self) -> str:
        parts = [self.element("h1", self.words(1, 12))] if self.chance(0.8) else []
        for _ in range(int(self.random.integers(1, 14))):
            kind = self.random.random()
            if kind < 0.75:
                inside = self.sentence() if self.chance(0.85) else self.odd()
                if self.chance(0.15):
                    inside = f'<b>{self.sentence(1, 12)}<br>'
                elif self.chance(0.2):
                    inside += f' <a href="#">{self.words(1, 3)}</a> {self.sentence(1, 10)}'
                parts.append(f"<p>{inside}" + ("</p>" if self.chance(0.8) else ""))
            elif kind < 0.83:
                parts.append(self.element(self.pick("h2 h3"), self.words(1, 6)))
            elif kind < 0.9:
                items = "".join(f"<li>{self.sentence(2, 15)}</li>" for _ in range(3))
                parts.append(self.element(self.pick("ul ol"), items))
            elif kind < 0.95:
                parts.append(self.element("blockquote", f"<p>{self.sentence(5, 30)}</p>"))
            else:
                parts.append(self.element("pre", self.words(2, 12)))
        for _ in range(2 if self.chance(0.4) else 0):
            place = int(self.random.integers(len(parts) + 1))
            parts.insert(place, self.mark(self.other(self.pick(["advert", "notice", "share", "sidebar", "form", "comments"]))))
        return "".join(parts)

    def mark(self, inside: str) -> str:
        """A part that is not main text, between marks that a label is read from."""
        return f"\x01{inside}\x02"

    def other(self, kind: str) -> str:
        tags, names = OTHER_PARTS[kind]
        tag, name = self.pick(tags), self.pick(names)
        # Some elements say by themselves what they are; the others need a name.
        named = tag not in ("nav", "header", "footer", "aside", "form", "dialog") or self.chance(0.5)
        if self.chance(0.3):
            name += self.pick(["-wrap", "_box", " inner", "-list", "Item", "-area"])
        leaf = _LEAF.get(kind, "p")
        if tag in ("ul", "ol", "menu"):
            leaf = "li"
        most = 7 if kind in ("nav", "comments", "share") else 4
        # A paragraph cannot hold other blocks.
        count = 1 if tag == "p" else int(self.random.integers(1, most))
        leaves = []
        for _ in range(count):
            text = self.sentence(1, 30) if kind not in ("nav", "share", "form") else self.words(1, 3)
            if kind in ("nav", "share") or kind == "sidebar" and self.chance(0.5):
                text = f'<a href="/{self.words(1, 1)}">{text}</a>'
            if kind == "footer":
                text = self.pick(["&copy; ", "", "&copy; 2020 "]) + text + self.pick(["", " | " + self.words(1, 3)])
            leaves.append(text if count == 1 and tag in ("p", "div") else f"<{leaf}>{text}</{leaf}>")
        inside = "".join(leaves)
        if kind == "nav" and tag in ("nav", "div"):
            inside = f"<ul>{inside}</ul>"
        return self.element(tag, inside, name if named else "")

    def page(self) -> str:
        parts = [self.mark(self.other(k)) for k in ("header", "nav") if self.chance(0.6)]
        for kind in ("advert", "notice", "form"):
            if self.chance(0.35):
                parts.append(self.mark(self.other(kind)))
        tag = self.pick([*MAIN_TAGS.split(), "article", "article"])
        named = tag in ("div", "section") or self.chance(0.3)
        main = self.element(tag, self.main(), self.pick(MAIN_NAMES) if named else "")
        if self.chance(0.2):
            main = self.element("main", main)
        parts.append(main)
        for kind in ("sidebar", "comments", "share", "advert", "notice", "form", "footer"):
            if self.chance(0.8 if kind == "footer" else 0.3):
                parts.append(self.mark(self.other(kind)))
        return "".join(parts)


def labelled_pages(count: int = TRAIN_PAGES, seed: int = 11) -> list[tuple[list[Block], list[bool]]]:
    """Blocks and labels of generated pages. Marks around the other parts become their blocks' labels."""
    writer = _Writer(seed)
    found = []
    for _ in range(count):
        page = writer.page()
        # An element of its own carries the label through the parser and is then taken out.
        marked = page.replace("\x01", "<x-other>").replace("\x02", "</x-other>")
        blocks = leaf_blocks(f"<html><head><title>{writer.words(2, 6)}</title></head><body>{marked}</body></html>")
        labels = ["x-other" not in block.tags for block in blocks]
        found.append(([Block(b.text, _unmarked(b.level), b.linked) for b in blocks], labels))
    return found


def _unmarked(level: Level) -> Level:
    """The same elements without those that carry labels."""
    result = PAGE
    for outer in reversed(list(level.outwards())):
        if outer.tag != "x-other":
            result = Level(outer.tag, outer.names, result, outer.new_tag, outer.new_names)
    return result


@lru_cache(maxsize=1)
def trained() -> BlockLabels:
    return train(labelled_pages())


def extracted(pages: DataFrame, model: BlockLabels | None = None, html: str = "html") -> DataFrame:
    """Pages with ``text``, the blocks labelled main text in page order with two line ends between, and ``n_chars``.

    NULL, empty and text-less pages have an empty text. Columns of these names are replaced.
    """
    labels = model or trained()

    @F.pandas_udf("string")
    def main_text(values: pd.Series) -> pd.Series:
        return values.map(labels.main_text)

    rows = pages.withColumn("text", main_text(F.col(html)))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def extraction_digest(pages: DataFrame) -> DataFrame:
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
