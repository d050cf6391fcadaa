"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page becomes its sequence of leaf blocks. Features of a block are the tags, classes,
ids and roles around it and simple properties of its text (length, share of links,
punctuation, telling words). The field has a weight for each feature and for each pair of
neighbouring labels; it is trained on labelled pages by maximum likelihood (forward and
backward sums) and decoded by the Viterbi algorithm. Content of scripts, styles and form
controls is never shown and never text.

Defined results: a null page is empty; a page without article blocks has an empty text;
rows that repeat a page_id keep a row each; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import pieces, texts_of
from tidepanel.llm.labelled_pages import labelled
from tidepanel.llm.webpage import Block, blocks

ROUNDS = 250
RATE = 0.3
L2 = 0.02
# Words that often stand in text around articles.
TELLING = frozenset(
    "cookie cookies privacy subscribe newsletter comment comments reply share tweet related advertisement sponsored copyright login "
    "register menu search terms".split()
)
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=50_000)
def _around(tag: str, around: frozenset[str], near: frozenset[str]) -> tuple[str, ...]:
    """Features of what encloses a block; few differ within a site."""
    return (
        f"own:{tag}",
        *sorted(f"in:{m}" for m in around),
        *sorted(f"near:{m}" for m in near),
        *sorted(f"{tag}+{m}" for m in around if m[0] == "<"),
    )


def features(block: Block) -> list[str]:
    text = block.text
    n = text.count(" ") + 1
    found = [
        f"words:{min(6, int(math.log2(n)))}",
        f"links:{block.linked * 4 // max(1, len(text))}",
        f"end:{text[-1] if text[-1] in '.!?:,;' else '-'}",
        f"bar:{' | ' in text}",
    ]
    if "©" in text:
        found.append("copyright")
    if n <= 40 and TELLING & {w.lower() for w in _WORD.findall(text)}:
        found.append("telling")
    return found


@dataclass
class ChainField:
    """Weights of label 1 against 0 for features, and of neighbouring labels."""

    weights: dict[str, float]
    first: np.ndarray  # by label
    pair: np.ndarray  # by label and next label

    def lean(self, block: Block) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in _around(block.tag, block.around, block.near)]) + sum([get(f, 0.0) for f in features(block)])

    def decode(self, sequence: list[Block]) -> list[int]:
        """The likeliest labels of a page."""
        if not sequence:
            return []
        (a, b), ((aa, ab), (ba, bb)) = self.first.tolist(), self.pair.tolist()
        leans = [self.lean(x) for x in sequence]
        zero, one, back = a, b + leans[0], []
        for lean in leans[1:]:
            back.append((zero + aa < one + ba, zero + ab < one + bb))
            zero, one = max(zero + aa, one + ba), max(zero + ab, one + bb) + lean
        label = int(one > zero)
        labels = [label]
        for came in reversed(back):
            label = int(came[label])
            labels.append(label)
        return labels[::-1]

    def extract(self, page: str) -> str:
        shown = [b for b in blocks(page) if not b.hidden]
        return "\n".join(b.text for b, label in zip(shown, self.decode(shown), strict=True) if label)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS) -> ChainField:
    """Maximum likelihood with an L2 penalty by gradient steps scaled per weight. All pages
    go through the forward and backward sums together, padded to the longest."""
    pages = [([b for b in bs if not b.hidden], [y for b, y in zip(bs, ys, strict=True) if not b.hidden]) for bs, ys in pages]
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    row, col = [], []
    longest = max(len(bs) for bs, _ in pages)
    mask = np.zeros((len(pages), longest), bool)
    y = np.zeros((len(pages), longest), int)
    for p, (bs, ys) in enumerate(pages):
        mask[p, : len(bs)], y[p, : len(bs)] = True, ys
        for t, b in enumerate(bs):
            for f in [*_around(b.tag, b.around, b.near), *features(b)]:
                row.append(p * longest + t)
                col.append(names.setdefault(f, len(names)))
    row, col = np.array(row), np.array(col)
    w, first, pair = np.zeros(len(names)), np.zeros(2), np.zeros((2, 2))
    sums = [np.full_like(x, 1e-6) for x in (w, first, pair)]
    next_on = mask[:, 1:]
    seen_pair = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & next_on).sum() for j in (0, 1)] for i in (0, 1)], float)
    seen_first = np.array([(y[:, 0] == k).sum() for k in (0, 1)], float)
    total = mask.sum()
    log_sum = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for _ in range(rounds):
        lean = np.bincount(row, w[col], minlength=mask.size).reshape(mask.shape)
        emit = np.stack([np.zeros_like(lean), lean], axis=2)
        forward = np.empty((longest, len(pages), 2))
        backward = np.zeros((longest, len(pages), 2))
        forward[0] = first + emit[:, 0]
        for t in range(1, longest):
            step = log_sum(forward[t - 1][:, :, None] + pair, 1) + emit[:, t]
            forward[t] = np.where(mask[:, t, None], step, forward[t - 1])
        for t in range(longest - 2, -1, -1):
            step = log_sum(pair + (emit[:, t + 1] + backward[t + 1])[:, None, :], 2)
            backward[t] = np.where(mask[:, t + 1, None], step, 0.0)
        z = log_sum(forward[-1], 1)
        both = forward + backward
        one = np.exp(both[:, :, 1] - z).T * mask
        expected_first = np.exp(both[0] - z[:, None]).sum(axis=0)
        joint = forward[:-1][:, :, :, None] + pair + (emit.transpose(1, 0, 2)[1:] + backward[1:])[:, :, None, :] - z[None, :, None, None]
        expected_pair = (np.exp(joint) * next_on.T[:, :, None, None]).sum(axis=(0, 1))
        error = ((y * mask) - one).ravel()
        grads = (np.bincount(col, error[row], minlength=len(names)) - L2 * w, seen_first - expected_first, seen_pair - expected_pair - L2 * pair)
        for x, g, s in zip((w, first, pair), grads, sums, strict=True):
            g = g / total
            s += g * g
            x += RATE * g / np.sqrt(s)
    return ChainField({f: float(w[k]) for f, k in names.items() if abs(w[k]) > 1e-4}, first, pair)


def extract(pages: DataFrame, model: ChainField | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    model = model or train(labelled())
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [shared.value.extract(t) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
