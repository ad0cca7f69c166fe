"""Operator 12: main text of web pages, by a linear-chain conditional random field over their leaf blocks.

A page is the chain of its leaf blocks (``html_blocks``); each is tagged as main text or not.  Features are the tags
and names of all ancestors, those of the nearest part of the page, the block's own element, and what its text tells:
size, share in links, signs.  The field is trained by gradient ascent on the likelihood of labelled pages; the best
sequence of tags is found by Viterbi.  Labelled pages are HTML with the main text's elements marked; those of
``labelled_pages`` are taken unless others are given.

The trained weights are a table of the features that the labelled pages have, so the model doesn't grow with the pages
that are read.  Reading is a column without a shuffle.

Defined cases: null and empty pages, and pages without text, have the empty text; torn markup is read as browsers
read it, to the page's end; repeated rows and null ids stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import fsum

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.common import prepare, unused
from sightings.llm.html_blocks import Block, leaf_blocks
from sightings.llm.labelled_pages import labelled_pages

STEPS, STEP, PENALTY = 150, 0.3, 2e-5


@dataclass
class BlockField:
    """Weights of the features for main text, and scores of tags (0 other, 1 main) that follow each other."""

    weights: dict[str, float] = field(default_factory=dict)
    follow: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def emission(self, block: Block) -> float:
        """The score of main text over other."""
        return fsum(self.weights.get(x, 0.0) for x in block.features)

    def best(self, emissions: Sequence[float]) -> list[int]:
        """The best sequence of tags, by Viterbi."""
        (f00, f01), (f10, f11) = self.follow
        back: list[tuple[int, int]] = []
        other = main = 0.0
        for i, e in enumerate(emissions):
            if i == 0:
                main = e
                continue
            to_other, to_main = (other + f00, main + f10), (other + f01, main + f11)
            back.append((int(to_other[1] > to_other[0]), int(to_main[1] > to_main[0])))
            other, main = max(to_other), max(to_main) + e
        if not emissions:
            return []
        tags = [int(main > other)]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]

    def main_text(self, html: str | None) -> str:
        """The texts of the page's blocks of main text, in order, joined by spaces."""
        blocks = list(leaf_blocks(html or ""))
        tags = self.best([self.emission(b) for b in blocks])
        return " ".join(b.text for b, tag in zip(blocks, tags, strict=True) if tag)


def marginals(emission: np.ndarray, inside: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The chance of main text at every block, the expected number of each pair of tags, and the sum of log partitions.

    Chains are rows, ``inside`` marks their blocks.  Scores are logarithms, forward and backward.
    """
    many, span = emission.shape
    local = np.stack([np.zeros_like(emission), emission], -1)
    forward, backward = np.zeros((span, many, 2)), np.zeros((span, many, 2))
    forward[0] = local[:, 0]
    for t in range(1, span):
        step = np.logaddexp.reduce(forward[t - 1][:, :, None] + follow[None], axis=1) + local[:, t]
        forward[t] = np.where(inside[:, t, None], step, forward[t - 1])
    for t in range(span - 2, -1, -1):
        step = np.logaddexp.reduce(follow[None] + (local[:, t + 1] + backward[t + 1])[:, None, :], axis=2)
        backward[t] = np.where(inside[:, t + 1, None], step, 0.0)
    total = np.logaddexp.reduce(forward[-1], axis=1)
    chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total).T * inside
    pairs = np.zeros((2, 2))
    for t in range(1, span):
        joint = forward[t - 1][:, :, None] + follow[None] + (local[:, t] + backward[t])[:, None, :] - total[:, None, None]
        pairs += np.exp(joint)[inside[:, t]].sum(0)
    return chance, pairs, float(total.sum())


def train(pages: Sequence[str], steps: int = STEPS) -> BlockField:
    """A field from pages whose main text is marked; a block without a mark is no main text."""
    chains = [blocks for page in pages if (blocks := list(leaf_blocks(page)))]
    names = sorted({x for blocks in chains for b in blocks for x in b.features})
    if not names:
        return BlockField()
    index = {name: i for i, name in enumerate(names)}
    span = max(map(len, chains))
    inside = np.array([[t < len(blocks) for t in range(span)] for blocks in chains])
    tag = np.zeros(inside.shape)
    at, ids = [], []
    for k, blocks in enumerate(chains):
        for t, block in enumerate(blocks):
            tag[k, t] = block.label or 0
            own = sorted(index[x] for x in block.features)
            ids += own
            at += [k * span + t] * len(own)
    at, ids = np.array(at), np.array(ids)
    whole = tag.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (whole[:, :-1][inside[:, 1:]], whole[:, 1:][inside[:, 1:]]), 1)
    w, follow = np.zeros(len(names)), np.zeros((2, 2))
    sums, follow_sums = np.full(len(names), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        emission = np.bincount(at, w[ids], inside.size).reshape(inside.shape)
        chance, pairs, _ = marginals(emission, inside, follow)
        miss = ((tag - chance) * inside).ravel()
        gradient = np.bincount(ids, miss[at], len(names)) - PENALTY * inside.sum() * w
        sums += gradient**2
        w += STEP * gradient / np.sqrt(sums)
        change = seen - pairs
        follow_sums += change**2
        follow = follow + STEP * change / np.sqrt(follow_sums)
    return BlockField({name: float(w[i]) for name, i in index.items()}, follow.tolist())


def main_text(html: Column, model: Broadcast[BlockField]) -> Column:
    """The main text of a column of pages."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([model.value.main_text(page) for page in pages], dtype=object)

    return F.pandas_udf(of, "string")(html)


def extract(pages: DataFrame, labelled: Sequence[str] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = train(labelled_pages() if labelled is None else labelled)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a number for each feature of the labelled pages
    (found,) = unused(["page_id", "url"], "text")
    out = pages.select("page_id", "url", main_text(F.col("html"), shared).alias(found))
    return out.select("page_id", "url", F.col(found).alias("text"), F.length(found).cast("bigint").alias("n_chars"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"))
