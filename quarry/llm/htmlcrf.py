"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Every leaf block is kept or dropped.  Its features are the tags, classes and ids of its
ancestors and figures of its text (words, link share, punctuation, place on the page); the
chain adds weights for neighbouring labels.  The model is trained by maximum likelihood
(forward-backward, AdaGrad) on labelled pages, on the driver, from a bounded set; pages are
decoded by Viterbi, row by row.

Defined results: a null, empty or text-less page has the text '' and 0 characters; broken markup
is read to its end; formulas and fallback texts are text; of labels that score alike 0 is taken; repeated rows each get the same
result; an empty table gives no rows; very long and deeply nested pages take time in proportion to their length; kept
columns travel in a struct, so names can't clash.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import attach
from quarry.llm.htmlblocks import Block, blocks

ENDINGS = (".", "!", "?", "…", "。", "”", "\"", ":", "»")
SIGNS = {"©": "copyright", "|": "bar", "·": "dot", "»": "more", "→": "more", "@": "at"}


def text_features(b: Block, i: int, n: int) -> list[str]:
    text = b.text
    words = text.count(" ") + 1
    out = ["bias", f"b:{b.tag}",
           f"words:{next(k for k in (2, 5, 10, 20, 40, 80, 10 ** 12) if words <= k)}",
           f"links:{next(k for k in (0, 25, 60, 90, 10 ** 12) if 100 * b.linked <= k * len(text))}",
           f"end:{text.endswith(ENDINGS)}", f"commas:{min(3, text.count(','))}",
           f"place:{min(4, 5 * i // n)}"]
    out += [f"sign:{name}" for sign, name in SIGNS.items() if sign in text]
    if b.node:
        out += [f"near:{f}" for f in b.node.near if f[0] == "c"]
        if b.node.header is not None:
            out.append(f"header in article:{b.node.header}")
    if i == 0:
        out.append("first")
    if i == n - 1:
        out.append("last")
    return out


def page_features(found: list[Block]) -> list[list[str]]:
    return [text_features(b, i, len(found)) + b.path for i, b in enumerate(found)]


class Chain:
    """Two labels; scores of label 1 over label 0 per feature, and of neighbouring labels."""

    def __init__(self, weights: dict[str, float], pairs: list[list[float]]):
        self.weights, self.pairs = weights, pairs

    def decode(self, pages: list[list[str]]) -> list[int]:
        """Viterbi over the features of each block."""
        return self.viterbi([sum(self.weights.get(f, 0.0) for f in fs) for fs in pages])

    def label(self, found: list[Block]) -> list[int]:
        """The same for blocks; the features of an element count once for all that stands inside it."""
        get, known = self.weights.get, {None: 0.0}

        def path(node) -> float:
            way = []
            while node not in known:
                way.append(node)
                node = node.parent
            total = known[node]
            for node in reversed(way):
                total = known[node] = total + sum(get(f, 0.0) for f in node.own)
            return total
        return self.viterbi([sum(get(f, 0.0) for f in text_features(b, i, len(found))) + path(b.node) for i, b in enumerate(found)])

    def viterbi(self, scores: list[float]) -> list[int]:
        if not scores:
            return []
        (p00, p01), (p10, p11) = self.pairs
        back, s0, s1 = [], 0.0, 0.0
        for i, e in enumerate(scores):
            if i:
                a, b, c, d = s0 + p00, s1 + p10, s0 + p01, s1 + p11
                back.append((b > a, d > c))
                s0, s1 = max(a, b), max(c, d)
            s1 += e
        label = int(s1 > s0)
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 14, rate: float = 0.3, ridge: float = 1e-3) -> Chain:
    """Maximum likelihood with AdaGrad, one page at a time in a fixed order."""
    index = {f: i for i, f in enumerate(sorted({f for fs, _ in pages for b in fs for f in b}))}
    data = [([np.array([index[f] for f in b]) for b in fs], np.array(y)) for fs, y in pages if y]
    w, pairs = np.zeros(len(index)), np.zeros((2, 2))
    seen_w, seen_p = np.full(len(index), 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(4)
    for _ in range(rounds):
        for k in rng.permutation(len(data)):
            ids, y = data[k]
            node, edge = _marginals(np.array([w[i].sum() for i in ids]), pairs)
            error = y - node
            grad = np.zeros_like(w)
            np.add.at(grad, np.concatenate(ids), np.repeat(error, [len(i) for i in ids]))
            grad -= ridge * w
            seen_w += grad ** 2
            w += rate * grad / np.sqrt(seen_w)
            gold = np.zeros((2, 2))
            np.add.at(gold, (y[:-1], y[1:]), 1)
            grad_p = gold - edge - ridge * pairs
            seen_p += grad_p ** 2
            pairs += rate * grad_p / np.sqrt(seen_p)
    return Chain({f: float(w[i]) for f, i in index.items()}, pairs.tolist())


def _marginals(e: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) per block, and expected counts of neighbouring labels (forward-backward)."""
    n = len(e)
    emit = np.stack([np.zeros(n), e], axis=1)
    fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
    fore[0] = emit[0]
    for t in range(1, n):
        fore[t] = emit[t] + np.logaddexp(fore[t - 1, 0] + pairs[0], fore[t - 1, 1] + pairs[1])
    for t in range(n - 2, -1, -1):
        nxt = emit[t + 1] + aft[t + 1]
        aft[t] = np.logaddexp(pairs[:, 0] + nxt[0], pairs[:, 1] + nxt[1])
    z = np.logaddexp(*fore[-1])
    node = np.exp(fore + aft - z)[:, 1]
    edge = np.exp(fore[:-1, :, None] + pairs[None] + (emit + aft)[1:, None, :] - z).sum(axis=0)
    return node, edge


@cache
def model(n_pages: int = 800) -> Chain:
    """The chain trained on the first ``n_pages`` labelled pages."""
    from quarry.llm.labelled_pages import labelled_pages
    data = []
    for page, marks in labelled_pages(n_pages):
        found = blocks(page)
        data.append((page_features(found), [int(marks[b.text]) for b in found]))
    return fit(data)


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    kept = chain.label(found)
    return "\n".join(b.text for b, k in zip(found, kept) if k)


def extract(pages: DataFrame, keep: list[str], chain: Chain | None = None) -> DataFrame:
    """``row`` (the kept columns), text and n_chars (code points) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or model())

    def start():
        def fn(htmls):
            texts = [main_text(h, shared.value) for h in htmls]
            return {"text": texts, "n_chars": [len(t) for t in texts]}
        return fn
    return attach(pages, keep, ["html"], "text string, n_chars long", start)


def report(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """The contract's digest: page_id, url, text, n_chars."""
    return extract(pages, ["page_id", "url"], chain).select("row.page_id", "row.url", "text", "n_chars")
