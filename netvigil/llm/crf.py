"""A linear-chain conditional random field over word features, in numpy.

Fitted by full-batch gradient steps on a small table, decoded by Viterbi over batches of padded sequences.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

NEVER = -1e4
# Padded sequences decoded at once, counted in places.
PLACES = 1 << 16


class Chain(NamedTuple):
    tags: list[str]
    own: dict[str, np.ndarray]       # feature -> weight by tag
    before: dict[str, np.ndarray]    # feature of the word before
    after: dict[str, np.ndarray]     # feature of the word after
    step: np.ndarray                 # from tag, to tag
    first: np.ndarray                # tag at the start


def allowed(tags: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Penalties of steps and starts: an inner tag only follows the begin or inner tag of its kind."""
    step = np.array([[NEVER if b[0] == "I" and a[1:] != b[1:] else 0.0 for b in tags] for a in tags])
    return step, np.array([NEVER if b[0] == "I" else 0.0 for b in tags])


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit(rows: list[tuple[list[list[str]], list[str]]], tags: list[str], steps: int = 120, ridge: float = 0.02, rate: float = 0.1) -> Chain:
    """``rows``: per sentence the features of each word, and its tags."""
    names = {(part, f): 0 for words, _ in rows for w in words for f in w for part in (0, -1, 1)}
    names.update({(-1, "edge"): 0, (1, "edge"): 0})
    index = {n: i for i, n in enumerate(names)}
    size, k, longest = len(rows), len(tags), max(len(t) for _, t in rows)
    place = {t: i for i, t in enumerate(tags)}
    where, which, gold = [], [], np.zeros((size, longest), int)
    mask = np.zeros((size, longest), bool)
    for s, (words, said) in enumerate(rows):
        for t in range(len(words)):
            mask[s, t], gold[s, t] = True, place[said[t]]
            sets = ((0, words[t]), (-1, words[t - 1] if t else ["edge"]), (1, words[t + 1] if t + 1 < len(words) else ["edge"]))
            for part, features in sets:
                for f in features:
                    where.append(s * longest + t)
                    which.append(index[part, f])
    where, which = np.array(where), np.array(which)
    ban_step, ban_first = allowed(tags)
    weights = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)]
    moment = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    hot = np.zeros((size, longest, k))
    hot[np.nonzero(mask) + (gold[mask],)] = 1
    steps_seen = np.zeros((k, k))
    pair = mask[:, 1:]
    np.add.at(steps_seen, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
    for turn in range(1, steps + 1):
        unary = np.zeros((size * longest, k))
        np.add.at(unary, where, weights[0][which])
        unary = unary.reshape(size, longest, k)
        step, first = weights[1] + ban_step, weights[2] + ban_first
        forward, backward = np.zeros_like(unary), np.zeros_like(unary)
        forward[:, 0] = first + unary[:, 0]
        for t in range(1, longest):
            new = _logsumexp(forward[:, t - 1, :, None] + step, 1) + unary[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _logsumexp(step + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        total = _logsumexp(forward[:, -1], 1)
        share = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        diff = (share - hot).reshape(-1, k)
        expected = np.zeros((k, k))
        for t in range(1, longest):
            joint = np.exp(forward[:, t - 1, :, None] + step + (unary[:, t] + backward[:, t])[:, None, :] - total[:, None, None])
            expected += (joint * mask[:, t, None, None]).sum(axis=0)
        gradient = [np.zeros_like(weights[0]), expected - steps_seen, (share - hot)[:, 0].sum(axis=0)]
        np.add.at(gradient[0], which, diff[where])
        for w, g, (m, v) in zip(weights, gradient, moment, strict=True):
            g = g + ridge * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-8)
    parts: dict[int, dict[str, np.ndarray]] = {0: {}, -1: {}, 1: {}}
    for (part, f), i in index.items():
        parts[part][f] = weights[0][i]
    return Chain(tags, parts[0], parts[-1], parts[1], weights[1] + ban_step, weights[2] + ban_first)


def score_word(chain: Chain, features: list[str]) -> np.ndarray:
    """What a word adds by tag to its own place, to the next one and to the one before: three rows."""
    none = np.zeros(len(chain.tags))
    return np.array([sum((table.get(f, none) for f in features), none) for table in (chain.own, chain.before, chain.after)])


def viterbi(chain: Chain, lines: list[np.ndarray]) -> list[np.ndarray]:
    """Best tags of each line. A line is an array (words, 3, tags) of ``score_word`` rows."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(lines)
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and len(lines[order[stop]]) * (stop + 1 - at) <= PLACES:
            stop += 1
        group, at = order[at:stop], stop
        _viterbi_padded(chain, lines, [i for i in group if len(lines[i])], out)
    return out


def _viterbi_padded(chain: Chain, lines: list[np.ndarray], group: list[int], out: list[np.ndarray]) -> None:
    if not group:
        return
    k, sizes = len(chain.tags), np.array([len(lines[i]) for i in group])
    longest = int(sizes.max())
    unary = np.zeros((len(group), longest, k))
    for g, i in enumerate(group):
        line = lines[i]
        unary[g, :len(line)] = line[:, 0]
        unary[g, 1:len(line)] += line[:-1, 1]
        unary[g, :len(line) - 1] += line[1:, 2]
        unary[g, 0] += chain.before["edge"]
        unary[g, len(line) - 1] += chain.after["edge"]
    back = np.zeros((len(group), longest, k), np.int8)
    score = chain.first + unary[:, 0]
    for t in range(1, longest):
        ways = score[:, :, None] + chain.step
        back[:, t] = ways.argmax(axis=1)
        live = (t < sizes)[:, None]
        score = np.where(live, ways.max(axis=1) + unary[:, t], score)
    tag = score.argmax(axis=1)
    found = np.zeros((len(group), longest), int)
    rows = np.arange(len(group))
    for t in range(longest - 1, -1, -1):
        inside = t < sizes
        found[:, t] = np.where(inside, tag, 0)
        if t:
            tag = np.where(inside, back[rows, t, tag], tag)
    for g, i in enumerate(group):
        out[i] = found[g, :sizes[g]]
