"""Voters, label model and linear classifier for toxicity (plain arrays, bounded rows)."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
INDUCED_VOTERS = 24
# Word lists of the fixed lexicon voters; no words that mean something else in other languages.
LEXICONS = {
    "insult": "idiot moron imbecile fool stupid dumb loser clown jerk lunatic freak coward brat",
    "contempt": "worthless pathetic useless disgusting disgrace ridiculous vile repulsive revolting",
    "dirt": "scum trash garbage filth vermin parasite maggot",
    "threat": "kill hurt destroy beat suffer",
    "profanity": "damn crap bastard bitch shit fuck ass asshole bullshit",
}
_OF_LEXICON = {w: name for name, words in LEXICONS.items() for w in words.split()}
_BURST = re.compile(r"[!?]{2,}")
_AIMED = re.compile(r"\b(?:you|your|you're|they|these)\b\W+(?:\w+\W+){0,3}?(" + "|".join(_OF_LEXICON) + r")\b")
SEVERAL = ("1 listed", "2 listed", "3 listed")
VOTERS = [*LEXICONS, *(f"induced{i}" for i in range(INDUCED_VOTERS)), "aimed", "burst", "shouting", "no_hit"]
ABSTAIN, CLEAN, TOXIC = 0, 1, 2


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def sketch(text: str) -> int:
    """Smallest hash of five words in a row: near copies mostly share it."""
    found = _WORD.findall(text.lower())
    return min(zlib.crc32(" ".join(found[i : i + 5]).encode()) for i in range(max(1, len(found) - 4)))


def count_features(texts: list[str], toxic: list[int]) -> tuple[Counter, Counter]:
    """Documents with each feature, among toxic and among clean ones."""
    counts = (Counter(), Counter())
    for text, y in zip(texts, toxic, strict=True):
        counts[0 if y else 1].update({f for w in words(text) for f in features_of(w)})
    return counts


class Featurizer:
    """Which features of a vocabulary a text has; remembers words.

    The last features of the vocabulary say that a text has at least one, two, ... words
    with a listed feature (``listed``: numbers of those).
    """

    def __init__(self, vocabulary: dict[str, int], listed: frozenset[int]):
        self.vocabulary, self.listed = vocabulary, listed
        self.several = [vocabulary[f] for f in SEVERAL if f in vocabulary]
        self.seen: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> set[int]:
        seen, vocabulary, hits, count = self.seen, self.vocabulary, set(), 0
        for w in words(text):
            own = seen.get(w)
            if own is None:
                if len(seen) > 200_000:
                    seen.clear()
                own = seen[w] = tuple(vocabulary[f] for f in features_of(w) if f in vocabulary)
            if own:
                hits.update(own)
                count += not self.listed.isdisjoint(own)
        hits.update(self.several[:count])
        return hits


def votes(text: str, hits: set[int], voter_of: np.ndarray) -> list[int]:
    """One vote per voter; ``voter_of`` has the induced voter of each feature, -1: none."""
    low = text.lower()
    lists = {_OF_LEXICON[w] for w in words(text) & _OF_LEXICON.keys()}
    induced = {int(voter_of[h]) for h in hits if voter_of[h] >= 0}
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    out = [TOXIC if name in lists else ABSTAIN for name in LEXICONS]
    out += [TOXIC if i in induced else ABSTAIN for i in range(INDUCED_VOTERS)]
    out.append(TOXIC if lists and _AIMED.search(low) else ABSTAIN)
    out.append(TOXIC if len(_BURST.findall(text)) > 3 else ABSTAIN)
    out.append(TOXIC if letters > 20 and upper > 0.7 * letters else ABSTAIN)
    out.append(ABSTAIN if lists or induced else CLEAN)
    return out


def induced_voter(feature: str) -> int:
    """Features of one stem belong to one voter."""
    return zlib.crc32(feature[: PREFIXES[0]].encode()) % INDUCED_VOTERS


def label_model(votes_: np.ndarray, gold: np.ndarray, weight: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """P(toxic) of each row by expectation maximisation over its votes.

    The latent class has a prior; each voter has a distribution over its votes in either
    class (its accuracy and coverage).  Voters whose votes correlate within a class beyond
    what the class explains form a group, whose members share one voice.  ``gold`` (0, 1,
    or -1 for unknown) votes too, with a fixed accuracy.
    """
    n, m = votes_.shape
    known = gold >= 0
    prior = min(0.5, max(0.01, float(np.average(gold[known] == 1, weights=weight[known])) if known.any() else 0.05))
    start = (votes_ == TOXIC).any(axis=1).astype(float)
    q = np.where(known, 0.1 + 0.8 * (gold == 1), 0.05 + 0.7 * start)
    voice = np.ones(m)
    one_hot = np.stack([votes_ == v for v in (ABSTAIN, CLEAN, TOXIC)], axis=2).astype(float)
    table = np.zeros((2, m, 3))
    for step in range(rounds):
        for y, share in ((0, (1 - q) * weight), (1, q * weight)):
            totals = np.einsum("i,imv->mv", share, one_hot) + 0.5
            table[y] = totals / totals.sum(axis=1, keepdims=True)
        if step == rounds // 2:
            voice = _voices(votes_, q, weight)
        vote_odds = np.einsum("imv,mv->im", one_hot, np.log(table[1]) - np.log(table[0])) @ voice
        gold_odds = np.where(known, np.where(gold == 1, 1, -1) * np.log(0.95 / 0.05), 0.0)
        odds = np.log(prior / (1 - prior)) + vote_odds + gold_odds
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, {"prior": prior, "table": table, "voice": voice}


def _voices(votes_: np.ndarray, q: np.ndarray, weight: np.ndarray, least: float = 0.4) -> np.ndarray:
    """1 / size of each voter's group of voters that correlate within the classes."""
    fired = (votes_ != ABSTAIN).astype(float)
    m = fired.shape[1]
    linked = np.eye(m, dtype=bool)
    for share in ((1 - q) * weight, q * weight):
        if share.sum() < 20:
            continue
        centred = fired - np.average(fired, axis=0, weights=share)
        cov = (centred * share[:, None]).T @ centred / share.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        linked |= (np.abs(cov) / np.outer(sd, sd) > least) & (sd > 0.01)[:, None] & (sd > 0.01)[None, :]
    while True:
        wider = (linked.astype(int) @ linked) > 0
        if (wider == linked).all():
            return 1 / linked.sum(axis=1)
        linked = wider


def logistic(rows: np.ndarray, columns: np.ndarray, count: int, width: int, target: np.ndarray, weight: np.ndarray, l2: float = 0.05, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on 0/1 features with soft targets (Adam)."""
    w, bias = np.zeros(width), -2.0
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    total = weight.sum()
    for step in range(1, rounds + 1):
        z = np.bincount(rows, weights=w[columns], minlength=count) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        grad = np.append(np.bincount(columns, weights=error[rows], minlength=width) + l2 * w, error.sum()) / total
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return w, float(bias)
