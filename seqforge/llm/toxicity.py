"""Toxicity scores by weak supervision.

Lexicon entries are known insults and, from a bounded sample of labelled rows, words and word
starts that are over-represented in toxic texts. A word that is an entry by itself counts for
no word start. Of texts that are copies of each other, by minimum hashes of their word triples, one
counts, so that the words of a much copied text are no lexicon. Entries that meet in the same toxic
texts form a theme, so that each voter looks at another kind of language. Voters are: a theme's
entry occurs, two different entries of it occur, two or three different entries of any theme occur,
entries are one or one and a half words in a hundred, any entry follows a word of address, any entry
occurs in a text of capitals or with runs of exclamation marks; for clean, no entry occurs at all,
or fewer than one word in a hundred is one; and the row's own label, as one more voter, of which
the model believes at best that it errs in two rows of a hundred.

A generative label model treats the true label as hidden: given it, voters fire with unknown
rates, and a voter's log-odds are divided by how much it repeats others: one plus its
correlations with the voters that it is correlated with inside both classes. Labels give the first
estimate of the rates; from there rates, correlations and class share are estimated in turn by
expectation maximisation. A logistic regression on the texts' theme and pattern features is fitted to the
posterior labels and scores every whole text; labels take no part in that.

The fit reads at most ``sample`` rows of each label, each weighted by the rows of its label that
it stands for, so that the class mix is that of all labelled rows at every size; scoring reads everything and shuffles nothing.

Defined results: null and empty texts get the score of a text without any feature; repeated
rows get equal scores; a doc_id that is labelled or written more than once is learned from once,
and as toxic if any of its labels says so; labels of one class tell nothing apart, so without toxic
ones every score is 0, and without clean ones 1. Extra columns pass unread.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
#: Rows of each label that the fit reads at most.
SAMPLE = 5000
#: A word enters a lexicon if its share of toxic texts is this many times theirs overall, beyond chance
#: over all words looked at (the Chernoff bound of the binomial tail, times the words, stays below MAX_CHANCE).
MIN_RATIO, MAX_CHANCE = 3.0, 0.01
#: Lengths of word starts; themes at most; least share of common toxic texts that joins two entries in a theme.
STEMS, THEMES, OVERLAP = range(4, 9), 8, 0.1
THRESHOLD = 0.3
#: Minimum hashes of word triples, and how many have been seen before in a copy; density of entries that speaks for toxic or, below the first, for clean; least error of the label.
HASHES, SEEN, DENSITIES, LABEL_ERROR = 8, 3, (0.01, 0.015), 0.02
#: Columns after the two of each theme: address, density, capitals, exclamations.
PATTERNS = 4
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A general lexicon of insults, which the learnt words join; words of address.
INSULTS = (
    "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk imbecile filth vermin garbage"
    " dummkopf trottel abschaum arschloch wertlos widerlich connard imbécile ordure débile crétin estúpido idiota imbécil basura asqueroso"
).split()
ADDRESS = frozenset("you your u du dich dir ihr tu te toi vous usted tú ti".split())


@dataclass
class Model:
    """Lexicons as word or word start -> (theme, entry number), and the classifier's weights over the features."""

    words: dict[str, tuple[int, int]] = field(default_factory=dict)
    stems: dict[str, tuple[int, int]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * THEMES + PATTERNS))
    intercept: float = -20.0


def features(text: str | None, words: dict[str, tuple[int, int]], stems: dict[str, tuple[int, int]]) -> np.ndarray:
    """log(1 + hits) of each theme, log(1 + different entries) of each theme, then the patterns."""
    found = np.zeros(2 * THEMES + PATTERNS)
    if not text:
        return found
    tokens = WORD.findall(text.lower())
    starts = sorted({len(s) for s in stems}, reverse=True)
    seen: set[tuple[int, int]] = set()
    previous, spoken_to = "", 0
    for w in tokens:
        hit = words.get(w)
        if hit is None:
            for k in starts:
                if len(w) > k and (hit := stems.get(w[:k])) is not None:
                    break
        if hit is not None:
            found[hit[0]] += 1
            seen.add(hit)
            spoken_to += previous in ADDRESS
        previous = w
    for theme, _ in seen:
        found[THEMES + theme] += 1
    hits = found[:THEMES].sum()
    raw = text.encode("utf-8", "surrogatepass")
    found[2 * THEMES :] = spoken_to, 0, 2 * len(raw.translate(None, CAPITALS)) < len(raw), "!!" in text
    found[: 2 * THEMES + 1] = np.log1p(found[: 2 * THEMES + 1])
    found[2 * THEMES + 1] = math.sqrt(hits / max(1, len(tokens)))
    return found


def _entries(texts: list[str], toxic: np.ndarray, weight: np.ndarray, bag_of: Callable[[str], set[str]]) -> dict[str, float]:
    """Over-represented members of the texts' bags and how telling each is."""
    base = min(0.999, toxic.mean())
    inside, outside = Counter(), Counter()
    for i in np.flatnonzero(toxic):
        inside.update(bag_of(texts[i]))
    limit = math.log(MAX_CHANCE / max(1, len(inside)))
    # rarer ones would be chance even if no clean text had them, so clean texts are counted for the others only
    inside = {w: c for w, c in inside.items() if c * math.log(base) <= limit}
    for i in np.flatnonzero(~toxic):
        outside.update(bag_of(texts[i]).intersection(inside))
    # chance is that of the sample; the ratio is that of all labelled rows
    true_base = min(0.999, float(np.average(toxic, weights=weight)))
    of_toxic, of_clean = weight[toxic].mean(), weight[~toxic].mean() if not toxic.all() else 1.0
    found = {}
    for w, c in inside.items():
        n = c + outside[w]
        share = c / n
        divergence = share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0.0)
        true_share = c * of_toxic / (c * of_toxic + outside[w] * of_clean)
        if share > base and true_share >= min(MIN_RATIO * true_base, (1 + true_base) / 2) and -n * divergence <= limit:
            found[w] = n * divergence
    return found


def firsts(texts: list[str]) -> np.ndarray:
    """Which texts are no copies of an earlier one."""
    turns = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
    seen: set[tuple[int, int]] = set()
    first = np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        w = WORD.findall(text.lower())
        codes = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))], dtype=np.uint64)
        keys = list(enumerate((codes[:, None] * turns).min(0).tolist()))
        first[i] = sum(k in seen for k in keys) < SEEN
        seen.update(keys)
    return first


def lexicons(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> tuple[dict[str, tuple[int, int]], dict[str, tuple[int, int]]]:
    """Words and word starts with their themes. Of nested word starts the most telling one stays."""
    words = lambda t: set(WORD.findall(t.lower()))
    learned = set(_entries(texts, toxic, weight, words)).union(INSULTS)
    telling = _entries(texts, toxic, weight, lambda t: {w[:k] for w in words(t) if w not in learned for k in STEMS if len(w) > k})
    stems: list[str] = []
    for s in sorted(telling, key=lambda s: (-telling[s], s)):
        if not any(s.startswith(old) or old.startswith(s) for old in stems):
            stems.append(s)
    # which toxic texts hold which entry
    lengths = {len(s) for s in stems}
    known = set(stems)
    where: dict[tuple[str, bool], set[int]] = {}
    for i in np.flatnonzero(toxic).tolist():
        for w in words(texts[i]):
            if w in learned:
                where.setdefault((w, True), set()).add(i)
            else:
                for k in lengths:
                    if len(w) > k and w[:k] in known:
                        where.setdefault((w[:k], False), set()).add(i)
    theme: dict[tuple[str, bool], int] = {}
    covered: list[set[int]] = []
    for e in sorted(where, key=lambda e: (-len(where[e]), e)):
        shares = [len(where[e] & c) / min(len(where[e]), len(c)) for c in covered]
        best = int(np.argmax(shares)) if shares else -1
        if best < 0 or (shares[best] < OVERLAP + 0.5 * len(covered[best]) / max(1, toxic.sum()) and len(covered) < THEMES):
            best = len(covered)
            covered.append(set())
        covered[best] |= where[e]
        theme[e] = best
    entry = {e: (theme.get(e, 0), i) for i, e in enumerate([*((w, True) for w in sorted(learned)), *((s, False) for s in stems)])}
    return {w: entry[w, True] for w in learned}, {s: entry[s, False] for s in stems}


def repeats(votes: np.ndarray, belief: np.ndarray, limit: float = 0.3, rows: np.ndarray | float = 1.0) -> np.ndarray:
    """How often each voter is told: 1 plus its correlations with the voters that it is correlated with (above ``limit``) inside both believed classes."""
    least = np.full((votes.shape[1], votes.shape[1]), np.inf)
    for weight in (belief * rows, (1 - belief) * rows):
        centred = votes - (weight[:, None] * votes).sum(0) / max(weight.sum(), 1e-9)
        scale = np.sqrt((weight[:, None] * centred**2).sum(0)) + 1e-9
        least = np.minimum(least, (centred * weight[:, None]).T @ centred / scale[:, None] / scale[None, :])
    np.fill_diagonal(least, 0.0)
    return 1.0 + np.where(least > limit, np.minimum(least, 1.0), 0.0).sum(axis=1)


def label_model(
    votes: np.ndarray, belief: np.ndarray, rounds: int = 50, weight: np.ndarray | None = None, against: np.ndarray | None = None, error: np.ndarray | float = 0.0
) -> np.ndarray:
    """Posterior of the hidden label, by expectation maximisation from ``belief``; ``against`` marks the voters that vote for clean, ``error`` is the least error of each."""
    votes = votes.astype(float)
    weight = np.ones(len(votes)) if weight is None else weight
    against = np.zeros(votes.shape[1], dtype=bool) if against is None else against
    for _ in range(rounds):
        share = 1.0 / repeats(votes, belief, rows=weight)
        one, zero = (((w[:, None] * votes).sum(0) + 0.5) / (w.sum() + 1.0) for w in (belief * weight, (1 - belief) * weight))
        # no voter speaks against its own side
        one = np.where(against, np.minimum(one, zero), np.maximum(one, zero))
        one, zero = np.clip(one, error, 1 - np.asarray(error)), np.clip(zero, error, 1 - np.asarray(error))
        prior = ((belief * weight).sum() + 0.5) / (weight.sum() + 1.0)
        odds = math.log(prior / (1 - prior)) + votes @ (share * np.log(one / zero)) + (1 - votes) @ (share * np.log((1 - one) / (1 - zero)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - belief).max() < 1e-6:
            break
        belief = new
    return belief


def votes_of(x: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes of all voters over features ``x`` and labels, which of them vote for clean, and the least error of each."""
    any_ = (x[:, :THEMES] > 0).any(1)
    one, two, address = x[:, :THEMES] > 0, x[:, THEMES : 2 * THEMES] > math.log(2.5), x[:, 2 * THEMES] > 0
    loud = (x[:, -2:] > 0.5) & any_[:, None]
    different, density = np.expm1(x[:, THEMES : 2 * THEMES]).sum(1), x[:, 2 * THEMES + 1] ** 2
    many = [different > n - 0.5 for n in (2, 3)] + [density >= d for d in DENSITIES]
    votes = np.column_stack([one, two, address, loud, *many, toxic, ~any_, density < DENSITIES[0]])
    used, n = votes.any(0) & ~votes.all(0), votes.shape[1]
    return votes[:, used], (np.arange(n) >= n - 2)[used], np.where(np.arange(n) == n - 3, LABEL_ERROR, 0.0)[used]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Newton's method on soft labels."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (weight * (p - y)) + penalty * w
        hessian = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """On a sample that the caller has bounded; ``weight``: labelled rows that each row stands for."""
    toxic = toxic.astype(bool)
    if not toxic.any() or toxic.all():
        return Model(intercept=20.0 if toxic.any() else -20.0)
    weight = np.ones(len(texts)) if weight is None else weight * (len(texts) / weight.sum())
    own = firsts(texts)
    words, stems = lexicons([t for t, k in zip(texts, own, strict=True) if k], toxic[own], weight[own])
    x = np.array([features(t, words, stems) for t in texts])
    votes, against, error = votes_of(x, toxic)
    weights, intercept = logistic(x, label_model(votes, np.where(toxic, 0.9, 0.02), weight=weight, against=against, error=error), weight=weight)
    return Model(words, stems, weights, intercept)


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """At most ``sample`` texts of each label, by hash order, among the rows that ``learn`` marks; their labels and weights."""
    marked = labels.where("toxic IS NOT NULL").where(learn).groupBy("doc_id").agg(F.bool_or(F.col("toxic") == 1).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marked.where("toxic").orderBy(*order).limit(sample).unionByName(marked.where("NOT toxic").orderBy(*order).limit(sample))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").toPandas()
    toxic = rows["toxic"].to_numpy(dtype=bool)
    stands_for = {x["toxic"]: x["count"] / min(x["count"], sample) for x in marked.groupBy("toxic").count().collect()}
    return rows["text"].tolist(), toxic, np.array([stands_for[bool(t)] for t in toxic], dtype=float)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([features(t, model.words, model.stems) for t in batch["text"]]).reshape(len(batch), -1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-np.clip(x @ model.weights + model.intercept, -30, 30)))})

    scored = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").transform(common.in_batches, task, "doc_id string, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
