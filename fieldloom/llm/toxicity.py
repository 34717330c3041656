"""Toxicity by weak supervision.

1. Voters. Lexicons of their own (insults in four languages), which need no labels; lexicons of words and word beginnings that are
   mined from labelled rows by log odds and dealt over many voters, in two strengths (any hit; several hits); and pattern voters (hits close
   together, hits over all lexicons, shares of the text, none at all). A voter says toxic, clean, or nothing.
2. Label model. A generative model is fitted to the votes alone by expectation maximisation: given the class, a voter's vote depends on that of
   one other voter, and the pairs form the tree that explains most (by mutual information given the class). Its parameters are how each voter votes on toxic and on clean texts,
   given the vote it hangs on: accuracies and correlations are estimated together, and a voter that repeats another adds nothing.
3. Classifier. A logistic model over distinct words and their beginnings is trained on the posterior labels;
   a logistic curve, fitted on labelled rows kept apart, gives the score.

Fitting uses a bounded sample (``limit`` labelled rows); scoring reads every whole text. Empty texts have no
words and get the score of the bias. With one class only, every text gets that class's smoothed rate.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .labelled import kept_apart, sample, scored
from .linear import PackedRows, Rows, logistic, platt, sigmoid

BITS = 20
LIMIT = 5_000
THRESHOLD = 0.3
LEXICONS, TERMS = 16, 480
#: Rows by which the shares of a vote, given another, are drawn towards its shares alone.
PULL = 5.0
#: Words that are insults by themselves (fixed values, common usage).
OWN_LEXICONS = {
    "en": "arsehole asshole bastard bitch bozo bum clown cockroach coward creep cretin crook degenerate dimwit dirtbag disgusting dumb dumbass dunce failure fool foolish freak fraud garbage halfwit hypocrite idiot idiotic ignorant imbecile jackass jerk liar loser lowlife lunatic maggot moron moronic nitwit parasite pathetic pig psycho rat retard ridiculous rubbish savage scum scumbag shit shithead simpleton sleazy slob stupid stupidity subhuman thug traitor trash twat ugly vermin vile wanker weasel worthless wretch",
    "de": "abschaum arschloch bastard blöd depp dreckig dumm dummkopf ekelhaft erbärmlich feigling hurensohn idiot lügner miststück müll narr schlampe schwachkopf schwein spinner trottel versager wertlos widerlich wichser",
    "fr": "abruti bâtard bouffon connard connasse crétin débile dégoûtant enculé idiot imbécile lâche menteur merde minable nul ordure pathétique pourriture raté salaud salope stupide vermine",
    "es": "asqueroso basura bastardo bobo cabrón cobarde cretino escoria estúpido gilipollas idiota imbécil inútil mentiroso mierda miserable necio patético payaso perdedor puta repugnante tonto",
}
_WORD = re.compile(r"\w+")
STARTS = (4, 5, 6, 7)


def word_features(word: str) -> list[int]:
    """Hashed word and beginnings."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(b"=" + word.encode()) & mask, *(zlib.crc32(word[:k].encode()) & mask for k in STARTS if len(word) > k)]


def distinct_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _kernel():
    def apply(ids, texts):
        idx, val = [], []
        for t in texts:
            found = [f for w in distinct_words(t) for f in word_features(w)]
            i, n = np.unique(np.array(found, np.int32), return_counts=True)
            idx.append(i)
            val.append(n.astype(np.float32))
        return {"doc_id": ids, "idx": idx, "val": val}

    return apply


def mine(x: Rows, y: np.ndarray, dims: int, terms: int = TERMS, least: int = 3) -> np.ndarray:
    """Columns that occur on toxic rows far more often than on others, best first."""
    p, q = x.counts(y, dims), x.counts(1 - y, dims)
    odds = np.log((p + 0.5) / (y.sum() + 1)) - np.log((q + 0.5) / ((1 - y).sum() + 1))
    worth = np.where((p >= least) & (odds > 1.5), odds * np.sqrt(p), 0)
    best = np.argsort(-worth, kind="stable")[:terms]
    return best[worth[best] > 0]


def own_columns(name: str) -> np.ndarray:
    """Columns of the whole words of a lexicon of our own."""
    return np.array([word_features(w)[0] for w in OWN_LEXICONS[name].split()])


def votes(x: Rows, terms: np.ndarray, dims: int, lexicons: int = LEXICONS) -> np.ndarray:
    """(rows, voters) of 1 toxic, -1 clean, 0 nothing."""
    out = []
    member = np.zeros(dims)
    insults = np.zeros(x.n)
    for name in OWN_LEXICONS:
        member[:] = 0
        member[own_columns(name)] = 1
        hits = x.dot(member)
        insults += hits
        out.append(np.where(hits > 0, 1, 0))
        out.append(np.where(hits > 2, 1, 0))
    out.append(np.where(insults > 1, 1, np.where(insults == 0, -1, 0)))
    total = np.zeros(x.n)
    for k in range(lexicons):
        member[:] = 0
        member[terms[k::lexicons]] = 1
        hits = x.dot(member)
        total += hits
        out.append(np.where(hits > 0, 1, 0))
        out.append(np.where(hits > 2, 1, 0))
    member[:] = 0
    member[terms[: max(1, len(terms) // 8)]] = 1
    strong, size = x.dot(member), x.sums(x.val)
    out.append(np.where(strong > 0, 1, -1))
    out.append(np.where(total == 0, -1, 0))
    out.append(np.where(total > 4, 1, np.where(total < 2, -1, 0)))
    out.append(np.where(total > 0.02 * size, 1, np.where(total < 0.002 * size, -1, 0)))
    return np.stack(out, axis=1)


def pair_tables(v: np.ndarray, post: np.ndarray) -> np.ndarray:
    """(2, voters, 3, voters, 3): soft counts of every pair of votes on clean and on toxic rows."""
    n, m = v.shape
    kinds = np.stack([v == s for s in (-1, 0, 1)], axis=2).reshape(n, 3 * m).astype(float)
    return np.stack([(kinds * w[:, None]).T @ kinds for w in (1 - post, post)]).reshape(2, m, 3, m, 3)


def dependence_tree(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The voter that each hangs on (-1: the first, on none) and their mutual information given the class: the tree that has most of it, grown from voter 0."""
    m = tables.shape[1]
    total = tables.sum(axis=(1, 2, 3, 4), keepdims=True) / m**2
    joint = (tables + 0.1) / (total + 0.9)
    alone = joint.sum(axis=4)[:, :, :, 0]
    chance = alone[:, :, :, None, None] * alone[:, None, None, :, :]
    share = total / total.sum()
    gain = (share * joint * np.log(joint / chance)).sum(axis=(0, 2, 4))
    parent, best = np.full(m, -1), np.zeros(m)
    inside, near, of = np.zeros(m, bool), np.full(m, -np.inf), np.zeros(m, int)
    at = 0
    for _ in range(m - 1):
        inside[at] = True
        better = ~inside & (gain[at] > near)
        near[better], of[better] = gain[at][better], at
        at = int(np.where(inside, -np.inf, near).argmax())
        parent[at], best[at] = of[at], near[at]
    return parent, best


def log_ratios(tables: np.ndarray, parent: np.ndarray, pull: float = PULL) -> np.ndarray:
    """(voters, 3, 3): log of how much likelier a vote is on toxic than on clean rows, given the vote that it hangs on (any, for the first).

    Conditional shares are drawn towards the voter's own by ``pull`` rows, so that pairs seldom seen say no more than the voter alone."""
    m = tables.shape[1]
    own = np.stack([np.diagonal(tables[:, k, :, k, :], axis1=1, axis2=2) for k in range(m)], axis=1) + 0.5  # (2, m, 3)
    own = own / own.sum(axis=2, keepdims=True)
    out = np.zeros((m, 3, 3))
    for k in range(m):
        if parent[k] < 0:
            out[k] = np.log(own[1, k] / own[0, k])[None, :]
            continue
        given = tables[:, parent[k], :, k, :] + pull * own[:, k][:, None, :]
        given = given / given.sum(axis=2, keepdims=True)
        out[k] = np.log(given[1] / given[0])
    return out


def evidence(v: np.ndarray, parent: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Sum of the log ratios of a row's votes."""
    at = v + 1
    return sum(ratios[k, at[:, max(parent[k], 0)], at[:, k]] for k in range(v.shape[1]))


def first_call(v: np.ndarray, alike: float = 0.5) -> np.ndarray:
    """How many voters call a row toxic; voters that vote alike share one voice."""
    dev = v - v.mean(axis=0)
    size = np.sqrt((dev * dev).sum(axis=0)) + 1e-9
    corr = np.abs(dev.T @ dev / np.outer(size, size))
    np.fill_diagonal(corr, 1.0)
    return (v > 0) @ (1 / np.where(corr > alike, corr, 0).sum(axis=1))


def label_model(v: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic by rows, accuracies of voters, the voter each hangs on, and how much it depends on it, from the votes alone."""
    m, said = v.shape[1], first_call(v)
    # to begin with, the rows that most voters call toxic, as many as the prior says
    post = np.where(said > max(float(np.quantile(said, 1 - prior)), 0.01), 0.9, 0.02) if len(v) else np.zeros(0)
    parent, strength = np.full(m, -1), np.zeros(m)
    for r in range(rounds):
        old, tables = post, pair_tables(v, post)
        if r % 5 == 0:
            parent, strength = dependence_tree(tables)
        post = sigmoid(evidence(v, parent, log_ratios(tables, parent)) + np.log(prior / (1 - prior)))
        if np.abs(post - old).max() < 1e-4:
            break
    says = (v != 0).sum(axis=0) + 1e-9
    accuracy = ((v > 0) * post[:, None] + (v < 0) * (1 - post)[:, None]).sum(axis=0) / says
    return post, accuracy, parent, strength


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    accuracy: np.ndarray
    parent: np.ndarray
    dependence: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> Model:
    x, y, ids = sample(docs, labels, label_col, limit, _kernel, id_col, text_col)
    dims, apart = 1 << BITS, kept_apart(ids)  # rows for the curve
    none = np.zeros(0)
    if not apart.any() or apart.all() or len(set(y[~apart])) < 2 or isinstance(x, PackedRows):
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(dims), 0.0, 0.0, float(np.log(rate / (1 - rate))), none, none, none)
    take = lambda keep: Rows([x[i] for i in np.flatnonzero(keep)])
    own, rest, t = take(~apart), take(apart), y[~apart]
    terms = mine(own, t, dims)
    post, accuracy, parent, dependence = label_model(votes(own, terms, dims), float(np.clip(t.mean(), 0.01, 0.99)))
    # columns that the lexicons are about, or seen often enough to say something
    p, q = own.counts(post, dims), own.counts(1 - post, dims)
    lift = np.log((p + 0.5) / (post.sum() + 1)) - np.log((q + 0.5) / ((1 - post).sum() + 1))
    keep = (p + q >= 4) & (lift > 0.7)
    keep[terms] = True
    keep[np.concatenate([own_columns(name) for name in OWN_LEXICONS])] = True
    chosen = Rows([(i[keep[i]], v[keep[i]]) for i, v in (own[k] for k in range(own.n))])  # the counts that scoring sums
    w, bias = logistic(chosen, post, dims, l2=0.3)
    w = np.where(keep, w, 0.0)
    model = Model(w, bias, 1.0, 0.0, accuracy, parent, dependence)
    model.slope, model.offset = platt(rest.dot(w) + bias, y[apart])
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every text."""
    used = np.flatnonzero(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast((dict(zip(used.tolist(), model.weights[used].tolist())), model.bias, model.slope, model.offset))

    def kernel():
        weights, bias, slope, offset = sent.value
        worth: dict[str, float] = {}

        def apply(ids, texts):
            if len(worth) > 400_000:
                worth.clear()
            margins = []
            for t in texts:
                total = bias
                for w in distinct_words(t):
                    v = worth.get(w)
                    if v is None:
                        v = worth[w] = sum(weights.get(f, 0.0) for f in word_features(w))
                    total += v
                margins.append(total)
            return {"doc_id": ids, "score": sigmoid(slope * np.array(margins) + offset)}

        return apply

    return scored(docs, kernel, threshold, id_col, text_col)
