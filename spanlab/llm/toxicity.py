"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give scores and offsets.

Tokens are runs without white space, lower-cased and stripped of ASCII punctuation; a chain is a line, whole. Labels are of
documents, so the tags are latent: of a clean document all tags are 0, of a toxic one at least one is 1, and the field is
fitted to the likelihood of just that. With P0 the chance of a document without any tag 1, the slope of the log-likelihood
is the expected features of a clean document, negative, and those of a toxic one times P0 / (1 - P0): gradient steps on
the marginals of forward-backward over all chains, in which each toxic document shares out its tags among its tokens.
Features of a token are its word, its first 4, 5 and 6 characters, and the words before and after it. Words and prefixes
take part if they are tied to toxic documents beyond chance, neighbours if they stand next to such a word in several
documents; which of them mark a toxic token is for the field to find. Transitions couple neighbouring tags.

Chains without a known feature have the same marginals at the same length, which are computed once for each length. A
document's score is a logistic function, fitted on the same rows, of its highest marginal; spans are the tokens whose
marginal is 0.5 or more. The fit takes labelled documents in the order of a hash of their identifier, whole and different
texts, up to `sample_docs` of them and `sample_bytes` of text; one that doesn't fit is passed over, those after it aren't.
Scoring reads all of every text.

Defined cases: a null or empty text gets the score of a text without any toxic token, and no span; without labelled rows
of both kinds every score is the smoothed share of toxic ones among them (0 without any). Repeated rows are scored each;
labels that contradict each other for one identifier all count.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXES = (4, 5, 6)
_TOKEN = re.compile(r"\S+")
_KNOWN_WORDS = 1_000_000
#: Forward-backward runs over so many places at once.
_PLACES = 1 << 18


def bare(token: str) -> str:
    return token.strip(string.punctuation)


def features(token: str) -> list[str]:
    """Of a token itself."""
    word = bare(token)
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)] if word else []


def marginals(emission: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """emission: (chains, width), the score of label 1 against 0. move: (2, 2) transition scores.

    Returns P(label 1) for each place, expected transitions (chains, 2, 2), and log Z. Places beyond a chain's length are 0.
    Forward and backward vectors are scaled to sum to 1, so that only that of label 1 is held.
    """
    n, width = emission.shape
    place, m = np.exp(np.ascontiguousarray(emission.T)), np.exp(move)
    ahead, behind, sums = np.empty((width, n)), np.full((width, n), 0.5), np.empty((width, n))
    sums[0] = 1 + place[0]
    ahead[0] = place[0] / sums[0]
    for t in range(1, width):
        one = ahead[t - 1]
        up = (m[0, 1] + one * (m[1, 1] - m[0, 1])) * place[t]
        sums[t] = up + m[0, 0] + one * (m[1, 0] - m[0, 0])
        ahead[t] = up / sums[t]
    last = np.maximum(length - 1, 0)
    for t in range(width - 2, -1, -1):
        one = behind[t + 1]
        up, down = one * place[t + 1], 1 - one
        to_one = m[1, 0] * down + m[1, 1] * up
        found = to_one / (to_one + m[0, 0] * down + m[0, 1] * up)
        behind[t] = np.where(t < last, found, 0.5)
    inside = np.arange(width)[:, None] < length
    both = ahead * behind
    p = np.where(inside, both / (both + (1 - ahead) * (1 - behind)), 0.0)
    up, down = behind[1:] * place[1:], 1 - behind[1:]
    pairs = [[x * y * m[a, b] for b, y in enumerate((down, up))] for a, x in enumerate((1 - ahead[:-1], ahead[:-1]))]
    whole = np.where(inside[1:], 1 / (pairs[0][0] + pairs[0][1] + pairs[1][0] + pairs[1][1]), 0.0)
    moves = np.array([[(w * whole).sum(axis=0) for w in row] for row in pairs]).transpose(2, 0, 1)
    return p.T, moves, np.where(inside, np.log(sums), 0.0).sum(axis=0)


class Quiet:
    """Marginals of chains without known features: of each length from shared prefixes and suffixes, which are scaled to sum
    to 1."""

    def __init__(self, bias: float, move: np.ndarray):
        self.place, self.move = np.exp([0.0, bias]), np.exp(move)
        self.ahead, self.behind, self.log_sum = np.empty((0, 2)), np.empty((0, 2)), np.empty(0)

    def _reach(self, length: int) -> None:
        many = len(self.log_sum)
        if many >= length:
            return
        ahead, behind, sums = np.empty((length, 2)), np.empty((length, 2)), np.empty(length)
        ahead[:many], behind[:many], sums[:many] = self.ahead, self.behind, self.log_sum
        for t in range(many, length):
            a = (ahead[t - 1] @ self.move if t else np.ones(2)) * self.place
            b = self.move @ (self.place * behind[t - 1]) if t else np.ones(2)
            ahead[t], behind[t], sums[t] = a / a.sum(), b / b.sum(), math.log(a.sum()) + (sums[t - 1] if t else 0.0)
        self.ahead, self.behind, self.log_sum = ahead, behind, sums

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray, float]:
        """As `marginals` has them, of one chain."""
        if length > len(self.log_sum):
            self._reach(max(length, 2 * len(self.log_sum)))
        both = self.ahead[:length] * self.behind[:length][::-1]
        pairs = self.ahead[: length - 1, :, None] * self.move * (self.place * self.behind[: length - 1][::-1])[:, None, :]
        return both[:, 1] / both.sum(axis=1), (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0), float(self.log_sum[length - 1])


def batched(lengths: list[int]) -> Iterator[np.ndarray]:
    """Numbers of chains, those of like length together, so that a batch holds about _PLACES places with its padding."""
    order = np.argsort(np.array(lengths, int), kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * lengths[order[to]] <= _PLACES and lengths[order[to]] <= 2 * lengths[order[at]] + 8:
            to += 1
        yield order[at:to]
        at = to


@dataclass
class Field:
    weight: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def __post_init__(self):
        self._plain: set[str] = set()
        self._loud: dict[str, tuple[float, float, float]] = {}
        self._quiet: dict[int, float] = {}
        self._alone: Quiet | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _weigh(self, tokens: set[str]) -> None:
        """Known weights of a token: its own, and those that it gives the tokens after and before it."""
        for token in tokens:
            word = bare(token)
            own = sum(self.weight.get(f, 0.0) for f in features(token))
            near = self.weight.get(f"<{word}", 0.0), self.weight.get(f">{word}", 0.0)
            if own or any(near):
                self._loud[token] = (own, *near)
            else:
                self._plain.add(token)

    def emission(self, tokens: list[str]) -> np.ndarray | None:
        """Scores of tag 1 along a line; None if no token has a known weight."""
        known = [(t, self._loud[w]) for t, w in enumerate(tokens) if w in self._loud]
        if not known:
            return None
        row = np.full(len(tokens) + 2, self.bias)
        for t, (own, after, before) in known:
            row[t + 1] += own
            row[t + 2] += after
            row[t] += before
        return row[1:-1]

    def quiet(self, length: int) -> float:
        """The highest marginal of a chain without known features."""
        if length not in self._quiet:
            self._alone = self._alone or Quiet(self.bias, self.move)
            self._quiet[length] = float(self._alone.of(length)[0].max())
        return self._quiet[length]

    def score(self, marginal: float) -> float:
        if self.constant is not None:
            return self.constant
        m = min(max(marginal, 1e-9), 1 - 1e-9)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * math.log(m / (1 - m)) + self.shift))))

    def tagged(self, texts: list[str]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """Of each text the highest marginal and the spans (start, end, marginal)."""
        chains, owner, tokens_of = [], [], []
        best = [0.0] * len(texts)
        spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        for k, text in enumerate(texts):
            if len(self._plain) > _KNOWN_WORDS:  # between texts only: a text's own words are looked up to its end
                self._plain.clear()
                self._loud.clear()
            words = text.lower().split()
            fresh = set(words).difference(self._plain)
            if fresh:
                new = fresh.difference(self._loud)
                if new:
                    self._weigh(new)
                fresh = fresh.intersection(self._loud)
            lines = text.split("\n")
            if not fresh:
                if words:
                    best[k] = max(self.quiet(n) for n in {len(line.split()) for line in lines} if n)
                continue
            base = 0
            for line in lines:
                found = list(_TOKEN.finditer(line))
                row = self.emission([m.group().lower() for m in found])
                if row is not None:
                    chains.append(row)
                    owner.append(k)
                    tokens_of.append([(base + m.start(), base + m.end()) for m in found])
                elif found:
                    best[k] = max(best[k], self.quiet(len(found)))
                base += len(line) + 1
        for p, i in self._marginals(chains):
            k = owner[i]
            best[k] = max(best[k], float(p.max()))
            spans[k] += [(*tokens_of[i][t], float(p[t])) for t in np.flatnonzero(p >= 0.5)]
        return [*zip(best, map(sorted, spans))]

    def _marginals(self, chains: list[np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
        lengths = [*map(len, chains)]
        for own in batched(lengths):
            rows = np.zeros((len(own), lengths[own[-1]]))
            for row, i in zip(rows, own):
                row[: lengths[i]] = chains[i]
            p, _, _ = marginals(rows, np.array([lengths[i] for i in own]), self.move)
            for row, i in zip(p, own):
                yield row[: lengths[i]], int(i)


def association(toxic_with: int, clean_with: int, toxic: int, clean: int) -> float:
    """Log-likelihood ratio of a feature's and a label's independence."""

    def part(k: float, n: float) -> float:
        return k * math.log(k / n) if k else 0.0

    k, n = toxic_with + clean_with, toxic + clean
    split = part(toxic_with, toxic) + part(toxic - toxic_with, toxic) + part(clean_with, clean) + part(clean - clean_with, clean)
    return 2 * (split - part(k, n) - part(n - k, n))


def known_features(rows: list[tuple[str, int]], least_docs: int = 3) -> dict[str, float]:
    """Features with a first weight: words and prefixes tied to toxic documents beyond chance, with the logarithm of how much
    more frequent they are there, shared among the features of a token; and words that mostly stand next to those, with 0.

    A tie is beyond chance where none as close is expected once in a hundred times among so many features.
    """
    toxic = sum(y for _, y in rows)
    rate = [len(rows) - toxic, toxic]
    seen: tuple[Counter, Counter] = Counter(), Counter()
    for text, y in rows:
        if y:
            seen[1].update({f for t in set(text.lower().split()) for f in features(t)})
    least = 2 * math.log(100 * max(1, len(seen[1])))
    tried = {f for f, n in seen[1].items() if n >= least_docs}
    marks: dict[str, list[str]] = {}  # of tokens that have any
    plain: set[str] = set()
    for text, y in rows:
        tokens = set(text.lower().split())
        for t in [t for t in tokens if t not in plain and t not in marks]:
            if own := [f for f in features(t) if f in tried]:
                marks[t] = own
            else:
                plain.add(t)
        if not y:
            seen[0].update({f for t in tokens if t in marks for f in marks[t]})
    odds = lambda f: math.log((seen[1][f] + 0.5) / (rate[1] + 1)) - math.log((seen[0][f] + 0.5) / (rate[0] + 1))
    used = {f: odds(f) / (1 + len(PREFIXES)) for f in tried if odds(f) > 0 and association(seen[1][f], seen[0][f], rate[1], rate[0]) >= least}
    loud = {t for t, own in marks.items() if any(f in used for f in own)}
    near: Counter = Counter()
    for text, _ in rows:
        own = set()
        if loud.isdisjoint(text.lower().split()):
            continue
        for line in text.lower().split("\n"):
            tokens = line.split()
            for t in (t for t, token in enumerate(tokens) if token in loud):
                own |= {f"<{bare(tokens[t - 1])}"} if t else set()
                own |= {f">{bare(tokens[t + 1])}"} if t + 1 < len(tokens) else set()
        near.update(own)
    # A word counts as a neighbour if a fifth of the documents that have it have it there; others tell nothing of the place.
    names = {f[1:] for f, n in near.items() if n >= least_docs}
    held: Counter = Counter()
    for text, _ in rows:
        held.update(names.intersection(map(bare, text.lower().split())))
    return used | {f: 0.0 for f, n in near.items() if n >= least_docs and 5 * n >= held[f[1:]]}


def fit_field(rows: list[tuple[str, int]], rounds: int = 25) -> Field:
    """rows: text and document label (1: toxic). Tags are latent; see the module."""
    rows = sorted(set(rows))  # copies would make chance look like a tie
    toxic = sum(y for _, y in rows)
    if not rows or toxic in (0, len(rows)):
        return Field(constant=(toxic + 1) / (len(rows) + 2) if rows else 0.0)
    weights = known_features(rows)
    number = {f: i for i, f in enumerate(sorted(weights))}
    # Of a token that has any: its own features, and those that it is for the tokens after and before it.
    loud: dict[str, tuple[list[int], list[int], list[int]]] = {}
    plain: set[str] = set()
    chains: list[list[tuple[int, int]]] = []  # of each the places and numbers of features
    lengths: list[int] = []
    of_chain: list[int] = []
    quiet: Counter = Counter()  # (document, length) of chains without features
    for d, (text, _) in enumerate(rows):
        for line in text.lower().split("\n"):
            tokens = line.split()
            for t in {t for t in tokens if t not in plain and t not in loud}:
                own = tuple([number[f] for f in fs if f in number] for fs in (features(t), [f"<{bare(t)}"], [f">{bare(t)}"]))
                if any(own):
                    loud[t] = own
                else:
                    plain.add(t)
            known = []
            for t, token in enumerate(tokens):
                if token in loud:
                    own, after, before = loud[token]
                    known += [(t, f) for f in own] + [(t + 1, f) for f in after if t + 1 < len(tokens)] + [(t - 1, f) for f in before if t]
            if known:
                chains.append(known)
                lengths.append(len(tokens))
                of_chain.append(d)
            elif tokens:
                quiet[d, len(tokens)] += 1
    batches = []
    for own in batched(lengths):
        width = lengths[own[-1]]
        at = [(k * width + t, f) for k, i in enumerate(own) for t, f in chains[i]]
        where, what = np.array(at, int).reshape(-1, 2).T
        batches.append((np.array([lengths[i] for i in own]), width, where, what, np.array([of_chain[i] for i in own])))
    sizes = sorted({n for _, n in quiet})
    place = {n: i for i, n in enumerate(sizes)}
    quiet_doc, quiet_size, quiet_many = (np.array(x) for x in zip(*[(d, place[n], m) for (d, n), m in quiet.items()])) if quiet else (np.empty(0, int),) * 3
    label = np.array([y for _, y in rows])
    theta = np.array([weights[f] for f in sorted(weights)])
    prior, bias, move = theta.copy(), -6.0, np.zeros((2, 2))
    step = [np.zeros(len(theta)), 0.0, np.zeros((2, 2))]
    for _ in range(rounds):
        done = []
        none = np.zeros(len(rows))  # log P0
        for length, width, where, what, doc in batches:
            emission = np.bincount(where, theta[what], len(length) * width).reshape(-1, width) + bias
            p, moves, z = marginals(emission, length, move)
            np.add.at(none, doc, -z)
            done.append((p, moves))
        same = Quiet(bias, move)
        alone = [same.of(n) for n in reversed(sizes)][::-1]
        if sizes:
            np.add.at(none, quiet_doc, -np.array([z for *_, z in alone])[quiet_size] * quiet_many)
        share = np.where(label == 1, 1 / np.expm1(np.clip(-none, 1e-9, 700)), -1.0)
        slopes = [-0.5 * (theta - prior), -0.001 * bias, -0.5 * move]
        for (p, moves), (length, width, where, what, doc) in zip(done, batches):
            own = p * share[doc][:, None]
            slopes[0] += np.bincount(what, own.ravel()[where], len(theta))
            slopes[1] += own.sum()
            slopes[2] += np.einsum("nab,n->ab", moves, share[doc])
        if sizes:
            weight = np.bincount(quiet_size, share[quiet_doc] * quiet_many, len(sizes))
            slopes[1] += sum(w * p.sum() for w, (p, _, _) in zip(weight, alone))
            slopes[2] += sum(w * moves for w, (_, moves, _) in zip(weight, alone))
        slopes[2][0, 0] = 0.0  # scores are against all tags 0
        slopes = [s / len(rows) for s in slopes]
        step = [s + g**2 for s, g in zip(step, slopes)]
        theta, bias, move = (x + 0.4 * g / (np.sqrt(s) + 1e-12) for x, g, s in zip((theta, bias, move), slopes, step))
    out = Field({f: float(theta[i]) for f, i in number.items() if abs(theta[i]) > 1e-3}, float(bias), move)
    top = np.array([m for m, _ in out.tagged([t for t, _ in rows])])
    x = np.log(np.clip(top, 1e-9, 1 - 1e-9) / (1 - np.clip(top, 1e-9, 1 - 1e-9)))
    y = np.array([y for _, y in rows], float)
    slope, shift = 1.0, 0.0
    for _ in range(25):  # Newton steps, with a prior that keeps separable data finite
        q = 1 / (1 + np.exp(-np.clip(slope * x + shift, -60, 60)))
        w = q * (1 - q) + 1e-9
        gradient = np.array([((y - q) * x).sum() - 1.0 * (slope - 1), (y - q).sum() - 0.01 * shift])
        curve = np.array([[(w * x * x).sum() + 1.0, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        change = np.clip(np.linalg.solve(curve, gradient), -1, 1)
        slope, shift = slope + change[0], shift + change[1]
    out.slope, out.shift = float(max(slope, 1e-3)), float(shift)
    return out


def training_rows(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_id: str, label_col: str, sample_docs: int,
    sample_bytes: int, seed: int,
) -> list[tuple[str, int]]:
    """In the order of a hash, so many different labelled texts as sample_docs and sample_bytes allow; those come to the driver.

    A text that is longer than sample_bytes by itself is left out, and so is one that no longer fits; those after it are
    tried. Texts are told apart by their digest, so rows that repeat a text or an identifier count once and both bounds hold.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.where(F.coalesce(learn, F.lit(False))).select(docs[id_col].alias("id"), text.alias("text"))
    marks = labels.where(labels[label_col].isNotNull() & labels[label_id].isNotNull())
    marks = marks.select(labels[label_id].alias("id"), (labels[label_col] > 0).cast("int").alias("y")).distinct()
    known = rows.select("id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    known = known.join(marks, "id").where(F.col("size") <= sample_bytes).withColumn("turn", F.xxhash64("id", F.lit(seed)))
    each = known.groupBy("digest", "y").agg(F.min("turn").alias("turn"), F.min("id").alias("id"), F.min("size").alias("size"))
    taken, held = [], 0
    for r in each.orderBy("turn", "digest", "y").limit(sample_docs).collect():  # digests and sizes only
        if held + r["size"] <= sample_bytes:
            taken.append((r["digest"], r["id"], r["y"]))
            held += r["size"]
    if not taken:
        return []
    spark = docs.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    chosen = spark.createDataFrame(taken, f"digest string, id {kind}, y int")  # sample_docs of them at most
    found = rows.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi").withColumn("digest", F.sha2("text", 256))
    found = found.join(F.broadcast(chosen.drop("id")), "digest").groupBy("digest", "y").agg(F.first("text").alias("text"))
    return [(r["text"], r["y"]) for r in found.collect()]


def _scored(shared):
    names = ["id", "held_out", "marginal", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = model.tagged([t or "" for t in part.column(2).to_pylist()])
                spans = pa.array([[{"start": a, "end": b, "marginal": m} for a, b, m in s] for _, s in found], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m for m, _ in found], pa.float64()), pa.array([model.score(m) for m, _ in found], pa.float64()), spans], names)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample_docs: int = 5000, sample_bytes: int = 32 << 20, seed: int = 9) -> DataFrame:
    """One row for each document: identifier, held_out, score, predicted, and spans (offsets in code points, marginals)."""
    remainder = F.pmod(F.crc32(F.encode(docs[id_col].cast("string"), "UTF-8")), F.lit(5))
    model = fit_field(training_rows(docs, labels, remainder != 0, id_col, text_col, label_id, label_col, sample_docs, sample_bytes, seed))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by sample_docs and sample_bytes
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(_scored(shared), f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, marginal double, score double, spans array<struct<start:int,end:int,marginal:double>>")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
