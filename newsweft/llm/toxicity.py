"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are words of a fixed lexicon, stems that labelled training rows associate with toxicity, and patterns over
their hits.  The label model is a tree-augmented naive Bayes mixture fitted by EM to the votes on unlabelled training
rows: each voter has an accuracy for each class, and the voters that agree beyond what the class explains are tied
along a maximum spanning tree of conditional mutual information.  Its posteriors, no labels, train a logistic
classifier on the same evidence.  Labels choose voters, give the share of toxic rows, and place the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from newsweft.llm.common import is_held_out, materialise, slabs, word_hashes, words_of
from newsweft.llm.quality import labelled_sample

#: Labelled rows that voters and classifier are fitted on at most; mined voters at most, and what a mined stem takes.
FIT_ROWS, MINED, LEAST_DOCS, LEAST_ODDS, CANDIDATES = 20000, 192, 3, 2.5, 20000
STEM_LENGTHS = (4, 5, 6)
#: EM rounds, the share of toxic rows where no label tells it.
ROUNDS, PRIOR = 25, 0.1
#: The least conditional mutual information of a tie, and its least share of what either vote leaves open.
LEAST_TIE, TIE_SHARE = 1e-3, 0.2
FLAG = 0.3
_SLAB = 1 << 20
_ROWS = 2048
#: The seed lexicon.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "clown", "clowns", "loser", "losers", "pathetic", "worthless", "disgusting", "scum", "trash", "garbage",
    "imbecile", "dumb", "dumbass", "fool", "jerk", "bastard", "asshole", "bitch", "shit", "bullshit", "fuck", "fucking", "fucker", "crap", "retard", "vermin",
    "filth", "filthy", "pig", "pigs", "whore", "slut", "freak", "coward", "degenerate", "parasite", "subhuman", "brainless", "useless", "hateful",
)
_TRIM = "!?.,;:%$#&*|\"'()[]{}<>-_+=/\\~`@^«»“”„¿¡"
_LEET = str.maketrans("01345@$7", "oieasast")


@dataclass
class Voters:
    """Whole words and stems, each a voter by its place; the patterns come after them."""

    words: pa.Array
    stems: tuple[tuple[int, pa.Array], ...]

    @property
    def lexical(self) -> int:
        return len(self.words) + sum(len(s) for _, s in self.stems)

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(count of each lexical voter's hits, words) for each text without nulls."""
        out, n = np.zeros((len(texts), self.lexical), np.float32), np.zeros(len(texts), np.int64)
        docs, codes, distinct = words_of(pc.utf8_lower(texts))
        if not len(docs):
            return out, n
        n += np.bincount(docs, minlength=len(texts))
        bare = pc.utf8_trim(distinct, characters=_TRIM)
        found = [np.asarray(pc.fill_null(pc.index_in(bare, value_set=self.words), -1))]
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(bare, r"[a-z][01345@$7]|[01345@$7][a-z]")) & (found[0] < 0))
        if len(odd):
            plain = pa.array([bare[int(i)].as_py().translate(_LEET) for i in odd], bare.type)
            found[0] = found[0].copy()
            found[0][odd] = np.asarray(pc.fill_null(pc.index_in(plain, value_set=self.words), -1))
        base = len(self.words)
        for length, stems in self.stems:
            here = np.asarray(pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(bare, 0, length), value_set=stems), -1))
            found.append(np.where(here >= 0, here + base, -1))
            base += len(stems)
        for which in found:
            voter = which[codes]
            ok = voter >= 0
            np.add.at(out, (docs[ok], voter[ok]), 1)
        return out, n


def votes(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1 for toxic, 0 for no opinion, -1 for clean: a column for each lexical voter and five patterns."""
    total, kinds = hits.sum(1), (hits > 0).sum(1)
    density = total / np.maximum(n, 1)
    patterns = [
        np.where(total == 0, -1, 0),
        np.where(total >= 2, 1, np.where(total == 0, -1, 0)),
        np.where(kinds >= 3, 1, 0),
        np.where(density >= 0.01, 1, np.where(density < 0.0005, -1, 0)),
        np.where((n < 5) & (total == 0), -1, 0),
    ]
    return np.concatenate([(hits > 0).astype(np.int8), np.stack(patterns, 1).astype(np.int8)], axis=1)


def features(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the classifier reads: each voter's hits, and their sum, kinds and density, all damped."""
    total, kinds = hits.sum(1), (hits > 0).sum(1)
    return np.concatenate([np.minimum(hits, 3) / 3, np.stack([np.minimum(total, 6) / 6, np.minimum(kinds, 4) / 4, np.minimum(100 * total / np.maximum(n, 1), 1), total > 0], axis=1)], axis=1)


@dataclass
class LabelModel:
    """P(y), and P(vote | y) or, for a voter tied to another, P(vote | y, the other's vote)."""

    prior: float
    parent: np.ndarray
    tables: np.ndarray

    def posterior(self, ballots: np.ndarray) -> np.ndarray:
        logit = np.full(len(ballots), np.log(self.prior / (1 - self.prior)))
        v = ballots.astype(np.int8) + np.int8(1)
        for j, p in enumerate(self.parent):
            other = v[:, p] if p >= 0 else np.zeros(len(v), np.int8)
            logit += np.log(self.tables[j, 1, other, v[:, j]]) - np.log(self.tables[j, 0, other, v[:, j]])
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def accuracies(self, ballots: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """Each voter's expected share of right votes among those it casts."""
        right = np.where(ballots > 0, posterior[:, None], 1 - posterior[:, None]) * (ballots != 0)
        return right.sum(0) / np.maximum((ballots != 0).sum(0), 1)


def _tables(v: np.ndarray, q: np.ndarray, parent: np.ndarray) -> np.ndarray:
    out = np.zeros((v.shape[1], 2, 3, 3))
    for j, p in enumerate(parent):
        cell = (v[:, p] if p >= 0 else np.zeros(len(v), np.int8)) * np.int8(3) + v[:, j]
        for y, w in ((0, 1 - q), (1, q)):
            alone = np.bincount(v[:, j], w, 3) + 1e-2
            alone /= alone.sum()
            counts = np.bincount(cell, w, 9).reshape(3, 3) + 2 * alone
            out[j, y] = counts / counts.sum(1, keepdims=True)
    return out


def _ties(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each voter's parent, or -1: a maximum spanning forest of conditional mutual information given the class."""
    m = v.shape[1]
    # Votes that some row casts; most voters never cast one of the three.
    cast = np.flatnonzero(np.stack([(v == k).any(0) for k in range(3)], 1).ravel())
    sums = np.zeros((2, len(cast), len(cast)))
    for a in range(0, len(v), _ROWS):
        one = (v[a : a + _ROWS, cast // 3] == cast % 3).astype(np.float64)
        for y, w in enumerate((1 - q, q)):
            sums[y] += (one * w[a : a + _ROWS, None]).T @ one
    info = np.zeros((m, m))
    for w, part in zip((1 - q, q), sums):
        mass = max(w.sum(), 1e-9)
        joint = np.zeros((m * 3, m * 3))
        joint[np.ix_(cast, cast)] = part / mass
        alone = joint.diagonal().reshape(m, 3)
        joint = joint.reshape(m, 3, m, 3).transpose(0, 2, 1, 3)
        expected = alone[:, None, :, None] * alone[None, :, None, :]
        info += mass / len(v) * np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(expected, 1e-12)), 0).sum((2, 3))
    open_ = info.diagonal()
    bar = np.maximum(LEAST_TIE, TIE_SHARE * np.minimum(open_[:, None], open_[None, :]))
    parent, inside = np.full(m, -1), np.zeros(m, bool)
    best, via = np.full(m, -1.0), np.full(m, -1)
    for _ in range(m):
        j = int(np.argmax(np.where(inside, -np.inf, best)))
        inside[j] = True
        parent[j] = via[j] if via[j] >= 0 and best[j] >= bar[j, via[j]] else -1
        better = ~inside & (info[j] > best)
        best[better], via[better] = info[j][better], j
    return parent


def fit_label_model(ballots: np.ndarray, prior: float = PRIOR) -> tuple[LabelModel, np.ndarray]:
    """(model, posteriors) by EM on votes alone, from a start at which each vote for toxic weighs against the prior."""
    v = ballots.astype(np.int8) + np.int8(1)
    odds = np.log(prior / (1 - prior))
    q = 1 / (1 + np.exp(-np.clip(odds + 2.0 * ballots.sum(1, dtype=np.int64), -40, 40)))
    parent, model = np.full(v.shape[1], -1), None
    for k in range(ROUNDS):
        if k in (1, ROUNDS // 2):
            parent = _ties(v, q)
        model = LabelModel(prior, parent, _tables(v, q, parent))
        q = model.posterior(ballots)
    return model, q


def train_linear(x: np.ndarray, q: np.ndarray, decay: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights of a logistic classifier, the constant last, trained on posteriors by accelerated gradient descent."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    look, t = w.copy(), 1.0
    rate = 4.0 / max((z**2).sum(1).mean(), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ look, -40, 40)))
        grad = z.T @ (p - q) / len(z) + decay / 10 * np.r_[look[:-1], 0]
        new, nxt = look - rate * grad, (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / nxt * (new - w), new, nxt
    return w


@dataclass
class Model:
    voters: Voters | None
    weights: np.ndarray | None
    prior: float
    label_model: LabelModel | None = None

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.voters is None:
            return np.full(len(texts), self.prior)
        z = features(*self.voters.hits(texts))
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, stem, group) for the toxic documents without a word of the lexicon; kind 0 are whole words, -1 whole documents.

    ``group`` is a document's least word hash, which near copies nearly always share, so that a toxic text with many
    copies doesn't lend its every word to the voters.
    """
    seed = Voters(pa.array(LEXICON, pa.large_string()), ())
    for batch in batches:
        toxic = pc.filter(batch.column("text"), pc.equal(batch.column("y"), 1))
        for _, texts in slabs(toxic, _SLAB):
            texts = texts.filter(pa.array(seed.hits(texts)[0].sum(1) == 0))
            docs, codes, distinct = words_of(pc.utf8_lower(texts))
            if not len(docs):
                continue
            bare = pc.utf8_trim(distinct, characters=_TRIM)
            group = np.full(len(texts), np.iinfo(np.int64).max)
            np.minimum.at(group, docs, word_hashes(bare)[codes])
            long = np.asarray(pc.utf8_length(bare))
            whole = np.unique(group[docs])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(whole), -1, np.int32)), pa.array([""] * len(whole)), pa.array(whole)], ["kind", "stem", "grp"])
            for kind in (0, *STEM_LENGTHS):
                keyed = (pc.utf8_slice_codeunits(bare, 0, kind) if kind else bare).dictionary_encode()
                ok = long[codes] >= max(kind, 1)
                size = max(1, len(keyed.dictionary))
                pairs = np.unique(docs[ok] * np.int64(size) + np.asarray(keyed.indices)[codes][ok])
                stems = keyed.dictionary.take(pa.array(pairs % size)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), kind, np.int32)), stems, pa.array(group[pairs // size])], ["kind", "stem", "grp"])


def mine(sample: DataFrame, clean: int) -> Voters:
    """The lexicon and at most MINED words or stems of toxic rows that it misses, far more frequent there than in clean rows.

    A stem's evidence is a log likelihood ratio, which has to outweigh that the best of so many candidates is looked
    for. Stems are chosen one by one; rows that a chosen one explains count for no other.
    """
    pairs = materialise(sample.select("text", "y").mapInArrow(_stem_rows, "kind int, stem string, grp bigint").distinct(), "toxicity-stems")
    counted = pairs.groupBy("kind", "stem").agg(F.count(F.lit(1)).alias("toxic"))
    toxic = next((r["toxic"] for r in counted.filter("kind < 0").collect()), 0)
    best = counted.filter((F.col("kind") >= 0) & (F.col("toxic") >= LEAST_DOCS)).orderBy(F.desc("toxic"), "kind", "stem").limit(CANDIDATES)
    candidates = best.join(pairs, ["kind", "stem"]).groupBy("kind", "stem").agg(F.collect_list("grp").alias("groups")).collect()
    candidates.sort(key=lambda r: (r["kind"], r["stem"]))
    asked = Voters(pa.array([r["stem"] for r in candidates if r["kind"] == 0], pa.large_string()), tuple((k, pa.array([r["stem"] for r in candidates if r["kind"] == k], pa.large_string())) for k in STEM_LENGTHS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(asked.lexical, np.int64)
        for batch in batches:
            y = np.asarray(batch.column("y"))
            for start, texts in slabs(batch.column("text"), _SLAB):
                docs, codes, distinct = words_of(pc.utf8_lower(texts))
                if not len(docs):
                    continue
                bare, base = pc.utf8_trim(distinct, characters=_TRIM), 0
                for kind, known in ((0, asked.words), *asked.stems):
                    here = np.asarray(pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(bare, 0, kind) if kind else bare, value_set=known), -1))[codes]
                    ok = here >= 0
                    pairs = np.unique(docs[ok] * np.int64(max(1, len(known))) + here[ok])
                    pairs = pairs[y[start + pairs // max(1, len(known))] != 1]
                    total[base : base + len(known)] += np.bincount(pairs % max(1, len(known)), minlength=len(known))
                    base += len(known)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["n"])

    cleans = np.zeros(asked.lexical, np.int64)
    for r in sample.select("text", "y").mapInArrow(count, "n array<bigint>").collect():
        cleans += np.array(r["n"], np.int64)
    if not clean:
        return Voters(pa.array(LEXICON, pa.large_string()), tuple((n, pa.array([], pa.large_string())) for n in STEM_LENGTHS))
    order = {0: len(STEM_LENGTHS), **{k: i for i, k in enumerate(STEM_LENGTHS)}}
    groups = {(r["kind"], r["stem"]): set(r["groups"]) for r in candidates}
    share, bar = toxic / max(1, toxic + clean), np.log(max(2, len(candidates)))
    open_: dict[tuple[int, str], int] = {}
    for (kind, known), base in zip(((0, asked.words), *asked.stems), np.cumsum([0, len(asked.words), *(len(s) for _, s in asked.stems)])):
        for i, stem in enumerate(known.to_pylist()):
            if not any(w.startswith(stem) for w in LEXICON):
                open_[kind, stem] = int(cleans[base + i])

    def evidence(key: tuple[int, str]) -> float:
        t, c = len(groups[key]), open_[key]
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        if t < LEAST_DOCS or odds < LEAST_ODDS:
            return -np.inf
        return t * np.log(t / (t + c) / share) + (c * np.log(c / (t + c) / (1 - share)) if c else 0.0)

    chosen: list[tuple[int, str]] = []
    while open_ and len(chosen) < MINED:
        top = max(open_, key=lambda k: (evidence(k), -order[k[0]], k[1]))
        if evidence(top) < bar:
            break
        chosen.append(top)
        covered = groups[top]
        for key in list(open_):
            if key != top and covered & groups[key]:
                groups[key] = groups[key] - covered
            if key == top or len(groups[key]) < LEAST_DOCS:
                del open_[key]
    words = [*LEXICON, *(s for k, s in chosen if k == 0)]
    return Voters(pa.array(words, pa.large_string()), tuple((n, pa.array([s for k, s in chosen if k == n], pa.large_string())) for n in STEM_LENGTHS))


def _training_sample(docs: DataFrame, rows: int) -> DataFrame:
    """(key, text, y): up to ``rows`` distinct rows that aren't held out, those with the least hash, with -1 for their label."""
    keyed = docs.filter(~is_held_out()).select(F.xxhash64(F.lit("fit"), "doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = keyed.select("key").distinct().orderBy("key").limit(rows)
    return keyed.join(chosen, "key").dropDuplicates(["key"]).withColumn("y", F.lit(-1))


def _evidence(sample: DataFrame, voters: Voters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hits of each lexical voter, words, label) of the rows of a bounded sample."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slabs(batch.column("text"), _SLAB):
                hits, n = voters.hits(texts)
                r, c = np.nonzero(hits)
                ends = pa.array(np.searchsorted(r, np.arange(len(n) + 1)).astype(np.int32))
                lists, sizes = pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(hits[r, c]))
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(start, len(n)), lists, sizes, pa.array(n)], ["y", "voter", "hits", "n"])

    got = sample.select("text", "y").mapInArrow(gather, "y int, voter array<int>, hits array<float>, n bigint").toPandas()
    hits = np.zeros((len(got), voters.lexical), np.float32)
    for i, (which, many) in enumerate(zip(got["voter"], got["hits"])):
        hits[i, np.asarray(which, np.int64)] = many
    # Sums over rows come out the same whatever order the rows arrive in.
    n, y = got["n"].to_numpy(), got["y"].to_numpy()
    order = np.lexsort((y, n, *(hits[:, k] for k in np.flatnonzero(hits.any(0))[:8])))
    return hits[order], n[order], y[order]


def threshold(logits: np.ndarray, y: np.ndarray, flag: float = FLAG) -> float:
    """What to add to logits so that ``flag`` parts the labels with the fewest errors; the middle of the widest best gap."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(logits, kind="stable")
    z, t = logits[order], y[order] == 1
    wrong = np.r_[0, np.cumsum(t)] + np.r_[np.cumsum((~t)[::-1])[::-1], 0]
    edges = np.r_[z[0] - 2.0, z, z[-1] + 2.0]
    # Equal logits can't be parted.
    wrong = np.where(edges[1:] - edges[:-1] > 1e-9, wrong, len(y) + 1)
    gap = np.where(wrong == wrong.min(), edges[1:] - edges[:-1], -1.0)
    k = int(np.argmax(gap))
    return float(np.log(flag / (1 - flag)) - (edges[k] + edges[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """A model whose label model and classifier are fitted on at most ``rows`` training rows without their labels.

    At most ``rows`` labelled rows choose the voters beside the seed lexicon's, give the share of toxic rows and place
    the threshold; without them the lexicon and the patterns vote alone, PRIOR is the share and no threshold is moved.
    """
    known = materialise(labelled_sample(docs, labels, label, rows).repartition(8, "doc_id"), "toxicity-sample").coalesce(8)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    voters = mine(known, counts.get(0, 0)) if counts else Voters(pa.array(LEXICON, pa.large_string()), tuple((n, pa.array([], pa.large_string())) for n in STEM_LENGTHS))
    sample = materialise(_training_sample(docs, rows).repartition(8, "key"), "toxicity-training").coalesce(8)
    hits, n, _ = _evidence(sample, voters)
    if not len(n):
        return Model(None, None, 0.0)
    prior = float(np.clip(counts[1] / sum(counts.values()), 0.001, 0.999)) if len(counts) == 2 else PRIOR
    model, posterior = fit_label_model(votes(hits, n), prior)
    weights = train_linear(features(hits, n), posterior)
    if len(counts) == 2:
        hits, n, y = _evidence(known, voters)
        weights[-1] += threshold(features(hits, n) @ weights[:-1] + weights[-1], y)
    return Model(voters, weights, prior, model)


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with column ``out``; null, empty and blank texts get the score of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]
    narrow = docs.select(*[F.col(f"`{c}`") for c in kept])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(texts) for _, texts in slabs(batch.column(text), _SLAB)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, out])

    return narrow.mapInArrow(step, StructType([*narrow.schema.fields, StructField(out, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", flag: float = FLAG) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null, empty and blank texts score alike; very long ones are read whole; ids may be null, of any type, or repeat,
    and repeated rows come as often as they are given; other columns aren't read. An empty table gives an empty
    result. A score of exactly ``flag`` is flagged. Of several labels of one id the greatest counts.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, label)).select("doc_id", "score")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= flag).cast("int").alias("predicted"))
