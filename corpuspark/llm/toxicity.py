"""Toxicity by weak supervision.

1. Lexicons: named word lists of common insults (fixed, by theme, in several languages), and mined terms: words and word stems
   that are far more frequent in training texts labelled toxic than in clean ones, counted by Spark over all of them.
2. Voters: each named list, each kind of mined term, and patterns (no hit, several distinct hits, dense hits, shouting) vote
   toxic, clean or abstain on every text that may be learnt from, labelled or not. Abstaining is no evidence.
3. Label model: a latent class y with P(y) P(label | y) prod P(vote | y, vote of its parent). The parents form the tree of the
   strongest correlations that y leaves unexplained, so correlated voters don't count twice. EM estimates the share of toxic
   texts, every voter's accuracy, the correlations and how far labels can be trusted, from counts over all vote patterns.
4. A logistic classifier over the lexicon counts is trained on the posterior labels; it alone scores every text.

The classifier is fitted to a sample of at most ``FIT_ROWS`` labelled rows of each label, chosen by a hash of the id and
weighted to stand for all. All counts (terms, votes, patterns) cover all training rows. Scoring reads whole texts and needs no shuffle.

Defined results: null and empty texts are scored as texts without words; repeated labels of an id count once, toxic if any
says so; null labels train nothing; without training rows of both classes every score is the share of toxic ones (0 if there
are none); ties of the choice of terms go to the smaller hash; an empty table gives no rows; columns other than the named ones
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspark.llm.common import IdFilter, discard, in_fold, kind_of, map_texts, quoted, stored, table, unused
from corpuspark.llm.textscan import letters, mix, row_slices, span_hashes, spans

STEM_BYTES = (4, 5, 6, 7, 8)
MIN_TOXIC = 4
LEAST_SHARE = 1 / 400  # of the toxic texts must have a term; so there are at most 400 times as many candidates as a text has terms
MIN_RATIO = 6.0
LEAST_RATIO = 2.0
LEXICON = 256
FIT_ROWS = 4_000
FIT_TASKS = 16
EM_ROUNDS = 12
LABEL_TRUST = 0.95
# Common insults by theme, in English, German, French and Spanish.
LEXICONS = {
    "stupidity": "idiot idiots moron morons stupid dumb dumbass imbecile fool foolish brainless idioten dumm dummkopf trottel idiote imbécile stupide crétin idiota imbécil estúpido tonto",
    "contempt": "pathetic loser losers worthless useless failure nobody versager erbärmlich wertlos nutzlos pathétique minable inútil patético perdedor",
    "filth": "trash garbage scum filth filthy vermin parasite abschaum dreck müll ungeziefer ordure déchet vermine basura escoria asco",
    "ridicule": "clown clowns freak weirdo joke laughable lächerlich witzfigur bouffon ridicule payaso ridículo",
    "disgust": "disgusting vile repulsive revolting ekelhaft widerlich dégoûtant répugnant asqueroso repugnante",
    "threat": "kill hurt destroy beat burn töten sterben verrecke tuer mourir crève matar morir",
    "swearing": "shit fuck fucking bitch bastard asshole damn crap scheiße arschloch mistkerl merde salaud connard mierda cabrón puta",
}
NAMES = list(LEXICONS)
VOTES = 3  # toxic, abstain, clean as 1, 0, -1


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(words of each text, words in capitals, an iterator of (text number, hash) arrays: whole words first, then stems by length)."""
    symbols, at = letters(data, offsets)
    starts, ends = spans(symbols != 0)
    doc = np.searchsorted(at, starts, "right") - 1
    n = len(offsets) - 1

    def each():
        yield doc, span_hashes(symbols, starts, ends)
        for k in STEM_BYTES:
            long = ends - starts >= k
            yield doc[long], mix(span_hashes(symbols, starts[long], starts[long] + k) ^ np.uint64(k))

    capital = (data >= 65) & (data <= 90)
    run_starts, run_ends = spans(capital)
    shouted = run_starts[run_ends - run_starts >= 4]
    return np.bincount(doc, minlength=n), np.bincount(np.searchsorted(offsets, shouted, "right") - 1, minlength=n), each()


def named_hashes() -> tuple[np.ndarray, np.ndarray]:
    """(hashes, theme number) of the words of ``LEXICONS``."""
    words = [(w, k) for k, name in enumerate(NAMES) for w in LEXICONS[name].split()]
    raw = [w.encode() for w, _ in words]
    _, _, each = word_features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return next(each)[1], np.array([k for _, k in words])


def _distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hashes, once for each text."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return x[first]


class Lookup:
    """Find which hashes are in a fixed list: a bitmap of low bits first, then binary search."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``h``, their number in the list)."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bitmap[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
        hit = self.sorted[i] == h[maybe]
        return maybe[hit], self.order[i[hit]]


@dataclass
class Lexicon:
    """Mined terms (hash, kind: 0 whole words, then the stem lengths) and the named lists behind one lookup."""

    mined: np.ndarray
    kinds: np.ndarray
    lookup: Lookup = field(init=False)

    def __post_init__(self):
        named, self.theme = named_hashes()
        self.size = len(self.mined) + len(NAMES)  # columns: mined terms, then themes
        self.lookup = Lookup(np.concatenate([self.mined, named]))
        self.column = np.concatenate([np.arange(len(self.mined)), len(self.mined) + self.theme])

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words by text, shouted words by text, and sorted by text: text number, column, count)."""
        words, shouted, each = word_features(data, offsets)
        keys = [np.zeros(0, np.int64)]
        for doc, h in each:
            at, entry = self.lookup(h)
            keys.append(doc[at] * self.size + self.column[entry])
        pairs, n = np.unique(np.concatenate(keys), return_counts=True)
        return words, shouted, pairs // self.size, pairs % self.size, n

    def votes(self, words: np.ndarray, shouted: np.ndarray, doc: np.ndarray, column: np.ndarray, n: np.ndarray) -> np.ndarray:
        """1, 0 or -1 of each voter (columns) on each text (rows)."""
        m, mined = len(words), column < len(self.mined)
        parts = []
        for k in range(1 + len(STEM_BYTES)):
            own = np.zeros(len(column), bool)
            own[mined] = self.kinds[column[mined]] == k
            kinds = np.bincount(doc[own], minlength=m)
            parts.append(np.where(kinds > 0, 1, 0))
        for k in range(len(NAMES)):
            parts.append(np.where(np.bincount(doc[column == len(self.mined) + k], minlength=m) > 0, 1, 0))
        distinct, total = np.bincount(doc, minlength=m), np.bincount(doc, n, m)
        parts.append(np.where(distinct == 0, -1, 0))
        parts.append(np.where(distinct >= 3, 1, np.where(distinct <= 1, -1, 0)))
        parts.append(np.where((total > 0) & (total >= 0.01 * words), 1, np.where(total == 0, -1, 0)))
        parts.append(np.where(2 * shouted > words, 1, 0))
        return np.stack(parts, 1).astype(np.int8)


def _document_frequencies(texts: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(feature, kind, n): in how many texts; counted in place, then summed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(only) if only is not None else None
        for batch in batches:
            for _, data, offsets in row_slices(batch):
                for kind, (doc, h) in enumerate(word_features(data, offsets)[2]):
                    if lookup:
                        at, _ = lookup(h)
                        doc, h = doc[at], h[at]
                    features, n = np.unique(_distinct(doc, h), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(features.view(np.int64)), pa.array(np.full(len(features), kind, np.int32)), pa.array(n.astype(np.int64))], ["feature", "kind", "n"]
                    )

    return map_texts(texts.select("text"), run, "feature long, kind int, n long").groupBy("feature", "kind").agg(F.sum("n").alias("n"))


def _clean_frequencies(rows: DataFrame, clean: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """In how many of the texts labelled clean each term is. Texts stay where they are: only the numbers of the terms they have are joined."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(hashes)
        for batch in batches:
            for part, data, offsets in row_slices(batch):
                keys = [np.zeros(0, np.int64)]
                for doc, h in word_features(data, offsets)[2]:
                    at, entry = lookup(h)
                    keys.append(doc[at] * len(hashes) + entry)
                pairs = np.unique(np.concatenate(keys))
                ends = np.searchsorted(pairs // len(hashes), np.arange(part.num_rows + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array((pairs % len(hashes)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), found], ["doc_id", "terms"])

    terms = map_texts(rows, run, f"doc_id {kind_of(rows, 'doc_id')}, terms array<int>").where("size(terms) > 0").join(clean, "doc_id")
    counted = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(len(hashes))
    out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return out


def mine(toxic: DataFrame, rows: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """The ``LEXICON`` terms with the greatest gain that no named list has: of a least share of all toxic texts, and rare in clean ones, the
    rows of the ids ``clean``. What is not even ``LEAST_RATIO`` times as frequent as among rows that a bitmap of those ids lets pass,
    which are few more, is left out before."""
    rows = IdFilter(clean, "doc_id").maybe(rows)
    least = max(MIN_TOXIC, int(n_toxic * LEAST_SHARE))
    frequent = _document_frequencies(toxic).where(F.col("n") >= least).toArrow()
    hashes, kinds, n1 = (frequent.column(c).to_numpy() for c in ("feature", "kind", "n"))
    everywhere = _document_frequencies(rows.select("text"), hashes.view(np.uint64)).toArrow()
    others = np.zeros(len(hashes))
    order = np.argsort(hashes, kind="stable")
    others[order[np.searchsorted(hashes[order], everywhere.column("feature").to_numpy())]] = everywhere.column("n").to_numpy()
    ratio = lambda n0, n: (n1 + 0.5) / (n_toxic + 1) / ((np.maximum(n0, 0) + 0.5) / (n + 1))
    some = (ratio(others, n_clean) >= LEAST_RATIO) & ~np.isin(hashes.view(np.uint64), named_hashes()[0])
    hashes, kinds, n1 = hashes[some], kinds[some], n1[some]
    if not len(hashes):
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int32))
    r = ratio(_clean_frequencies(rows, clean, hashes.view(np.uint64)), n_clean)
    gain = np.where(r >= MIN_RATIO, n1 * np.log(r), 0)
    best = np.lexsort((hashes, -gain))[: min(LEXICON, int((gain > 0).sum()))]
    return Lexicon(hashes[best].view(np.uint64).copy(), kinds[best].copy())


@dataclass
class LabelModel:
    """P(y), P(label | y) and, for each voter, log P(vote | y, vote of its parent); a voter without parent repeats one row."""

    prior: float
    trust: float
    parent: np.ndarray  # of each voter, -1 for the root
    log_votes: np.ndarray  # y x voter x parent's vote + 1 x vote + 1
    accuracy: np.ndarray  # P(vote is right | it doesn't abstain)
    correlation: np.ndarray  # with the parent, within the classes, as information in nats

    def posterior(self, v: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic) of each row from its votes and its label (-1 where unknown)."""
        above = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0) + 1
        at = np.arange(v.shape[1])
        evidence = [np.where(v == 0, 0, self.log_votes[y][at, above, v + 1]).sum(1) for y in (0, 1)]
        pull = np.log(self.trust) - np.log1p(-self.trust)
        odds = evidence[1] - evidence[0] + np.log(self.prior) - np.log1p(-self.prior) + np.where(label < 0, 0, np.where(label == 1, pull, -pull))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def pair_counts(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted counts by y, voter and vote, other voter and its vote. ``w`` is y x rows."""
    n = v.shape[1]
    hot = (v[:, :, None] == np.arange(-1, 2)).reshape(len(v), n * VOTES).astype(float)
    return np.stack([(hot * w[y][:, None]).T @ hot for y in (0, 1)]).reshape(2, n, VOTES, n, VOTES)


def maximise(pairs: np.ndarray, label_mass: np.ndarray) -> LabelModel:
    """The model of expected counts: ``pairs`` as from ``pair_counts``; label_mass: y x (known 0, known 1)."""
    n = pairs.shape[1]
    single = np.stack([[np.diag(pairs[y, i, :, i, :]) for i in range(n)] for y in (0, 1)])  # y x voter x vote
    mass = single[:, 0].sum(1)
    prior = float(np.clip(mass[1] / max(mass.sum(), 1e-9), 1e-3, 1 - 1e-3))
    known = label_mass.sum()
    trust = float(np.clip((label_mass[0, 0] + label_mass[1, 1]) / known if known else LABEL_TRUST, 0.6, 0.999))
    joint = (pairs + 0.05) / (pairs.sum((2, 4), keepdims=True) + 0.45)
    own = joint.sum(4)[:, :, :, :, None]
    other = joint.sum(2)[:, :, None]
    information = (joint * np.log(joint / (own * other))).sum((2, 4))  # y x voter x voter
    information = (information * (mass / max(mass.sum(), 1e-9))[:, None, None]).sum(0)
    np.fill_diagonal(information, 0)
    parent, strength = np.full(n, -1), np.zeros(n)
    best, above = np.full(n, -np.inf), np.zeros(n, int)
    best[0] = np.inf
    todo = np.ones(n, bool)
    for _ in range(n):  # the spanning tree of greatest information
        i = int(np.flatnonzero(todo)[np.argmax(best[todo])])
        todo[i] = False
        if best[i] < np.inf and best[i] > 0.01:
            parent[i], strength[i] = above[i], best[i]
        closer = todo & (information[i] > best)
        best[closer], above[closer] = information[i][closer], i
    log_votes = np.zeros((2, n, VOTES, VOTES))
    for i in range(n):
        if parent[i] < 0:
            log_votes[:, i] = np.log((single[:, i] + 0.5) / (single[:, i].sum(1, keepdims=True) + 1.5))[:, None]
        else:  # votes given the parent's vote lean on the votes alone where there is little to count
            alone = (single[:, i] + 0.5) / (single[:, i].sum(1, keepdims=True) + 1.5)
            c = pairs[:, parent[i], :, i, :]
            log_votes[:, i] = np.log((c + 4 * alone[:, None]) / (c.sum(2, keepdims=True) + 4))
    said = single[:, :, 0] + single[:, :, 2]
    accuracy = (single[1, :, 2] + single[0, :, 0]) / np.maximum(said.sum(0), 1e-9)
    return LabelModel(prior, trust, parent, log_votes, accuracy, strength)


def _start(label: np.ndarray, prior: float) -> np.ndarray:
    return np.where(label < 0, prior, np.where(label == 1, LABEL_TRUST, 1 - LABEL_TRUST))


def expected(v: np.ndarray, label: np.ndarray, n: np.ndarray, model: LabelModel | None) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of the vote patterns ``v`` that occur ``n`` times; the first round counts labelled ones only."""
    q = model.posterior(v, label) if model else _start(label, 0.0)
    w = np.stack([1 - q, q]) * (n if model else np.where(label >= 0, n, 0))
    return pair_counts(v, w), np.stack([(w * (label == x)).sum(1) for x in (0, 1)], 1)


def fit_label_model(patterns: DataFrame, rounds: int = EM_ROUNDS) -> LabelModel:
    """EM over (votes binary, toxic int or null, n); each round sums its counts in at most ``FIT_TASKS`` tasks, a few KB each."""
    n_voters, model = len(patterns.first()["votes"]), None
    for _ in range(rounds):
        now = model

        def run(batches: Iterable[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    v = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int8).reshape(batch.num_rows, n_voters)
                    label = np.nan_to_num(batch.column(1).to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(int)
                    for a in range(0, len(v), 20_000):
                        part = expected(v[a : a + 20_000], label[a : a + 20_000], batch.column(2).to_numpy()[a : a + 20_000], now)
                        total = part if total is None else tuple(x + y for x, y in zip(total, part, strict=True))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total], ["pairs", "labels"])

        sums = patterns.select("votes", "toxic", "n").mapInArrow(run, "pairs binary, labels binary").toArrow()
        pairs = sum(np.frombuffer(x, np.float64) for x in sums.column("pairs").to_pylist()).reshape(2, n_voters, VOTES, n_voters, VOTES)
        labels = sum(np.frombuffer(x, np.float64) for x in sums.column("labels").to_pylist()).reshape(2, 2)
        before, model = model, maximise(pairs, labels)
        if before is not None and abs(before.prior - model.prior) < 1e-4 and abs(before.trust - model.trust) < 1e-4:
            break
    return model


@dataclass
class Classifier:
    lexicon: Lexicon
    weights: np.ndarray  # lexicon columns, then the summary features, then the bias
    label_model: LabelModel | None = None


def _summary(total: np.ndarray, distinct: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(total), np.log1p(100 * total / np.maximum(words, 1)), np.log1p(distinct), np.log1p(words) / 10, np.ones(len(words))], 1)


def fit_logistic(x: np.ndarray, q: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Newton steps on soft labels."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (q - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _hits(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row for each text: its id, votes, words, and the lexicon columns it has with their counts. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_slices(batch):
                words, shouted, doc, column, n = lexicon.counts(data, offsets)
                votes = lexicon.votes(words, shouted, doc, column, n)
                ends = pa.array(np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (column, n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.tobytes() for x in votes], pa.binary()), pa.array(words.astype(np.int64)), *lists],
                    ["doc_id", "votes", "words", "columns", "counts"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return map_texts(texts.select("doc_id", "text"), run, f"doc_id {kind}, votes binary, words long, columns array<int>, counts array<int>")


def _fit_rows(hits: DataFrame, toxic: int, n: int) -> tuple:
    """(hits, weights) of the sample of one label."""
    rows = hits.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id", "votes", "words").limit(FIT_ROWS).toArrow()
    return rows, np.full(rows.num_rows, n / max(1, rows.num_rows))


def fit(docs: DataFrame, labels: DataFrame, usable=None) -> Classifier:
    """Fit to docs (doc_id, text) and labels (doc_id, toxic), on the rows of both where ``usable`` holds."""
    usable = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    known = labels.where(usable & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known, "toxicity-labels")
    rows = docs.where(usable).select("doc_id", "text")
    n_of = {r.toxic: r.n for r in rows.select("doc_id").join(known, "doc_id", "left").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n_of.get(1, 0), n_of.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        bias = np.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -800.0)
        none = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int32))
        return Classifier(none, np.concatenate([np.zeros(none.size + 4), [bias]]))
    bad = known.where("toxic = 1")
    toxic = stored(IdFilter(bad, "doc_id").maybe(rows).join(bad, "doc_id").select("text"), "toxicity-texts")  # the others stay where they are
    lexicon = mine(toxic, rows, known.where("toxic = 0").select("doc_id"), n_toxic, n_clean)
    discard(toxic)
    hits = stored(_hits(rows, lexicon).join(known, "doc_id", "left"), "toxicity-hits")  # no texts: some 50 bytes a row
    patterns = stored(hits.groupBy("votes", "toxic").agg(F.count("*").alias("n")).repartition(FIT_TASKS), "toxicity-patterns")
    model = fit_label_model(patterns)
    x, q, weight = [], [], []
    for label, n in ((0, n_clean), (1, n_toxic)):
        found, w = _fit_rows(hits, label, n)
        v = np.frombuffer(b"".join(found.column("votes").to_pylist()), np.int8).reshape(found.num_rows, -1)
        counts = np.zeros((found.num_rows, lexicon.size))
        for i, (c, k) in enumerate(zip(found.column("columns").to_pylist(), found.column("counts").to_pylist(), strict=True)):
            counts[i, c] = k
        x.append(np.concatenate([np.log1p(counts), _summary(counts.sum(1), (counts > 0).sum(1), found.column("words").to_numpy())], 1))
        q.append(model.posterior(v, np.full(len(v), label)))
        weight.append(w)
    weights = fit_logistic(np.concatenate(x), np.concatenate(q), np.concatenate(weight))
    return Classifier(lexicon, weights, model)


def score(docs: DataFrame, model: Classifier, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs, then score and predicted (with underscores added to a name that ``keep`` has). No shuffle; the model has at
    most ``LEXICON`` mined terms and the named words."""
    keep = keep or ["doc_id"]
    lexicon, weights = model.lexicon, model.weights
    names = [*keep, unused("score", keep), unused("predicted", keep)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_slices(batch):
                words, _, doc, column, count = lexicon.counts(data, offsets)
                n = len(words)
                total, distinct = np.bincount(doc, count, n), np.bincount(doc, minlength=n)
                z = np.bincount(doc, np.log1p(count) * weights[column], n) + _summary(total, distinct, words) @ weights[lexicon.size :]
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                predicted = (p >= 0.5).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(p), pa.array(predicted)], names)

    rows = docs.select(*quoted(keep), *([] if "text" in keep else ["text"]))
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField(names[-2], T.DoubleType()), T.StructField(names[-1], T.IntegerType())])
    return map_texts(rows, run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = in_fold("doc_id", 5, 0)
    model = fit(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict = {}
