"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a hashed word vector, the mean of hashed vectors of its character n-grams, and the log-odds
of the word and its n-grams among the labelled texts (cross-fitted while training, so that no text sees its
own label). Two gated recurrent units read a window of words forwards and backwards; attention weighs their
states; a logistic unit gives the window's score. Windows begin every ``STRIDE`` words, a quarter of their length, and
cover the whole text, so a passage of ``WINDOW - STRIDE + 1`` words or fewer lies whole in one wherever it stands;
a text's score is that of its worst window, and training follows the worst window of each text: by the log-odds in the first
epoch, then by the network's own score.

The network is fitted on a bounded sample of labelled texts: at most ``SAMPLE`` texts of each label, the first
by a hash of the id, of at most ``SAMPLE_CHARS`` characters each. Scoring has no bound.

Defined results: null texts count as empty; a text without words has the score of an empty window; repeated
rows score alike; labels that are null or not 0 or 1 are left out; of several labels of one id the highest holds;
with no labels of either kind, all scores are the share of label 1 (0.0 without any labels). Rows with a null
id are scored like others. An empty table gives no rows. Columns other than doc_id, text and toxic are not read, and
``drop_toxic`` passes them on, whatever their names. A long text is held as one number a word; its windows are scored
a few thousand at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import give_back, slices, strings

SAMPLE, SAMPLE_CHARS = 800, 20_000
WINDOW, STRIDE = 32, 8
BUCKETS, GRAMS, DIM, HIDDEN = 4096, 16384, 6, 8
EPOCHS, WARM, RATE, SEED, PRIOR = 8, 1, 0.02, 11, 5
WORDS_KEPT = 150_000


#: What is taken out of texts before they are cut into words.
PUNCTUATION = r"[.,;:!?\"()\[\]{}]+"


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the number of each word among them, how many words each text has): lower case, between white space, without punctuation."""
    split = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(strings(texts)), PUNCTUATION, ""))
    flat = split.flatten()
    # white space at the ends gives empty words
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    numbered = flat.filter(pa.array(filled)).dictionary_encode()
    return numbered.dictionary.to_pylist(), numbered.indices.to_numpy(), np.diff(np.concatenate([[0], np.cumsum(filled)])[split.offsets.to_numpy()])


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hashes of its n-grams end to end, how many it has): n-grams of three and five bytes, the word's ends marked; a shorter word is one."""
    marked = [f"<{w}>".encode() for w in words]
    size = np.array([len(m) for m in marked], np.int64)
    ends = np.cumsum(size)
    data = np.concatenate([np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1), np.zeros(5, np.uint64)])
    row = np.repeat(np.arange(len(words)), size)
    within = np.arange(len(row)) - (ends - size)[row]
    power = np.uint64(0x9E3779B97F4A7C15) ** np.arange(64, dtype=np.uint64)
    mix = lambda h: (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)
    whole = mix(np.add.reduceat(data[: len(row)] * power[within & 63] * (within.astype(np.uint64) + np.uint64(1)), ends - size)) if len(words) else np.empty(0, np.uint64)
    counts = [np.maximum(size - n + 1, 1) for n in (3, 5)]
    begin = np.cumsum(sum(counts)) - sum(counts)
    grams = np.empty(int(sum(counts).sum()), np.uint64)
    for n, count, before in zip((3, 5), counts, (0, counts[0])):
        first = within < count[row]
        at, own = first.nonzero()[0], row[first]
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h += data[at + i] * power[i + 1] * (within[at] + i < size[own])
        grams[(begin + before)[own] + within[at]] = mix(h)
    return whole, grams, sum(counts)


class Odds:
    """Smoothed log-odds of label 1 for texts that hold a word or an n-gram."""

    def __init__(self, words: list[str], texts: list[np.ndarray], labels: np.ndarray):
        """``texts`` are rows of ``words``."""
        self.n = [max(1, int((labels == x).sum())) for x in (0, 1)]
        word, gram = np.zeros((2, len(words))), np.zeros((2, GRAMS))
        _, flat, size = _hashes(words)
        grams = np.split((flat % GRAMS).astype(np.int64), np.cumsum(size)[:-1])
        for rows, y in zip(texts, labels.tolist()):
            rows = np.unique(rows)
            word[y, rows] += 1
            if len(rows):
                gram[y, np.unique(np.concatenate([grams[r] for r in rows]))] += 1
        self.grams = self._odds(gram[0], gram[1])
        # words of a single text tell nothing that lasts
        odds = self._odds(word[0], word[1])
        some = (word.sum(axis=0) > 1).nonzero()[0]
        self.words = dict(zip([words[i] for i in some], odds[some].tolist()))

    def _odds(self, clean, toxic):
        """Counts of both labels are drawn towards the labels' shares by ``PRIOR`` texts, so that rare words say little."""
        n0, n1 = self.n
        return np.log((toxic + PRIOR * n1 / (n0 + n1)) / n1) - np.log((clean + PRIOR * n0 / (n0 + n1)) / n0)

    def features(self, words: list[str], grams: np.ndarray, begins: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each word: its own log-odds, and the largest and the mean of its n-grams'."""
        g = self.grams[grams]
        own = np.fromiter((self.words.get(w, 0.0) for w in words), np.float64, len(words))
        return np.stack([own, np.maximum.reduceat(g, begins), np.add.reduceat(g, begins) / size], axis=1) / 4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters and passes. A word's input is [word vector, mean n-gram vector, three log-odds, 1]."""

    def __init__(self, bias: float = 0.0):
        r = np.random.default_rng(SEED)
        d, h = 2 * DIM + 4, HIDDEN
        init = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "word": (r.normal(size=(BUCKETS, DIM)) * 0.1).astype(np.float32), "gram": (r.normal(size=(GRAMS, DIM)) * 0.1).astype(np.float32),
            "wf": init(d, 3 * h), "wb": init(d, 3 * h), "uf": init(h, 3 * h), "ub": init(h, 3 * h),
            "att": init(2 * h, 1)[:, 0], "out": init(2 * h, 1)[:, 0], "bias": np.array([bias], np.float32),
        }

    def inputs(self, words: list[str], odds: Odds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input rows of distinct words, the places of their word vectors and of their n-gram vectors end to end, and how many of these each has."""
        whole, flat, size = _hashes(words)
        places, grams = (whole % BUCKETS).astype(np.int64), (flat % GRAMS).astype(np.int64)
        x = np.ones((len(words), 2 * DIM + 4), np.float32)
        if words:
            begins = np.cumsum(size) - size
            x[:, 2 * DIM : 2 * DIM + 3] = odds.features(words, grams, begins, size)
            self.inputs_again(x, places, grams, size)
        return x, places, grams, size

    def inputs_again(self, x: np.ndarray, places: np.ndarray, grams: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same input rows under the present parameters."""
        x[:, :DIM] = self.p["word"][places]
        x[:, DIM : 2 * DIM] = np.add.reduceat(self.p["gram"][grams], np.cumsum(size) - size) / size[:, None]
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions for each word, and a last row for a place without a word, which keeps the state."""
        pad = np.zeros((1, 6 * HIDDEN), np.float32)
        pad[0, :HIDDEN] = pad[0, 3 * HIDDEN : 4 * HIDDEN] = 40
        return np.concatenate([np.concatenate([x @ self.p["wf"], x @ self.p["wb"]], axis=1), pad])

    def forward(self, gates: np.ndarray, at: np.ndarray, keep: bool = False, empty: int = -1):
        """Scores (log-odds) of windows; ``at`` (windows, WINDOW) are rows of ``gates``, ``empty`` (the last one) where no word is."""
        h, n = HIDDEN, len(at)
        states = np.empty((at.shape[1], n, 2 * h), np.float32)
        kept = []
        for side, u in enumerate((self.p["uf"], self.p["ub"])):
            state = np.zeros((n, h), np.float32)
            trail = []
            own = gates[:, 3 * h * side : 3 * h * (side + 1)]
            for t in range(at.shape[1]) if side == 0 else range(at.shape[1] - 1, -1, -1):
                a = own[at[:, t]]
                zr = sigmoid(a[:, : 2 * h] + state @ u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(a[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
                if keep:
                    trail.append((t, state, z, r, new))
                state = new + z * (state - new)
                states[t, :, h * side : h * (side + 1)] = state
            kept.append(trail)
        weight = states.reshape(-1, 2 * h) @ self.p["att"]
        weight = weight.reshape(at.shape[1], n)
        weight[(at == (len(gates) - 1 if empty < 0 else empty)).T] = -30
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (states * weight[:, :, None]).sum(axis=0)
        score = pooled @ self.p["out"] + self.p["bias"][0]
        return (score, states, weight, pooled, kept) if keep else score

    def score_windows(self, gates: np.ndarray, padded: np.ndarray, starts: np.ndarray, empty: int, step: int = 2048) -> np.ndarray:
        """Scores of the windows that begin at ``starts`` in rows of ``gates``, a few at a time."""
        across = np.arange(WINDOW)
        return np.concatenate([self.forward(gates, padded[starts[i : i + step, None] + across], empty=empty) for i in range(0, len(starts), step)])

    def gradients(self, x: np.ndarray, places: np.ndarray, grams: np.ndarray, size: np.ndarray, at: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss of windows."""
        p, h = self.p, HIDDEN
        gates = self.project(x)
        score, states, weight, pooled, kept = self.forward(gates, at, keep=True)
        d = ((sigmoid(score) - y) * share).astype(np.float32)
        g = {"bias": np.array([d.sum()]), "out": pooled.T @ d}
        d_pooled = d[:, None] * p["out"]
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * p["att"]
        g["att"] = np.einsum("tn,tnh->h", d_score, states)
        d_gates = np.zeros_like(gates)
        for side, name in enumerate(("uf", "ub")):
            u, own = p[name], d_gates[:, 3 * h * side : 3 * h * (side + 1)]
            g[name] = np.zeros_like(u)
            back = np.zeros((len(at), h), np.float32)
            for t, state, z, r, new in reversed(kept[side]):
                back = back + d_states[t, :, h * side : h * (side + 1)]
                d_new = back * (1 - z) * (1 - new * new)
                d_z = back * (state - new) * z * (1 - z)
                d_rs = d_new @ u[:, 2 * h :].T
                d_r = d_rs * state * r * (1 - r)
                da = np.concatenate([d_z, d_r, d_new], axis=1)
                np.add.at(own, at[:, t], da)
                g[name][:, : 2 * h] += state.T @ da[:, : 2 * h]
                g[name][:, 2 * h :] += (r * state).T @ d_new
                back = back * z + d_rs * r + da[:, : 2 * h] @ u[:, : 2 * h].T
        d_gates = d_gates[:-1]
        g["wf"], g["wb"] = x.T @ d_gates[:, : 3 * h], x.T @ d_gates[:, 3 * h :]
        d_x = d_gates[:, : 3 * h] @ p["wf"].T + d_gates[:, 3 * h :] @ p["wb"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], places, d_x[:, :DIM])
        np.add.at(g["gram"], grams, np.repeat(d_x[:, DIM : 2 * DIM] / size[:, None], size, axis=0))
        return g


def windows(rows: np.ndarray, size: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with room after each text, where windows begin in them, how many each text has): every word lies in one, the last may be partly empty."""
    count = np.maximum(1, -((WINDOW - STRIDE - size) // STRIDE))
    room = (count - 1) * STRIDE + WINDOW
    begin = np.cumsum(room) - room
    padded = np.full(int(room.sum()), empty, np.int32)
    padded[np.arange(len(rows)) + np.repeat(begin - (np.cumsum(size) - size), size)] = rows
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return padded, np.repeat(begin, count) + within * STRIDE, count


class Model:
    """A fitted network with its log-odds."""

    def __init__(self, network: Network | None, odds: Odds | None, constant: float):
        self.network, self.odds, self.constant = network, odds, constant
        self._rows: dict[str, int] = {}
        self._gates = np.empty((0, 6 * HIDDEN), np.float32)

    def score(self, texts: pa.Array) -> np.ndarray:
        """The score of each whole text, from 0 to 1."""
        if self.network is None or not len(texts):
            return np.full(len(texts), self.constant)
        if len(self._rows) > WORDS_KEPT or not self._rows:
            self._rows, self._gates = {"": 0}, self.network.project(np.ones((0, 2 * DIM + 4), np.float32))
        words, flat, size = words_of(texts)
        rows = np.fromiter(map(self._rows.get, words, repeat(-1)), np.int64, len(words))
        unknown = rows < 0
        new = list(compress(words, unknown.tolist()))
        used = len(self._rows)
        rows[unknown] = np.arange(used, used + len(new))
        if used + len(new) > len(self._gates):
            grown = np.empty(((used + len(new)) * 5 // 4, 6 * HIDDEN), np.float32)
            grown[:used] = self._gates[:used]
            self._gates = grown
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self._gates[used + i : used + i + len(part)] = self.network.project(self.network.inputs(part, self.odds)[0])[:-1]
        self._rows.update(zip(new, range(used, used + len(new))))
        padded, starts, count = windows(rows[flat], size, 0)
        scores = self.network.score_windows(self._gates, padded, starts, 0)
        return sigmoid(np.maximum.reduceat(scores.astype(np.float64), np.cumsum(count) - count))


def train(texts: pa.Array, labels: list[int], epochs: int = EPOCHS) -> Model:
    """Fit on labelled texts; the same texts in the same order give the same model."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(None, None, float(y.mean()) if len(y) else 0.0)
    words, flat, size = words_of(texts)
    split = np.split(flat, np.cumsum(size)[:-1])
    fold = np.arange(len(y)) % 2
    if any(len(np.unique(y[fold != f])) < 2 for f in (0, 1)):
        fold = np.zeros(len(y), np.int64)
    network, rng = Network(), np.random.default_rng(SEED)
    groups = []
    for f in (0, 1):
        own = (fold == f).nonzero()[0]
        if len(own):
            # no text sees its own label
            others = [i for i in range(len(y)) if fold[i] != f or not fold.any()]
            odds = Odds(words, [split[i] for i in others], y[others])
            used, rows = np.unique(np.concatenate([split[i] for i in own]), return_inverse=True)
            padded, starts, count = windows(rows, size[own], len(used))
            groups.append((own, len(used), padded, starts, count, network.inputs([words[i] for i in used], odds)))
    del odds
    mean, square, step = {k: np.zeros_like(v) for k, v in network.p.items()}, {k: np.zeros_like(v) for k, v in network.p.items()}, 0
    share = np.array([0.5 / (y == 0).sum(), 0.5 / (y == 1).sum()])
    for epoch in range(epochs):
        jobs = []
        for which, (own, empty, padded, starts, count, (fixed, places, grams, sizes)) in enumerate(groups):
            # the worst window of every text under the present network
            if epoch < WARM:  # a network that knows nothing yet follows the log-odds
                told = np.append(fixed[:, 2 * DIM] + fixed[:, 2 * DIM + 2], -9.0)[padded]
                score = np.lib.stride_tricks.sliding_window_view(told, WINDOW).max(axis=1)[starts]
            else:
                if empty:
                    network.inputs_again(fixed, places, grams, sizes)
                score = network.score_windows(network.project(fixed), padded, starts, empty)
            for i, end, n in zip(own.tolist(), np.cumsum(count).tolist(), count.tolist()):
                worst = starts[end - n + int(np.argmax(score[end - n : end]))]
                jobs.append((y[i], which, worst))
                if not y[i]:  # clean texts have no toxic window at all: one more of theirs, by chance
                    jobs.append((0, which, starts[int(rng.integers(end - n, end))]))
        order = rng.permutation(len(jobs))
        for part in np.array_split(order, max(1, len(order) // 100)):
            for which, (_, empty, padded, _, _, (fixed, places, grams, sizes)) in enumerate(groups):
                chosen = [jobs[j] for j in part if jobs[j][1] == which]
                if not chosen:
                    continue
                at = padded[np.array([c[2] for c in chosen])[:, None] + np.arange(WINDOW)]
                rows, at = np.unique(at, return_inverse=True)
                at = at.reshape(len(chosen), WINDOW)
                if rows[-1] == empty:  # empty places come last
                    rows = rows[:-1]
                if not len(rows):
                    continue
                begins = np.cumsum(sizes) - sizes
                own_size = sizes[rows]
                own_grams = grams[np.repeat(begins[rows] - (np.cumsum(own_size) - own_size), own_size) + np.arange(int(own_size.sum()))]
                x = network.inputs_again(fixed[rows], places[rows], own_grams, own_size)
                target = np.array([c[0] for c in chosen])
                g = network.gradients(x, places[rows], own_grams, own_size, at, target, share[target] * len(y) / len(part))
                step += 1
                for k, v in g.items():
                    # vectors of single words learn as fast as there are texts, or a few would be learnt by heart
                    rate = RATE * (1 - 0.8 * epoch / epochs) * ((len(y) / (len(y) + 1000)) ** 2 if k in ("word", "gram") else 1)
                    mean[k] += 0.1 * (v - mean[k])
                    square[k] += 0.01 * (v * v - square[k])
                    network.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Model(network, Odds(words, split, y), float(y.mean()))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of labelled documents: ``labels`` (doc_id, toxic) without those that are held out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    order = F.xxhash64("doc_id")
    # a few more than needed: some may have no text, or too long a one
    chosen = known.where("toxic = 0").orderBy(order, "doc_id").limit(2 * sample).union(known.where("toxic = 1").orderBy(order, "doc_id").limit(2 * sample))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("h", order).orderBy("h", "doc_id").collect()
    picked, count = [], [0, 0]
    for r in rows:
        if count[r.toxic] < sample:
            count[r.toxic] += 1
            picked.append(r)
    texts, marks = pa.array([r.text for r in picked], pa.large_string()), [r.toxic for r in picked]
    del rows, picked
    model = train(texts, marks)
    # the driver goes on with other stages
    give_back()
    return model


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1_500_000):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(column: str = "doc_id"):
    """Whether a row's label is never learnt: crc32 of the id as text is a multiple of five."""
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below the threshold. Labels of held-out rows are not learnt."""
    model = fit(docs, labels.where(~F.coalesce(held_out(), F.lit(True))))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1_500_000):
                score = own.score(batch.column(names.index("text")))
                yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
