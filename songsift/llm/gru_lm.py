"""Language model scores: a gated recurrent network with a class-factored softmax, beside exact counts.

1. ``split_blocks`` cuts texts into words.  A block is a bounded run of texts of
   one task with its own list of distinct words; a text becomes the places of
   its words in that list.
2. ``word_counts`` adds up the lists of the training texts.  That covers all of
   them, and the most common words become the network's vocabulary.
3. ``train`` starts the network on the driver, on a bounded sample.  Then every
   task goes on with its part of the training texts, all of them whole, and
   Spark averages the weights.
4. ``score_texts`` joins the counts back to the lists and reads each text from
   its first to its last word.  Texts go through the network side by side, a
   window of positions at a time, and each carries its state from one window
   to the next, so the likelihood is that of the whole text.

Common words lie in classes of equal size by falling count; the network gives the
probability of a class and then of the word within it.  All other words are in
one further class, within which a word has its share of ``count + 1``, an unseen
one that of a count of 0.  So any text has a probability above 0.

A null or empty text is its end alone.  Equal texts get equal scores up to rounding.
Rows without an id are not learned from.  Without a training text the network
is as it was set up and all words are in the further class.  An empty table gives
no rows.  Kept columns may not have the names of result columns.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songsift.llm.batches import TEXT, first_of_each, pieces, slices
from songsift.llm.word_bpe import pack_places, unpack_places
from songsift.operators.joins import lookup
from songsift.session import settle

#: Bytes of text in a block.
BLOCK = 16 << 20
#: Weights in a row when they are averaged.
PART = 1024
#: The end of a text, which no word can be, as words hold no blank.
END = " "
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))
RESULT = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


@dataclass(frozen=True)
class Settings:
    """``documents`` of up to ``words`` bound the first training, of about ``updates`` windows; the second one
    reads all training texts, at a tenth of the rate."""

    classes: int = 64
    members: int = 64
    hidden: int = 24
    window: int = 32
    documents: int = 600
    words: int = 512
    updates: int = 250
    lanes: int = 128
    rate: float = 0.01
    bytes_per_task: int = 32 << 20
    seed: int = 3


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words, a part of the text at a time."""
    return (part.split() for part in slices(text.translate(_LOWER)))


# The network.


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign, in place of the hyperbolic tangent, at a third of the time."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


class Network:
    """Weights by name, in single precision.

    Word numbers run from 0 to ``classes * members``, the last of which stands
    for all further words.  Class ``c`` has the words from ``c * members`` on.
    """

    def __init__(self, counts: np.ndarray, further: int, settings: Settings):
        """``counts`` of the common words by number, ``further`` tokens in all others."""
        random, self.settings = np.random.default_rng(settings.seed), settings
        classes, members, hidden = settings.classes, settings.members, settings.hidden
        mass = np.full(classes * members, 1e-6)
        mass[: len(counts)] = counts
        by_class = np.append(mass.reshape(classes, members).sum(axis=1), further + 1)
        small = lambda *shape: random.normal(0, 0.1, shape)
        weights = {
            "input": small(classes * members + 1, 3 * hidden),
            "state": small(hidden, 3 * hidden),
            "class": np.zeros((hidden, classes + 1)),
            "class_bias": np.log(by_class / by_class.sum()),
            "word": np.zeros((classes, hidden, members)),
            "word_bias": np.log(mass.reshape(classes, members) / by_class[:-1, None]),
        }
        self.weights = {name: w.astype(np.float32) for name, w in weights.items()}

    @property
    def further(self) -> int:
        return self.settings.classes * self.settings.members

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state of each lane, and what the way back needs."""
        size = self.settings.hidden
        given, back = np.take(self.weights["input"], x, axis=0), h @ self.weights["state"]
        gates = given[:, : 2 * size]
        gates += back[:, : 2 * size]
        gates = _squash(gates)
        gates += 1
        gates *= 0.5
        r, z, back = gates[:, :size], gates[:, size:], back[:, 2 * size :]
        n = r * back
        n += given[:, 2 * size :]
        n = _squash(n)
        new = h - n
        new *= z
        new += n
        return new, r, z, n, back

    @staticmethod
    def _softmax(logits: np.ndarray, own: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of the share of ``own`` in each row, and with ``learn`` its gradient."""
        np.minimum(logits, 60, out=logits)
        rows = np.arange(len(own))
        out = logits[rows, own]
        np.exp(logits, out=logits)
        total = logits @ np.ones((logits.shape[1], 1), logits.dtype)
        out -= np.log(total[:, 0])
        if learn:
            logits /= total
            logits[rows, own] -= 1
        return out, logits

    def output(self, states: np.ndarray, words: np.ndarray, learn: bool = False):
        """The natural logarithm of each word's probability; of a further word, of their class.

        With ``learn`` also the gradients of its negative sum by weight and by state.
        """
        w, members = self.weights, self.settings.members
        owner = words // members
        logits = states @ w["class"]
        logits += w["class_bias"]
        out, d = self._softmax(logits, owner, learn)
        if learn:
            grad = {"class": states.T @ d, "class_bias": d.sum(axis=0)}
            grad |= {"word": np.zeros_like(w["word"]), "word_bias": np.zeros_like(w["word_bias"])}
            d_states = d @ w["class"].T
        order = np.argsort(owner.astype(np.int16), kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(self.settings.classes + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            some = order[cuts[c] : cuts[c + 1]]
            h = states[some]
            logits = h @ w["word"][c]
            logits += w["word_bias"][c]
            share, d = self._softmax(logits, words[some] - c * members, learn)
            out[some] += share
            if learn:
                grad["word"][c], grad["word_bias"][c] = h.T @ d, d.sum(axis=0)
                d_states[some] += d @ w["word"][c].T
        return (out, grad, d_states) if learn else out

    def gradients(
        self, words: np.ndarray, given: np.ndarray, fresh: np.ndarray, h: np.ndarray
    ) -> tuple[float, dict, np.ndarray]:
        """Loss and gradients of one window (positions x lanes) from state ``h``; back through the window only.

        ``given`` are the words before each position, ``fresh`` marks the first
        ones of a text; a word below 0 is padding.  Also the state behind the window.
        """
        to = self.weights["state"]
        real, stays, before, trace = words >= 0, ~fresh[:, :, None], [], []
        for x, stay in zip(given, stays):
            before.append(h * stay)
            trace.append(self.step(x, before[-1]))
            h = trace[-1][0]
        states = np.stack([t[0] for t in trace])
        out, grad, d_real = self.output(states[real], words[real], learn=True)
        upstream = np.zeros_like(states)
        upstream[real] = d_real
        carry, d_state, d_in = np.zeros_like(h), np.zeros_like(to), []
        for t in range(len(given) - 1, -1, -1):
            _, r, z, n, back = trace[t]
            d_h = upstream[t] + carry
            d_n = d_h * (1 - z) * (1 - np.abs(n)) ** 2
            d_z = d_h * (before[t] - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            d_r = d_n * back * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            d_back = np.concatenate([d_r, d_z, d_n * r], axis=1)
            carry = (d_h * z + d_back @ to.T) * stays[t]
            d_state += before[t].T @ d_back
            d_in.append(np.concatenate([d_r, d_z, d_n], axis=1))
        grad["state"] = d_state
        grad["input"] = np.zeros_like(self.weights["input"])
        np.add.at(grad["input"], given[::-1].ravel(), np.concatenate(d_in))
        return float(-out.sum()), grad, h

    def fit(self, texts: list[np.ndarray], updates: int, rate: float) -> None:
        """Adam over windows of ``lanes`` runs of text side by side, which carry their states; a falling rate.

        ``texts`` are the numbers of their words.  They follow each other in the
        lanes, each from a new state and as if behind an end, until there were
        about ``updates`` windows, all texts once at least.
        """
        cfg, random, count = self.settings, np.random.default_rng(self.settings.seed), 0
        moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in self.weights.items()}
        total = sum(map(len, texts))
        size = -(-total // cfg.lanes)
        windows = -(-size // cfg.window)
        epochs = max(1, round(updates / windows))
        for _ in range(epochs):
            some = [texts[i] for i in random.permutation(len(texts))]
            columns = [np.concatenate(some), np.concatenate([np.append(0, t[:-1]) for t in some])]
            columns.append(np.concatenate([np.arange(len(t)) == 0 for t in some]))
            fill = windows * cfg.window * cfg.lanes
            words, given, fresh = (
                np.append(c, np.full(fill - total, none, c.dtype)).reshape(cfg.lanes, -1).T
                for c, none in zip(columns, (-1, 0, False))
            )
            h = np.zeros((cfg.lanes, cfg.hidden), np.float32)
            for at in range(0, len(words), cfg.window):
                part = slice(at, at + cfg.window)
                real = int((words[part] >= 0).sum())
                if not real:
                    continue
                _, grad, h = self.gradients(words[part], given[part], fresh[part], h)
                count += 1
                now = np.float32(rate * (1 - 0.9 * count / (epochs * windows)))
                for name, w in self.weights.items():
                    d, (m, v) = grad[name], moments[name]
                    d /= np.float32(real)
                    m += 0.1 * (d - m)
                    d *= d
                    v += 0.01 * (d - v)
                    w -= now * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.99**count)) + np.float32(1e-6))

    def log_probabilities(self, texts: list[np.ndarray], at_once: int = 1 << 13) -> np.ndarray:
        """The natural logarithm of the probability of each whole text, further words as their class.

        Longest texts first, so that those still running are always the first
        lanes.  States carry over from window to window.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes, sums = sizes[order], np.zeros(len(texts))
        flat = np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, np.int64)
        start = np.cumsum(sizes) - sizes
        h = np.zeros((len(texts), self.settings.hidden), np.float32)
        longest = int(sizes.max(initial=0))
        states, words, owners, waiting = [], [], [], 0

        def settle_window() -> None:
            if states:
                owner = np.concatenate(owners)
                out = self.output(np.concatenate(states), np.concatenate(words))
                sums[:] += np.bincount(owner, out, len(sums))

        for t in range(longest):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            before = flat[start[:live] + t - 1] if t else np.zeros(live, np.int64)
            h = self.step(before, h[:live])[0]
            states.append(h)
            words.append(flat[start[:live] + t])
            owners.append(np.arange(live))
            waiting += live
            if waiting >= at_once:
                settle_window()
                states, words, owners, waiting = [], [], [], 0
        settle_window()
        out = np.zeros(len(texts))
        out[order] = sums
        return out


# Counts.


def split_blocks(df: DataFrame, keep: list[str], text: str, block: int = BLOCK) -> DataFrame:
    """Texts and word lists of blocks.

    ``words`` is null for a text, which has ``n`` words and ``places``.  A row of
    a list has some ``words``, their places from ``n`` on, and in ``counts`` how
    often each occurs in training texts.  ``learn`` marks training texts.
    """
    types = dict(df.dtypes)
    schema = pa.schema(
        [("block", pa.int64()), ("n", pa.int64()), ("places", pa.binary())]
        + [("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        at: defaultdict[bytes, int] = defaultdict()
        at.default_factory = at.__len__
        held: list[pa.RecordBatch] = []
        found: list[np.ndarray] = []
        learns: list[bool] = []

        def rows(columns: list, kept: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(columns, schema.types)), *kept], [*schema.names, *keep, "_learn"]
            )

        def close() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(found)
            common = np.argsort(-np.bincount(every, minlength=len(at)), kind="stable")
            rank = np.empty(len(at), np.int32)
            rank[common] = np.arange(len(at))
            training = [p for p, learn in zip(found, learns) if learn]
            learned = np.bincount(rank[np.concatenate(training)] if training else [], minlength=len(at))
            done = 0
            for piece in held:
                for few in (piece.slice(k, 256) for k in range(0, piece.num_rows, 256)):
                    n = few.num_rows
                    own = found[done : done + n]
                    done += n
                    packed = [pack_places(rank[p]) for p in own]
                    columns = [[number] * n, [len(p) for p in own], packed, [None] * n, [None] * n]
                    yield rows(columns, [few.column(c) for c in [*keep, "_learn"]])
            spelled = list(at)
            for k in range(0, len(at), 4096):
                some = [spelled[w].decode("utf-8", "replace") for w in common[k : k + 4096].tolist()]
                none = [pa.nulls(1, few.column(c).type) for c in [*keep, "_learn"]]
                yield rows([[number], [k], [None], [some], [learned[k : k + 4096]]], none)

        for piece in pieces(batches):
            held.append(piece)
            learns += piece.column("_learn").to_pylist()
            for text_bytes in piece.column(TEXT).to_pylist():
                parts = [np.fromiter(map(at.__getitem__, p), np.int32, len(p)) for p in words_of(text_bytes or b"")]
                found.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
                size += len(text_bytes or b"")
            if size >= block:
                yield from close()
                number, size = number + 1, 0
                at.clear()
                held, found, learns = [], [], []
        if held:
            yield from close()

    kept = "".join(f", `{c}` {types[c]}" for c in keep)
    return df.select(*keep, "_learn", F.col(text).cast("binary").alias(TEXT)).mapInArrow(
        run, f"block bigint, n bigint, places binary, words array<string>, counts array<bigint>{kept}, _learn boolean"
    )


def listed(blocks: DataFrame) -> DataFrame:
    """``block``, ``place``, ``word`` and ``n`` occurrences in training texts, a row for each word of a block."""
    lists = blocks.filter("words is not null").select(
        "block", F.col("n").alias("first"), F.posexplode(F.arrays_zip("words", "counts")).alias("at", "of")
    )
    return lists.select("block", (F.col("first") + F.col("at")).alias("place"), F.col("of.words").alias("word"), F.col("of.counts").alias("n"))


def word_counts(blocks: DataFrame) -> DataFrame:
    """``word`` and its occurrences ``c`` in all training texts."""
    return listed(blocks).filter("n > 0").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Corpus:
    """What the training texts hold: tokens, distinct tokens, texts, and the common words with their counts."""

    tokens: int
    distinct: int
    texts: int
    common: list[str]
    counts: list[int]

    @property
    def base(self) -> float:
        """The denominator of a token's smoothed share."""
        return self.tokens + self.distinct + 1

    @property
    def further(self) -> int:
        """Occurrences of words that are not common, and one for each of them and for an unseen one."""
        own = self.tokens - sum(self.counts)
        return own + self.distinct - len(self.counts) + 1


def corpus_of(counts: DataFrame, texts: int, settings: Settings) -> Corpus:
    """The vocabulary is the end, number 0, and the most common words; its size is a setting."""
    total = counts.agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(settings.classes * settings.members - 1).collect()
    return Corpus(
        (total["tokens"] or 0) + texts,
        total["distinct"] + (texts > 0),
        texts,
        [END] + [r["word"] for r in top] if texts else [],
        [texts] + [r["c"] for r in top] if texts else [],
    )


# Training.


def _numbers(text: bytes, number: dict[bytes, int], further: int, most: int | None = None) -> np.ndarray:
    out, n = [], 0
    for part in words_of(text):
        out.append(np.fromiter((number.get(w, further) for w in part), np.int64, len(part)))
        n += len(part)
        if most is not None and n >= most:
            return np.concatenate(out)[:most]
    return np.concatenate([*out, np.zeros(1, np.int64)])


def _trainer(network: Network, number: dict[bytes, int], at_once: int = 1 << 18):
    """Goes on training with the texts of a task and gives the weights in parts, with the task's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[np.ndarray] = []
        tokens = held = 0

        def learn() -> None:
            network.fit(texts, 1, network.settings.rate / 10)
            texts.clear()

        for piece in pieces(batches):
            for text in piece.column(TEXT).to_pylist():
                texts.append(_numbers(text or b"", number, network.further))
                held += len(texts[-1])
                if held >= at_once:
                    tokens, held = tokens + held, 0
                    learn()
        if texts:
            tokens += held
            learn()
        if tokens:
            yield from _parts(network, tokens)

    return run


def _parts(network: Network, tokens: int) -> Iterator[pa.RecordBatch]:
    flat = np.concatenate([w.ravel() for w in network.weights.values()])
    parts = np.array_split(flat, -(-len(flat) // PART))
    for at in range(0, len(parts), 64):
        some = parts[at : at + 64]
        numbers = pa.array(range(at, at + len(some)), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [numbers, pa.array([tokens] * len(some)), pa.array(some, pa.list_(pa.float32()))], ["part", "tokens", "weights"]
        )


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a part's weights over all tasks, each times its tokens."""
    total, part, tokens = 0.0, None, 0
    for batch in batches:
        n = batch.column("tokens").to_numpy()
        weights = batch.column("weights").flatten().to_numpy().reshape(len(n), -1)
        part, tokens = batch.column("part")[0].as_py(), tokens + int(n.sum())
        total = total + n @ weights.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([tokens]), pa.array([total])], ["part", "tokens", "weights"])


def train(texts: DataFrame, corpus: Corpus, settings: Settings = Settings()) -> Network:
    """A network for the training ``texts``, which have ``_id`` and the text as binary."""
    network = Network(np.array(corpus.counts, float), corpus.further, settings)
    number = {w.encode(): i for i, w in enumerate(corpus.common)}
    first = first_of_each(texts.withColumn("_all", F.lit(1)), "_all", ["_id"], settings.documents)
    # Words have at least a byte and a blank, most have more; what is too much is cut below.
    cut = F.expr(f"substring({TEXT}, 1, {32 * settings.words})").alias(TEXT)
    rows = first.select("_hash", "_id", cut).orderBy("_hash", "_id").collect()
    some = [_numbers(bytes(r[TEXT] or b""), number, network.further, settings.words) for r in rows]
    some = [t for t in some if len(t)]
    if not some:
        return network
    network.fit(some, settings.updates, settings.rate)
    whole = texts.select(TEXT)
    # So many tasks that each has about the same text, as each sends all its weights.
    size = whole.agg(F.sum(F.octet_length(TEXT)).alias("n")).first()["n"] or 0
    whole = whole.coalesce(-(-size // settings.bytes_per_task) or 1)
    made = whole.mapInArrow(_trainer(network, number), "part bigint, tokens bigint, weights array<float>")
    averaged = made.groupBy("part").applyInArrow(_sum_parts, "part bigint, tokens bigint, weights array<double>")
    averaged = averaged.orderBy("part").collect()
    if averaged:
        # The start counts with its own tokens, so that few texts change little.
        start, more = sum(map(len, some)), averaged[0]["tokens"]
        flat, at = np.concatenate([r["weights"] for r in averaged]), 0
        for w in network.weights.values():
            w[...] = (w * start + flat[at : at + w.size].reshape(w.shape)) / (start + more)
            at += w.size
    return network


# Scores.


def _scorer(network: Network, corpus: Corpus, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, lists = [], []
        for batch in batches:
            is_text = batch.column("counts").is_null()
            texts.append(batch.filter(is_text))
            own = batch.filter(pc.invert(is_text))
            lists.append([own.column(c).flatten().to_numpy() for c in ("first", "counts", "numbers")])
        size = sum(len(first) for first, _, _ in lists)
        counts, numbers = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for first, c, number in lists:
            counts[first], numbers[first] = c, number
        base = np.log10((counts + 1) / corpus.base)
        further = np.where(numbers == network.further, np.log10((counts + 1) / corpus.further), 0)
        end = corpus.texts
        last = np.zeros(1, np.int64) if corpus.common else np.full(1, network.further)
        end_further = 0.0 if corpus.common else math.log10((end + 1) / corpus.further)
        for table in texts:
            for few in (table.slice(k, 1 << 13) for k in range(0, table.num_rows, 1 << 13)):
                places = [unpack_places(p) for p in few.column("places").to_pylist()]
                n = [len(p) + 1 for p in places]
                known = [int((counts[p] > 0).sum()) + (end > 0) for p in places]
                sums = [float(base[p].sum()) + math.log10((end + 1) / corpus.base) for p in places]
                own = network.log_probabilities([np.concatenate([numbers[p], last]) for p in places]) / math.log(10)
                score = own + [float(further[p].sum()) + end_further for p in places]
                yield pa.RecordBatch.from_arrays(
                    [*(few.column(c) for c in keep)]
                    + [pa.array(n), pa.array(known), pa.array([corpus.tokens] * len(n), pa.int64()), pa.array(sums), pa.array(score)],
                    [*keep, *RESULT],
                )

    return run


def score_texts(blocks: DataFrame, counts: DataFrame, network: Network, corpus: Corpus, keep: list[str]) -> DataFrame:
    """``keep`` and the fields of ``RESULT`` for each text of the blocks."""
    types = dict(blocks.dtypes)
    vocabulary = blocks.sparkSession.createDataFrame(
        list(enumerate(corpus.common)) or [(0, END)], "number bigint, word string"
    )
    words = counts.join(F.broadcast(vocabulary), "word", "left")
    number = F.coalesce("number", F.lit(network.further)).alias("number")
    known = lookup(listed(blocks).select("block", "place", "word"), words, "word").select(
        "block", "place", F.coalesce("c", F.lit(0)).alias("c"), number
    )
    # A list comes back in a few rows of bounded size.
    lists = known.groupBy("block", (F.col("place") / 4096).cast("bigint").alias("piece")).agg(
        F.collect_list("place").alias("first"), F.collect_list("c").alias("counts"), F.collect_list("number").alias("numbers")
    )
    array = "array<bigint>"
    lists = lists.select(
        *("block", F.lit(None).cast("binary").alias("places"), "first", "counts", "numbers"),
        *(F.lit(None).cast(types[c]).alias(c) for c in [*keep, "_learn"]),
    )
    texts = blocks.filter("words is null").select(
        *("block", "places"), *(F.lit(None).cast(array).alias(c) for c in ("first", "counts", "numbers")), *keep, "_learn"
    )
    schema = "".join(f"`{c}` {types[c]}, " for c in keep)
    schema += "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts.union(lists).groupBy("block").applyInArrow(_scorer(network, corpus, keep), schema)


def score_documents(
    df: DataFrame,
    learn: Column,
    keep: list[str],
    doc_id: str = "doc_id",
    text: str = "text",
    settings: Settings = Settings(),
    block: int = BLOCK,
) -> DataFrame:
    """Scores of all texts, by what the rows that ``learn`` marks hold."""
    clash = ({*RESULT, "block", "n", "places", "words", "counts", "first", "numbers"} & set(keep)) | {
        c for c in keep if c.startswith("_")
    }
    if clash:
        raise ValueError(f"rename {sorted(clash)} before keeping them")
    marked = df.withColumn("_learn", F.coalesce(learn, F.lit(False)))
    blocks = settle(split_blocks(marked, keep, text, block), "blocks")
    counts = settle(word_counts(blocks), "counts")
    corpus = corpus_of(counts, blocks.filter("words is null and _learn").count(), settings)
    texts = marked.filter("_learn").select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias(TEXT))
    return score_texts(blocks, counts, train(texts, corpus, settings), corpus, keep)
