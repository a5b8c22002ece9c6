"""Language model scores from a gated recurrent network with class-factored output.

The probability of a token is that of its class given the state, times that of the token in
its class. Head classes hold the most frequent tokens, in order of frequency, and give a
softmax over their members that also sees the state. All other tokens fall into tail
classes by their last byte; there a token has its share of the class's training count, and
one unknown token takes the share of tokens seen once (Good-Turing). The network is trained
with truncated backpropagation in numpy; for scoring, the state is carried through the
complete document.

Scale: counts cover every training token: one row per (word, block of documents), summed in
one shuffle and sent back to the blocks that hold the word, so no vocabulary is broadcast;
the texts are shuffled once, to their block, and become two bytes a token there, which are
stored. Only the ``HEAD`` most frequent tokens and the class totals reach the driver. The
network learns from every token of every training document, in parallel on shards of about
``SHARD_TOKENS``, so that training grows with the corpus and no shard does; weights are
averaged by Spark after each round, and each round reads its own part of the documents (a
corpus below ``LEAST_TOKENS`` a round is read whole in every round).

Defined cases: null counts as empty text, which is the end token alone; a null doc_id is
scored, neither held out nor learned from; without training documents all tokens are unknown
and the classes uniform; repeated rows are counted and scored as often as they occur. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import block_borders, block_numbers, deal_rows, stored
from .words import flat, hash_words, slices, split_words

HEAD = 1024  # tokens with a softmax of their own
PER_CLASS = 32
HEAD_CLASSES = HEAD // PER_CLASS
TAILS = 33  # tail classes: last byte modulo 32, and one for the end token when it is rare
CLASSES = HEAD_CLASSES + TAILS
HIDDEN = 32
WINDOW = 16  # steps of truncated backpropagation
TOGETHER = 16_384  # states whose probabilities are taken at once
SAFE = 80  # exp of less neither overflows nor vanishes in four bytes
STREAMS = 64
STEPS = 1000  # of training in a large shard
SHARD_TOKENS = 4_000_000
LEAST_TOKENS = 1_500_000  # of a round; a smaller corpus is read again, up to MOST_PASSES times
MOST_PASSES = 24
ROUNDS = 2
RATE = 3e-3
SCORE_TOKENS = 1_000_000  # tokens whose documents are scored together
SLICE = 1 << 20  # text bytes handled at once
BLOCK_BYTES = 16 << 20
DISTINCT = 500_000  # words counted in a task before they are sent
END = np.uint64(0x5BD1E9955BD1E995)  # stands for the end token among word hashes
ID = np.dtype("<i2")  # of a token

Weights = dict[str, np.ndarray]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end after each text, tail class, offsets per text)."""
    words = split_words(column, lower=True)
    at = words.first[1:]
    hashes = np.insert(hash_words(words), at, END)
    tail = words.data[words.ends - 1] % 32 if len(words.ends) else np.zeros(0, np.uint8)
    return hashes, np.insert(tail.astype(np.int16), at, TAILS - 1), words.first + np.arange(len(words.first))


# --- counts -------------------------------------------------------------------------


def _count_task(borders: list[int]):
    cuts = np.array(borders, np.int64)
    return lambda batches: _counts(batches, cuts)


def _summed(word: np.ndarray, block: np.ndarray, tail: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns with one row per word and block, ``n`` summed."""
    if not len(word):
        return word, block, tail, n
    order = np.argsort(word ^ (block.astype(np.uint64) << np.uint64(40)))
    word, block = word.take(order), block.take(order)
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    return word[at], block[at], tail[order[at]], np.add.reduceat(n.take(order), at)


def _counts(batches: Iterator[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per word and block of a task: its training count there (0 if only held out)."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def merged() -> tuple[np.ndarray, ...]:
        return _summed(*map(np.concatenate, zip(*held, strict=True)))

    def batch(word: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(word.view(np.int64)), *map(pa.array, rest)], names=["word", "block", "tail", "n"]
        )

    for part in slices(batches, "text", SLICE):
        hashes, tail, offsets = tokens(part.column("text"))
        sizes = np.diff(offsets)
        block = np.repeat(block_numbers(part.column("doc_id"), cuts), sizes)
        n = np.repeat(part.column("learn").to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        held.append(_summed(hashes, block, tail, n))
        size += len(held[-1][0])
        if size > DISTINCT:
            held = [merged()]
            size = len(held[0][0])
            if 2 * size > DISTINCT:
                yield batch(*held[0])
                held, size = [], 0
    if held:
        yield batch(*merged())


def counted(docs: DataFrame, borders: list[int]) -> DataFrame:
    """(word, block, tail, c, first): the corpus count of each word, for every block that holds it.

    ``first`` marks one row per word.
    """
    rows = docs.select("doc_id", "learn", "text").mapInArrow(_count_task(borders), "word bigint, block int, tail smallint, n bigint")
    by_word = Window.partitionBy("word")
    # dealt by word alone, so that neither the sums per block nor the windows move them again
    each = rows.repartition("word").groupBy("word", "block").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))
    return each.select(
        "word",
        "block",
        "tail",
        F.sum("n").over(by_word).alias("c"),
        (F.col("block") == F.min("block").over(by_word)).alias("first"),  # no order, so one sort serves both
    )


class Vocabulary:
    """Head tokens and tail totals; sizes are fixed, whatever the corpus."""

    def __init__(self, head: list[tuple[int, int, int]], tails: dict[int, tuple[int, int]], n: int, v: int):
        ranked = np.array([x[0] for x in head], np.int64).view(np.uint64)
        self.order = np.argsort(ranked)
        self.sorted = ranked[self.order]
        self.n, self.v = n, v
        self.head_counts = np.zeros(HEAD)
        self.head_counts[: len(head)] = [x[2] for x in head]
        self.size = len(head)
        total, once = np.zeros(TAILS), np.zeros(TAILS)
        for t, (s, o) in tails.items():
            total[t], once[t] = s, o
        for _, t, c in head:
            total[t] -= c
            once[t] -= c == 1
        self.tail_total = total
        self.unknown = np.clip((once + 0.5) / (total + 1), 1e-6, 0.9)
        self.unknown[total <= 0] = 1.0

    def ids(self, hashes: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Input id: rank among the head tokens, or HEAD plus the tail class."""
        out = HEAD + tail.astype(np.int64)
        if self.size:
            at = np.searchsorted(self.sorted, hashes)
            at[at == self.size] = 0
            known = self.sorted[at] == hashes
            out[known] = self.order[at[known]]
        return out

    def class_counts(self) -> np.ndarray:
        return np.concatenate([self.head_counts.reshape(-1, PER_CLASS).sum(axis=1), np.maximum(self.tail_total, 0)])


def classes(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < HEAD, ids // PER_CLASS, ids - HEAD + HEAD_CLASSES)


def vocabulary(words: DataFrame) -> Vocabulary:
    """From :func:`counted`: the most frequent words and the totals of the tail classes."""
    known = words.filter("first AND c > 0")
    head = known.orderBy(F.col("c").desc(), "word").limit(HEAD).select("word", "tail", "c").collect()
    totals = known.groupBy("tail").agg(F.sum("c").alias("s"), F.count_if(F.col("c") == 1).alias("o"), F.count(F.lit(1)).alias("v")).collect()
    return Vocabulary(
        [(r["word"], r["tail"], r["c"]) for r in head],
        {r["tail"]: (r["s"], r["o"]) for r in totals},
        sum(r["s"] for r in totals),
        sum(r["v"] for r in totals),
    )


# --- network ------------------------------------------------------------------------


def first_weights(vocab: Vocabulary) -> Weights:
    """Small random weights; output biases start at the counts."""
    g = np.random.default_rng(11)
    small = lambda *shape: (g.standard_normal(shape) * 0.1).astype(np.float32)
    class_counts = vocab.class_counts()
    return {
        "x": small(HEAD + TAILS, 3 * HIDDEN),  # input embedding times input weights
        "u": small(HIDDEN, 3 * HIDDEN),
        "wc": small(HIDDEN, CLASSES),
        "bc": np.log((class_counts + 0.5) / (class_counts.sum() + 0.5 * CLASSES)).astype(np.float32),
        "wh": small(HEAD, HIDDEN),
        "bh": np.log(vocab.head_counts + 0.5).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def gate_planes(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """``x`` and ``u`` with one plane a gate, so that the parts of a gate lie side by side."""
    x, u = (np.ascontiguousarray(w[k].reshape(-1, 3, HIDDEN).swapaxes(0, 1)) for k in "xu")
    return x, u


def _advance(h: np.ndarray, gates: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next state, and the candidate's recurrent sum; ``gates`` hold input sums and become z, r and n."""
    sums = h @ u
    zr, n = gates[:2], gates[2]
    zr += sums[:2]
    z, r = _sigmoid(zr)
    n += r * sums[2]
    np.tanh(n, out=n)
    out = h - n
    out *= z
    out += n
    return out, sums[2]


def step(w: Weights, h: np.ndarray, ids: np.ndarray):
    """Next state, and what backpropagation needs."""
    x, u = gate_planes(w)
    gates = x.take(ids, axis=1)
    out, hn = _advance(h, gates, u)
    return out, (h, *gates[:2], hn, gates[2])


def _picked(x: np.ndarray, at: np.ndarray, slope: bool) -> np.ndarray:
    """Log softmax of ``x`` at one column a row; with ``slope`` ``x`` becomes softmax minus that column."""
    if not -SAFE < x.min(initial=0) <= x.max(initial=0) < SAFE:
        x -= x.max(axis=1, keepdims=True)
    cells = x.reshape(-1)
    at = at + np.arange(0, x.size, x.shape[1])
    out = cells[at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    out -= np.log(total)
    if slope:
        x *= (1 / total)[:, None]
        cells[at] -= 1
    return out


def log_probability(w: Weights, h: np.ndarray, ids: np.ndarray, slope: bool = False):
    """Natural log of class and head-member probability per (state, id) row.

    With ``slope``: also the gradients of the summed negative log probability.
    """
    kind = classes(ids)
    d = h @ w["wc"]
    d += w["bc"]
    out = _picked(d, kind, slope)
    # rows of head tokens, sorted by class
    order = np.argsort(kind.astype(np.int8), kind="stable")
    borders = np.searchsorted(kind, np.arange(HEAD_CLASSES + 1), sorter=order).tolist()
    heads = order[: borders[-1]]
    member = ids[heads] % PER_CLASS
    lifted = np.ones((len(heads), HIDDEN + 1), h.dtype)  # a column of ones stands for the biases
    lifted[:, :HIDDEN] = h.take(heads, axis=0)
    weights = np.hstack([w["wh"], w["bh"][:, None]])
    filled = [
        (slice(a, b), slice(c * PER_CLASS, (c + 1) * PER_CLASS)) for c, (a, b) in enumerate(pairwise(borders)) if a < b
    ]
    e = np.empty((len(heads), PER_CLASS), h.dtype)
    for rows, members in filled:
        np.matmul(lifted[rows], weights[members].T, out=e[rows])
    out[heads] += _picked(e, member, slope)
    if not slope:
        return out
    by_member, back = np.zeros_like(weights), np.empty((len(heads), HIDDEN), h.dtype)
    for rows, members in filled:
        np.matmul(e[rows].T, lifted[rows], out=by_member[members])
        np.matmul(e[rows], w["wh"][members], out=back[rows])
    dh = d @ w["wc"].T
    dh[heads] += back
    by_bias = np.ones(len(d), d.dtype) @ d
    return out, {"wc": h.T @ d, "bc": by_bias, "wh": by_member[:, :-1].copy(), "bh": by_member[:, -1].copy()}, dh


def _window_slopes(w: Weights, h: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, Weights]:
    """State after the window, and gradients; ``ids`` and ``begin`` are (steps, streams)."""
    x, u = gate_planes(w)
    flat_ids = ids.ravel()
    gates = x.take(flat_ids, axis=1).reshape(3, *ids.shape, HIDDEN)
    states = np.empty(gates.shape[1:], h.dtype)
    hn = np.empty_like(states)
    go_on = (~begin).astype(h.dtype)[:, :, None]
    for t in range(len(ids)):
        np.multiply(h, go_on[t], out=states[t])
        h, hn[t] = _advance(states[t], gates[:, t], u)
    joined = states.reshape(-1, HIDDEN)
    _, grad, dstates = log_probability(w, joined, flat_ids, slope=True)
    dstates = dstates.reshape(states.shape)
    z, r, n = gates
    by_state = np.empty((2, *states.shape), h.dtype)  # slopes of the sums of n and z
    np.multiply(1 - z, 1 - n * n, out=by_state[0])
    np.multiply((states - n) * z, 1 - z, out=by_state[1])
    by_candidate = np.empty_like(by_state)  # of the sum of r and of the recurrent sum of n
    np.multiply(hn * r, 1 - r, out=by_candidate[0])
    by_candidate[1] = r
    sums = np.empty((4, *states.shape), h.dtype)  # n, z, r and the recurrent sum of n
    dh, back = np.zeros_like(h), u.swapaxes(1, 2).copy()
    for t in range(len(ids) - 1, -1, -1):
        np.multiply(dh, by_state[:, t], out=sums[:2, t])
        np.multiply(sums[0, t], by_candidate[:, t], out=sums[2:, t])
        dh *= z[t]
        for part in sums[1:, t] @ back:
            dh += part
        dh += dstates[t]
        dh *= go_on[t]
    sums = sums.reshape(4, -1, HIDDEN)
    grad["u"] = np.hstack(joined.T @ sums[1:])
    order = np.argsort(flat_ids.astype(np.int16), kind="stable")
    sorted_ids = flat_ids[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
    by_input = np.empty((len(order), 3 * HIDDEN), h.dtype)
    for k, gate in enumerate((1, 2, 0)):
        by_input[:, k * HIDDEN : (k + 1) * HIDDEN] = sums[gate].take(order, axis=0)
    twos = by_input.view(np.result_type(by_input, np.complex64))  # a sum over rows costs by the column
    grad["x"] = np.zeros_like(w["x"])
    grad["x"][sorted_ids[first]] = np.add.reduceat(twos, first, axis=0).view(by_input.dtype)
    return h, grad


def train(w: Weights, ids: np.ndarray, begin: np.ndarray, passes: int) -> Weights:
    """Adam over windows of parallel streams that cut the tokens in equal runs.

    There are ``STREAMS`` of them, more on a shard that would otherwise take over ``STEPS`` steps.
    Both moments are held without their factors of 0.1 and 0.01.
    """
    w = {k: v.copy() for k, v in w.items()}
    streams = max(1, min(max(STREAMS, len(ids) // (STEPS * WINDOW)), len(ids) // (4 * WINDOW)))
    length = -(-len(ids) // streams)
    fill = lambda a: np.resize(a, streams * length).reshape(streams, length).T.copy()
    ids, begin = fill(ids), fill(begin)
    begin[0] = True
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    steps, total = 0, passes * -(-length // WINDOW)
    for _ in range(passes):
        h = np.zeros((streams, HIDDEN), np.float32)
        for lo in range(0, length, WINDOW):
            h, grad = _window_slopes(w, h, ids[lo : lo + WINDOW], begin[lo : lo + WINDOW])
            n = ids[lo : lo + WINDOW].size
            steps += 1
            rate = RATE * (1 - 0.9 * steps / total) * 0.1 / (1 - 0.9**steps)
            spread = np.sqrt(0.01 / (1 - 0.99**steps))
            for k, g in grad.items():
                g *= np.float32(STREAMS / n)
                np.clip(g, -1, 1, out=g)
                mean[k] *= np.float32(0.9)
                mean[k] += g
                g *= g
                square[k] *= np.float32(0.99)
                square[k] += g
                np.sqrt(square[k], out=g)
                g += np.float32(1e-4 / spread)
                np.divide(mean[k], g, out=g)
                g *= np.float32(rate / spread)
                w[k] -= g
    return w


def _pack(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _unpack(values: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _train_shards(w: Weights, passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard."""
        shard, parts, begins = None, [], []

        def trained() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            out = _pack(train(w, ids, np.concatenate(begins), passes))
            lists = pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))
            return pa.RecordBatch.from_arrays([pa.array([len(ids)]), lists], names=["n", "w"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.diff(shards)) + 1
            for a, b in zip([0, *edges], [*edges, len(shards)], strict=True):
                if a == b:
                    continue
                if shards[a] != shard:
                    if parts:
                        yield trained()
                    shard, parts, begins = shards[a], [], []
                raw, offsets = flat(batch.column("ids").slice(a, b - a))
                ids = raw.view(ID)
                first = np.zeros(len(ids), bool)
                first[offsets[:-1] // ID.itemsize] = True  # every document has its end token
                parts.append(ids.copy())
                begins.append(first)
        if parts:
            yield trained()

    return run


def fit(encoded: DataFrame, vocab: Vocabulary) -> Weights:
    """Network trained on every document of :func:`encoded_documents` that is to be learned from."""
    w = first_weights(vocab)
    learned = encoded.filter("learn")
    total = learned.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return w
    again = total < ROUNDS * LEAST_TOKENS  # every round reads all documents
    shards = -(-total // (SHARD_TOKENS if again else ROUNDS * SHARD_TOKENS))
    passes = int(min(MOST_PASSES, max(1, LEAST_TOKENS // total)))
    drawn = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n))
    for turn in range(ROUNDS):
        part = learned if again else learned.filter(drawn(ROUNDS, "round") == turn)
        rows = part.select(drawn(shards, "shard").alias("shard"), F.xxhash64("doc_id", F.lit(1)).alias("place"), "ids")
        dealt = rows.repartition(int(shards), "shard").sortWithinPartitions("shard", "place")
        trained = dealt.select("shard", "ids").mapInArrow(_train_shards(w, passes), "n bigint, w array<float>")
        each = trained.select("n", F.posexplode("w").alias("at", "value"))
        mean = each.groupBy("at").agg((F.sum(F.col("value").cast("double") * F.col("n")) / F.sum("n")).alias("value"))
        found = mean.toArrow()  # one row per weight
        values = np.zeros(found.num_rows)
        values[found.column("at").to_numpy()] = found.column("value").to_numpy()
        w = _unpack(values, w)
    return w


# --- scores -------------------------------------------------------------------------


def sequence_scores(w: Weights, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log probability of classes and head members, summed per document.

    Documents run side by side, longest first, with their states; states are held until
    ``TOGETHER`` of them can be looked at.
    """
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], offsets[:-1][order]
    out = np.zeros(len(order))
    x, u = gate_planes(w)
    h = np.zeros((len(order), HIDDEN), np.float32)
    longest = int(sizes[0]) if len(sizes) else 0
    lives = np.searchsorted(-sizes, -np.arange(longest), side="left")  # documents longer than t
    states, targets, held = [], [], 0
    for t, live in enumerate(lives.tolist()):
        now = ids[starts[:live] + t]
        states.append(h[:live])
        targets.append(now)
        held += live
        if held >= TOGETHER or t + 1 == longest:
            value = log_probability(w, np.concatenate(states), np.concatenate(targets))
            at = 0
            for part in targets:
                out[: len(part)] += value[at : at + len(part)]
                at += len(part)
            states, targets, held = [], [], 0
        h = _advance(h[:live], x.take(now, axis=1), u)[0]
    back = np.zeros(len(out))
    back[order] = out
    return back


ENCODED = (
    "doc_id bigint, held_out boolean, learn boolean, n_tokens bigint, n_known bigint, base_score double, "
    "inside double, ids binary"
)


def _encode_task(vocab: Vocabulary):
    most = vocab.n + vocab.v + 1

    def encode(docs: pa.RecordBatch, table: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        hashes, tail, offsets = tokens(docs.column("text"))
        # every word of the slice is looked up once, in the order of the table
        order = np.argsort(hashes)
        ranked = hashes.take(order)
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        of_word = np.empty(len(order), np.int64)
        of_word[order] = np.cumsum(new) - 1
        hashes, tail = ranked[new], tail[order[new]]
        c = np.zeros(len(hashes), np.int64)
        if len(table):
            at = np.searchsorted(table, hashes)
            at[at == len(table)] = 0
            c = np.where(table[at] == hashes, counts[at], 0)
        ids = vocab.ids(hashes, tail)
        inside = np.zeros(len(ids))
        rare = np.flatnonzero(ids >= HEAD)
        t = ids[rare] - HEAD
        unknown = vocab.unknown[t]
        share = np.where(c[rare] > 0, (1 - unknown) * c[rare] / np.maximum(vocab.tail_total[t], 1), unknown)
        inside[rare] = np.log10(np.maximum(share, 1e-300))
        each = lambda values: np.add.reduceat(values.take(of_word), offsets[:-1])
        packed = pa.py_buffer(ids.astype(ID).take(of_word).tobytes())
        lists = pa.Array.from_buffers(
            pa.binary(), len(docs), [None, pa.py_buffer((offsets * ID.itemsize).astype(np.int32)), packed]
        )
        return pa.RecordBatch.from_arrays(
            [
                docs.column("doc_id"),
                docs.column("held_out"),
                docs.column("learn"),
                pa.array(np.diff(offsets)),
                pa.array(each((c > 0).astype(np.int64))),
                pa.array(each(np.log10((c + 1) / most))),
                pa.array(each(inside)),
                lists,
            ],
            names=[c.split()[0] for c in ENCODED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (block, kind): the block's words, then its documents."""
        block, words, counts = None, [], []
        table = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for part in slices(batches, "text", SLICE):
            blocks = part.column("block").to_numpy()
            kinds = part.column("kind").to_numpy()
            edges = np.flatnonzero(np.diff(blocks) | np.diff(kinds)) + 1
            for a, b in zip([0, *edges], [*edges, len(blocks)], strict=True):
                some = part.slice(a, b - a)
                if blocks[a] != block:
                    block, words, counts, table = blocks[a], [], [], None
                if kinds[a] == 0:
                    words.append(some.column("word").to_numpy().view(np.uint64))
                    counts.append(some.column("c").to_numpy())
                    continue
                if table is None:
                    joined = np.concatenate([np.zeros(0, np.uint64), *words])
                    order = np.argsort(joined)
                    table = joined[order], np.concatenate([np.zeros(0, np.int64), *counts])[order]
                    words, counts = [], []
                yield encode(some, *table)

    return run


def encoded_documents(rows: DataFrame, words: DataFrame, borders: list[int], vocab: Vocabulary) -> DataFrame:
    """Every document as ids of two bytes, with its base score and what its tail tokens add."""
    none = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("bigint")
    lexicon = words.select(
        "block", F.lit(0).alias("kind"), none("bigint").alias("doc_id"), none("boolean").alias("held_out"),
        none("boolean").alias("learn"), F.lit("").alias("text"), "word", "c",
    )
    texts = deal_rows(rows, borders).select(
        "block", F.lit(1).alias("kind"), "doc_id", "held_out", "learn", "text", zero.alias("word"), zero.alias("c")
    )
    joined = lexicon.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")
    return joined.mapInArrow(_encode_task(vocab), ENCODED)


SCHEMA = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)


def _score_task(w: Weights, train_tokens: int):
    def scored(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        docs = pa.Table.from_batches(batches).combine_chunks()
        raw, offsets = flat(docs.column("ids"))
        model = sequence_scores(w, raw.view(ID), offsets // ID.itemsize) / np.log(10)
        kept = {c: docs.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")}
        kept["train_tokens"] = pa.array(np.full(len(docs), train_tokens, np.int64))
        kept["score"] = pa.array(model + docs.column("inside").to_numpy())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([kept[c] for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, waiting = [], 0
        for part in slices(batches, "ids", SCORE_TOKENS * ID.itemsize):
            ready.append(part)
            waiting += pc.sum(part.column("n_tokens")).as_py()
            if waiting > SCORE_TOKENS:
                yield scored(ready)
                ready, waiting = [], 0
        if ready:
            yield scored(ready)

    return run


def score(docs: DataFrame, held_out) -> DataFrame:
    """Scores of all rows of ``docs``, learning from those where ``held_out`` is false."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(~held_out, F.lit(False)).alias("learn"),
    )
    borders = block_borders(rows, BLOCK_BYTES)
    words = stored(counted(rows, borders), "words")
    vocab = vocabulary(words)
    encoded = stored(encoded_documents(rows, words, borders, vocab), "encoded")
    w = fit(encoded, vocab)
    return encoded.drop("learn").mapInArrow(_score_task(w, vocab.n), SCHEMA)
