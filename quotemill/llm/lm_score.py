"""LM scoring: a causal self-attention model over subword ids, trained in numpy, and word counts of the whole corpus.

The model reads a text's subword ids in windows of CONTEXT + BLOCK that overlap by CONTEXT: every id is scored once, in the
block of one window, with at least the context before it that the text has. Many windows go through masked attention at
once. The model predicts the class of the next id from the attended ids; within its class an id has a share.

Ids of a class are in groups, of which the commonest ids have one each. The group of the last id shifts the shares of the
class's groups, as counted for pairs of groups, so the share too follows the text.

Classes, shares and weights come from all training documents, in whole. Texts are cut into pieces of whole windows that
keep the context before them; only a text's last piece has the end. All texts are cut into ids once, for learning and scoring. Counts of ids and of their neighbours are summed over
all pieces. Weights learn in rounds: each piece belongs to one round, and in it to one shard of a bounded number of windows,
dealt by hash. A task goes through its shard's windows, and the weights of all shards are averaged in tasks, by windows, and
embeddings by how often they were met. So steps grow with the corpus, and small corpora are gone through several times.

Word counts cover all training documents. The commonest words, in bounded number, reach the tasks; rarer words of the
documents are joined with their counts by shuffle.

Null and empty texts are the end alone. Texts are scored whole. Repeated rows are scored each for itself, ties among words
go by the word, without training documents all probabilities are uniform, an empty table gives an empty one, and other
columns play no part.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder_is, settled, steps, table, texts
from .packing import default_tokenizer, part_ids

VOCABULARY = 49_408
BEGIN, END = 49_406, 49_407
CONTEXT, BLOCK = 16, 32
SPAN = CONTEXT + BLOCK
CLASSES, WIDTH, KEY, HIDDEN = 32, 8, 8, 16
#: Cells that ids on one side of an id are hashed to, for its class.
CELLS = 64
#: Groups of ids in a class, how many of them hold one common id each, and pairs that the shares without context count as.
GROUPS, SINGLE, PRIOR = 64, 56, 8.0
#: Small corpora are gone through until there are so many steps.
STEPS, BATCH, RATE, ROW_RATE = 125, 256, 0.03, 0.2
#: Ids of one piece of a text (a multiple of BLOCK), windows of one shard, about, and rounds after which shards are averaged.
PIECE, SHARD_WINDOWS, ROUNDS = 512 * BLOCK, 32_768, 4
#: Pieces that are scored at a time.
PIECES = 64
#: Rows that the sums of one kind are dealt to, by id or group, and rows of one of them that a task adds.
CHUNKS, FAN = 49, 32
#: Words whose counts reach the tasks.
COMMON_WORDS = 100_000
END_WORD = "\n"
STEP_BYTES = 6_000_000


def neighbours(pieces: list[tuple[np.ndarray, bool, bool]], seen: np.ndarray | None = None) -> np.ndarray:
    """For each id the hashes of the ids after and before it, and its count; pieces that do not begin their text repeat a block."""
    seen = np.zeros(VOCABULARY * (2 * CELLS + 1), np.int64) if seen is None else seen
    for own, begins, ends in pieces:
        ids = np.append(own, END).astype(np.int64) if ends else own.astype(np.int64)
        ids = ids if begins else ids[BLOCK - 1 :]  # the last id before is a neighbour, and counted by the piece it is from
        at = ids * (2 * CELLS + 1)
        np.add.at(seen, at[:-1] + ids[1:] * 31 % CELLS, 1)
        np.add.at(seen, at[1:] + CELLS + ids[:-1] * 31 % CELLS, 1)
        np.add.at(seen, at[not begins :] + 2 * CELLS, 1)
    return seen


def neighbour_classes(seen: np.ndarray, seed: int = 5) -> np.ndarray:
    """A class for each id, by k-means over its neighbours' hashes; ids not seen are dealt evenly."""
    rng = np.random.default_rng(seed)
    out = np.arange(VOCABULARY) % CLASSES
    known = np.flatnonzero(seen.sum(axis=1) >= 3)
    if len(known) < CLASSES:
        return out
    points = np.sqrt(seen[known], dtype=np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    out[known] = clusters(points, seen[known].sum(axis=1), CLASSES, rng)
    return out


def clusters(points: np.ndarray, weight: np.ndarray, number: int, rng: np.random.Generator) -> np.ndarray:
    """The cluster of each point of length one, by k-means."""
    centers = points[rng.choice(len(points), number, replace=False, p=weight / weight.sum())]
    for _ in range(8):
        of = (points @ centers.T).argmax(axis=1)
        for k in range(number):
            if (of == k).any():
                centers[k] = np.average(points[of == k], axis=0, weights=weight[of == k])
                centers[k] /= np.linalg.norm(centers[k])
    return of


def groups_of(classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A group for each id: SINGLE ids of each class, the commonest, have their own; the rest are dealt by how common they are."""
    order = np.lexsort((np.arange(VOCABULARY), -counts, classes))
    size = np.bincount(classes, minlength=CLASSES)
    rank = np.empty(VOCABULARY, np.int64)
    rank[order] = np.arange(VOCABULARY) - np.repeat(np.cumsum(size) - size, size)
    band = SINGLE + np.maximum(0, np.log2(np.maximum(rank, SINGLE) / SINGLE)).astype(np.int64)
    return classes * GROUPS + np.where(rank < SINGLE, rank, np.minimum(band, GROUPS - 1))


def cut(ids: np.ndarray) -> list[tuple[np.ndarray, bool, bool]]:
    """Pieces of a text: their ids, and whether the text begins and ends with them. All but the first repeat the block before."""
    starts = range(0, len(ids) + 1, PIECE)
    return [(ids[max(0, at - BLOCK) : at + PIECE], at == 0, at + PIECE > len(ids)) for at in starts]


def windows(ids: list[np.ndarray], begins: np.ndarray | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Inputs (-1: before the text) and targets (-1: after it) of all windows, the text of each window, and the ids before it.

    Without ``begins`` and ``ends`` all are whole texts; else the block that a later piece repeats is context alone.
    """
    begins = np.ones(len(ids), bool) if begins is None else np.asarray(begins, bool)
    ends = np.ones(len(ids), bool) if ends is None else np.asarray(ends, bool)
    sizes = np.array([len(own) for own in ids], np.int64) + ends
    number = -(-sizes // BLOCK)
    padded = number * BLOCK
    first = np.cumsum(padded) - padded
    blank = np.full(SPAN, -1, np.int32)
    tail = np.r_[np.int32(END), blank]
    tails = zip(ids, ends.tolist(), (padded - sizes).tolist(), strict=True)
    rows = (x for own, last, more in tails for x in (own, tail[: 1 + more] if last else blank[:more]))
    flat = np.concatenate([blank[: CONTEXT + 1], *rows, blank], dtype=np.int32)
    targets = flat[CONTEXT + 1 :][: padded.sum()].reshape(-1, BLOCK)
    text = np.repeat(np.arange(len(ids)), number)
    start = np.arange(len(text)) * BLOCK  # of the block in the padded texts
    back = start - first[text]  # ids of the text before the block
    inputs = np.lib.stride_tricks.sliding_window_view(flat, SPAN)[: padded.sum() : BLOCK].copy()
    inputs[back == 0, :CONTEXT], inputs[back == 0, CONTEXT] = -1, BEGIN
    own = (back > 0) | begins[text]
    return (inputs, targets, text, back) if own.all() else (inputs[own], targets[own], text[own], back[own])


def within(x: np.ndarray, most: float) -> np.ndarray:
    """The array with its values held to -most to most. Few arrays have others, and to see that costs less than to hold them."""
    return x if x.size and -most <= x.min() and x.max() <= most else np.clip(x, -most, most, out=x)


def passes(number: int) -> int:
    """How often ``number`` windows of a whole corpus are gone through."""
    return max(1, -(-STEPS * BATCH // max(1, number)))


class Attention:
    """Embeddings, one head of masked attention with biases by distance, a hidden layer, class logits; shares within classes.

    ``seen`` has the sums of ``neighbours`` over a corpus, for weights that learn later; without it the model learns from ``ids`` alone.
    """

    def __init__(self, ids: list[np.ndarray], seed: int = 3, seen: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        alone = seen is None
        seen = neighbours([(own, True, True) for own in ids] if alone else [], seen).reshape(VOCABULARY, -1)
        self.classes = neighbour_classes(seen[:, :-1])
        counts = seen[:, -1] + 0.1
        self.share = np.log(counts / np.bincount(self.classes, counts, CLASSES)[self.classes]).astype(np.float32)
        self.groups, self.shift = groups_of(self.classes, counts), None
        self.in_group = np.bincount(self.groups, counts, CLASSES * GROUPS)
        self.tables = None
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {
            "e": (rng.normal(0, 0.3, (VOCABULARY, WIDTH))).astype(np.float32),
            "q": normal(WIDTH, KEY),
            "k": normal(WIDTH, KEY),
            "v": normal(WIDTH, WIDTH),
            "r": np.zeros(SPAN, np.float32),
            "o": normal(WIDTH, HIDDEN),
            "x": normal(WIDTH, HIDDEN),
            "b": np.zeros(HIDDEN, np.float32),
            "c": normal(HIDDEN, CLASSES),
            "d": np.zeros(CLASSES, np.float32),
        }
        distance = CONTEXT + np.arange(BLOCK)[None] - np.arange(SPAN)[:, None]
        self.future, self.distance = distance < 0, np.maximum(distance, 0)
        if ids and alone:
            inputs, targets, *_ = windows(ids)
            self.learn(inputs, targets, passes(len(inputs)), rng)

    def follow(self, pairs: np.ndarray) -> None:
        """Takes the counts of pairs of groups, by the first and the second."""
        alone = self.in_group.reshape(CLASSES, GROUPS)
        alone = (alone / np.maximum(alone.sum(axis=1, keepdims=True), 1e-9)).reshape(1, -1)
        seen = pairs.reshape(-1, CLASSES, GROUPS).sum(axis=2).repeat(GROUPS, axis=1)
        chance = (pairs + PRIOR * alone) / (seen + PRIOR)
        self.shift = np.log(chance / np.maximum(alone, 1e-30), where=alone > 0, out=np.zeros(pairs.shape)).astype(np.float32)

    def attend(self, inputs: np.ndarray) -> tuple:
        """Attention is laid out as (window, key, query) and class logits as (class, place), so that sums run over rows.

        Attention and logits are exponents before they are divided by their sums. Values, laid out as (window, value, key), have
        ones at their end, so that the product that mixes them gives the sums too. ``tables`` has what weights make of each id.
        """
        p, n = self.p, len(inputs)
        at = np.maximum(inputs, 0)
        if self.tables:
            x = last = None
            kv = self.tables[0].take(at.ravel(), axis=0)
            own = self.tables[1].take(at[:, CONTEXT:].ravel(), axis=0)
            q, h = own[:, :KEY].reshape(n, BLOCK, KEY), own[:, KEY:]
        else:
            x = p["e"].take(at.ravel(), axis=0)
            kv = x @ np.hstack([p["k"], p["v"]])
            last = x.reshape(n, SPAN, WIDTH)[:, CONTEXT:].reshape(-1, WIDTH)
            q = (last @ (p["q"] / np.float32(np.sqrt(KEY)))).reshape(n, BLOCK, KEY)
            h = last @ p["x"]
            h += p["b"]
        kv = kv.reshape(n, SPAN, KEY + WIDTH)
        k, v = kv[..., :KEY], np.empty((n, WIDTH + 1, SPAN), np.float32)
        v[:, :WIDTH], v[:, WIDTH] = kv[..., KEY:].transpose(0, 2, 1), 1
        a = k @ np.ascontiguousarray(q.transpose(0, 2, 1))
        np.exp(within(a, 30), out=a)
        a *= np.where(self.future, np.float32(0), np.exp(p["r"])[self.distance])
        some = np.flatnonzero((inputs[:, 0] < 0) | (inputs[:, -1] < 0))
        a[some] *= (inputs[some] >= 0)[:, :, None]
        mixed = v @ a
        total = mixed[:, WIDTH:] + np.float32(1e-30)
        mixed[:, :WIDTH] /= total
        mixed = mixed[:, :WIDTH].transpose(0, 2, 1).reshape(-1, WIDTH)
        h = np.add(mixed @ p["o"], h)
        np.tanh(h, out=h)
        chance = p["c"].T @ h.T
        chance += p["d"][:, None]
        return x, last, q, k, v, a, total, mixed, h, within(chance, 60)

    def forward(self, inputs: np.ndarray) -> tuple:
        """What ``attend`` gives, and last the log probabilities of the classes by window and place."""
        *rest, logits = self.attend(inputs)
        logits = logits - np.log(np.exp(logits).sum(axis=0))
        return *rest, logits.T.reshape(len(inputs), BLOCK, CLASSES)

    def learn(self, inputs: np.ndarray, targets: np.ndarray, times: int, rng: np.random.Generator, since: float = 0.0, until: float = 1.0) -> np.ndarray:
        """Goes through all windows so many times, from one share of the whole training to another; how often each embedding was met."""
        self.tables, dense = None, [name for name in self.p if name != "e"]
        until_name = np.cumsum([self.p[name].size for name in dense])
        first, second = np.zeros((2, until_name[-1]), np.float32)
        met, square = np.zeros(VOCABULARY, np.int64), np.zeros(VOCABULARY, np.float32)
        order = np.concatenate([rng.permutation(len(inputs)) for _ in range(times)])
        for step, at in enumerate(range(0, len(order), BATCH), 1):
            some = order[at : at + BATCH]
            share = min(1.0, 2 * (1 - since - (until - since) * at / len(order)) + 1e-3)
            rows, grads = self.gradients(inputs.take(some, axis=0), targets.take(some, axis=0))
            met[rows] += 1
            own = grads.pop("e")  # one size of steps for all of an id's weights
            square[rows] += np.einsum("ij,ij->i", own, own) / WIDTH
            own *= (ROW_RATE * share / (np.sqrt(square[rows]) + 1e-6)).astype(np.float32)[:, None]
            self.p["e"][rows] = self.p["e"].take(rows, axis=0) - own
            grad = np.concatenate([grads[name].ravel() for name in dense])
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad**2
            move = (RATE * share * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            for name, values in zip(dense, np.split(move, until_name[:-1]), strict=True):
                self.p[name] -= values.reshape(self.p[name].shape)
        return met

    def gradients(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The ids among the inputs, and all gradients; that of the embeddings is for these ids alone."""
        p, n = self.p, len(inputs)
        x, last, q, k, v, a, total, mixed, h, logits = self.attend(inputs)
        targets = targets.ravel()
        live = np.flatnonzero(targets >= 0)
        g = np.exp(logits, out=logits)
        g /= g.sum(axis=0)
        g.reshape(-1)[self.classes.take(targets.take(live)) * len(targets) + live] -= 1
        g *= (targets >= 0) / np.float32(max(1, len(live)))
        gh = g.T @ p["c"].T
        slope = h * h
        gh *= np.subtract(1, slope, out=slope)
        gm = gh @ p["o"].T
        gm /= total.reshape(-1, 1)
        back = np.empty((n, WIDTH + 1, BLOCK), np.float32)  # last: what all weights of a place share, against the ones
        np.negative(np.einsum("ij,ij->i", gm, mixed).reshape(n, BLOCK), out=back[:, WIDTH])
        gm = gm.reshape(n, BLOCK, WIDTH)
        back[:, :WIDTH] = gm.transpose(0, 2, 1)
        gs = v.transpose(0, 2, 1) @ back
        gs *= a
        gr = np.bincount(self.distance.ravel(), np.where(self.future, 0, np.einsum("ijk->jk", gs)).ravel(), SPAN).astype(np.float32)
        gq = (gs.transpose(0, 2, 1) @ k).reshape(-1, KEY) / np.float32(np.sqrt(KEY))
        gkv = np.empty((n, SPAN, KEY + WIDTH), np.float32)
        np.matmul(gs, q, out=gkv[..., :KEY])
        np.matmul(a, gm, out=gkv[..., KEY:])
        gkv = gkv.reshape(-1, KEY + WIDTH)
        gx = gkv @ np.hstack([p["k"], p["v"]]).T
        here = gq @ p["q"].T
        here += gh @ p["x"].T
        gx.reshape(n, SPAN, WIDTH)[:, CONTEXT:] += here.reshape(n, BLOCK, WIDTH)
        ids = inputs.ravel().astype(np.uint16)  # sorted by digits; -1 becomes the largest
        order = np.argsort(ids, kind="stable")[: np.count_nonzero(inputs >= 0)]
        ids = ids[order]
        starts = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1]
        gk = x.T @ gkv
        return ids[starts], {
            "e": np.add.reduceat(gx.take(order, axis=0), starts, axis=0),
            "q": last.T @ gq,
            "k": gk[:, :KEY],
            "v": gk[:, KEY:],
            "r": gr,
            "o": mixed.T @ gh,
            "x": last.T @ gh,
            "b": np.einsum("ij->j", gh),
            "c": (g @ h).T,
            "d": g.sum(axis=1),
        }

    def score(self, ids: list[np.ndarray], at_once: int = 256, begins: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each text's ids and its end, or of pieces of texts."""
        p = self.p
        plain = np.hstack([p["q"] / np.float32(np.sqrt(KEY)), p["x"]]), np.r_[np.zeros(KEY, np.float32), p["b"]]
        self.tables = self.tables or (p["e"] @ np.hstack([p["k"], p["v"]]), p["e"] @ plain[0] + plain[1])
        inputs, targets, text, _ = windows(ids, begins, ends)
        out = np.zeros(len(ids))
        for at in range(0, len(inputs), at_once):
            own = targets[at : at + at_once].ravel()
            logits = self.attend(inputs[at : at + at_once])[-1]
            place = np.flatnonzero(own >= 0)
            found = own.take(place)
            nats = self.share.take(found) + logits.take(self.classes.take(found) * len(own) + place)
            nats -= np.log(np.exp(logits, out=logits).sum(axis=0)).take(place)
            if self.shift is not None:
                before = self.groups.take(inputs[at : at + at_once, CONTEXT:].ravel().take(place))
                nats += self.shift.take(before * (CLASSES * GROUPS) + self.groups.take(found))
            out += np.bincount(text[at : at + at_once][place // BLOCK], nats, len(ids))
        return out


def flat_words(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts with A-Z in lower case, and the text of each."""
    # Lower case first: after a cast of a slice, whose offsets do not begin at 0, Arrow would change the wrong bytes.
    split = pc.ascii_split_whitespace(pc.ascii_lower(values).cast(pa.large_string()))
    own = split.flatten()
    of = np.repeat(np.arange(len(values)), np.diff(split.offsets.to_numpy()))
    solid = pc.greater(pc.binary_length(own), 0)
    if pc.all(solid).as_py():
        return own, of
    return own.filter(solid), of[solid.to_numpy(zero_copy_only=False)]


def filled(batch: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(batch.column("text"), "")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents, with one end word for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                found = flat_words(filled(part))[0].value_counts()
                names = pa.concat_arrays([found.field("values").cast(pa.string()), pa.array([END_WORD])])
                numbers = pa.concat_arrays([found.field("counts"), pa.array([part.num_rows], pa.int64())])
                yield pa.RecordBatch.from_arrays([names, numbers], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


PARTS = "chunk int, shard bigint, places binary, weights binary, means binary"


def parts_of(cell: np.ndarray, weight: np.ndarray, mean: np.ndarray, shard: int, wide: int = 1, first: int = 0) -> pa.RecordBatch:
    """Rows of PARTS. Runs of ``wide`` cells, such as those of one id, are dealt to the chunks from ``first`` in turn, so that common ids are spread."""
    run, place = np.divmod(cell, wide)
    turn, chunk = np.divmod(run, CHUNKS)
    order = np.argsort(chunk.astype(np.uint8), kind="stable")
    chunk, place, weight, mean = first + chunk[order], (turn * wide + place)[order], weight[order], mean[order]
    return rows_of(chunk, place, weight, mean, shard)


def cells(row: dict, wide: int = 1, first: int = 0) -> np.ndarray:
    """The cells that a row of ``parts_of`` is about."""
    turn, place = np.divmod(np.frombuffer(row["places"], "<i4").astype(np.int64), wide)
    return (turn * CHUNKS + row["chunk"] - first) * wide + place


def rows_of(chunk: np.ndarray, place: np.ndarray, weight: np.ndarray, mean: np.ndarray, shard: int) -> pa.RecordBatch:
    """Rows of PARTS; chunks are in order."""
    starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else np.empty(0, int)
    split = lambda values, kind: [x.astype(kind).tobytes() for x in np.split(values, starts[1:])] if len(starts) else []
    columns = [pa.array(chunk[starts], pa.int32()), pa.array([shard] * len(starts), pa.int64())]
    columns += [pa.array(split(*x), pa.binary()) for x in ((place, "<i4"), (weight, "<f8"), (mean, "<f4"))]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "shard", "places", "weights", "means"])


def merged(parts: DataFrame, shards: int) -> pa.Table:
    """Sums of the weights and weighted means over so many shards, one row for each chunk, added up in tasks, FAN at most at a time."""
    while True:
        parts, shards = added(parts), -(-shards // FAN)
        if shards <= 1:
            return parts.toArrow()


def added(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, sums = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if own is not None:
                at = np.flatnonzero(total)
                yield rows_of(np.full(len(at), own[0]), at, total[at], sums[at] / total[at, None], own[1])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["chunk"], row["shard"] // FAN) != own:
                    yield from done()
                    own, total, sums = (row["chunk"], row["shard"] // FAN), np.zeros(0), None
                place, weight = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["weights"], "<f8")
                mean = np.frombuffer(row["means"], "<f4").reshape(len(place), -1)
                sums = np.zeros((0, mean.shape[1])) if sums is None else sums
                if (more := place.max() + 1 - len(total)) > 0:
                    total, sums = np.pad(total, (0, more)), np.pad(sums, ((0, more), (0, 0)))
                total[place] += weight
                sums[place] += weight[:, None] * mean
        yield from done()

    return parts.repartition("chunk", F.expr(f"shard div {FAN}")).sortWithinPartitions("chunk", "shard").mapInArrow(run, PARTS)


def pieces_in(batch: pa.RecordBatch) -> list[tuple[np.ndarray, bool, bool]]:
    ids, begins, ends = (batch.column(name).to_pylist() for name in ("ids", "begins", "ends"))
    return [(np.frombuffer(own, "<u2"), first, last) for own, first, last in zip(ids, begins, ends, strict=True)]


def pieces(docs: DataFrame, key: str = "doc_id", tokenizer: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """The documents' ids, two bytes each, in pieces of bounded size, with their key and other columns named."""
    path = tokenizer or default_tokenizer()
    kept = [key, *also]
    names = [*kept, "place", "begins", "ends", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                own = [cut(ids.astype("<u2")) for ids in part_ids(path).of([text.encode() for text in texts(part)])]
                of = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                place = pa.array([i for x in own for i in range(len(x))], pa.int64())
                ids, begins, ends = zip(*(piece for x in own for piece in x), strict=True)
                made = [place, pa.array(begins), pa.array(ends), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(name).take(of) for name in kept), *made], names)

    kinds = ", ".join(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in kept)
    return docs.select(*kept, "text").mapInArrow(run, f"{kinds}, place bigint, begins boolean, ends boolean, ids binary")


def gathered(cut_texts: DataFrame) -> np.ndarray:
    """The sums of ``neighbours`` over all pieces."""
    wide = 2 * CELLS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            seen = neighbours(pieces_in(batch), seen)
        if seen is not None:
            at = np.flatnonzero(seen)
            yield parts_of(at, seen[at], np.empty((len(at), 0)), TaskContext.get().partitionId(), wide)

    out = np.zeros(VOCABULARY * wide, np.int64)
    own = cut_texts.select("ids", "begins", "ends")
    for row in merged(own.mapInArrow(run, PARTS), tasks(own)).to_pylist():
        out[cells(row, wide)] = np.frombuffer(row["weights"], "<f8")
    return out


def tasks(df: DataFrame) -> int:
    """Tasks that read a settled table."""
    return df.rdd.getNumPartitions()


def group_pairs(cut_texts: DataFrame, model: Attention) -> np.ndarray:
    """How often an id of the second group follows one of the first, over all pieces."""
    number = CLASSES * GROUPS
    groups = cut_texts.sparkSession.sparkContext.broadcast(model.groups.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(number**2, np.int32)
        for batch in batches:
            for own, begins, ends in pieces_in(batch):
                ids = np.concatenate([[BEGIN] if begins else [], own if begins else own[BLOCK - 1 :], [END] if ends else []]).astype(np.int64)
                of = groups.value[ids]
                np.add.at(seen, of[:-1] * number + of[1:], np.int32(1))  # a one of another type is cast for each place
        at = np.flatnonzero(seen)
        if len(at):
            yield parts_of(at, seen[at], np.empty((len(at), 0)), TaskContext.get().partitionId(), number)

    out = np.zeros(number**2)
    own = cut_texts.select("ids", "begins", "ends")
    for row in merged(own.mapInArrow(run, PARTS), tasks(own)).to_pylist():
        out[cells(row, number)] = np.frombuffer(row["weights"], "<f8")
    groups.unpersist()
    return out.reshape(number, number)


def train(docs: DataFrame, key: str = "doc_id", tokenizer: str | None = None) -> Attention:
    """The model of all documents, in whole."""
    return train_on(settled(pieces(docs, key, tokenizer), "pieces"), key)


def train_on(own: DataFrame, key: str = "doc_id") -> Attention:
    """The model of all texts whose pieces a settled table has."""
    blocks = F.ceil((F.length("ids") / 2 + F.col("ends").cast("int")) / BLOCK) - F.when(F.col("begins"), 0).otherwise(1)
    number = int(own.agg(F.coalesce(F.sum(blocks), F.lit(0))).first()[0])
    model = Attention([], seen=gathered(own))
    dense = [name for name in model.p if name != "e"]
    times, shards = passes(number), max(1, -(-number // (SHARD_WINDOWS * ROUNDS)))
    for turn in range(ROUNDS if number else 0):
        shared = own.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            found = [piece for batch in batches for piece in pieces_in(batch)]
            if not found:
                return
            shard = TaskContext.get().partitionId()
            mine = copy.deepcopy(shared.value)  # the worker may serve other shards
            inputs, targets, *_ = windows(*zip(*found, strict=True))
            met = mine.learn(inputs, targets, times, np.random.default_rng([turn, shard]), turn / ROUNDS, (turn + 1) / ROUNDS)
            flat = np.concatenate([mine.p[name].ravel() for name in dense])
            yield rows_of(np.zeros(len(flat), int), np.arange(len(flat)), np.full(len(flat), len(inputs)), flat[:, None], shard)
            rows = np.flatnonzero(met)
            yield parts_of(rows, met[rows], mine.p["e"][rows], shard, first=1)

        some = own.filter(F.pmod(F.xxhash64(key, "place", "ids"), F.lit(ROUNDS)) == turn)
        dealt = some.repartition(shards, key, "place", "ids").sortWithinPartitions(key, "place", "ids").select("ids", "begins", "ends")
        for row in merged(dealt.mapInArrow(run, PARTS), shards).to_pylist():
            mean = np.frombuffer(row["means"], "<f4")
            if row["chunk"]:
                model.p["e"][cells(row, first=1)] = mean.reshape(-1, WIDTH)
            else:
                sizes = np.cumsum([model.p[name].size for name in dense])
                for name, values in zip(dense, np.split(mean, sizes[:-1]), strict=True):
                    model.p[name] = values.reshape(model.p[name].shape).copy()
        shared.unpersist()
    model.follow(group_pairs(own, model))
    return model


def text_scores(cut_texts: DataFrame, model: Attention, names: list[str]) -> DataFrame:
    """The log10 probability of each text, whose pieces share the columns named."""
    shared = cut_texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECES):
                part = batch.slice(at, PIECES)
                ids, begins, ends = zip(*pieces_in(part), strict=True)
                nats = shared.value.score(ids, begins=begins, ends=ends)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in (*names, "place")), pa.array(nats / np.log(10))], [*names, "place", "score"])

    kinds = ", ".join(f"`{name}` {cut_texts.schema[name].dataType.simpleString()}" for name in names)
    scored = cut_texts.select(*names, "place", "ids", "begins", "ends").mapInArrow(run, f"{kinds}, place bigint, score double")
    once = scored.groupBy(*names, "place").agg(F.max("score").alias("score"))  # of repeated rows, which score alike
    return once.groupBy(*names).agg(F.sum("score").alias("score"))


def common_words(counts: DataFrame) -> DataFrame:
    """The end and the commonest words, COMMON_WORDS at most: all whose counts are in the highest eighths of powers of two that fit."""
    step = F.floor(F.log2("n") * 8).cast("int")
    kinds = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    fit = np.cumsum([row["count"] for row in kinds]) < COMMON_WORDS
    least = min((row["step"] for row, x in zip(kinds, fit, strict=True) if x), default=1 << 30)
    return counts.filter((step >= least) | (F.col("word") == END_WORD))


def digested(docs: DataFrame, key: str) -> DataFrame:
    """The key, the text, and a number that rows of one key share if their texts are equal."""
    return docs.select(key, "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_digest"))


def score(
    docs: DataFrame, counts: DataFrame, model: Attention, key: str = "doc_id", tokenizer: str | None = None, cut_texts: DataFrame | None = None
) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score); ``counts`` is a settled table (word, n).

    ``cut_texts`` has the pieces of the documents with ``_digest``, if they have been made already.
    """
    docs = digested(docs, key)
    cut_texts = pieces(docs, key, tokenizer, ("_digest",)) if cut_texts is None else cut_texts
    nats = text_scores(cut_texts, model, [key, "_digest"])
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = common_words(counts).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    is_end = pc.equal(common.column("word"), END_WORD)
    common = pa.concat_tables([common.filter(is_end), common.filter(pc.invert(is_end))])
    shared = docs.sparkSession.sparkContext.broadcast((common.column("word").combine_chunks(), common.column("n").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = shared.value
        numbers = np.append(numbers, 0)
        logs = np.log10(numbers + 1.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                size = part.num_rows
                own, of = flat_words(filled(part))
                coded = own.dictionary_encode()
                words = coded.dictionary.cast(pa.string())
                place = pc.fill_null(pc.index_in(words, value_set=names), len(names)).to_numpy(zero_copy_only=False)
                which = coded.indices.to_numpy()
                at = place[which]
                n_words = np.bincount(of, minlength=size)
                end_known = int(len(names) > 0 and names[0].as_py() == END_WORD)
                base = np.bincount(of, logs[at], size) + (logs[0] if end_known else 0.0)
                known = np.bincount(of, at < len(names), size).astype(np.int64) + end_known
                rows = np.arange(row, row + size)
                marks = pa.array([f" {r}" for r in rows])
                nothing = pa.nulls(size, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column(key), part.column("_digest"), marks, nothing, *map(pa.array, (n_words + 1, known, base))], names_
                )
                rare = at == len(names)
                pairs, times = np.unique(of[rare] * np.int64(len(words)) + which[rare], return_counts=True)
                if len(pairs):
                    doc, word = np.divmod(pairs, len(words))
                    empty = [pa.nulls(len(pairs), kind) for kind in (pa.int64(), pa.int64(), pa.float64())]
                    text = words.take(pa.array(word))
                    nokey = pa.nulls(len(pairs), part.schema.field(key).type)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[doc]), nokey, pa.nulls(len(pairs), pa.int64()), text, pa.array(times), *empty], names_)
                row += size

    kind = docs.schema[key].dataType.simpleString()
    names_ = ["row", key, "_digest", "word", "times", "n_tokens", "n_known", "base"]
    schema = f"row bigint, `{key}` {kind}, _digest bigint, word string, times bigint, n_tokens bigint, n_known bigint, base double"
    parts = docs.mapInArrow(run, schema)
    # Rows of documents carry a word of their own, which no count has, so they too are spread over the join's partitions.
    joined = parts.join(counts, "word", "left")
    found = F.when(F.col("times").isNotNull(), F.col("n"))
    whole = joined.groupBy("row").agg(
        F.max(key).alias(key),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(found > 0, F.col("times"))), F.lit(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(F.col("times") * F.log10(found + 1.0)), F.lit(0.0))).alias("base"),
        F.max("_digest").alias("_digest"),
    )
    own = nats.select(F.col(key).alias("_key"), F.col("_digest").alias("_of"), "score")
    whole = whole.join(own, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_digest") == F.col("_of")), "left")
    smallest = F.lit(float(np.log10(tokens + kinds + 1.0)))
    return whole.select(
        key,
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * smallest).alias("base_score"),
        "score",
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder_is("doc_id", 7, 2)
    counts = settled(word_counts(docs.filter(~held)), "words")
    cut_texts = settled(pieces(digested(docs, "doc_id"), also=("_digest",)), "pieces")
    scored = score(docs, counts, train_on(cut_texts.filter(~held)), cut_texts=cut_texts)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
