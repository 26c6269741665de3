"""Text scores by a small causal self-attention model over subword ids, trained in numpy on the executors.

The model predicts the next subword from a window of at least CONTEXT subwords before it: one attention head
with a bias for each distance, a hidden layer, and a two-level softmax (class, then slot of the class). Texts
are cut into chunks of SCORED subwords; each chunk is read together with the subwords before it, so that
windows overlap and every subword is scored once. A word's probability is a weighted mean of that model's
and of the word's smoothed share in the corpus (weight MIX), so that frequent words are known by heart.

Counts and network cover every training text. The network sees each chunk once, in rounds: each task trains on
its chunks from the common parameters, and the results are averaged by number of subwords.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from doseframe.llm.text import byte_groups, split_words
from doseframe.session import staged

# Slots (the most frequent subwords; the last slot stands for all others), slots of a class, sizes of the network.
SLOTS, CLASS, WIDTH, HIDDEN = 2_048, 64, 16, 24
# Subwords scored with one window, and subwords before them that it holds.
SCORED = CONTEXT = 16
# Rounds that the training chunks are dealt to, chunks of a step, step size.
ROUNDS, STEP_CHUNKS, RATE = 3, 64, 0.15
# Most frequent words whose counts every task holds; the others are joined.
HEAD_WORDS = 200_000
KEPT_WORDS, COUNTED_WORDS, BATCH_SUBWORDS = 150_000, 200_000, 32_768
# Bytes of text whose words are split and made distinct at once, and new words coded at once.
GROUP_BYTES, WORDS_AT_ONCE = 2 << 20, 1_000
# Scored rows that a task holds before it gives them on, each with the words that are not at hand.
ROWS_AT_ONCE = 500
MIX = 0.5


class Cut(NamedTuple):
    """Subword ids of some texts, end to end."""
    ids: np.ndarray
    sizes: np.ndarray      # ids of each word and of each text's end
    many: np.ndarray       # words of each text, its end among them
    word: np.ndarray       # place among the distinct words of each word; for an end their number
    distinct: list[bytes]

    @property
    def text_sizes(self) -> np.ndarray:
        return np.add.reduceat(self.sizes, np.cumsum(self.many) - self.many) if len(self.many) else self.many


class Subwords:
    """Ids of words by a public vocabulary, each word with a blank before it; `end` follows a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.piece = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        # Words with a blank before each are its pieces; a token that begins with a blank begins a word.
        self.many = tiktoken.Encoding("words", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = max(ranks.values(), default=-1) + 1
        self.begins = np.zeros(self.end, dtype=bool)
        self.begins[[i for b, i in ranks.items() if b.startswith(b" ")]] = True
        self.known: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as native 32-bit numbers."""
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            new = [word for word, ids in zip(words, got) if ids is None]
            for a in range(0, len(new), WORDS_AT_ONCE):
                self.known.update(self._coded(new[a:a + WORDS_AT_ONCE]))
            got = [self.known[word] if ids is None else ids for word, ids in zip(words, got)]
        return got

    def _coded(self, words: list[bytes]) -> Iterable[tuple[bytes, bytes]]:
        try:
            flat = np.array(self.many((b" " + b" ".join(words)).decode()), dtype=np.int32)
        except UnicodeDecodeError:
            return [(word, array("i", self.piece(b" " + word)).tobytes()) for word in words]
        ends = [*(np.flatnonzero(self.begins[flat])[1:] * 4).tolist(), flat.nbytes]
        one = flat.tobytes()
        return zip(words, [one[a:b] for a, b in zip([0, *ends], ends)], strict=True)

    def texts(self, texts: pa.Array) -> Cut:
        """Ids of texts, each with its end: words are split and made distinct in Arrow, and each distinct one is looked up once."""
        of, found = split_words(texts)
        coded = found.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = [*self.of(distinct), array("i", [self.end]).tobytes()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        many = np.bincount(of, minlength=len(texts)) + 1
        word = np.full(len(of) + len(texts), len(distinct), dtype=np.int32)
        word[np.arange(len(of)) + of] = coded.indices.to_numpy(zero_copy_only=False)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
        return Cut(lists.take(pa.array(word)).flatten().to_numpy(zero_copy_only=False), sizes[word], many, word, distinct)

    def text(self, found: list[bytes]) -> tuple[list[int], list[int]]:
        """Subword ids of a text with its end, and the number of ids of each word and of the end."""
        got = self.texts(pa.array([b" ".join(found)], pa.binary()))
        return got.ids.tolist(), got.sizes.tolist()


@dataclass
class Network:
    """Parameters by name; slot_of maps a subword id to its slot, rest_log10 is the share of an id in the last slot."""
    slot_of: np.ndarray
    rest_log10: np.ndarray
    weights: dict[str, np.ndarray]

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in sorted(self.weights)])

    def with_flat(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k in sorted(self.weights):
            size = self.weights[k].size
            out[k] = flat[at:at + size].reshape(self.weights[k].shape).astype(np.float32)
            at += size
        return Network(self.slot_of, self.rest_log10, out)


def new_network(counts: np.ndarray, seed: int = 1) -> Network:
    """An untrained network whose output is the smoothed share of each id; `counts` by id, the end included."""
    order = np.argsort(-counts, kind="stable")
    slot_of = np.full(len(counts), SLOTS - 1)
    own = order[:SLOTS - 1]
    slot_of[own] = np.arange(len(own))
    rest = np.ones(len(counts), dtype=bool)
    rest[own] = False
    rest_total = float((counts[rest] + 1).sum())
    rest_log10 = np.where(rest, np.log10((counts + 1) / max(rest_total, 1.0)), 0.0)
    mass = np.full(SLOTS, 1e-3)
    mass[:len(own)] = counts[own] + 1
    mass[SLOTS - 1] = max(rest_total, 1e-3)
    classes = SLOTS // CLASS
    by_class = mass.reshape(classes, CLASS)
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 0.3 / np.sqrt(shape[0]), shape).astype(np.float32)
    weights = {
        "embed": rng.normal(0, 0.3, (SLOTS + 1, WIDTH)).astype(np.float32),
        "q": normal(WIDTH, WIDTH), "k": normal(WIDTH, WIDTH), "v": normal(WIDTH, WIDTH),
        "near": np.zeros(SCORED + CONTEXT, dtype=np.float32), "own": normal(WIDTH, HIDDEN), "seen": normal(WIDTH, HIDDEN),
        "hidden": np.zeros(HIDDEN, dtype=np.float32), "class": normal(HIDDEN, classes) * 0.1,
        "class_bias": np.log(by_class.sum(axis=1) / mass.sum()).astype(np.float32),
        "slot": (rng.normal(0, 0.02, (classes, HIDDEN, CLASS))).astype(np.float32),
        "slot_bias": np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32),
    }
    return Network(slot_of, rest_log10, weights)


SPAN = SCORED + CONTEXT
# Distance from each scored position (row) back to each position of the window (column); negative: ahead.
BACK = (np.arange(SCORED)[:, None] + CONTEXT) - np.arange(SPAN)[None, :]
DISTANCE = np.maximum(BACK, 0)


def chunked(slots: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over flat texts (from starts to ends): inputs (chunks, SPAN), targets (chunks, SCORED), positions.

    The input at a position is the subword before it, BOS at a text's start; input SLOTS + 1 marks places
    outside the text, and position -1 targets behind its end.
    """
    sizes = ends - starts
    pieces = -(-sizes // SCORED)
    of = np.repeat(np.arange(len(starts)), pieces)
    first = starts[of] + SCORED * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    at = first[:, None] + np.arange(-CONTEXT, SCORED)[None, :]
    low, high = starts[of][:, None], ends[of][:, None]
    inputs = slots[np.clip(at - 1, 0, len(slots) - 1)]
    inputs = np.where(at == low, SLOTS, np.where((at < low) | (at >= high), SLOTS + 1, inputs))
    place = np.where(at[:, CONTEXT:] < high, at[:, CONTEXT:], -1)
    return inputs, slots[np.maximum(place, 0)], place


def _exps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) and the sums of its rows; where a score is large or a sum is lost, after the greatest of each row is taken off z."""
    ones = np.ones(z.shape[-1], dtype=z.dtype)
    if not z.size or z.max() < 60:
        e = np.exp(z)
        sums = e @ ones
        if not z.size or sums.min() > 1e-20:
            return e, sums
    z -= z.max(axis=-1, keepdims=True)
    e = np.exp(z)
    return e, e @ ones


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """Places of the targets in order of classes, class and slot of each in that order, the rows of each class that occurs."""
    kind = (targets // CLASS).astype(np.int16)
    order = np.argsort(kind, kind="stable")
    targets, sizes = targets.take(order), np.bincount(kind, minlength=SLOTS // CLASS)
    kind, ends = kind.take(order), np.cumsum(sizes).tolist()
    return order, kind, targets % CLASS, [(c, slice(b - n, b)) for c, (b, n) in enumerate(zip(ends, sizes.tolist())) if n]


def _slot_scores(h: np.ndarray, slots: np.ndarray, runs: list[tuple[int, slice]]) -> np.ndarray:
    """Scores of the slots of each row's class."""
    z = np.empty((len(h), CLASS), dtype=h.dtype)
    for c, rows in runs:
        np.dot(h[rows], slots[c], out=z[rows])
    return z


def _with_bias(matrix: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.concatenate((matrix, bias[..., None, :]), axis=-2)


class Step:
    """Parameters and their gradient, each in one vector with views by name, made ready for many steps.

    Only the products q k' and v seen matter, so keys and values are the embeddings themselves. Biases are
    the last row of "classes" and "slots"; states end with a one, the tanh of STEADY.
    """

    PLAIN = {
        "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "near": (SCORED + CONTEXT,), "own": (WIDTH, HIDDEN), "seen": (WIDTH, HIDDEN),
        "hidden": (HIDDEN,),
    }
    SHAPES = PLAIN | {"classes": (HIDDEN + 1, SLOTS // CLASS), "slots": (SLOTS // CLASS, HIDDEN + 1, CLASS)}
    STEADY = 20.0

    def __init__(self, w: dict[str, np.ndarray]):
        self.embed = w["embed"].copy()
        sizes = [int(np.prod(s)) for s in self.SHAPES.values()]
        self.flat, self.slope = (np.zeros(sum(sizes), dtype=self.embed.dtype) for _ in range(2))
        self.w, self.g = (
            {k: a.reshape(s) for (k, s), a in zip(self.SHAPES.items(), np.split(x, np.cumsum(sizes)[:-1]))} for x in (self.flat, self.slope)
        )
        for name in self.PLAIN:
            self.w[name][:] = w[name]
        self.w["classes"][:] = _with_bias(w["class"], w["class_bias"])
        self.w["slots"][:] = _with_bias(w["slot"], w["slot_bias"])

    def named(self, embed: np.ndarray, parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Parameters or gradient by the names of a network."""
        out = {k: parts[k].copy() for k in self.PLAIN}
        out |= {"class": parts["classes"][:-1].copy(), "class_bias": parts["classes"][-1].copy()}
        return out | {"embed": embed, "slot": parts["slots"][:, :-1].copy(), "slot_bias": parts["slots"][:, -1].copy()}

    def products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What makes scores of an own embedding, and states of an own embedding with the mean of those attended, and their bias."""
        w, kind = self.w, self.embed.dtype.type
        near = w["q"] @ w["k"].T / np.sqrt(kind(WIDTH))
        far = np.zeros((2 * WIDTH, HIDDEN + 1), dtype=kind)
        far[:WIDTH, :-1], far[WIDTH:, :-1] = w["own"], w["v"] @ w["seen"]
        return near, far, np.append(w["hidden"], kind(self.STEADY))

    def forward(self, inputs: np.ndarray):
        """Hidden states of the scored positions, and what the gradient needs."""
        n, kind = len(inputs), self.embed.dtype.type
        near, far, bias = self.products()
        which = np.minimum(inputs, SLOTS)
        x = self.embed.take(which, axis=0)
        xt = np.ascontiguousarray(x.transpose(0, 2, 1))
        both = np.empty((n, SCORED, 2 * WIDTH), dtype=kind)
        both[:, :, :WIDTH] = x[:, CONTEXT:]
        flat = both.reshape(-1, 2 * WIDTH)
        # Behind the queries is room for the slopes of the means, before the weights for the slopes of the scores.
        q, pairs = np.empty((n, 2 * SCORED, WIDTH), dtype=kind), np.empty((n, 2 * SCORED, SPAN), dtype=kind)
        q[:, :SCORED] = (flat[:, :WIDTH] @ near).reshape(n, SCORED, WIDTH)
        score = np.matmul(q[:, :SCORED], xt)
        score += np.where(BACK < 0, kind(-1e4), self.w["near"].take(DISTANCE))
        some = np.flatnonzero((inputs[:, 0] > SLOTS) | (inputs[:, -1] > SLOTS))   # texts begin or end there
        if len(some):
            score[some] += np.where(inputs[some] > SLOTS, kind(-1e4), kind(0))[:, None, :]
        attend, total = _exps(score)
        attend = np.divide(attend, total[:, :, None], out=pairs[:, SCORED:])
        both[:, :, WIDTH:] = np.matmul(attend, x)
        state = flat @ far
        state += bias
        return np.tanh(state, out=state), (which, x, xt, flat, near, far, q, pairs)

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean loss over the real targets; its gradient is left in `g`, that of some rows of the embedding is given back."""
        w, g = self.w, self.g
        state, (which, x, xt, both, near, far, q, pairs) = self.forward(inputs)
        n, share = len(inputs), x.dtype.type(1 / max(1, int(real.sum())))
        take = np.flatnonzero(real)
        order, kind, slot, runs = _by_class(targets.ravel().take(take))
        order = take.take(order)
        h = state.take(order, axis=0)

        def slopes_of(z: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
            at = np.arange(len(z)) * z.shape[1] + target
            e, sums = _exps(z)
            loss = float((np.log(sums) - z.take(at)).sum())
            e *= (share / sums)[:, None]
            e.ravel()[at] -= share
            return loss, e

        loss, d = slopes_of(h @ w["classes"], kind)
        np.dot(h.T, d, out=g["classes"])
        dh = d @ w["classes"].T
        more, d = slopes_of(_slot_scores(h, w["slots"], runs), slot)
        back, dslot = w["slots"].transpose(0, 2, 1), np.empty_like(dh)
        g["slots"][:] = 0
        for c, rows in runs:
            np.dot(h[rows].T, d[rows], out=g["slots"][c])
            np.dot(d[rows], back[c], out=dslot[rows])
        dh += dslot
        dh *= 1 - h * h
        # Slopes of states (the one has none), then of queries.
        slopes = np.zeros((len(both), HIDDEN + 1 + WIDTH), dtype=x.dtype)
        slopes[order, :HIDDEN + 1] = dh
        dmean = slopes[:, :HIDDEN + 1] @ far[WIDTH:].T
        q[:, SCORED:] = dmean.reshape(n, SCORED, WIDTH)
        dscore = np.matmul(q[:, SCORED:], xt)
        dscore -= np.vecdot(dmean, both[:, WIDTH:]).reshape(n, SCORED, 1)
        dscore = np.multiply(dscore, pairs[:, SCORED:], out=pairs[:, :SCORED])
        slopes[:, HIDDEN + 1:] = np.matmul(dscore, x).reshape(-1, WIDTH)
        dx = np.matmul(pairs.transpose(0, 2, 1), q)
        dx[:, CONTEXT:] += (slopes @ np.concatenate((far[:WIDTH], near), axis=1).T).reshape(n, SCORED, WIDTH)
        made = both.T @ slopes
        dnear, dfar = made[:WIDTH, HIDDEN + 1:] / np.sqrt(x.dtype.type(WIDTH)), made[WIDTH:, :HIDDEN]
        g["near"][:] = np.bincount(DISTANCE.ravel(), dscore.sum(axis=0).ravel(), SPAN)
        g["own"][:], g["hidden"][:] = made[:WIDTH, :HIDDEN], (np.ones(len(dh), dtype=x.dtype) @ dh)[:-1]
        g["q"][:], g["k"][:], g["v"][:], g["seen"][:] = dnear @ w["k"], dnear.T @ w["q"], dfar @ w["seen"].T, w["v"].T @ dfar
        # Equal rows of the embedding side by side; places outside a text have no slope. Pairs of numbers are summed as one.
        which = which.ravel().astype(np.int16)
        order = np.argsort(which, kind="stable")
        which = which.take(order)
        first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        dx = dx.reshape(-1, WIDTH).take(order, axis=0).view(np.result_type(x, 1j))
        return (loss + more) * float(share), which[first], np.add.reduceat(dx, first, axis=0).view(x.dtype)


def forward(w: dict[str, np.ndarray], inputs: np.ndarray):
    """Hidden states of the scored positions, and what the gradient needs; `Scorer.states` gives the same states."""
    state, rest = Step(w).forward(inputs)
    return state[:, :HIDDEN].reshape(len(inputs), SCORED, HIDDEN), rest


def gradient(w: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the real targets, and its gradient."""
    step = Step(w)
    loss, rows, sums = step.gradient(inputs, targets, real)
    embed = np.zeros_like(step.embed)
    embed[rows] = sums
    return loss, step.named(embed, step.g)


def _adagrad(w: np.ndarray, square: np.ndarray, g: np.ndarray) -> None:
    change = g * g
    square += change
    np.sqrt(square, out=change)
    np.divide(g, change, out=change)
    change *= np.float32(RATE)
    w -= change


def train(net: Network, chunks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[Network, int]:
    """Adagrad over batches of (inputs, targets, real); returns the network and the number of targets seen."""
    step, seen = Step(net.weights), 0
    square, rows_square = np.full_like(step.flat, 1e-4), np.full_like(step.embed, 1e-4)
    for inputs, targets, real in chunks:
        _, rows, g = step.gradient(inputs, targets, real)
        _adagrad(step.flat, square, step.slope)
        part, part_square = step.embed.take(rows, axis=0), rows_square.take(rows, axis=0)   # the others have no slope
        _adagrad(part, part_square, g)
        step.embed[rows], rows_square[rows] = part, part_square
        seen += int(real.sum())
    return Network(net.slot_of, net.rest_log10, step.named(step.embed, step.w)), seen


class Scorer:
    """A trained network made ready for scoring: what depends on one subword alone is looked up by its slot."""

    AT_ONCE = 256   # windows

    def __init__(self, net: Network):
        step = Step(net.weights)
        near, far, bias = step.products()
        self.net, self.classes, self.slots = net, step.w["classes"], step.w["slots"]
        self.x = np.concatenate((step.embed, step.embed[SLOTS:]))   # the last row: outside
        self.q, self.own, self.mean = self.x @ near, self.x @ far[:WIDTH] + bias, far[WIDTH:]
        self.near = np.where(BACK < 0, np.float32(-1e4), step.w["near"][DISTANCE])

    def _states(self, inputs: np.ndarray) -> np.ndarray:
        """Those of `Step`, with their one."""
        own, x = inputs[:, CONTEXT:], self.x.take(inputs, axis=0)
        score = np.matmul(self.q.take(own, axis=0), np.ascontiguousarray(x.transpose(0, 2, 1)))
        score += self.near
        some = np.flatnonzero((inputs[:, 0] > SLOTS) | (inputs[:, -1] > SLOTS))
        if len(some):
            score[some] += np.where(inputs[some] > SLOTS, np.float32(-1e4), np.float32(0))[:, None, :]
        score, total = _exps(score)
        mean = np.matmul(score, x)
        mean /= total[:, :, None]
        state = mean.reshape(-1, WIDTH) @ self.mean
        state += self.own.take(own.ravel(), axis=0)
        return np.tanh(state, out=state)

    def states(self, inputs: np.ndarray) -> np.ndarray:
        return self._states(inputs)[:, :HIDDEN].reshape(len(inputs), SCORED, HIDDEN)

    def _logs(self, state: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target slot."""
        order, kind, slot, runs = _by_class(target)
        state = state.take(order, axis=0)
        got = np.zeros(len(target), dtype=np.float32)
        for z, at in ((state @ self.classes, kind), (_slot_scores(state, self.slots, runs), slot)):
            sums = _exps(z)[1]
            got += z.take(np.arange(len(z)) * z.shape[1] + at) - np.log(sums)
        out = np.empty_like(got)
        out[order] = got
        return out

    def log10(self, ids: list[np.ndarray]) -> np.ndarray:
        """log10 probability of every subword id of some texts (each an array that ends with the end id), flat."""
        return self.flat_log10(np.concatenate(ids), np.cumsum([len(i) for i in ids]))

    def flat_log10(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same of ids that lie end to end."""
        inputs, targets, place = chunked(self.net.slot_of[flat], np.concatenate(([0], ends[:-1])), ends)
        out = np.empty(len(flat))
        for a in range(0, len(inputs), self.AT_ONCE):
            here = place[a:a + self.AT_ONCE].ravel()
            real = np.flatnonzero(here >= 0)
            state, target = self._states(inputs[a:a + self.AT_ONCE]), targets[a:a + self.AT_ONCE].ravel()
            out[here.take(real)] = self._logs(state.take(real, axis=0), target.take(real))
        return out / np.log(10) + self.net.rest_log10[flat]


# --- the corpus on Spark ---------------------------------------------------------------------------------------

def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the column text, counted in the tasks before anything is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        rows = lambda: pa.RecordBatch.from_pydict({"word": pa.array(seen, pa.binary()), "c": pa.array(seen.values(), pa.int64())})
        for batch in batches:
            for part in byte_groups(batch, 0, GROUP_BYTES):
                found = split_words(part.column(0))[1].value_counts()
                words, many = (found.field(i) for i in range(2))
                for w, c in zip(words.cast(pa.binary()).to_numpy(zero_copy_only=False), many.to_numpy().tolist()):
                    seen[w] = seen.get(w, 0) + c
                if len(seen) > COUNTED_WORDS:
                    yield rows()
                    seen.clear()
        yield rows()

    return texts.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _subword_counts(counts: DataFrame, ranks: dict[bytes, int], pattern: str, texts: int) -> np.ndarray:
    """Occurrences of every subword id in the corpus: as many numbers as the vocabulary has ids, and the end."""
    size = max(ranks.values(), default=-1) + 2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sub, total = Subwords(ranks, pattern), np.zeros(size)
        for pdf in batches:
            for w, c in zip(pdf["word"], pdf["c"]):
                for i in sub.piece(b" " + bytes(w)):
                    total[i] += c
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": some, "c": total[some]})

    rows = counts.mapInPandas(count, "id int, c double").groupBy("id").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["id"]] = r["c"]
    out[size - 1] = texts
    return out


def _head(counts: DataFrame) -> dict[bytes, int]:
    """The most frequent words with their counts, at most HEAD_WORDS: all words from a count on, cut between counts."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for s, n in sizes:  # some hundred steps at any size
        total += n
        if total > HEAD_WORDS:
            break
        least = s
    return {} if least is None else {bytes(r["word"]): r["c"] for r in counts.where(step >= least).collect()}


def _training_chunks(texts: DataFrame, net: Network, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(turn, inputs, targets, real): the chunks of texts as packed arrays, a batch of steps per row."""
    slot_of = net.slot_of.astype(np.int16)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(ranks, pattern)
        for batch in batches:
            done, left = 0, np.empty(0, dtype=np.int16)
            sizes: list[int] = []
            for part in byte_groups(batch, 0, GROUP_BYTES):
                got = sub.texts(part.column(0))
                slots, at = np.concatenate((left, slot_of[got.ids])), 0
                for n in got.text_sizes.tolist():
                    sizes.append(n)
                    done += 1
                    if sum(sizes) >= BATCH_SUBWORDS or len(sizes) == 64 or done == batch.num_rows:
                        ends = np.cumsum(sizes)
                        inputs, targets, place = chunked(slots[at:at + ends[-1]], ends - sizes, ends)
                        at += int(ends[-1])
                        sizes = []
                        # Given at once: the chunks of a whole batch of texts take some hundred MB.
                        for a in range(0, len(inputs), 512):
                            b = slice(a, a + 512)
                            packed = [pa.array([x.astype(np.int16).tobytes()]) for x in (inputs[b], targets[b], place[b] >= 0)]
                            yield pa.RecordBatch.from_arrays(packed, ["inputs", "targets", "real"])
                left = slots[at:]

    rows = texts.select("text").mapInArrow(cut, "inputs binary, targets binary, real binary")
    return staged(rows.withColumn("turn", F.pmod(F.xxhash64("inputs"), F.lit(ROUNDS)).cast("int")), "chunks")


def _round(chunks: DataFrame, net: Network) -> Network:
    """Every task trains on its chunks; the parameters are averaged by targets, element by element."""
    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def steps():
            for pdf in batches:
                for r in pdf.itertuples():
                    inputs, targets, real = (
                        np.frombuffer(x, dtype=np.int16).reshape(-1, n)
                        for x, n in ((r.inputs, SPAN), (r.targets, SCORED), (r.real, SCORED))
                    )
                    order = np.random.default_rng(len(inputs)).permutation(len(inputs))
                    for a in range(0, len(order), STEP_CHUNKS):
                        b = order[a:a + STEP_CHUNKS]
                        yield inputs[b], targets[b], real[b] > 0

        got, seen = train(net, steps())
        if seen:
            flat = got.flat.astype(np.float64)
            yield pd.DataFrame({"at": np.arange(len(flat) + 1), "x": np.append(flat, 1.0) * seen})

    rows = chunks.select("inputs", "targets", "real").mapInPandas(fit, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    total = np.zeros(len(net.flat) + 1)
    got = rows.toPandas()  # one number per parameter
    total[got["at"].to_numpy(int)] = got["x"].to_numpy(float)
    return net.with_flat(total[:-1] / total[-1]) if total[-1] else net


def score(docs: DataFrame, key: str, text: str, held_out: Column, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """One row per row of `docs`: the key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z lowered, cut at space and the control characters 9 to 13) and one end per
    text; a null text is an empty one, its end alone is scored. `held_out` is a condition; rows where it is
    not false (null keys among them) are not learnt from. base_score sums log10((c + 1) / (N + V + 1)) over the
    tokens, score is the model's log10 probability of the text. Repeated rows are texts of their own.
    Without training texts the counts are 0 and the network is untrained.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    seen = rows.where(~F.col("held_out"))
    counts = staged(word_counts(seen), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    texts = seen.select("key").count()
    n, v = total["n"] + texts, total["v"] + (texts > 0)
    base = float(n + v + 1)
    net = new_network(_subword_counts(counts, ranks, pattern, texts))
    chunks = _training_chunks(seen, net, ranks, pattern)
    for turn in range(ROUNDS):
        net = _round(chunks.where(F.col("turn") == turn), net)
    head = _head(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, scorer = Subwords(ranks, pattern), Scorer(net)
        for batch in batches:
            for part in byte_groups(batch, 1, GROUP_BYTES):
                got = sub.texts(part.column(1))
                ids, many, ends = got.ids, got.many, np.cumsum(got.text_sizes)
                logs, at = np.empty(len(ids)), 0
                while at < len(ends):
                    before = int(ends[at - 1]) if at else 0
                    upto = min(len(ends), int(np.searchsorted(ends, before + BATCH_SUBWORDS)) + 1)
                    logs[before:ends[upto - 1]] = scorer.flat_log10(ids[before:ends[upto - 1]], ends[at:upto] - before)
                    at = upto
                mine = np.add.reduceat(logs, np.cumsum(got.sizes) - got.sizes)
                c = np.array([*(head.get(w, -1) for w in got.distinct), texts_seen], dtype=np.int64)[got.word]
                text = np.repeat(np.arange(len(many)), many)
                known = c >= 0
                rest, text_known, c_known = np.flatnonzero(~known), text[known], c[known]
                both = np.log10(MIX * ((c_known + 1) / base) + (1 - MIX) * np.power(10.0, mine[known]))
                per_text = lambda of, x: pa.array(np.bincount(of, x, len(many)))
                upto = np.append(0, np.cumsum(np.bincount(text[rest], minlength=len(many))))
                seldom = pa.array([got.distinct[i] for i in got.word[rest].tolist()], pa.binary())
                tail = pa.StructArray.from_arrays([seldom, pa.array(mine[rest])], ["word", "log"])
                out = {
                    "key": part.column(0), "held_out": part.column(2), "rid": part.column(3), "n_tokens": pa.array(many),
                    "known": pa.array(np.bincount(text_known[c_known > 0], minlength=len(many))),
                    "base": per_text(text_known, np.log10(c_known + 1)), "mixed": per_text(text_known, both),
                    "tail": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), tail),
                }
                rows = pa.RecordBatch.from_pydict(out)
                for a in range(0, rows.num_rows, ROWS_AT_ONCE):
                    yield rows.slice(a, ROWS_AT_ONCE)

    texts_seen = texts
    key_type = dict(rows.dtypes)["key"]
    schema = f"key {key_type}, held_out boolean, rid long, n_tokens long, known long, base double, mixed double, tail array<struct<word:binary,log:double>>"
    part = staged(rows.select("key", "text", "held_out", F.monotonically_increasing_id().alias("rid")).mapInArrow(run, schema), "scores")
    tail = part.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.log").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0)).cast("double")
    sums = tail.groupBy("rid").agg(
        F.sum((c > 0).cast("long")).alias("known2"), F.sum(F.log10(c + 1)).alias("base2"),
        F.sum(F.log10(MIX * (c + 1) / base + (1 - MIX) * F.pow(F.lit(10.0), F.col("log")))).alias("mixed2"),
    )
    out = part.drop("tail").join(sums, "rid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(
        F.col("key").alias(key), "held_out", "n_tokens", plus("known", "known2").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (plus("base", "base2") - F.col("n_tokens") * float(np.log10(base))).alias("base_score"), plus("mixed", "mixed2").alias("score"),
    )
