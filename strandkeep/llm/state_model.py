"""Scoring texts by a hidden Markov language model.

A text is its words and one end. Latent states emit classes of words, and a class its words by their counts
in the training texts: the OWN commonest words are classes of their own, the others share a class with the words that
end like them. So the model that Baum-Welch trains has one size whatever the corpus, while the counts below
it cover every word. A pass over the corpus adds up expected counts in each task, Spark adds those of the tasks, and the
driver divides them; the likelihood of a text is that of the scaled forward recursion, an unknown word having
in each state the probability that it has in the base model.

Texts are written once as blocks with a dictionary of their own. Counts are joined to the dictionaries, never
to tokens, and passes read blocks of class numbers, two bytes a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkeep.llm import common
from strandkeep.llm.labelled import fold

#: Latent states and passes of Baum-Welch over the training texts.
STATES, PASSES = 8, 6
#: Words that are classes of their own, and classes of all other words, by a hash of their last ENDING bytes.
OWN, ENDINGS, ENDING = 1 << 13, 1 << 12, 3
#: Classes of the end of a text and of unknown words; the others follow.
END, UNKNOWN = 0, 1
CLASSES = 2 + OWN + ENDINGS
#: Pseudo-counts with which a state's emissions lean on those of all words, and its transitions on equal ones.
LEAN, EVEN = 50.0, 0.1
#: The chance of staying in a state before training, and how far emissions are set apart then.
STAY, APART = 0.95, 0.5
#: What the counts of the base model are raised by.
ADDED = 0.1
#: Bytes of text in a block; tokens that are worked on at a time; tokens after which a text is cut into pieces.
BLOCK, AT_ONCE, PIECE = 6 << 20, 1 << 20, 1 << 11
#: Steps between two scalings of the forward and backward sums.
SCALED = 8

_BLOCKS = "block long, doc_ids array<long>, held array<boolean>, n array<int>, ids binary, words array<string>, seen array<long>"
_CODED = "doc_ids array<long>, held array<boolean>, n array<int>, n_known array<long>, base array<double>, inner array<double>, codes binary"


class Model(NamedTuple):
    """start (states), move (from, to), emit (class, state)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class Totals(NamedTuple):
    """Training tokens and different ones, the end among them, and the ends."""

    tokens: int
    different: int
    ends: int

    @property
    def unknown(self) -> float:
        """The probability of an unknown word in the base model."""
        return ADDED / (self.tokens + ADDED * (self.different + 1))


def _arrays(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))


def _encoded(batch: pa.Table, block: int) -> pa.RecordBatch:
    """One block of rows (doc_id, held, text): tokens as places in the block's own dictionary, common words first, 0 for the end; their bytes lie by significance, packed."""
    texts = pc.fill_null(batch["text"].combine_chunks().cast(pa.large_string()), "")
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets, flat = words.offsets.to_numpy(), words.values
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at an edge leaves an empty piece
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[offsets])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    places = coded.indices.to_numpy()
    common_first = np.argsort(-np.bincount(places, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(common_first), np.int32)
    rank[common_first] = np.arange(1, len(rank) + 1)
    n = counts + 1
    ids = np.zeros(int(n.sum()), np.int32)
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(n) - 1] = False
    ids[inside] = rank[places]
    taught = np.repeat(~batch["held"].to_numpy(), n)
    seen = np.bincount(ids[taught], minlength=len(rank) + 1)[1:]
    one = np.array([0, len(n)])
    several = np.array([0, len(seen)])
    return pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()),
        pa.ListArray.from_arrays(pa.array(one, pa.int32()), batch["doc_id"].combine_chunks()),
        pa.ListArray.from_arrays(pa.array(one, pa.int32()), batch["held"].combine_chunks()),
        _arrays(n.astype(np.int32), one),
        pa.array([pa.compress(ids.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)], pa.binary()),
        pa.ListArray.from_arrays(pa.array(several, pa.int32()), coded.dictionary.take(pa.array(common_first)).cast(pa.string())),
        _arrays(seen.astype(np.int64), several),
    ], names=[x.split()[0] for x in _BLOCKS.split(", ")])


def blocks(docs: DataFrame) -> DataFrame:
    """The texts of docs (doc_id, text) as blocks, written as a table."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK:
                yield _encoded(pa.Table.from_batches(held), block)
                held, size, block = [], 0, block + 1
        if sum(map(len, held)):
            yield _encoded(pa.Table.from_batches(held), block)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(10) == 0, F.lit(False)).alias("held"), F.col("text"))
    return common.stash(rows.mapInArrow(common.lean(encode), _BLOCKS))


def word_counts(coded: DataFrame) -> DataFrame:
    """word, c of the training texts in blocks, as a table."""
    seen = coded.select(F.inline(F.arrays_zip("words", "seen"))).where("seen > 0")
    return common.stash(seen.groupBy(F.col("words").alias("word")).agg(F.sum("seen").alias("c")))


def classed(counts: DataFrame) -> DataFrame:
    """counts with class, as a table. The commonest words are looked for above a count that few more than OWN reach, so no task sends many."""
    spark = counts.sparkSession
    level = F.floor(F.log2("c") * 16).cast("int")
    least, reached = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # 1,008 levels at most
        least, reached = r["level"], reached + r["count"]
        if reached >= OWN:
            break
    top = [r["word"] for r in counts.where(level >= least).orderBy(F.desc("c"), "word").limit(OWN).collect()]
    own = spark.createDataFrame([(w, 2 + k) for k, w in enumerate(top)], "word string, own int")
    data = F.col("word").cast("binary")
    ending = F.substring(data, F.greatest(F.octet_length(data) - ENDING + 1, F.lit(1)), F.lit(ENDING))
    rows = counts.join(F.broadcast(own), "word", "left").withColumn("class", F.coalesce("own", (F.lit(2 + OWN) + F.crc32(ending) % ENDINGS).cast("int")))
    return common.stash(rows.select("word", "c", "class"))


def sizes(words: DataFrame) -> np.ndarray:
    """Tokens and different words of every class, (class, 2)."""
    out = np.zeros((CLASSES, 2))
    for r in words.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # a row a class at most
        out[r["class"]] = r["c"], r["n"]
    return out


def coded(block: DataFrame, words: DataFrame, totals: Totals, size: np.ndarray) -> DataFrame:
    """The blocks with class numbers for tokens, and for each text what needs no states, as a table."""
    need = block.select("block", F.posexplode("words").alias("at", "word"))
    found = need.join(words, "word").groupBy("block").agg(F.collect_list(F.struct("at", "c", "class")).alias("found"))
    found = common.stash(found)  # the shuffles of words are gone when tokens are moved
    rows = block.select("block", "doc_ids", "held", "n", "ids", F.size("words").alias("size")).join(found, "block", "left")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = totals.tokens + ADDED * (totals.different + 1)
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1)
                c, kind, inner = np.zeros(x["size"][0].as_py() + 1, np.int64), np.full(x["size"][0].as_py() + 1, UNKNOWN, np.uint16), np.zeros(x["size"][0].as_py() + 1)
                if totals.ends:
                    c[0], kind[0] = totals.ends, END
                known = x["found"].flatten()
                if len(known):
                    at = known.field("at").to_numpy() + 1
                    c[at], kind[at] = known.field("c").to_numpy(), known.field("class").to_numpy()
                    inner[at] = np.log10((c[at] + ADDED) / (size[kind[at]] @ (1, ADDED)))
                n = x["n"].flatten().to_numpy()
                planes = pa.decompress(x["ids"][0].as_buffer(), 4 * int(n.sum()), "zstd", asbytes=True)
                ids = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.int32)[:, 0]
                first, one = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), np.array([0, len(n)])
                sums = [np.add.reduceat(v[ids], first) for v in ((c > 0).astype(np.int64), np.log10((c + ADDED) / scale), inner)]
                yield pa.RecordBatch.from_arrays([x["doc_ids"], x["held"], x["n"], *(_arrays(v, one) for v in sums), pa.array([kind[ids].tobytes()], pa.binary())], names=[y.split()[0] for y in _CODED.split(", ")])

    return common.stash(rows.mapInArrow(common.lean(code), _CODED))


class _Pieces(NamedTuple):
    """Texts cut into pieces, longest first: each one's first token, length, whether it starts a text, its text."""

    at: np.ndarray
    size: np.ndarray
    begins: np.ndarray
    text: np.ndarray
    #: Pieces there are at each step.
    live: list[int]
    #: For the second, third and so on pieces of texts: those pieces, the ones before them, and their products.
    rounds: list[tuple]


def _live(size: np.ndarray) -> list[int]:
    """How many of some pieces, longest first, have a token at each step."""
    return np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left").tolist()


def _cut(n: np.ndarray) -> _Pieces:
    each = -(-n // PIECE)
    text = np.repeat(np.arange(len(n)), each)
    number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    at = np.repeat(np.cumsum(n) - n, each) + number * PIECE
    size = np.minimum(PIECE, np.repeat(n, each) - number * PIECE)
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    rounds = []
    for k in range(1, int(each.max(initial=0))):
        now = np.flatnonzero(number == k)
        rounds.append((place[now], place[now - 1]))
    return _Pieces(at[order], size[order], (number == 0)[order], text[order], _live(size[order]), rounds)


def likelihoods(codes: np.ndarray, n: np.ndarray, m: Model, counts: np.ndarray | None = None, moves: np.ndarray | None = None, starts: np.ndarray | None = None) -> np.ndarray:
    """log10 of each text's probability by the scaled forward recursion; with counts, moves and starts the expected ones are added to these.

    codes holds the tokens of all texts, n of each. The steps of all texts are taken together; a text of over PIECE tokens is cut,
    its pieces are run from every state there may be before them, and put together piece after piece. Emissions are
    taken relative to the class's largest, which no expectation depends on, and sums are scaled every SCALED steps.
    """
    if not len(n):
        return np.zeros(0)
    p, states = _cut(n), len(m.start)
    most = m.emit.max(1)
    most[most == 0] = 1
    total = np.add.reduceat(np.log10(most)[codes], np.cumsum(n) - n)
    one, base = np.ones(states), np.concatenate([[0], np.cumsum(p.live)]).astype(np.int64)
    order = np.concatenate([p.at[:k] + t for t, k in enumerate(p.live)])  # tokens by step
    emit = (m.emit / most[:, None])[codes[order]]
    enter = _entering(p, base, emit, m)
    alphas, step = np.empty((len(codes), states)), np.empty((len(p.at), states))
    scales, log = {}, np.zeros(len(p.at))
    for t, k in enumerate(p.live):
        here = alphas[base[t] : base[t + 1]]
        if t:
            np.matmul(alphas[base[t - 1] : base[t - 1] + k], m.move, out=step[:k])
        else:
            step = np.where(p.begins[:, None], m.start, enter @ m.move)
        np.multiply(step[:k], emit[base[t] : base[t + 1]], out=here)
        if t % SCALED == SCALED - 1:
            scales[t] = here @ one
            here /= scales[t][:, None]
            log[:k] += np.log10(scales[t])
    last = alphas[base[p.size - 1] + np.arange(len(p.size))]
    np.add.at(total, p.text, log + np.log10(last @ one))
    if counts is None:
        return total
    beta = np.ones((len(p.at), states))  # of what follows, so scaled that with the forward sum it makes one
    for now, before, product in reversed(p.rounds):
        y = (product @ beta[now][:, :, None])[:, :, 0]
        beta[before] = y / (y @ one)[:, None]
    beta /= ((last * beta) @ one)[:, None]
    pairs, back = np.zeros((states, states)), m.move.T.copy()
    for t in range(len(p.live) - 1, -1, -1):
        k, here = p.live[t], alphas[base[t] : base[t + 1]]
        w = emit[base[t] : base[t + 1]] * beta[:k]
        here *= beta[:k]
        if t in scales:
            w /= scales[t][:, None]
        if t:
            pairs += alphas[base[t - 1] : base[t - 1] + k].T @ w
            np.matmul(w, back, out=beta[:k])
        else:
            starts += here[p.begins].sum(0)
            pairs += enter[~p.begins].T @ w[~p.begins]
    moves += pairs * m.move
    kinds = codes[order]
    for s in range(states):
        counts[:, s] += np.bincount(kinds, alphas[:, s], len(counts))
    return total


def _entering(p: _Pieces, base: np.ndarray, emit: np.ndarray, m: Model) -> np.ndarray:
    """The states before each piece that goes on with a text; p.rounds gets the pieces' products beside them."""
    states = len(m.start)
    enter, after = np.zeros((2, len(p.at), states))
    if not p.rounds:
        return enter

    def run(which: np.ndarray, x: np.ndarray, first: bool) -> np.ndarray:
        """x (piece, any, state) at the pieces' ends, scaled."""
        for t, k in enumerate(_live(p.size[which])):
            y = x[:k] if first and not t else (x[:k].reshape(-1, states) @ m.move).reshape(k, -1, states)
            np.multiply(y, emit[base[t] + which[:k]][:, None, :], out=x[:k])
            if t % SCALED == SCALED - 1:
                x[:k] /= x[:k].sum((1, 2))[:, None, None]
        return x / x.sum((1, 2))[:, None, None]

    rest, head = np.flatnonzero(~p.begins), np.sort(p.rounds[0][1])
    products = run(rest, np.tile(np.eye(states), (len(rest), 1, 1)), False)
    after[head] = run(head, np.tile(m.start, (len(head), 1, 1)), True)[:, 0]
    for k, (now, before) in enumerate(p.rounds):
        product = products[np.searchsorted(rest, now)]
        p.rounds[k] = now, before, product
        enter[now] = after[before]
        y = (enter[now][:, None, :] @ product)[:, 0, :]
        after[now] = y / y.sum(1)[:, None]
    return enter


def _slices(n: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Texts and their tokens, some AT_ONCE tokens at a time."""
    ends = np.cumsum(n)
    done = 0
    while done < len(n):
        start = int(ends[done] - n[done])
        stop = max(done + 1, int(np.searchsorted(ends, start + AT_ONCE, side="right")))
        yield slice(done, stop), slice(start, int(ends[stop - 1]))
        done = stop


def first_model(share: np.ndarray, unknown: float, seed: int = 11) -> Model:
    """The model before training: states that last, and emissions set apart by seeded noise. share: of all tokens, by class."""
    rng = np.random.default_rng(seed)
    emit = share[:, None] * np.exp(rng.normal(0, APART, (len(share), STATES)))
    emit[UNKNOWN] = 0
    emit /= np.maximum(emit.sum(0), 1e-300)
    emit *= 1 - unknown
    emit[UNKNOWN] = unknown
    move = np.full((STATES, STATES), (1 - STAY) / (STATES - 1))
    np.fill_diagonal(move, STAY)
    return Model(np.full(STATES, 1 / STATES), move, emit)


def _pass(table: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The expected counts of a pass over the training texts: starts, moves, emissions; each task adds up its own, Spark those of the tasks."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, moves, starts = np.zeros((CLASSES, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
        any_ = False
        for batch in batches:
            for k in range(batch.num_rows):
                n, codes = np.array(batch["n"][k].values), np.frombuffer(batch["codes"][k].as_buffer(), np.uint16)
                taught = ~np.array(batch["held"][k].values.to_numpy(zero_copy_only=False), bool)
                codes, n = codes[np.repeat(taught, n)], n[taught].astype(np.int64)
                for texts, tokens in _slices(n):
                    likelihoods(codes[tokens], n[texts], model, counts, moves, starts)
                    any_ = True
        if any_:
            rows = np.concatenate([counts, moves, starts[None]])
            keys = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(rows[keys, s]) for s in range(STATES))], names=["key", *names])

    names = [f"s{s}" for s in range(STATES)]
    parts = table.select("held", "n", "codes").mapInArrow(common.lean(expect), "key int, " + ", ".join(f"{x} double" for x in names))
    out = np.zeros((CLASSES + STATES + 1, STATES))
    for r in parts.groupBy("key").agg(*(F.sum(x).alias(x) for x in names)).collect():  # a row a class at most
        out[r["key"]] = r[1:]
    return out[-1], out[CLASSES:-1], out[:CLASSES]


def train(table: DataFrame, share: np.ndarray, unknown: float, passes: int = PASSES) -> Model:
    """The model after some passes of Baum-Welch over all training texts of a coded table."""
    model = first_model(share, unknown)
    for _ in range(passes):
        starts, moves, counts = _pass(table, model)
        emit = (counts + LEAN * share[:, None]) / (counts.sum(0) + LEAN * share.sum())
        emit = emit * (1 - unknown)
        emit[UNKNOWN] = unknown
        moves, starts = moves + EVEN, starts + EVEN
        model = Model(starts / starts.sum(), moves / moves.sum(1)[:, None], emit)
    return model


def score_language(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text and others, which are left out).

    Null and empty texts are an end alone. Repeated rows count and are scored one by one; rows without an id are learnt from.
    Very long texts are read whole, piece by piece. Where there is nothing to learn from every token is unknown and
    has probability 1, as in the base model. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    block = blocks(docs)
    counts = word_counts(block)
    ends = block.select(F.explode("held").alias("h")).where("NOT h").count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count("*").alias("n")).first()
    totals = Totals(total["c"] + ends, total["n"] + (1 if ends else 0), ends)
    words = classed(counts)
    size = sizes(words)
    table = common.settled(spark, lambda: coded(block, words, totals, size))
    share = size[:, 0] / max(1, totals.tokens)
    share[END] = ends / max(1, totals.tokens)
    model = train(table, share, totals.unknown, passes if totals.tokens else 0)
    if not totals.tokens:
        model.emit[UNKNOWN] = 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1)
                n, codes = x["n"].flatten().to_numpy().astype(np.int64), np.frombuffer(x["codes"][0].as_buffer(), np.uint16)
                log = [likelihoods(codes[tokens], n[texts], model) for texts, tokens in _slices(n)]
                out = np.concatenate([np.empty(0), *log]) + x["inner"].flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([
                    x["doc_ids"].flatten(), x["held"].flatten(), pa.array(n), x["n_known"].flatten(),
                    pa.array(np.full(len(n), totals.tokens)), x["base"].flatten(), pa.array(out),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return table.mapInArrow(common.lean(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return score_language(common.table(spark, sf_dir, "documents"))


QUERIES = {"op11_hidden_markov": op11_hidden_markov}
