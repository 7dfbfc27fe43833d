"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles, told apart by hashes under two seeds (128 bits). Texts with equal
sets (by digests of 192 bits of both hashes) are one class, and one document of it, with the smallest doc_id,
goes on. Its sketch has REGISTERS registers, each the smallest of the set's
exponentially distributed hash values on an exponential scale, cut off to a fixed range; registers of a
union are the larger ones, and equal registers are likely in proportion to similarity. Bands of registers
are hashed, and documents of one band value are compared:

1. with the smallest document of the value: a star, as many pairs as members. The joint likelihood of the
   registers says whether a pair can be near enough, then the full sets of the words themselves decide;
2. where documents of one value are still in different components after that, those outside the leader's
   component with all documents of the value, in blocks that hold the words, are bounded by documents and
   bytes, and return only links that join two components.

So no pair of one band value stays undecided, no group is paired out, and no block outgrows a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkeep.llm import common, packed
from strandkeep.llm.components import connected

#: Bands and registers of a band; a pair at similarity 0.8 shares no band with probability 1e-5, at 0.85 with 1e-8.
BANDS, ROWS = 48, 7
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base of the scale, rate of the values, largest register.
BASE, RATE, LARGEST = 1.02, 20.0, (1 << 16) - 2
#: A pair is given up unread if its estimate lies so many standard errors under the threshold.
ERRORS = 5.0
#: A block's documents and bytes, about: of those outside the leader's component, and of all of the band value.
BLOCK_REST, BLOCK_ALL = 128, 512
REST_BYTES, ALL_BYTES = 4 << 20, 16 << 20
#: Shingles that a block keeps spelled out, about.
HELD_SHINGLES = 200_000
#: Documents without an id are keyed from here on, by a hash of their text.
_NULL_IDS = 1 << 62
_FACTORS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text, A-Z in lower case, as hashes under two seeds, sorted by the first and then the second.

    Fewer words than size are one shingle, none are none. Words made to collide under one seed differ under the other.
    """
    lower = [t.lower() for t in texts]
    (one, starts), (two, _) = (common.hash_words(lower, seed) for seed in (0, 1))
    every, out = [common.rolling(one, size), common.rolling(two, size)], []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(_distinct(*(x[a : b - size + 1] for x in every)))
        elif b > a:
            out.append(tuple(common.mixed(common.rolling(x[a:b], b - a) + np.uint64(b - a)) for x in (one, two)))
        else:
            out.append((np.empty(0, np.uint64),) * 2)
    return out


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of x and y in order."""
    order = np.argsort(x)
    x, y = x[order], y[order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():  # a collision under the first seed
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    return x[new], y[new]


def elements(pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One 64-bit value a shingle for the registers, of its hashes under both seeds."""
    return common.mixed(pair[0] + pair[1] * np.uint64(0x9E3779B97F4A7C15))


def spelled(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = text.lower().split()
    return set(zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else {tuple(words)} if words else set()


def sketch(elements: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes, uint16; zeros for the empty set."""
    if not len(elements):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(elements), 1024):
        least = np.minimum(least, (elements[None, k : k + 1024] * _FACTORS[:, None]).min(axis=1))
    value = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-12)) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, LARGEST + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def likeliest(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarities of most likelihood for rows of registers and the sets' sizes, from how many registers are larger, smaller and equal."""
    up, down = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - up - down
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def fit(j):
        q, r = p(u - v * j), p(v - u * j)
        return up * np.log(q + 1e-12) + down * np.log(r + 1e-12) + same * np.log(np.maximum(1 - q - r, 1e-12))

    low, high = np.zeros(len(u)), top.copy()
    for _ in range(30):  # golden section; the likelihood has one peak
        x, y = high - (high - low) * 0.618034, low + (high - low) * 0.618034
        better = fit(x) > fit(y)
        high, low = np.where(better, y, high), np.where(better, low, x)
    return (low + high) / 2


def near_enough(a, b, n_a, n_b, percent: int) -> np.ndarray:
    """Whether the sizes and the estimates leave room for the threshold."""
    t = percent / 100
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & (likeliest(a, b, n_a.astype(float), n_b.astype(float)) >= t - ERRORS * math.sqrt(t * (1 - t) / REGISTERS))


def linked(a: set, b: set, percent: int) -> bool:
    """100 * intersection >= percent * union, on the full sets."""
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band of each row of registers."""
    rows = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    out = np.zeros(rows.shape[:2], np.uint64)
    for k in range(ROWS):
        out = common.mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k] + np.uint64(1))
    return common.mixed(out + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F))


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc, t (a digest of the text), n (size of the set), s (digests of the set under two seeds) of rows doc, text."""

    def digested(batches):
        for batch in batches:
            sets = shingle_sets(common.texts(batch.column("text")), size)
            digests = [xxhash.xxh3_128_digest(x.tobytes()) + xxhash.xxh3_64_digest(y.tobytes()) for x, y in sets]
            yield pa.record_batch([batch.column("doc"), batch.column("t"), pa.array([len(x) for x, _ in sets], pa.int64()), pa.array(digests, pa.binary())], ["doc", "t", "n", "s"])

    return docs.select("doc", _digest().alias("t"), "text").mapInArrow(common.lean(digested), "doc long, t binary, n long, s binary")


def _digest() -> F.Column:
    return F.unhex(F.sha2("text", 256))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc, words (joined by one space, in lower case), n (size of the set), registers (packed) of rows doc, text."""

    def built(batches):
        for batch in batches:
            texts = common.texts(batch.column("text"))
            sets = shingle_sets(texts, size)
            words = [b" ".join(t.lower().split()) for t in texts]
            columns = [batch.column("doc"), pa.array(words, pa.binary()), pa.array([len(x) for x, _ in sets], pa.int64()), pa.array([sketch(elements(x)).tobytes() for x in sets], pa.binary())]
            yield pa.record_batch(columns, ["doc", "words", "n", "registers"])

    return docs.select("doc", "text").mapInArrow(common.lean(built), "doc long, words binary, n long, registers binary")


def _rows(values: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _verify(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b of those pairs that are linked: estimated from the sketches first, then decided on the words."""
    one, two = (sets.select(F.col("doc").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("words", "n", "registers"))) for x in "ab")

    def decided(batches):
        for batch in batches:
            a, b, wa, wb, ra, rb, na, nb = (batch.column(c).to_pylist() for c in ("a", "b", "words_a", "words_b", "registers_a", "registers_b", "n_a", "n_b"))
            keep, last, own = [], None, set()
            if a:
                room = near_enough(_rows(ra, np.uint16), _rows(rb, np.uint16), np.array(na), np.array(nb), percent)
                for k in np.flatnonzero(room).tolist():
                    if b[k] != last:  # rows of one leader stand together
                        last, own = b[k], spelled(wb[k], size)
                    if linked(spelled(wa[k], size), own, percent):
                        keep.append(k)
            yield pa.record_batch([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", *(f"{c}_{x}" for c in ("words", "n", "registers") for x in "ab")).mapInArrow(common.lean(decided), "a long, b long")


def block_links(rows: list[tuple], size: int, percent: int) -> list[tuple[int, int]]:
    """Links of one block that join two components: each document of rest against all.

    rows: doc, component, rest, words, n, registers. Sketches rule pairs out, the words decide, and documents
    that a link has joined are not compared again.
    """
    if not rows:
        return []
    docs, components, rest, words, n, registers = zip(*rows, strict=True)
    sketches, n = _rows(registers, np.uint16), np.array(n)
    _, own = np.unique(components, return_inverse=True)
    root = np.arange(own.max() + 1)
    t = percent / 100
    least = REGISTERS * (t - ERRORS * math.sqrt(t * (1 - t) / REGISTERS))  # equal registers are at least as likely as similarity
    out, sets, held = [], {}, 0
    for k in np.flatnonzero(rest).tolist():
        there = np.flatnonzero(root[own] != root[own[k]])
        if not len(there):
            break
        there = there[(sketches[there] == sketches[k]).sum(1) >= least]
        if not len(there):
            continue
        there = there[near_enough(sketches[there], sketches[k][None, :], n[there], np.full(len(there), n[k]), percent)]
        mine = spelled(words[k], size) if len(there) else set()
        for j in there.tolist():
            if root[own[j]] != root[own[k]]:
                if j not in sets:
                    if held > HELD_SHINGLES:
                        sets.clear()
                        held = 0
                    sets[j] = spelled(words[j], size)
                    held += len(sets[j])
                if linked(mine, sets[j], percent):
                    out.append((docs[k], docs[j]))
                    root[root == root[own[j]]] = root[own[k]]
    return out


def similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc, n_shingles, component of every different doc of rows doc (no null), text (no null).

    Documents link if 100 * intersection >= percent * union of their sets; empty sets link with nothing.
    """
    known = common.stash(described(docs, size))
    equal = known.where("n > 0").groupBy("s").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    others = common.stash(known.join(common.sized(common.stash(equal.where("least < most")), F.lit(24)), "s").where("doc <> least").select("doc", "t", "least"))
    empty = known.where("n = 0").select("doc", "t")
    apart = others.select("doc", "t").unionByName(empty).distinct()
    one = docs.withColumn("t", _digest()).join(common.sized(common.stash(apart), F.lit(32)), ["doc", "t"], "left_anti").select("doc", "text")

    def banded(batch):
        sets = shingle_sets(common.texts(batch.column("text")), size)
        registers = np.array([sketch(elements(s)) for s in sets]).reshape(-1, REGISTERS)
        ids = batch.column("doc").to_numpy()
        text, band = np.repeat(np.arange(len(ids)), BANDS), np.tile(np.arange(BANDS), len(ids))
        return [band_hashes(registers).ravel()], text, band, ids, ids

    buckets = packed.buckets_for(known.count() * BANDS)
    members = common.stash(packed.repeated(one, banded, packed.Packing(buckets, wide=False, least=True), members=True))
    stars = members.where("doc <> leader").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct()
    touched = common.stash(members.select("doc").distinct())
    sets = common.stash(_sets(one.join(touched, "doc", "left_semi"), size))
    links = common.stash(_verify(stars, sets, size, percent))
    first = connected(links)
    # band values that still hold several components
    nodes = sets.groupBy("doc").agg(F.sum(F.octet_length("words")).alias("bytes")).join(first.withColumnRenamed("node", "doc"), "doc", "left")
    inside = members.join(nodes, "doc").withColumn("component", F.coalesce("component", "doc"))
    lead = first.select(F.col("node").alias("leader"), F.col("component").alias("of_leader"))
    inside = inside.join(lead, "leader", "left").withColumn("rest", F.col("component") != F.coalesce("of_leader", "leader"))
    inside = common.stash(inside.select("hash", "doc", "component", "rest", "bytes"))
    # a value of two documents has had its pair compared; values of the same documents are compared once
    of_value = inside.groupBy("hash").agg(
        F.count("*").alias("all"), F.sum(F.col("rest").cast("long")).alias("some"),
        F.sum("bytes").alias("all_bytes"), F.coalesce(F.sum(F.when(F.col("rest"), F.col("bytes"))), F.lit(0)).alias("some_bytes"),
        *(F.sum(F.xxhash64(F.lit(k), "doc").bitwiseAND(F.lit((1 << 30) - 1))).alias(f"sum{k}") for k in (1, 2)),
    )
    parts = {
        "x": F.greatest(F.ceil(F.col("all") / BLOCK_ALL), F.ceil(F.col("all_bytes") / ALL_BYTES)).cast("int"),
        "y": F.greatest(F.ceil(F.col("some") / BLOCK_REST), F.ceil(F.col("some_bytes") / REST_BYTES)).cast("int"),
    }
    open_ = of_value.where("some > 0 AND all > 2").withColumns(parts).groupBy("x", "y", "all", "some", "sum1", "sum2").agg(F.min("hash").alias("hash")).select("hash", "x", "y")
    blocks = inside.join(open_, "hash")
    spread = F.pmod(F.xxhash64("doc"), F.col("x")).cast("int")
    alls = blocks.where("NOT rest").withColumn("bx", spread).withColumn("by", F.explode(F.sequence(F.lit(0), F.col("y") - 1)))
    rests = blocks.where("rest").withColumn("by", F.pmod(F.xxhash64("doc"), F.col("y")).cast("int")).withColumn("bx", F.explode(F.sequence(F.lit(0), F.col("x") - 1)))
    # the documents outside the leader's component also meet each other, across the blocks they are dealt to
    cross = blocks.where("rest AND y > 1").withColumn("bx", -1 - F.pmod(F.xxhash64("doc"), F.col("y")).cast("int")).withColumn("by", F.explode(F.sequence(F.lit(0), F.col("y") - 1)))
    home = blocks.where("rest AND y > 1").withColumn("by", F.pmod(F.xxhash64("doc"), F.col("y")).cast("int")).withColumn("bx", F.explode(F.expr("sequence(-y, -1)")))
    columns = ["hash", "bx", "by", "doc", "component", "rest"]
    dealt = alls.select(columns).unionByName(rests.select(columns)).unionByName(cross.withColumn("rest", F.lit(False)).select(columns)).unionByName(home.select(columns))

    def joined(batches):
        held, block = [], None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*columns, "words", "n", "registers")), strict=True):
                if row[:3] != block:
                    out += block_links(held, size, percent)
                    held, block = [], row[:3]
                held.append(row[3:])
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        out = block_links(held, size, percent)
        yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.join(sets, "doc").repartition(n, "hash", "bx", "by").sortWithinPartitions("hash", "bx", "by", "doc")
    more = sorted_.select(*columns, "words", "n", "registers").mapInArrow(common.lean(joined), "a long, b long")
    all_links = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(common.stash(more))
    classes = connected(all_links.unionByName(others.select(F.col("doc").alias("a"), F.col("least").alias("b"))))
    sizes = known.groupBy("doc").agg(F.max("n").alias("n_shingles"))
    out = sizes.join(classes.withColumnRenamed("node", "doc"), "doc", "left")
    return out.select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text and others) with n_shingles, component_id, kept.

    Null and empty texts have empty sets and stand alone. Rows of one doc_id are one document: it links if
    any of its texts does, n_shingles is of its largest set, and each row gets its component. Rows without a
    doc_id are told apart by their texts and order by hashes of 62 bits, after ids below _NULL_IDS; a component
    whose first document has none has a null component_id. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept", "__doc")]
    of_text = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2) + F.lit(_NULL_IDS)
    keyed = docs.select(*names, F.coalesce(F.col("doc_id").cast("long"), of_text).alias("__doc"))
    unnamed = common.sized(common.stash(keyed.where("doc_id IS NULL").select(F.col("__doc").alias("__component")).distinct()).withColumn("__unnamed", F.lit(True)))
    found = similar(keyed.select(F.col("__doc").alias("doc"), F.coalesce("text", F.lit("")).alias("text")), size, percent)
    found = common.stash(found.select(F.col("doc").alias("__doc"), "n_shingles", F.col("component").alias("__component")))
    found = found.join(unnamed, "__component", "left")
    out = keyed.join(found, "__doc").withColumn("component_id", F.when(F.col("__unnamed").isNull(), F.col("__component")))
    return out.select(*names, "n_shingles", "component_id", (F.col("__doc") == F.col("__component")).alias("kept"))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document: 3-word shingles, similarity 0.85."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op4_near_dups": op4_near_dups}

ORACLES = {
    "op4_near_dups": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
             f AS (SELECT doc_id, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS f FROM s GROUP BY doc_id),
             r AS (SELECT f, min(doc_id) AS rep, any_value(n) AS n FROM f GROUP BY f),
             t AS (SELECT rep, n, s FROM s JOIN r ON rep = doc_id),
             c AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.s = b.s AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
             l AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
             h AS (SELECT rep AS a, rep AS b FROM r UNION SELECT h.a, l.b FROM h JOIN l ON h.b = l.a),
             m AS (SELECT a AS rep, min(b) AS component_id FROM h GROUP BY a)
        SELECT doc_id, coalesce(f.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM d LEFT JOIN f USING (doc_id) LEFT JOIN r USING (f) LEFT JOIN m USING (rep)""",
}
