"""Near-duplicates by BagMinHash over multisets of five-word shingles.

A document is a bag: its shingles with their counts. Every unit of weight of every shingle carries a
Poisson process of points in time, each with a random component of the signature, all derived from
hashes; a component's value is its earliest point. Weights are discretised at powers of two, and
a level's process is thinned to the part of it that the weight covers, so heavy shingles cost a
logarithm of their weight. Two signatures agree in a component with a probability equal to the
weighted Jaccard similarity, sum of minima over sum of maxima.

Equal texts are folded first. Bands of the signatures make buckets, which are cut into blocks of
bounded size. In a first round two pivots of a bucket are compared with all its other members; what
they link becomes one component, so a bucket of thousands of copies needs no more. In a second round
members that are still in different components, mostly texts that share one passage, are compared
pair by pair. Comparisons are on the signatures; pairs that could be similar enough are then
checked, and links rest on the bags alone, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.base import ROW, numbered, or_empty, query, stored, table
from shelfmark.llm.decontaminate import SHINGLE, slices, tokens

SIMILARITY = 0.8
BANDS, PER_BAND = 20, 4
#: Documents that one task compares with one pivot's bag.
PER_PIVOT = 512
#: Members of a bucket that are compared with all others in the first round.
PIVOTS = 2
#: So many ids of documents (8 bytes each) are sent to the texts; more are joined with them.
SENT_IDS = 1_000_000
#: Members of a bucket that are compared with as many others at once.
BLOCK = 1024
#: A pair goes on if its signatures agree in no fewer components than the similarity less this
#: many standard deviations: one linked pair in 20 million is below.
DEVIATIONS = 5.5

_MASK = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


class Bags:
    """Shingle bags of texts; hashes of words that come again are looked up."""

    KNOWN = 500_000

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.KNOWN:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def bag(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, ascending, and their counts."""
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hashes(words)
        width = min(SHINGLE, len(h))
        n = len(h) - width + 1
        s = np.full(n, width, np.uint64)
        for i in range(width):
            s = mix(s * _ODD + h[i : i + n])
        return np.unique(s, return_counts=True)


def bag_min_hash(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Signatures (a row per bag, ``size`` times) as float64; an empty bag gives infinities."""
    out = np.full((len(bags), size), np.inf)
    if not bags:
        return out
    element = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags]).astype(np.float64)
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    # Level 0 is the weight interval (0, 1], level j > 0 is (2^(j-1), 2^j].
    deepest = int(np.ceil(np.log2(weight.max()))) if len(weight) else 0
    seeds, owners, weights, lows, rates = [mix(element)], [owner], [weight], [np.zeros(len(weight))], [np.ones(len(weight))]
    for j in range(1, deepest + 1):
        low = 2.0 ** (j - 1)
        on = weight > low
        seeds.append(mix(element[on] + np.uint64(j * int(_ODD) & _MASK)))
        owners.append(owner[on])
        weights.append(weight[on])
        lows.append(np.full(on.sum(), low))
        rates.append(np.full(on.sum(), low))
    seed, owner, weight, low, rate = map(np.concatenate, (seeds, owners, weights, lows, rates))
    time, turn, flat = np.zeros(len(seed)), 0, out.reshape(-1)
    while len(seed):
        turn += 1
        point = mix(seed + np.uint64(turn * 0xD1342543DE82EF95 & _MASK))
        time = time - np.log(unit(point)) / rate
        where = mix(point + _ODD)
        component = (where >> np.uint64(32)) % np.uint64(size)
        position = low + rate * unit(mix(where + _ODD))  # the interval is as wide as its rate
        inside = position <= np.maximum(weight, 1)
        np.minimum.at(flat, owner[inside] * size + component[inside].astype(np.int64), time[inside])
        alive = time < out.max(axis=1)[owner]
        seed, owner, weight, low, rate, time = (a[alive] for a in (seed, owner, weight, low, rate, time))
    return out


def band_keys(signatures: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, per_band)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for i in range(per_band):
        key = mix(key * _ODD + bits[:, :, i])
    return key.view(np.int64)


def signed(rows: DataFrame, bands: int = BANDS, per_band: int = PER_BAND) -> DataFrame:
    """``_row``, ``doc_id``, ``digest`` of the words, ``weight`` (shingles), ``keys`` of the
    bands and ``marks``, 8 bits of each component."""

    def run(batches):
        bags = Bags()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in slices(texts):
                words = [tokens(t) for t in texts[a:z]]
                held = [bags.bag(w) for w in words]
                digest = pa.array([xxhash.xxh3_128_digest("\n".join(w).encode("utf-8", "surrogatepass")) for w in words], pa.binary())
                weight = pa.array([int(c.sum()) for _, c in held], pa.int64())
                signatures = bag_min_hash(held, bands * per_band)
                marks = pa.array([m.tobytes() for m in (mix(signatures.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)], pa.binary())
                keys = band_keys(signatures, bands, per_band)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(ROW)[a:z], batch.column("doc_id")[a:z], digest, weight, keys, marks], names=[ROW, "doc_id", "digest", "weight", "keys", "marks"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select(ROW, "doc_id", or_empty("text").alias("text")).mapInArrow(run, f"{ROW} bigint, doc_id {kind}, digest binary, weight bigint, keys array<bigint>, marks binary")


def packed(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """A bag as bytes: how many hashes, the hashes, then place and count of those that come more than
    once. Most come once, so a shingle takes 8 bytes."""
    more = np.flatnonzero(counts > 1)
    return np.int64(len(hashes)).tobytes() + hashes.astype(np.uint64).tobytes() + more.astype(np.int64).tobytes() + counts[more].astype(np.int64).tobytes()


def unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(bag, np.int64, 1)[0])
    more, counts = np.split(np.frombuffer(bag, np.int64, offset=8 * (n + 1)), 2)
    out = np.ones(n, np.int64)
    out[more] = counts
    return np.frombuffer(bag, np.uint64, n, 8), out


def bag_table(rows: DataFrame) -> DataFrame:
    """``_row`` and ``bag``, packed."""

    def run(batches):
        bags = Bags()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                out.append(packed(*bags.bag(tokens(text))))
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(out, pa.binary())], names=[ROW, "bag"])

    return rows.select(ROW, or_empty("text").alias("text")).mapInArrow(run, f"{ROW} bigint, bag binary")


def similarity(a: bytes, b: bytes) -> float:
    """Sum of minima over sum of maxima."""
    (ha, ca), (hb, cb) = unpacked(a), unpacked(b)
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    total = int(ca.sum() + cb.sum()) - common
    return common / total if total else 0.0


def verified(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs ``(pivot, member)`` that are similar enough.

    Bags meet where the pivots' bags lie, so those of members move twice and those of pivots once.
    The bag of a pivot with more than ``PER_PIVOT`` members is sent once for every so many of them, ahead
    of them in sort order, so a task holds that one bag and streams the members past it.
    """
    load = stored(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PER_PIVOT), "pivot-loads")
    # Both reads of the bags are one exchange: they are alike up to the join.
    held = bags.select(ROW, "bag")
    few = pairs.join(load, "pivot", "left_anti")
    sent = few.join(held, few["member"] == held[ROW]).select("pivot", "member", F.col("bag").alias("other"))
    met = sent.join(held, sent["pivot"] == held[ROW]).select("pivot", "member", "other", "bag")

    def compare(batches):
        for batch in batches:
            keep = [i for i, (a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bag", "other")))) if similarity(a, b) >= least]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("pivot", "member")], names=["pivot", "member"])

    found = met.mapInArrow(compare, "pivot bigint, member bigint")
    return found if load.isEmpty() else found.unionByName(_past_pivots(pairs, load, bags, least))


def _past_pivots(pairs: DataFrame, load: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    load = load.withColumn("shares", F.ceil(F.col("n") / PER_PIVOT).cast("int"))
    share = F.pmod(F.xxhash64("member"), F.col("shares")).cast("int")
    members = (
        pairs.join(load.select("pivot", "shares"), "pivot")
        .select("pivot", share.alias("share"), "member")
        .join(bags.select(F.col(ROW).alias("member"), "bag"), "member")
        .select("pivot", "share", "member", "bag")
    )
    pivots = (
        load.select("pivot", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        .join(bags.select(F.col(ROW).alias("pivot"), "bag"), "pivot")
        .select("pivot", "share", F.lit(None).cast("bigint").alias("member"), "bag")
    )
    sorted_rows = pivots.unionByName(members).repartition("pivot", "share").sortWithinPartitions("pivot", "share", F.col("member").asc_nulls_first())

    def run(batches):
        base = None
        for batch in batches:
            pivots, found = [], []
            for pivot, member, bag in zip(*(batch.column(c).to_pylist() for c in ("pivot", "member", "bag"))):
                if member is None:
                    base = bag
                elif similarity(base, bag) >= least:
                    pivots.append(pivot)
                    found.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(pivots, pa.int64()), pa.array(found, pa.int64())], names=["pivot", "member"])

    return sorted_rows.mapInArrow(run, "pivot bigint, member bigint")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node`` and ``label``, the lowest node it is connected with, for all nodes of the
    links ``(pivot, member)``. Labels spread to neighbours and jump to the label's label.

    With ``rounds`` it stops early: nodes of one label are connected then, but not all
    connected nodes have one label. One round completes stars.
    """
    both = stored(
        links.select(F.col("pivot").alias("node"), F.col("member").alias("other")).unionByName(links.select(F.col("member").alias("node"), F.col("pivot").alias("other"))),
        "links",
    )
    labels, done = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels"), 0
    while done != rounds:
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label", F.lit(None).cast("bigint").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        low = heard.unionByName(own).groupBy("node").agg(F.min("label").alias("low"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = stored(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), "old"), "labels")
        labels, done = new.select("node", "label"), done + 1
        if rounds is None and new.filter("label <> old").isEmpty():
            break
    return labels


def blocked(members: DataFrame, signatures: DataFrame, *carried: str) -> DataFrame:
    """The members of each bucket with ``carried`` columns of their signature, a row for each
    block pair ``(i, j)`` that a member takes part in. A bucket is cut into blocks of about
    ``BLOCK`` members by a hash, so the largest bucket is spread over many groups of rows."""
    blocks = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    signatures = only(signatures, members.select(F.col("node").alias(ROW)).distinct())
    rows = (
        members.join(signatures.select(F.col(ROW).alias("node"), *carried), "node")
        .join(blocks, "bucket")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"), "node", "weight", "label", *carried
    )


def by_block(met: DataFrame) -> DataFrame:
    return met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "right", "node")


def groups(batches, names: list[str]):
    """The rows of each (bucket, i, j) as they stream by: the key, and tuples of ``names``."""
    key, group = None, []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", *names))):
            if r[:3] != key:
                if len(group) > 1:
                    yield key, group
                key, group = r[:3], []
            group.append(r[3:])
    if len(group) > 1:
        yield key, group


class Block:
    """One group: which of its members may be similar enough, by weights and signatures."""

    NAMES = ["right", "node", "weight", "label", "marks"]

    def __init__(self, group: list, least: float):
        right, node, weight, label, marks = list(zip(*group))[:5]
        self.right, self.node, self.weight, self.label = map(np.array, (right, node, weight, label))
        self.marks = np.frombuffer(b"".join(marks), np.uint8).reshape(len(group), -1)
        self.least, size = least, self.marks.shape[1]
        self.need = size * least - DEVIATIONS * np.sqrt(size * least * (1 - least))
        two = self.right.any()
        self.left = np.flatnonzero(~self.right) if two else np.arange(len(group))
        self.other = np.flatnonzero(self.right) if two else None

    def partners(self, x: int, all_others: bool = False) -> np.ndarray:
        """Members that come after ``x`` (or all others), of another label."""
        y = self.other if self.other is not None else self.left[self.left != x] if all_others else self.left[self.left > x]
        w = self.weight
        y = y[(self.label[y] != self.label[x]) & (np.minimum(w[y], w[x]) >= self.least * np.maximum(w[y], w[x]))]
        return y[(self.marks[y] == self.marks[x]).sum(axis=1) >= self.need] if len(y) else y


def as_pairs(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.int64()) for c in (0, 1)], names=["pivot", "member"])


def pivot_pairs(members: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Pairs ``(pivot, member)`` of ``PIVOTS`` members of a bucket's first block with all others."""
    met = by_block(blocked(members, signatures, "marks").filter(F.col("i") == 0))

    def run(batches):
        out = []
        for _, group in groups(batches, Block.NAMES):
            block = Block(group, least)
            # The same ones in every bucket they are in: the lowest hashes.
            for x in block.left[np.argsort(mix(block.node[block.left].astype(np.uint64)))[:PIVOTS]]:
                out.extend((min(block.node[x], block.node[y]), max(block.node[x], block.node[y])) for y in block.partners(x, True))
            if len(out) > 10_000:
                yield as_pairs(out)
                out = []
        yield as_pairs(out)

    return met.mapInArrow(run, "pivot bigint, member bigint").distinct()


def links_in_blocks(members: DataFrame, signatures: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Linked pairs of different labels in the buckets. A first pass leaves the members that
    have a possible partner; their bags join them, once for each block pair, and a second
    pass compares bags in place, so a pair becomes a row only if it is a link. A pair that
    shares several buckets is compared in that of the first band it agrees in."""
    names = [*Block.NAMES, "keys"]

    def first(block: Block, keys: np.ndarray, bucket: int):
        for x in block.left:
            y = block.partners(x)
            if len(y):
                same = keys[y] == keys[x]
                yield x, y[keys[x][same.argmax(axis=1)] == bucket]

    def keep(batches):
        for (bucket, i, j), group in groups(batches, names):
            block, keys = Block(group, least), np.array([g[5] for g in group])
            held = sorted({int(k) for x, y in first(block, keys, bucket) if len(y) for k in (x, *y)})
            if held:
                columns = list(zip(*(group[k] for k in held)))
                kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                key = [pa.array([v] * len(held), t) for v, t in ((bucket, pa.int64()), (i, pa.int32()), (j, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*key, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["bucket", "i", "j", *names])

    def compare(batches):
        for (bucket, _, _), group in groups(batches, [*names, "bag"]):
            block, keys = Block(group, least), np.array([g[5] for g in group])
            out, joined = [], {}

            def root(label: int) -> int:
                while label in joined:
                    label = joined[label]
                return label

            for x, y in first(block, keys, bucket):
                for k in y:
                    low, high = sorted((root(int(block.label[x])), root(int(block.label[k]))))
                    # What the block has connected needs no further link.
                    if low != high and similarity(group[x][6], group[k][6]) >= least:
                        joined[high] = low
                        out.append((min(block.node[x], block.node[k]), max(block.node[x], block.node[k])))
            yield as_pairs(out)

    shape = "bucket bigint, i int, j int, right boolean, node bigint, weight bigint, label bigint, marks binary, keys array<bigint>"
    possible = stored(by_block(blocked(members, signatures, "marks", "keys")).mapInArrow(keep, shape), "possible")
    bags = bags_of(rows, possible.select(F.col("node").alias(ROW)).distinct())
    met = possible.join(bags.select(F.col(ROW).alias("node"), "bag"), "node").select("bucket", "i", "j", *names, "bag")
    return by_block(met).mapInArrow(compare, "pivot bigint, member bigint").distinct()


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows named by ``ids(_row)``; up to ``SENT_IDS`` ids are sent, so that the rows stay where they are."""
    ids = stored(ids, "row-ids")
    wanted = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    return rows.join(wanted, ROW, "left_semi")


def bags_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The bags of the documents named by ``ids(_row)``, read from their whole texts."""
    return stored(bag_table(only(rows, ids)), "bags")


def near_links(signatures: DataFrame, rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Labels of the connected components among different texts: ``node``, ``label``.

    ``signatures`` has one row per different text (``_row``, ``weight``, ``keys``, ``marks``).
    """
    exploded = signatures.select(F.col(ROW).alias("node"), "weight", F.explode("keys").alias("bucket"))
    crowded = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = stored(exploded.join(crowded, "bucket").select("bucket", "node", "weight", F.col("node").alias("label")), "buckets")
    pairs = stored(pivot_pairs(members, signatures, least), "pairs")
    ids = pairs.select(F.col("pivot").alias(ROW)).unionByName(pairs.select(F.col("member").alias(ROW))).distinct()
    links = stored(verified(pairs, bags_of(rows, ids), least), "found")
    # Members of one label are connected already; only buckets of several labels go on.
    labelled = members.drop("label").join(components(links, 1), "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = labelled.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("bucket")
    rest = stored(labelled.join(several, "bucket").select("bucket", "node", "weight", "label"), "buckets")
    more = stored(links_in_blocks(rest, signatures, rows, least), "found")
    return components(links.unionByName(more))


def classes(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``_row``, ``doc_id``, ``class_row`` and ``class_id`` for stored rows with ``_row``,
    ``doc_id``, ``text``. ``class_row`` is the class's row with the lowest id, NULL last."""
    sigs = stored(signed(rows), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    worded = sigs.filter("weight > 0")
    # The signature of a text moves once, with the fold; copies are folded before they move.
    signature = F.min_by(F.struct(ROW, "weight", "keys", "marks"), ROW).alias("s")
    texts = stored(worded.groupBy("digest").agg(signature, F.min(first).alias("first")).select("digest", "first", "s.*"), "texts")
    labels = near_links(texts.select(ROW, "weight", "keys", "marks"), rows, least).select(F.col("node").alias(ROW), "label")
    grouped = texts.join(labels, ROW, "left").withColumn("label", F.coalesce("label", F.col(ROW)))
    heads = grouped.groupBy("label").agg(F.min("first").alias("head"))
    of_text = grouped.select("digest", "label").join(heads, "label").select("digest", "head")
    found = worded.select(ROW, "doc_id", "digest").join(of_text, "digest").select(ROW, "doc_id", F.col("head.row").alias("class_row"), F.col("head.id").alias("class_id"))
    alone = sigs.filter("weight = 0").select(ROW, "doc_id", F.col(ROW).alias("class_row"), F.col("doc_id").alias("class_id"))
    return found.unionByName(alone)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id`` and ``class_id``, the lowest id of its class, for every row.

    Two documents are linked when the bags of their five-word shingles (lower-cased words of
    letters, digits and underscores) have a weighted Jaccard similarity of at least ``least``;
    classes are the connected components. A text under five words is one shingle. NULL, empty
    and wordless texts are classes of their own. Equal rows are in one class. NULL ids come
    last; a class of NULL ids only has a NULL class id. An empty table gives an empty result.
    """
    return classes(numbered(docs.select("doc_id", "text"), "dup-rows"), least).select("doc_id", "class_id")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` per class, the one with the lowest id."""
    rows = numbered(docs, "dup-rows")
    keep = classes(rows, least).filter(F.col(ROW) == F.col("class_row")).select(ROW)
    return only(rows, keep).select(docs.columns)


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
spread AS (SELECT doc_id, ws, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM words),
grams AS (
  SELECT doc_id, CASE WHEN n < {SHINGLE} THEN array_to_string(ws, ' ') ELSE concat_ws(' ', w, {", ".join(f"lead(w, {i}) OVER o" for i in range(1, SHINGLE))}) END AS gram
  FROM spread WINDOW o AS (PARTITION BY doc_id ORDER BY pos) QUALIFY (n < {SHINGLE} AND pos = 1) OR pos <= n - {SHINGLE - 1}),
bags AS (SELECT doc_id, gram, count(*) AS c FROM grams GROUP BY 1, 2),
sizes AS (SELECT doc_id, sum(c) AS n FROM bags GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS common FROM bags x JOIN bags y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE common >= {SIMILARITY} * (s.n + t.n - common)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT documents.doc_id, least(documents.doc_id, coalesce(min(other), documents.doc_id)) AS class_id
FROM documents LEFT JOIN reach USING (doc_id) GROUP BY documents.doc_id"""


@query("op5_near_duplicates", _SQL)
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
