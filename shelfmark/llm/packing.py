"""Best-fit packing of token sequences by the configuration linear program.

A configuration is a multiset of lengths that fits into one sequence. The program asks how often to
use each configuration so that every length of the histogram is covered with the fewest sequences.
Multiplicative weights solve it: each length has a price, a knapsack over the prices names the
dearest configuration, which is used as far as its scarcest length allows, and the prices of what it
covered fall. The averaged solution is rounded to whole numbers, what is left goes through the same
steps again, and the last few thousand sequences are filled one by one.

The histogram has at most as many rows as the capacity, so the driver's work and what the tasks get
from it do not grow with the corpus. Pieces meet their places by their number within their length.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.ranking import global_index
from shelfmark.llm.base import ROW, or_empty, query, stored, table

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"

#: Rounds of multiplicative weights in a phase, and their rate.
ROUNDS, RATE = 240, 0.6
#: With no more sequences than this left, they are filled one by one.
LAST_SEQUENCES = 1500

# --- the configuration program ------------------------------------------------------


def dearest(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each length in the dearest configuration: knapsack dynamic programme over the
    capacity. ``lengths`` are distinct and ascending."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        k = fit[c]
        value = best[c - lengths[:k]] + prices[:k]
        j = int(value.argmax())
        if value[j] > best[c - 1]:
            best[c], choice[c] = value[j], j
        else:
            best[c] = best[c - 1]
    copies = np.zeros(len(lengths), dtype=np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
            continue
        copies[choice[c]] += 1
        c -= int(lengths[choice[c]])
    return copies


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, as fractions that cover the lengths on average."""
    prices = lengths / capacity
    cover = np.zeros(len(lengths))
    used: dict[bytes, float] = {}
    for _ in range(rounds):
        copies = dearest(lengths, prices, capacity)
        held = copies > 0
        amount = float((counts[held] / copies[held]).min())
        used[copies.tobytes()] = used.get(copies.tobytes(), 0.0) + amount
        share = np.zeros(len(lengths))
        share[held] = copies[held] * amount / counts[held]
        cover += share
        prices = prices * np.exp(-rate * share)
        prices *= (counts @ lengths / capacity) / (counts @ prices)  # an optimal dual sums to this
    mass = counts * lengths
    scale = mass.sum() / (mass @ cover)
    return [(np.frombuffer(k, dtype=np.int64), x * scale) for k, x in sorted(used.items(), key=lambda kx: (-kx[1], kx[0]))]


def rounded(solution: list[tuple[np.ndarray, float]], counts: np.ndarray) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Whole uses of the configurations, none beyond the counts, and the counts left."""
    left = counts.copy()
    out = []
    for copies, x in solution:
        held = copies > 0
        k = int(min(x + 0.5, (left[held] // copies[held]).min()))
        if k > 0:
            left -= k * copies
            out.append((copies, k))
    return out, left


def fill_one(lengths: list[int], left: list[int], capacity: int) -> list[int]:
    """Indices for one sequence: the longest piece left, then the fullest completion of it. Sums
    that can be reached are the bits of one integer."""
    top = max(i for i, n in enumerate(left) if n)
    room = capacity - lengths[top]
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i in range(len(lengths) - 1, -1, -1):
        spare = left[i] - (i == top)
        for _ in range(min(spare, room // lengths[i])):
            steps.append((i, reach))
            reach |= (reach << lengths[i]) & mask
        if reach >> room & 1:
            break
    taken, at = [top], reach.bit_length() - 1
    for i, before in reversed(steps):
        if not before >> at & 1:
            taken.append(i)
            at -= lengths[i]
    return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations (length to copies) and the number of sequences of each; together they hold
    every piece once. Lengths from 1 to ``capacity``."""
    out: list[tuple[dict[int, int], int]] = []
    if histogram.get(capacity):
        out.append(({capacity: 1}, histogram[capacity]))
    lengths = np.array(sorted(n for n, c in histogram.items() if n < capacity and c), dtype=np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    while len(lengths):
        before = int(counts @ lengths)
        chosen, left = rounded(fractional(lengths, counts, capacity), counts)
        out += [({int(n): int(c) for n, c in zip(lengths, copies) if c}, k) for copies, k in chosen]
        lengths, counts = lengths[left > 0], left[left > 0]
        rest = int(counts @ lengths)
        if rest <= LAST_SEQUENCES * capacity or rest > 0.95 * before:
            break
    sizes, left = lengths.tolist(), counts.tolist()
    while any(left):
        config: dict[int, int] = {}
        for i in fill_one(sizes, left, capacity):
            config[sizes[i]] = config.get(sizes[i], 0) + 1
        times = min(left[sizes.index(n)] // c for n, c in config.items())
        for n, c in config.items():
            left[sizes.index(n)] -= c * times
        out.append((config, times))
    return out


class Places:
    """Where the pieces of each length go, as arrays for lookup by (length, number)."""

    def __init__(self, configurations: list[tuple[dict[int, int], int]]):
        rows, first, taken = [], 0, {}
        for config, times in configurations:
            offset = 0
            for length in sorted(config, reverse=True):
                at = taken.get(length, 0)
                rows.append((length, at, first, times, offset))
                taken[length] = at + times * config[length]
                offset += length * config[length]
            first += times
        rows.sort()
        self.length, self.start, self.first, self.times, self.offset = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else [[]] * 5))
        self.sequences = first

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.length * (1 << 44) + self.start, length * (1 << 44) + number, side="right") - 1
        copy, which = np.divmod(number - self.start[row], self.times[row])
        return self.first[row] + which, self.offset[row] + copy * length


# --- tokens -------------------------------------------------------------------------

#: Pieces whose ids a worker keeps (beyond those of one slice of texts), and the longest of them in bytes.
CACHED, CACHED_LENGTH = 600_000, 64


def as_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


#: Kinds of bytes. An odd word has a byte of the last kind: its normal form or split is not plain.
SPACE, LETTER, MARK, DIGIT, ODD = range(5)


def byte_kinds() -> np.ndarray:
    """The kind of each byte. Marks are the ASCII ones but the apostrophe, white space is that between words (``base.WORD``)."""
    kinds = np.full(256, ODD, dtype=np.uint8)
    kinds[33:127] = MARK
    kinds[ord("'")] = ODD
    kinds[48:58] = DIGIT
    kinds[65:91] = kinds[97:123] = LETTER
    kinds[9:14] = kinds[32] = SPACE
    return kinds


_KINDS = byte_kinds()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def cut_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where the pieces of UTF-8 bytes start, which of them are odd words, and the pieces.

    A word of Latin letters (ASCII and À to ÿ), ASCII digits and marks has a piece, in lower case, for each run
    of letters, each run of marks and each digit, as the tokenizer splits it. Any other word is one
    piece, unchanged. The last byte has to be white space.
    """
    kind, lower = _KINDS[data], _LOWER[data]
    lead = np.flatnonzero(data == 0xC3)  # of À to ÿ, where 97 and B7 are signs
    second = data[lead + 1]
    lead = lead[(second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    capital = lead[data[lead + 1] < 0x9F]
    lower[capital + 1] += 0x20

    if (kind == ODD).any():
        word = np.concatenate([[False], kind != SPACE])
        first, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
        odd = np.logical_or.reduceat(kind == ODD, first)
        first, size = first[odd], (end - first)[odd]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        kind[at] = ODD
        lower[at] = data[at]

    kept = kind != SPACE
    starts = kept & (kind == DIGIT)
    starts[0] = kept[0]
    starts[1:] |= kept[1:] & (kind[1:] != kind[:-1])
    ends = np.flatnonzero(kept[:-1] & (starts[1:] | ~kept[1:])) + 1
    starts = np.flatnonzero(starts)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(lower[kept])])
    return starts, kind[starts] == ODD, pieces


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the other
    bytes take the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts as little-endian bytes.

    The tokenizer's normaliser and splitter never join characters across white space, so a
    text's ids are those of its words in turn, and those of a plain word are those of its pieces.
    Pieces that come again are looked up. Pieces of plain words go to the tokenizer's BPE
    model at once, odd words through its whole chain.
    """

    #: Pieces in one call of the tokenizer.
    TOGETHER = 1000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.model.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.letters = {b: c for b, c in byte_letters().items() if b != 32}
        self.known: dict[bytes, bytes] = {}

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of_plain(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of plain words. The model sees them in one text; a piece ends where
        an id closes a word."""
        text = b" ".join(pieces).decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
        if len(ends) != len(pieces):  # a vocabulary without marked ends
            return [as_bytes([t.id for t in self.tokenizer.model.tokenize(w)]) for w in text.split(" ")]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, pieces: list[bytes], words: list[bytes]) -> None:
        """Look up new pieces of plain words and new odd words."""
        for i in range(0, len(pieces), self.TOGETHER):
            some = pieces[i : i + self.TOGETHER]
            self.known.update(zip(some, self.ids_of_plain(some)))
        self.known.update(zip(words, self.ids_of([w.decode() for w in words])))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        parts = [t.encode() for t in texts]
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        starts, odd, pieces = cut_pieces(np.frombuffer(b"\n".join([*parts, b""]), np.uint8))
        coded = pieces.dictionary_encode()
        number, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        is_odd = np.zeros(len(distinct), dtype=bool)
        is_odd[number[odd]] = True
        new = [i for i, w in enumerate(distinct) if w not in self.known]
        if len(self.known) + len(new) > CACHED:
            self.known = {w: self.known[w] for w in distinct if w in self.known}
        self.learn([distinct[i] for i in new if not is_odd[i]], [distinct[i] for i in new if is_odd[i]])

        found = list(map(self.known.__getitem__, distinct))
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        sizes = size[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(first[number] - ends[:-1], sizes)
        at += np.arange(len(at))
        data = ids[at].tobytes()
        for i in new:
            if len(distinct[i]) > CACHED_LENGTH:
                del self.known[distinct[i]]
        cuts = (4 * ends[np.searchsorted(starts, begins)]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


_ENCODERS: dict[str, Encoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks_by_size(texts: list[str], most: int = 4_000_000):
    """Slices of the list with a bounded number of characters (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 100
    if start < len(texts):
        yield start, len(texts)


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``.

    ``tokenizer`` is a public tokenizer's file name or a path that exists on all machines.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches):
        path = tokenizer if os.path.isabs(tokenizer) else tokenizer_path(tokenizer)
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks_by_size(texts):
                source, rows = [], []
                for at, data in enumerate(encoder.encode(texts[a:b]), a):
                    data += END_ID.to_bytes(4, "little")
                    for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[start : start + 4 * capacity]
                        source.append(at)
                        rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if keep_ids else None))
                piece, start, length, crc, ids = zip(*rows)
                columns = [batch.column("doc_id").take(pa.array(source)), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    shape = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", or_empty("text").alias("text")).mapInArrow(cut, shape)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. The table is read twice: store it before.

    Pieces are numbered within their length by one range sort over length and document, so a
    length that a third of all pieces share is spread over many tasks. Equal rows are pieces
    of their own. Lengths must lie between 1 and ``capacity``.
    """
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    places = Places(plan(counted, capacity))
    before = np.zeros(capacity + 2, dtype=np.int64)
    for length, n in counted.items():
        before[length + 1] = n
    before = np.cumsum(before)
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    numbers = global_index(pieces.select(kept), ["length", "doc_id", "piece", "ids_crc32"], "_number")

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("_number").to_numpy(zero_copy_only=False)
            sequence, offset = places.find(length, number - before[length])
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = numbers.select(kept).schema.add("sequence_id", "long").add("offset", "long")
    return numbers.mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their places.

    A NULL or empty text is the end id alone. Rows with one id are documents of their own. An
    empty table has no pieces. Long texts are tokenised whole; memory for a task is one batch
    of texts and their ids.
    """
    return pack_pieces(stored(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)


def packed_sequences(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id``, ``ids`` and ``doc_ids``: the sequences themselves, at most ``capacity``
    ids in a group. Only narrow rows are sorted; the ids move once, to their sequence."""
    pieces = stored(token_pieces(docs, tokenizer, capacity, keep_ids=True).withColumn(ROW, F.monotonically_increasing_id()), "id-pieces")
    placed = pack_pieces(pieces.drop("ids"), capacity).select(ROW, "sequence_id", "offset")
    part = F.struct("offset", "ids", "doc_id")
    return (
        pieces.select(ROW, "ids", "doc_id")
        .join(placed, ROW)
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
    )


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
