"""Arrow columns of different lengths as compressed bytes, for rows that would move one by one otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

CODEC = "zstd"
#: What a task hands on: the part that a blob belongs to, and the blob with its size.
BLOBS = "part int, size bigint, body binary"


def pack(columns: dict[str, pa.Array]) -> tuple[int, bytes]:
    """The size and the compressed bytes of the columns."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
    batch = pa.RecordBatch.from_arrays(lists, names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    plain = sink.getvalue()
    return plain.size, pa.compress(plain, codec=CODEC, asbytes=True)


def unpack(size: int, body: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(pa.decompress(body, size, codec=CODEC)).read_next_batch()
    return {name: batch.column(name).flatten() for name in batch.schema.names}


def blobs(found: list[tuple[int, tuple[int, bytes]]]) -> pa.RecordBatch:
    """Rows of ``BLOBS``."""
    columns = [pa.array([part for part, _ in found], pa.int32()), pa.array([x[0] for _, x in found], pa.int64()), pa.array([x[1] for _, x in found], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "size", "body"])


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict[str, pa.Array]]]]:
    """The unpacked blobs of each part, from rows that are sorted by it."""
    held, at = [], None
    for batch in batches:
        for part, size, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if part != at and held:
                yield at, held
                held = []
            at = part
            held.append(unpack(size, body.as_buffer()))
    if held:
        yield at, held
