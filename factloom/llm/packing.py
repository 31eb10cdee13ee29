"""Best-fit packing of documents into sequences of fixed length, by merging bins up a tree.

Documents become pieces: ids and an end id, cut only where a document is longer than a sequence.
Round 0 packs the pieces of each partition in blocks of at most ``BLOCK``, best fit in order of falling length. Bins
short of the sequence length by no more than ``slack`` are emitted; the others become items of the
next round, in which ``fan`` neighbouring groups meet in one and are packed by best fit again, with
twice the slack. After about log(groups)/log(fan) rounds one group is left and all its bins are emitted. A group
only ever holds the underfull bins of its ``fan`` children, never their pieces' texts or ids. Where a round leaves
over ``worth`` of the underfull bins as they were, as with documents too large for any two to share a sequence, the bins
are emitted there and then, so that groups don't grow up the tree without merging.

Best fit runs on counts by free space: a bit mask of the free spaces that open bins have gives the
tightest one in constant time.

Defined cases: null or empty text is a document of the end id alone; a document of exactly a sequence's length is
one piece; rows that repeat an id, or have none, are packed as documents of their own; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from factloom.llm.tokens import WordTokenizer
from factloom.operators.staging import Staging

BLOCK = 400_000  # pieces packed at once in round 0
PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BINS = pa.schema([("bin", pa.int64()), ("grp", pa.int64()), ("used", pa.int32()), ("done", pa.bool_()), ("pieces", pa.list_(PIECE))])
BINS_SQL = "bin long, grp long, used int, done boolean, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Bins of item numbers; items by falling length, each into the fullest bin that still takes it."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    open_bins: list[list[list[int]]] = [[] for _ in range(room + 1)]
    mask, out = 0, []
    for i in order:
        size = lengths[i]
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            held = open_bins[free].pop()
            if not open_bins[free]:
                mask &= ~(1 << free)
        else:
            free, held = room, []
            out.append(held)
        held.append(i)
        if left := free - size:
            open_bins[left].append(held)
            mask |= 1 << left
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordTokenizer(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.encode(text).tobytes() + end
                for at in range(0, len(ids), 4 * room):
                    cut = ids[at : at + 4 * room]
                    rows.append((doc, at // (4 * room), at // 4, len(cut) // 4, zlib.crc32(cut)))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, PIECE)], names=[f.name for f in PIECE])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _packed(members: list[list[dict]], used: list[int], room: int, slack: int, first: int, parent: int) -> pa.RecordBatch:
    """Bins of one group; members and used of each item."""
    bins = best_fit(used, room)
    sums = [sum(used[i] for i in b) for b in bins]
    done = [room - s <= slack for s in sums]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(first, first + len(bins)), pa.int64()), pa.array([parent] * len(bins), pa.int64()), pa.array(sums, pa.int32()), pa.array(done), pa.array([[p for i in b for p in members[i]] for b in bins], pa.list_(PIECE))],
        schema=BINS,
    )


def _merger(level: int, fan: int, room: int, slack: int):
    """The function that packs one group's bins as items in a round of the tree."""

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = table.sort_by("bin").to_pydict()
        return pa.Table.from_batches([_packed(rows["pieces"], rows["used"], room, slack, (level << 58) + (group << 30), group // fan)])

    return merged


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = 4096, slack: int = 4, fan: int = 8, worth: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    st = Staging(docs.sparkSession, "packing")
    cut = st.write(pieces(docs, tokenizer, end_id, room, id_col, text_col), "pieces")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            columns = pa.Table.from_batches(held).to_pydict()
            names, lengths = list(columns), columns["length"]
            bins = best_fit(lengths, room)
            for at in range(0, len(bins), 2000):
                some = bins[at : at + 2000]
                sums = [sum(lengths[i] for i in b) for b in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part << 30) + made + j for j in range(len(some))], pa.int64()),
                        pa.array([part // fan] * len(some), pa.int64()),
                        pa.array(sums, pa.int32()),
                        pa.array([room - s <= slack for s in sums]),
                        pa.array([[{n: columns[n][i] for n in names} for i in b] for b in some], pa.list_(PIECE)),
                    ],
                    schema=BINS,
                )
                made += len(some)

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BLOCK:
                yield from flush(held)
                held, count = [], 0
        if count:
            yield from flush(held)

    rounds = [st.write(cut.mapInArrow(local, BINS_SQL), "round-0")]
    top = rounds[0].agg(F.max("grp")).first()[0]
    groups = 1 if top is None else top + 1
    level, before, unmerged = 0, None, None
    while True:
        now = rounds[-1].where("not done").count()
        if before is not None and now > worth * before:
            unmerged = rounds[-1].where("not done")
            break
        before, level = now, level + 1
        last = groups == 1
        merged = _merger(level, fan, room, room if last else slack << level)
        left = rounds[-1].where("not done")
        rounds.append(st.write(left.groupBy("grp").applyInArrow(merged, BINS_SQL), f"round-{level}"))
        if last:
            break
        groups = -(-groups // fan)
    bins = rounds[0].where("done")
    for r in rounds[1:]:
        bins = bins.unionByName(r.where("done"))
    if unmerged is not None:
        bins = bins.unionByName(unmerged)
    upto = F.transform(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: F.aggregate(F.slice("pieces", 1, i), F.lit(0).cast("long"), lambda a, p: a + p["length"]))
    return bins.select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip("pieces", upto.alias("before"))).alias("x")).select("x.pieces.*", "sequence_id", F.col("x.before").alias("offset"))
