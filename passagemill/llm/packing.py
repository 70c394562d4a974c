"""Best-fit packing of token sequences, certified by dual-feasible-function bounds.

Pieces are dealt to partitions and packed there by best-fit decreasing. Dual
feasible functions give a lower bound on the bins that a partition's pieces
need; where the count meets the bound the partition is finished. The others
pool the pieces of their unfilled bins, are dealt anew to fewer partitions and
run best-fit decreasing again, until all is certified or a round no longer
saves a bin. What is then left open is the gap to the bound of all pieces.
"""

from __future__ import annotations

import base64
import itertools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.scratch import materialize
from passagemill.partitions import spread
from passagemill.shipping import ship_package

#: Pieces per partition in the first round; bounds the memory of a packing task.
PIECES_PER_PARTITION = 20_000


def dff_bound(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins of ``capacity`` for ``sizes``.

    For each threshold t <= capacity / 2 the dual feasible function counts sizes
    above capacity - t as a whole bin, sizes below t as nothing and the others
    as their size; the best over t, the rounding functions floor((k+1)x) / k,
    and the total size, is taken.
    """
    return dff_bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity) if len(sizes) else 0


def dff_bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """``dff_bound`` from the number of pieces of each size 0 .. capacity."""
    count = count.astype(np.int64)
    mass = np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    number = np.concatenate([[0], np.cumsum(count)])
    t = np.arange(capacity // 2 + 1)
    whole = number[capacity + 1] - number[capacity - t + 1]
    middle = np.maximum(mass[capacity - t + 1] - mass[t], 0)
    best = int((whole + -(-middle // capacity)).max())
    x = np.arange(capacity + 1)
    for k in range(1, 21):
        scaled, exact = (k + 1) * x // capacity, (k + 1) * x % capacity == 0
        value = np.where(exact, k * x, scaled * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the room left in each bin. Ties in size keep their order."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    open_rooms = 0  # bit r is set while a bin with room r exists
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room = len(rooms), capacity
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        rooms[b] = left
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, np.array(rooms, dtype=np.int64)


def _encoder(ranks_path: str | None) -> Callable[[str], np.ndarray]:
    """Text to ids as tokenizers gives them for byte_bpe_50k.json.

    tiktoken, which is faster, gives the same ids except where a text holds an
    added token, and it raises on very long white space; tokenizers encodes
    these texts. Ranks of another vocabulary come without the file for that.
    """
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    if ranks_path:
        return lambda text: fast.encode_to_numpy(text, disallowed_special=())
    whole = public_tokenizers.path("byte_bpe_50k.json")
    with open(whole, encoding="utf-8") as file:
        added = [token["content"] for token in json.load(file)["added_tokens"]]
    made = []

    def encode(text: str) -> np.ndarray:
        if not any(token in text for token in added):
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its regex ran out of stack
                pass
        if not made:
            from tokenizers import Tokenizer

            made.append(Tokenizer.from_file(whole))
        return np.array(made[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


_encoders: dict = {}


def tokenized_pieces(docs: DataFrame, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """One row per piece: uid, doc_id, piece, start, length, ids_crc32.

    ``ranks_path`` is the vocabulary of the byte-level BPE as ranks; by default
    the one that byte_bpe_50k.json holds, so the ids are the same.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks_path not in _encoders:
            _encoders[ranks_path] = _encoder(ranks_path)
        encode, uid = _encoders[ranks_path], TaskContext.get().partitionId() << 36
        for batch in batches:
            doc_ids, rows = batch.column("doc_id"), []
            for n, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or "").astype("<u4"), np.uint32(end_id)).astype("<u4")
                at, stop = 0, len(ids) % capacity or capacity
                piece = 0
                while at < len(ids):
                    rows.append((n, uid, piece, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
                    uid, piece, at, stop = uid + 1, piece + 1, stop, stop + capacity
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[1], pa.int64()), doc_ids.take(pa.array(columns[0], pa.int64())), pa.array(columns[2], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[3:])],
                names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(cut, f"uid long, doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _pack_round(items: DataFrame, partitions: int, capacity: int, round_no: int) -> DataFrame:
    """Deal ``items`` (uid, length) to ``partitions`` and pack each: adds bin, offset and final.

    Bins of a partition that meets its bound are final; elsewhere only filled
    bins are, and the rest may be exchanged.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        received = list(batches)
        if not received:
            return
        table = pa.Table.from_batches(received).sort_by("uid")
        sizes = table["length"].to_numpy()
        bins, offsets, rooms = best_fit_decreasing(sizes, capacity)
        certified = len(rooms) <= dff_bound(sizes, capacity)
        final = np.ones(len(sizes), dtype=bool) if certified else rooms[bins] == 0
        number = bins + (round_no << 56) + (TaskContext.get().partitionId() << 32)
        yield pa.RecordBatch.from_arrays([table["uid"].combine_chunks(), table["length"].combine_chunks(), pa.array(number), pa.array(offsets), pa.array(final)], names=["uid", "length", "bin", "offset", "final"])

    dealt = items.select("uid", "length").repartition(partitions, F.xxhash64("uid", F.lit(round_no)))
    return dealt.mapInArrow(pack, "uid long, length long, bin long, offset long, final boolean")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", per_partition: int = PIECES_PER_PARTITION, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and for all of them sequences, bound and gap.

    Null text is empty and takes one token, the end id. A document longer than
    ``capacity`` is cut into pieces of ``capacity`` tokens of which the first
    may be shorter; full pieces are sequences of their own. Repeated rows are
    packed once each. An empty table gives an empty result; other columns are
    ignored. Sequence ids are distinct, not gapless; full pieces have negative
    ones. ``bound`` is the least number of sequences that any packing of these
    pieces needs by the dual feasible functions, ``gap`` how many more this one
    has.
    """
    pieces = materialize(tokenized_pieces(docs, capacity, end_id, id_col, text_col, ranks_path), "packing-pieces")
    items = pieces.filter(F.col("length") < capacity).select("uid", "length")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        histogram[r["length"]] = r["n"]
    bound = dff_bound_of_counts(histogram, capacity)
    todo, bins_before, done = items, None, []
    for round_no in itertools.count():
        left = todo.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("mass")).first()
        if not left["n"]:
            break
        partitions = max(1, -(-left["n"] // per_partition))
        packed = materialize(_pack_round(todo, partitions, capacity, round_no), f"packing-round{round_no}")
        # Exchanged pieces keep their bins if the new round needs at least as many.
        first = F.col("offset") == 0  # one piece per bin
        counts = packed.agg(F.count_if(first).alias("all"), F.count_if(first & ~F.col("final")).alias("open")).first()
        if bins_before is not None and counts["all"] >= bins_before:
            break
        if done:
            done[-1] = done[-1].filter("final")
        done.append(packed)
        if not counts["open"] or -(-left["mass"] // capacity) >= counts["all"]:
            break
        todo, bins_before = packed.filter(~F.col("final")), counts["open"]
    full = pieces.filter(F.col("length") >= capacity).select(*pieces.columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows, sequences = full, int(histogram[capacity])
    if done:
        placed = done[0]
        for more in done[1:]:
            placed = placed.unionByName(more)
        sequences += placed.filter("offset = 0").count()
        rows = full.unionByName(pieces.join(placed.select("uid", F.col("bin").alias("sequence_id"), "offset"), "uid"))
    told = [F.lit(n).cast("long").alias(name) for name, n in (("sequences", sequences), ("bound", bound), ("gap", sequences - bound))]
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *told)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
