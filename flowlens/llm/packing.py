"""Best-fit packing with certified bin counts.

Documents are dealt to partitions and each packs its pieces by best fit decreasing. Dual feasible functions
give every partition a lower bound of its bins. Partitions above their bound put the pieces of their unfilled
bins together, deal them anew and pack them again; a new packing is taken when it needs fewer bins.
"""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

from ..plans.small import attach
from .common import release_arrow, staged
from .tokens import library_encoder, sliced

register_pickle_by_value(sys.modules[__name__])

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
GROUP_PIECES, ROUNDS = 50_000, 3
# A group with more than so many times its pieces is dealt by their places. Bits of a sequence number for the bin of a group.
OVERFLOW, BIN_BITS = 2, 24
NO_ID = -(1 << 63)


def cuts(sizes, capacity: int):
    """(text, piece, start, length) of the pieces of texts of so many ids; only a first piece may be shorter than the capacity
    where a text is longer than that."""
    import numpy as np

    pieces = np.maximum(-(-sizes // capacity), 1)
    row = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    end = sizes[row] - (pieces[row] - 1 - piece) * capacity
    start = np.maximum(end - capacity, 0)
    return row, piece, start, end - start


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every whole text: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null text is empty and gives one piece that holds the end id. Repeated rows give repeated pieces. An
    empty table gives no pieces. Other columns are not read.
    """

    def pieces(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encoder = library_encoder(tokenizer)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            for rows, texts in sliced(batch):
                ids, offsets = encoder.encode_ended(texts, end_id)
                row, piece, start, length = cuts(np.diff(offsets), capacity)
                first = offsets[row] + start
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                arrays = [rows.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(sums, np.int64))]
                if with_ids:  # the pieces of a text follow one another, and so do the texts
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(first, offsets[-1]).astype(np.int32)), pa.array(ids.view("<i4"))))
                yield pa.RecordBatch.from_arrays(arrays, names)
        release_arrow()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pieces, PIECES + ", ids array<int>" * with_ids)


def lower_bound(counts, capacity: int) -> int:
    """Fewest bins that pieces can need; ``counts[x]`` pieces have length x.

    Each dual feasible function maps lengths to weights of which no bin can hold more than one in sum. Two
    families are tried: thresholds (short pieces count nothing, those they would fit beside count whole) and
    roundings to k parts.
    """
    import numpy as np

    x, c = np.arange(capacity + 1, dtype=np.int64), np.asarray(counts, np.int64)
    best = -(-int((c * x).sum()) // capacity)
    for e in [int(v) for v in np.flatnonzero(c[:capacity // 2 + 1])]:
        w = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int((c * w).sum()) // capacity))
    for k in range(1, 25):
        w = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((c * w).sum()) // (capacity * k)))
    return best


def best_fit(lengths, capacity: int):
    """(bin, offset) of every piece; ``lengths`` must fall. A piece takes the fullest bin that still holds it."""
    import numpy as np

    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0  # bit r is set while some bin has r places left
    for i, x in enumerate(lengths.tolist()):
        room = mask >> x
        if room:
            left = x + (room & -room).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                mask ^= 1 << left
        else:
            left, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - left
        if left > x:
            free[left - x].append(b)
            mask |= 1 << (left - x)
    return bins, offsets


def dealt_pieces(pieces: DataFrame, turn: int, groups: int, group_pieces: int) -> tuple[DataFrame, int]:
    """``pieces`` with a ``_group``, and the number of groups: by a hash of the piece, and where equal pieces overflow a group, by their place in the table.

    The table must be a written one, so that a task that runs again meets the same places.
    """
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.lit(turn)), F.lit(groups)))
    over = dealt.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > OVERFLOW * group_pieces)
    most = over.agg(F.sum("_n")).first()[0]
    if not most:
        return dealt, groups
    parts = -(-most // group_pieces)
    own = F.lit(groups) + F.pmod(F.xxhash64("_place", F.lit(turn)), F.lit(parts))
    placed = attach(dealt.withColumn("_place", F.monotonically_increasing_id()), over, ["_group"])
    return placed.withColumn("_group", F.when(F.col("_n").isNull(), F.col("_group")).otherwise(own)).drop("_place", "_n"), groups + parts


def _packed(pieces: DataFrame, capacity: int, turn: int, groups: int, group_pieces: int) -> DataFrame:
    """One turn: deal pieces to groups of bounded size, pack each, add its gap above the certified bound."""

    def pack(pdf):
        import numpy as np

        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        n = int(bins.max()) + 1
        if n > 1 << BIN_BITS:
            raise ValueError("too many sequences in one group: use smaller groups")
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        gap = n - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        group = int(pdf["_group"].iloc[0])
        out = pdf.drop(columns=["_group"])
        return out.assign(sequence_id=(turn << 58) | (group << BIN_BITS) | bins, offset=offsets, _free=capacity - fill[bins], _gap=gap)

    dealt, groups = dealt_pieces(pieces, turn, groups, group_pieces)
    schema = pieces.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint,_free:bigint,_gap:bigint"
    # An explicit number keeps groups from being merged into one task.
    return dealt.repartition(groups, "_group").groupBy("_group").applyInPandas(pack, schema)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES, rounds: int | None = ROUNDS) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Every piece is packed once; lengths lie in 1..capacity. Pieces in full bins stay; those in the unfilled bins of
    partitions above their bound are exchanged in at most ``rounds`` turns (None: as long as a turn saves a bin), and a turn
    that saves nothing is dropped. A null doc_id stays null. Ties go by document and piece, and pieces are dealt by
    what they are, so the result does not depend on partitioning; pieces equal in all columns are interchangeable.
    """
    # Python tasks would turn a column with null ids into doubles. Written once: counting must not encode again.
    pieces = staged(pieces.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), "pieces")
    total = pieces.count()
    now = staged(_packed(pieces, capacity, 0, max(1, -(-total // group_pieces)), group_pieces), "packed")
    done, columns, turn = [], pieces.columns, 0
    while rounds is None or turn < rounds:
        turn += 1
        open_ = now.filter("_gap > 0 AND _free > 0")
        n, used = open_.agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first()
        groups = max(1, -(-n // group_pieces))
        # A lone group of the same pieces would be packed the same way again; sequence numbers have room for 31 turns.
        if not n or (groups == 1 and turn > 1) or turn > 31:
            break
        again = staged(_packed(open_.select(*columns), capacity, turn, groups, group_pieces), "packed")
        if again.agg(F.countDistinct("sequence_id")).first()[0] >= used:
            break
        done.append(now.filter("NOT (_gap > 0 AND _free > 0)"))
        now = again
    for part in done:
        now = now.unionByName(part)
    return now.select(*columns, "sequence_id", "offset").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def certified(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """(sequences used, lower bound over all pieces), from at most ``capacity`` counts."""
    import numpy as np

    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return packed.agg(F.countDistinct("sequence_id")).first()[0], lower_bound(counts, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from pieces that carry ids; a sequence is bounded by the capacity."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
