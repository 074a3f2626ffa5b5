"""Best-fit packing (operator 1): hierarchical residual packing.

1. Documents become token pieces of at most ``capacity`` (one pass, Arrow).
2. Pieces are dealt into groups of bounded size; each group packs best-fit
   decreasing on its own and gives out its nearly full bins.
3. The underfull bins of all groups are items of the next round, in as many
   groups as their number needs, until one group holds all that is left (or a
   round merges hardly anything).
Only (id, piece, length, checksum) rows move, never texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlytics.llm import text as TX
from churnlytics.llm.common import store
from churnlytics.llm.tokens import Encoder, vocabulary_path

CAPACITY = 2048
GROUP_ITEMS = 1 << 15  # items that one task packs


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` for every row.

    A document's tokens are its text's ids and ``end_id``. Longer ones than
    ``capacity`` are cut into pieces of ``capacity``; the first takes the rest.
    A null text is empty (one piece of one token).
    """
    path = vocabulary or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (
        ", ids array<int>" if keep_ids else "")

    def run(batches):
        encoder = Encoder(path)
        for part in TX.slices(batches):
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, text in enumerate(part.column(1).to_pylist()):
                ids = np.array([*encoder.encode(text or ""), end_id], dtype="<u4")
                cuts = [*range(0, len(ids), capacity)] if len(ids) % capacity == 0 else [
                    0, *range(len(ids) % capacity, len(ids), capacity)]
                for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
                    row.append(k)
                    piece.append(n)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if keep_ids:
                        kept.append(ids[a:b].astype(np.int32))
            columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each item and the bins' use. Open
    bins are kept by the room that they have left; a bit mask finds the
    smallest sufficient room."""
    if len(sizes) and (sizes.max() > capacity or sizes.min() < 1):
        raise ValueError(f"sizes must be from 1 to {capacity}")
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            b, room = len(used), capacity
            used.append(0)
        where[i], offset[i] = b, capacity - room
        used[b] += size
        if room > size:
            rooms[room - size].append(b)
            mask |= 1 << (room - size)
    return where, offset, np.array(used, np.int64)


def pack_round(rows: DataFrame, round_no: int, capacity: int, slack: int) -> DataFrame:
    """Pack the items (rows of one ``bin``) of each ``grp``; rows get their new
    bin and offset, and ``done`` where it is nearly full. Bin numbers hold the
    round, the group and the place."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin", "offset", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        item, codes = np.unique(pdf["bin"].to_numpy(), return_inverse=True)
        sizes = np.bincount(codes, weights=pdf["length"].to_numpy(), minlength=len(item)).astype(np.int64)
        where, offset, used = best_fit(sizes, capacity)
        base = (round_no << 56) | (int(pdf["grp"].iloc[0]) << 24)
        pdf["offset"] = pdf["offset"].to_numpy() + offset[codes]
        pdf["bin"] = base + where[codes]
        pdf["done"] = used[where[codes]] >= capacity - slack
        return pdf.drop(columns="grp")

    kinds = dict(rows.dtypes)
    names = [c for c in rows.columns if c not in ("grp", "done")]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", done boolean"
    return rows.select(*names, "grp").groupBy("grp").applyInPandas(lambda pdf: pack(pdf)[[*names, "done"]], schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS,
                slack: int | None = None) -> DataFrame:
    """``pieces(doc_id, piece, start, length, ids_crc32)`` with ``sequence_id``
    and ``offset``: no sequence is longer than ``capacity``, and its pieces
    stand without gaps from 0. Bins within ``slack`` tokens of full (a 64th)
    leave after each round."""
    slack = capacity // 64 if slack is None else slack
    # Every piece is an item of its own; equal rows stay separate items.
    rows = store(pieces.select("doc_id", "piece", "start", "length", "ids_crc32",
                               F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset")))
    n, out, round_no = rows.count(), [], 0
    while True:
        groups = max(1, -(-n // group_items))
        packed = store(pack_round(rows.withColumn("grp", F.pmod(F.xxhash64("bin"), F.lit(groups))),
                                  round_no, capacity, slack))
        left = packed.where("NOT done").select(F.countDistinct("bin")).first()[0] if groups > 1 else 0
        if groups == 1 or left > 0.99 * n or round_no == 63:
            out.append(packed)
            break
        out.append(packed.where("done"))
        rows, n, round_no = packed.where("NOT done").drop("done"), left, round_no + 1
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
                   vocabulary: str | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Tokenise and pack ``docs``: one row per piece, see ``token_pieces`` and
    ``pack_pieces``.

    Defined cases: a null or empty text is one token; a null id stays null;
    repeated rows are packed each; other columns are not read; an empty table
    gives an empty result; the sequence numbers have no meaning of their own.
    """
    out = pack_pieces(token_pieces(docs, capacity, id_col, text_col, vocabulary), capacity, group_items)
    return out.withColumnRenamed("doc_id", id_col)


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id",
              text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(sequence_id, ids array<int>)``: the token ids of the packed sequences,
    for training. Needs ids that are not null and not repeated; each group
    holds at most ``capacity`` tokens."""
    ids = token_pieces(docs, capacity, id_col, text_col, vocabulary, keep_ids=True) \
        .select(F.col("doc_id").alias(id_col), "piece", "ids")
    rows = packed.select(id_col, "piece", "sequence_id", "offset").join(ids, [id_col, "piece"])
    return rows.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
