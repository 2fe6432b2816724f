"""Exact top-k search by inner product of whole-number vectors: columnar branch and bound.

Candidates lie in blocks, dimension by dimension (a row of a block is one
dimension of all its vectors), the most spread dimensions first. For a query,
scores are accumulated a few dimensions at a time; what the rest can add is
bounded by the norms of what is left of both vectors, and candidates whose
bound falls below the k-th best certain score are dropped before the next
dimensions are read.

Blocks of queries meet blocks of candidates by a join on a slot that each
candidate block gets, every query block being sent to every slot. It is a
sort-merge join: sizes are estimated without the copies of the query blocks,
and broadcast they would all come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 8_192  # candidates in a block
QUERIES = 512  # queries in a block
STEP = 16  # dimensions accumulated between two bounds
FILE_BLOCKS = 8  # blocks in a file: Parquet's reader and writer hold at least a hundred rows of a file at once


def usable(vector: str) -> Column:
    """Not null, and no component null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("v")
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def _blocks(size: int):
    """Rows to blocks of ``size``: ids, and the matrix laid out by dimension."""

    def run(batches):
        ids, rows, n = [], [], 0

        def block():
            width = max(r.shape[1] for r in rows)
            m = np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()]), pa.array([np.ascontiguousarray(m.T).tobytes()]), pa.array([m.shape[0]], pa.int32())], ["ids", "m", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, min(size, batch.num_rows - at))
                start = 0
                while start < part.num_rows:
                    take = min(size - n, part.num_rows - start)
                    piece = part.slice(start, take)
                    ids.append(piece.column("id").to_numpy())
                    rows.append(_matrix(piece))
                    start, n = start + take, n + take
                    if n == size:
                        yield block()
                        ids, rows, n = [], [], 0
        if n:
            yield block()

    return run


def best(query: np.ndarray, own: int, ids: np.ndarray, m: np.ndarray, rest: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a block for one query: ids and scores, best first, ties by id.

    ``m`` by dimension; ``rest[i]``: norms of the candidates from the i-th step on.
    """
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive))
    left = np.append(np.cumsum((query * query)[::-1])[::-1], 0.0)
    whole = len(alive) == len(ids)
    for step, at in enumerate(range(0, len(query), STEP)):
        q = query[at : at + STEP]
        score += q @ (m[at : at + STEP] if whole else m[at : at + STEP][:, alive])
        nxt = at + STEP
        if len(alive) > k and nxt < len(query):
            slack = np.sqrt(left[nxt]) * rest[step + 1][alive]
            certain = score - slack
            bar = np.partition(certain, len(certain) - k)[len(certain) - k]
            stay = score + slack >= bar - 1e-6 * (1 + abs(bar))
            if not stay.all():
                alive, score, whole = alive[stay], score[stay], False
    order = np.lexsort([ids[alive], -score])[:k]
    return ids[alive][order], score[order]


def _search(k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                c_ids, q_ids = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("ids", "q_ids"))
                m = np.frombuffer(batch.column("m")[i].as_buffer()).reshape(-1, len(c_ids))
                q = np.frombuffer(batch.column("q_m")[i].as_buffer()).reshape(-1, len(q_ids))
                width = min(len(m), len(q))  # missing components count as 0
                order = np.argsort(-(m[:width] ** 2).sum(axis=1), kind="stable")
                m, q = np.ascontiguousarray(m[order]), q[order].T.copy()
                squares = np.add.reduceat(m * m, np.arange(0, width, STEP), axis=0) if width else np.zeros((0, len(c_ids)))
                rest = [*np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1]), np.zeros(len(c_ids))]
                found = [best(row, own, c_ids, m, rest, k) for row, own in zip(q, q_ids, strict=True)]
                size = [len(f[0]) for f in found]
                row, own = (np.repeat(x, size) for x in (np.arange(len(q_ids), dtype=np.int32), q_ids))
                block = np.full(len(row), batch.column("q_block")[i].as_py(), np.int64)
                answers = (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block, row, own, *answers)], ["q_block", "q_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 256) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: for each row of ``queries`` its k best of ``vectors`` (all, if fewer).

    Components become floor(scale * x); the score is their inner product, ties
    go to the smaller id, a row with the query's id is no candidate. Vectors
    that are null or hold a null or non-finite component, and rows without an
    id, take no part; missing components of shorter vectors count as 0. Scores
    are exact up to 2**53. Of repeated ids each row is a candidate, and each
    query row is answered: equal answers of one id come once, and different
    vectors of one id have ranks of their own. Extra columns are ignored. No vectors or no queries give no rows.
    """
    spark = common.ship(vectors.sparkSession)

    def rows(df: DataFrame) -> DataFrame:
        return df.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), quantised(vector, scale).alias("v"))

    def packed(df: DataFrame, size: int, name: str) -> DataFrame:
        return common.cut(df.mapInArrow(_blocks(size), "ids binary, m binary, n int").withColumn("block", F.monotonically_increasing_id()), name, maxRecordsPerFile=FILE_BLOCKS)

    blocks = packed(rows(vectors), BLOCK, "candidates")
    asked = packed(rows(queries).distinct(), QUERIES, "queries").select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    slots = max(1, blocks.count())
    blocks = blocks.select("ids", "m", F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot"))
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    # the blocks stand on the right, whose rows of one slot are held in memory: few, as each block is dealt by its own number
    found = asked.join(blocks.hint("merge"), "slot").select("ids", "m", "q_block", "q_ids", "q_m").mapInArrow(_search(k), "q_block long, q_row int, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()


def oracle_sql(k: int, every: int, scale: int) -> str:
    """The registered query in DuckDB SQL."""
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
asked as (select distinct vec_id, q from v where vec_id % {every} = 0),
pairs as (select a.vec_id as query_id, a.q, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from asked a join v b on a.vec_id <> b.vec_id),
ranked as (select *, row_number() over (partition by query_id, q order by score desc, vec_id)::int as rank from pairs)
select distinct query_id, rank, vec_id, score from ranked where rank <= {k}
"""
