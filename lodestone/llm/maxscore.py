"""Exact top-k search by MaxScore over integer vectors.

A dimension is a term and a shard's column its posting list. For each query
and shard, terms are ordered by the most that they can add (the query's value
times the shard's largest or smallest). With the query's k-th best score so
far as the bar, the essential terms are the fewest whose remainder cannot
reach it: their postings are traversed for the whole shard, and the other
terms are probed only for candidates that can still reach the bar. A first
pass over a few vectors gives every query a bar to begin with. Shards of one
group are scored one after the other, so that the bar rises; the groups' best
are merged by query.

Sums are 64-bit integers where no sum can leave them; rows with a component
beyond that bound are dealt to groups of their own and scored in integers of
any size.

Defined cases: vectors that are null or hold a null, NaN or infinite
component, and rows with a null id, take no part; every other row does, an
empty vector and one of huge components too; missing components of a shorter
vector count as zero; rows that repeat an id are each a candidate, and a
query's own id is none; where the id of a query repeats, its best are those of
all its rows together; ties go to the smaller id; fewer than k candidates give
all of them; scores are ordered to 38 digits and returned up to the largest
long; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, map_batches, tune

#: Of the contract: scale of a component, results of a query, which ids are queries.
SCALE, K, EVERY = 1024, 10, 100
#: Components of a group (one task's memory), of a group of wide rows and of the first pass; least vectors of a group; vectors of a shard; queries read at once; non-essential terms probed at once.
GROUP, WIDE_GROUP, FIRST, LEAST, SHARD, QUERIES, PROBE = 1 << 21, 1 << 17, 1 << 17, 1 << 11, 1 << 12, 256, 8
_DIGITS = 10**38 - 1


def usable_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and x, the components as doubles, of the rows that take part."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return rows.where(x.isNotNull() & F.col(id_column).isNotNull() & finite).select(F.col(id_column).cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))


def largest(width: int) -> int:
    """The largest component whose products, summed over the width, stay in 64 bits."""
    return isqrt((1 << 62) // max(1, width))


def integers(rows: list[np.ndarray], width: int) -> np.ndarray:
    """floor(SCALE * x), filled up with zeros: 64-bit integers, or Python's if a component is beyond the bound."""
    flat = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        flat[k, : len(row)] = row
    if np.abs(flat).max(initial=0) <= largest(width) / SCALE - 1:
        return np.floor(flat * SCALE).astype(np.int64)
    exact = [[floor(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE for x in row] for row in flat.tolist()]
    return np.array(exact, object).reshape(len(rows), width)


def search_group(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, bars: list[int | None] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, candidate ids, scores) of each query's best k in a group; a bar is a score that k candidates are known to reach."""
    shards = []
    for a in range(0, len(ids), SHARD):
        part = np.ascontiguousarray(vectors[a : a + SHARD].T)
        shards.append((ids[a : a + SHARD], part, part.max(1), part.min(1)))
    wide = vectors.dtype != np.int64 or queries.dtype != np.int64
    for me, q, known in zip(query_ids, queries, bars or [None] * len(query_ids), strict=True):
        q = q.astype(object) if wide else q
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        for own, part, high, low in shards:
            part = part.astype(object) if wide else part
            bound = np.maximum(q * high, q * low)
            order = np.argsort(-bound, kind="stable")
            rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what terms from each place on can add
            bar = max((x for x in (known, best[-1] if len(best) >= k else None) if x is not None), default=None)
            essential = len(order)
            if bar is not None:
                if rest[0] < bar:
                    continue  # not even all terms together
                # a candidate's essential part must be at least bar - rest; with fewer terms than these it needn't be positive
                essential = int(np.argmax(rest < bar)) if (rest < bar).any() else len(order)
            terms = order[:essential]
            score = q[terms] @ part[terms] if essential else np.zeros(len(own), q.dtype)
            live = np.arange(len(own)) if bar is None else np.flatnonzero(score + rest[essential] >= bar)
            score = score[live]
            for a in range(essential, len(order), PROBE):
                terms = order[a : a + PROBE]
                score = score + q[terms] @ part[np.ix_(terms, live)]
                keep = score + rest[a + len(terms)] >= bar
                live, score = live[keep], score[keep]
            other = own[live] != me
            cand, score = own[live][other], score[other]
            if not len(cand):
                continue
            best_ids, best = np.append(best_ids, cand), np.append(best, score)
            order = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[order], best[order]
        yield int(me), best_ids, best


def _bars(vectors: DataFrame, width: int, wide: DataFrame, every: int, k: int) -> DataFrame:
    """vec_id, x and bar of the queries: the k-th best score among a few vectors, for queries that are not wide."""
    few = vectors.where(~wide).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, FIRST // max(1, width))).toArrow()
    ids, rows = few.column("vec_id").to_numpy(), [np.array(x) for x in few.column("x").to_pylist()]
    shared = vectors.sparkSession.sparkContext.broadcast((ids, integers(rows, width)))  # FIRST components

    def bar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = shared.value
        for batch in batches:
            made: list[int | None] = []
            for me, x, is_wide in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                got = None
                if not is_wide and len(ids) > k:
                    score = (own @ integers([np.array(x)], width)[0])[ids != me]
                    got = int(np.partition(score, -k)[-k]) if len(score) >= k else None
                made.append(got)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int64())], ["vec_id", "x", "bar"])

    return cut(map_batches(vectors.where(F.col("vec_id") % every == 0).select("vec_id", "x", wide.alias("wide")), bar, "vec_id long, x array<double>, bar long"), "queries")


def top_k(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of all other rows for every row whose id is divisible by `every`."""
    spark = tune(rows.sparkSession)
    vectors = cut(usable_vectors(rows), "vectors")
    width = vectors.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    wide = F.exists("x", lambda e: F.abs(e) > largest(width) / SCALE - 1)
    n, n_wide = vectors.agg(F.count("*"), F.count_if(wide)).first()
    narrow_groups = max(1 + n * width // GROUP, min(spark.sparkContext.defaultParallelism, 1 + n // LEAST))
    groups = narrow_groups + (1 + n_wide * width // WIDE_GROUP if n_wide else 0)
    asked = _bars(vectors, width, wide, every, k)
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "vec_id", "x", "bar")
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.when(wide, groups - narrow_groups).otherwise(narrow_groups)) + F.when(wide, narrow_groups).otherwise(0)
    dealt = vectors.select(place.cast("int").alias("g"), F.lit(0).alias("kind"), "vec_id", "x", F.lit(None).cast("long").alias("bar")).unionByName(queries)
    score_kind = pa.decimal128(38, 0) if n_wide else pa.int64()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come group by group, first its vectors and then the queries."""
        group, ids, held, ready, asked = None, [], [], None, []

        def answer() -> Iterator[pa.RecordBatch]:
            if not asked or ready is None:
                return
            mine, x, bars = zip(*asked, strict=True)
            for me, cand, score in search_group(*ready, np.array(mine), integers(list(x), width), k, list(bars)):
                if len(cand):
                    value = [Decimal(max(-_DIGITS, min(_DIGITS, int(s)))) for s in score] if n_wide else score
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cand), me)), pa.array(cand), pa.array(value, score_kind)], ["query_id", "vec_id", "score"])

        for batch in batches:
            flat = batch.column(3).flatten().to_numpy()
            ends = np.append(0, np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False)))
            for r, (g, kind, me, bar) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
                if g != group:
                    yield from answer()
                    group, ids, held, ready, asked = g, [], [], None, []
                row = flat[ends[r] : ends[r + 1]]
                if kind == 0:
                    ids.append(me)
                    held.append(row.copy())
                    continue
                if ready is None and ids:
                    ready, held = (np.array(ids), integers(held, width)), []
                asked.append((me, row.copy(), bar))
                if len(asked) >= QUERIES:
                    yield from answer()
                    asked = []
        yield from answer()

    found = map_batches(dealt.repartitionById(groups, F.col("g")).sortWithinPartitions("g", "kind"), search, "query_id long, vec_id long, score " + ("decimal(38,0)" if n_wide else "long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    score = F.greatest(F.least(F.col("score"), F.lit((1 << 63) - 1)), F.lit(-(1 << 63))).cast("long") if n_wide else F.col("score")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
