"""The most similar vectors of each query vector: score-aware 4-bit product quantisation, table scans, exact reranking.

Vectors are scaled to length 1, so that cosine is inner product. Each is coded as one of 16 codewords for every two
dimensions. Codewords and codes minimise a loss that weighs the residual along the vector more than the residual across it,
because only the former biases large inner products. A query's products with all codewords form its tables, two codes at a time
(256 entries for a byte), and a scan adds up table entries. The best of each scan are scored exactly.

The vectors are held in blocks of bounded size, each with its model's codewords and the model's queries; every vector is coded and
scanned. A block sends on its exact best for each query, never its vectors.

For queries as many as the vectors that would be all pairs. A coarse partition then puts each vector into the cell of its nearest centre, and a
query goes to the cells whose centres are nearest to it, the share ``probed`` of them: every vector is scanned with 1; the tests
measure the recall with less.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checkpoint_dir
from ..sources.tables import deal

#: Vectors in a block, about, of a group that holds all rows; smaller groups have smaller blocks.
BLOCK_ROWS = 16_384
#: Bound of the sample that codewords are fitted on, for each group; and of the sample of all groups together, about.
FIT_ROWS, FIT_ALL = 4_096, 65_536
#: Weight of the parallel residual against the rest. 2.0 and more favour the ranking of near neighbours.
ETA = 3.0
FIT_ROUNDS, SWEEPS = 6, 2
#: Candidates of a block, for each neighbour asked for, that are scored exactly.
RERANK = 12
TILE_ROWS, TILE_QUERIES = 2_048, 256
#: Vectors of a cell, about; and the most cells of a group: a query's vector is sent once for each cell that it goes to.
CELL_ROWS, MOST_CELLS, CELL_ROUNDS = 2_048, 64, 8
BOOKS = "g string, books binary, cells binary"


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision first: lengths differ by many orders."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def pairs(x: np.ndarray) -> np.ndarray:
    """(rows, subspaces, 2); an odd last dimension is padded with zero."""
    if x.shape[1] % 2:
        x = np.hstack([x, np.zeros((len(x), 1), x.dtype)])
    return x.reshape(len(x), -1, 2)


def encode(x: np.ndarray, books: np.ndarray, eta: float = ETA, sweeps: int = SWEEPS) -> np.ndarray:
    """Codes (rows, subspaces): the nearest codewords, then bettered one subspace at a time under the score-aware loss.

    With r the residual of x, the loss is |r|² + (eta - 1) (r·x)²; the second term couples the subspaces by their sum, which is carried along.
    """
    s = pairs(x)
    n, m, _ = s.shape
    codes = np.empty((n, m), np.uint8)
    along = np.empty((n, m))
    for j in range(m):
        d = s[:, j, None, :] - books[j]
        codes[:, j] = np.einsum("nkd,nkd->nk", d, d).argmin(1)
        along[:, j] = ((s[:, j] - books[j][codes[:, j]]) * s[:, j]).sum(1)
    total = along.sum(1)
    for _ in range(sweeps if eta != 1.0 else 0):
        for j in range(m):
            d = s[:, j, None, :] - books[j]
            a = np.einsum("nkd,nd->nk", d, s[:, j])
            rest = total - along[:, j]
            codes[:, j] = (np.einsum("nkd,nkd->nk", d, d) + (eta - 1.0) * (rest[:, None] + a) ** 2).argmin(1)
            along[:, j] = a[np.arange(n), codes[:, j]]
            total = rest + along[:, j]
    return codes


def fit(x: np.ndarray, eta: float = ETA, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Codewords (subspaces, 16, 2) of the rows ``x`` (length 1): alternately codes and least squares for each codeword."""
    s = pairs(x)
    n, m, _ = s.shape
    at = np.linspace(0, n - 1, 16).astype(int)
    books = np.empty((m, 16, 2))
    for j in range(m):  # spread starts along the direction of the pair's first dimension, then plain means
        books[j] = s[np.argsort(s[:, j, 0], kind="stable")[at], j]
        for _ in range(4):
            d = s[:, j, None, :] - books[j]
            c = np.einsum("nkd,nkd->nk", d, d).argmin(1)
            k = np.bincount(c, minlength=16)
            for dim in range(2):
                sums = np.bincount(c, weights=s[:, j, dim], minlength=16)
                books[j, :, dim] = np.where(k > 0, sums / np.maximum(k, 1), books[j, :, dim])
    for _ in range(rounds):
        codes = encode(x, books, eta, 1)
        along = np.stack([((s[:, j] - books[j][codes[:, j]]) * s[:, j]).sum(1) for j in range(m)], 1)
        total = along.sum(1)
        for j in range(m):
            c, v = codes[:, j], s[:, j]
            pull = (eta - 1.0) * (total - along[:, j] + (v * v).sum(1))
            k = np.bincount(c, minlength=16).astype(float)
            g = lambda w: np.bincount(c, weights=w, minlength=16)  # noqa: B023, E731
            a11, a12, a22 = k + (eta - 1) * g(v[:, 0] ** 2), (eta - 1) * g(v[:, 0] * v[:, 1]), k + (eta - 1) * g(v[:, 1] ** 2)
            b1, b2 = g(v[:, 0] * (1 + pull)), g(v[:, 1] * (1 + pull))
            det = a11 * a22 - a12 * a12
            ok = det > 1e-12
            safe = np.where(ok, det, 1.0)
            books[j, :, 0] = np.where(ok, (b1 * a22 - b2 * a12) / safe, books[j, :, 0])
            books[j, :, 1] = np.where(ok, (b2 * a11 - b1 * a12) / safe, books[j, :, 1])
    return books


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(bytes, 256, queries): each query's products with the two codewords that a byte names."""
    p = np.einsum("qmd,mkd->mkq", pairs(q), books).astype(np.float32)
    if len(p) % 2:
        p = np.concatenate([p, np.zeros_like(p[:1])])
    hi, lo = p[0::2], p[1::2]
    return (hi[:, :, None, :] + lo[:, None, :, :]).reshape(len(hi), 256, q.shape[0])


def pack(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), codes.dtype)])
    return (codes[:, 0::2] << 4) | codes[:, 1::2]


def scan(packed: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(rows, queries): approximate inner products, added up from the tables tile by tile."""
    n, q = len(packed), table.shape[2]
    out = np.zeros((n, q), np.float32)
    got = np.empty((min(n, TILE_ROWS), q), np.float32)
    for a in range(0, n, TILE_ROWS):
        b = min(n, a + TILE_ROWS)
        for j in range(packed.shape[1]):
            np.take(table[j], packed[a:b, j], axis=0, out=got[: b - a])
            out[a:b] += got[: b - a]
    return out


def search_block(x: np.ndarray, q: np.ndarray, books: np.ndarray | None, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (rows of ``q``) the rows of ``x`` that are best by exact product, and the products; all of length 1.

    Without codewords (a group that the sample missed), or if as many are to be scored exactly as there are rows, the scan is left out.
    """
    n, keep = len(x), k * RERANK
    out = []
    packed = pack(encode(x, books)) if books is not None and n > keep else None
    for a in range(0, len(q), TILE_QUERIES):
        tile = q[a : a + TILE_QUERIES]
        if packed is None:
            rough, cand = None, np.broadcast_to(np.arange(n)[:, None], (n, len(tile)))
        else:
            rough = scan(packed, tables(tile, books))
            cand = np.argpartition(-rough, keep - 1, axis=0)[:keep]
        for i in range(len(tile)):
            c = cand[:, i]
            exact = x[c] @ tile[i]
            if len(c) > k:
                edge = np.partition(exact, len(exact) - k)[len(exact) - k]
                best = exact >= edge  # ties at the edge all stay; the final order decides
                c, exact = c[best], exact[best]
            out.append((c, exact))
    return out


def well_formed(vector: Column, dimensions: Column) -> Column:
    """Not null, of the size stated, all components finite and not all zero."""
    good = (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def centres(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres of the rows ``x`` (length 1) by spherical k-means; rows spread evenly over ``x`` are the start."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(CELL_ROUNDS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where((norm > 1e-12)[:, None], sums / np.maximum(norm, 1e-12)[:, None], c)
    return c


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("r", kind="stable").head(FIT_ROWS)
    x = unit(np.stack(pdf["v"].to_numpy()))
    rows = int(pdf["n"].iloc[0])  # 0 where no cells are wanted
    n = int(min(MOST_CELLS, len(x), -(-rows // CELL_ROWS)))
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "books": [pickle.dumps(fit(x).astype(np.float32))], "cells": [pickle.dumps(centres(x, n).astype(np.float32)) if n else None]})


def _in_cells(share: float | None):
    """Rows (g, s, query_id, key, v) of a group with the cell of each, or with the ``share`` of all cells that are nearest; cell 0 where there are no centres."""

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left.rename(columns={"bg": "g", "bkey": "key", "bv": "v"}).reset_index(drop=True)
        if not len(out):
            return pd.DataFrame({"g": pd.Series(dtype="object"), "cell": pd.Series(dtype="int32"), "query_id": pd.Series(dtype="int64"), "key": pd.Series(dtype="object"), "v": pd.Series(dtype="object")})
        if "query_id" not in out:
            out["query_id"] = 0
        blobs = [b for b in right["cells"] if b is not None]
        c = pickle.loads(blobs[0]).astype(np.float64) if blobs else None
        if c is None:
            near = np.zeros((len(out), 1), int)
        else:
            close = unit(np.stack(out["v"].to_numpy())) @ c.T
            n = 1 if share is None else max(1, int(np.ceil(share * len(c))))
            near = close.argmax(1)[:, None] if n == 1 else np.argpartition(-close, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(n), (len(out), 1))
        times = near.shape[1]
        out = out.loc[np.repeat(np.arange(len(out)), times)]
        out["cell"] = near.reshape(-1).astype("int32")
        return out[["g", "cell", "query_id", "key", "v"]]

    return assign


def _search(k: int):
    """The best ``k`` + 1 of a block for each query that came to it, a query's own key left out."""

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # No null among the query ids: pandas would turn them all into floats.
        q = right[right["v"].notna()]
        if not len(left) or not len(q):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "key": pd.Series(dtype="object"), "similarity": pd.Series(dtype="float64")})
        blobs = [b for b in right["books"] if b is not None]
        books = pickle.loads(blobs[0]).astype(np.float64) if blobs else None
        x = unit(np.stack(left["bv"].to_numpy()))
        keys = left["bkey"].to_numpy()
        hits = search_block(x, unit(np.stack(q["v"].to_numpy())), books, k + 1)
        ids, own = q["query_id"].to_numpy("int64"), q["key"].to_numpy()
        parts = [(np.full(len(c), i), keys[c], e) for i, o, (c, e) in zip(ids, own, hits, strict=True) for c, e in [(c[keys[c] != o], e[keys[c] != o])]]
        return pd.DataFrame({"query_id": np.concatenate([p[0] for p in parts]), "key": np.concatenate([p[1] for p in parts]), "similarity": np.concatenate([p[2] for p in parts])})

    return block


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, probed: float | None = None) -> DataFrame:
    """``query_id, key, similarity, rank``: the ``k`` vectors of greatest cosine for each query, its own key left out.

    ``vectors``: ``g`` (group; only vectors of one group are compared), ``key``, ``v`` (array<float>, well-formed), ``v_order`` (of several
    rows of a key the one with the greatest counts; equal ones by the vector itself). ``queries``: ``query_id, g, key``, by which the
    query's vector is found; repeated queries count once, queries of an unknown key give no rows. Equal similarities go by key.

    Without ``probed`` every query meets every vector of its group: right for a table of probes. The vectors are shuffled once, by group and salt;
    reduction to one row a key, coding, scanning and reranking all happen there. With ``probed``, for queries as many as the vectors, they are
    shuffled again, by group and cell, and a query goes to the nearest cells only, that share of them. Cells that are too large for a
    block are salted by their counted size.
    """
    total = vectors.count()
    salts = max(1, -(-total // BLOCK_ROWS))
    salt = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")
    rows = (
        deal(vectors.withColumn("s", salt), "g", "s").groupBy("g", "s", "key").agg(F.max(F.struct("v_order", "v"))["v"].alias("v"))
    )
    r = F.xxhash64(F.lit(7), "key")
    share = min(1.0, FIT_ALL / max(1, total))
    sample = vectors.select("g", "v", r.alias("r")).where(F.pmod(r, F.lit(1 << 20)) < int(share * (1 << 20)))
    sizes = vectors.groupBy("g").agg(F.count("*").alias("n"))
    books = (sample.withColumn("n", F.lit(0)) if probed is None else sample.join(sizes, "g")).groupBy("g").applyInPandas(_fit_group, BOOKS)

    asked = queries.select("query_id", "g", "key", salt.alias("s")).distinct()
    found = asked.join(rows, ["g", "s", "key"])
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    # New names: the queries' side comes from the same rows.
    held = rows.select(F.col("g").alias("bg"), F.col("s").alias("bs"), F.col("key").alias("bkey"), F.col("v").alias("bv"))
    if probed is None:
        side = _with_books(found.select("g", "query_id", "key", "v"), books).withColumn("s", every_salt)
        near = held.groupBy("bg", "bs").cogroup(side.groupBy("g", "s")).applyInPandas(_search(k), "query_id long, key string, similarity double")
    else:
        checkpoint_dir(vectors.sparkSession)
        books = books.checkpoint()
        to_all = books.select("g", "cells").withColumn("s", every_salt).select(F.col("g").alias("cg"), F.col("s").alias("cs"), "cells")
        schema = "g string, cell int, query_id long, key string, v array<float>"
        placed = held.groupBy("bg", "bs").cogroup(to_all.groupBy("cg", "cs")).applyInPandas(_in_cells(None), schema).drop("query_id").checkpoint()
        asking = found.select("g", "s", "query_id", "key", "v").groupBy("g", "s").cogroup(to_all.groupBy("cg", "cs")).applyInPandas(_in_cells(probed), schema)
        salted = placed.groupBy("g", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n")).checkpoint()
        blocks = placed.join(salted, ["g", "cell"]).select(F.col("g").alias("bg"), F.col("cell").alias("bcell"), F.pmod(F.xxhash64("key"), F.col("n")).cast("int").alias("bs"), F.col("key").alias("bkey"), F.col("v").alias("bv"))
        with_books = salted.join(books, "g").select("g", "cell", F.lit(0).cast("long").alias("query_id"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<float>").alias("v"), "books")
        side = asking.withColumn("books", F.lit(None).cast("binary")).unionByName(with_books).join(salted, ["g", "cell"]).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        near = blocks.groupBy("bg", "bcell", "bs").cogroup(side.groupBy("g", "cell", "s")).applyInPandas(_search(k), "query_id long, key string, similarity double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "key"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "key", "similarity", "rank")


def _with_books(queries: DataFrame, books: DataFrame) -> DataFrame:
    """Queries (g, query_id, key, v) and codewords (g, books) in one frame."""
    blank = [F.lit(0).cast("bigint").alias("query_id"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<float>").alias("v")]
    return queries.withColumn("books", F.lit(None).cast("binary")).unionByName(books.select("g", *blank, "books"))
