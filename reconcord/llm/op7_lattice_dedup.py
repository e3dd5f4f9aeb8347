"""Embedding near-duplicates by lattice hashing.

Each table projects the unit vectors onto ``blocks`` times eight random
directions, scales and shifts them, and decodes each eight numbers to the
nearest point of the E8 lattice; the points together name a cell.  A vector is
filed in its own cell and in ``probes`` neighbouring cells, those that cost
least extra distance.  Vectors of one cell are compared by their cosine in
double precision.

Equal vectors are one class that carries its count.  A cell with more than
``block`` members is dealt into pairs of blocks, each of bounded size, so that
no task sees a large cell whole.  A task adds up links instead of listing
pairs: it sends one count for each member (a pair counts in its first common
cell only) and one edge from each member to its component in the task.

Null, empty and zero vectors and those with null or non-finite components link
with nothing, as do vectors of unlike lengths.  Rows come back one for one;
repeated rows count as vectors of their own.  A row with a null id gets a null
component and is not kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, components
from .shingles import mix

TABLES = 8
BLOCKS = 3
CELL = 0.4
PROBES = 3
BLOCK = 512


def _nearest_even(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point with integer coordinates of even sum, and a next one, of each row of eight."""
    f = np.rint(x)
    e = x - f
    order = np.argsort(-np.abs(e), -1)
    step = np.where(np.take_along_axis(e, order, -1) >= 0, 1.0, -1.0)

    def moved(points: np.ndarray, rank: int) -> np.ndarray:
        out = points.copy()
        at = order[..., rank : rank + 1]
        np.put_along_axis(out, at, np.take_along_axis(points, at, -1) + step[..., rank : rank + 1], -1)
        return out

    odd = (f.sum(-1).astype(np.int64) & 1).astype(bool)[..., None]
    one = moved(f, 0)
    return np.where(odd, one, f), np.where(odd, moved(f, 1), moved(one, 1))


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubled coordinates of the two nearest of four close E8 points, (..., 2, 8), and their squared distances, (..., 2).

    E8 holds the integer points of even sum and these shifted by one half.
    """
    a, b = _nearest_even(x)
    c, d = _nearest_even(x - 0.5)
    points = np.stack([a, b, c + 0.5, d + 0.5], -2)
    far = ((x[..., None, :] - points) ** 2).sum(-1)
    order = np.argsort(far, -1, kind="stable")[..., :2]
    return np.rint(2 * np.take_along_axis(points, order[..., None], -2)).astype(np.int64), np.take_along_axis(far, order, -1)


@lru_cache
def _projection(dim: int, table: int, blocks: int, cell: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, table, blocks])
    g = rng.standard_normal((dim, 8 * blocks))
    if dim >= 8 * blocks:
        g = np.linalg.qr(g)[0]
    else:
        g /= np.sqrt(dim)
    return g / cell, rng.random(8 * blocks) * 2


def cells(unit: np.ndarray, tables: int, blocks: int, cell: float, probes: int) -> np.ndarray:
    """Cell keys of unit vectors: (rows, tables, 1 + probes), the own cell first."""
    n, dim = unit.shape
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        g, shift = _projection(dim, t, blocks, cell)
        points, far = decode((unit @ g + shift).reshape(n, blocks, 8))
        with np.errstate(over="ignore"):
            factor = mix(np.arange(blocks * 8, dtype=np.uint64), 100 + t) | np.uint64(1)
            term = (points.astype(np.uint64) * factor.reshape(blocks, 1, 8)).sum(-1, dtype=np.uint64)
            own = term[:, :, 0].sum(1, dtype=np.uint64)
            change = term[:, :, 1] - term[:, :, 0]
            order = np.argsort(far[:, :, 1] - far[:, :, 0], 1, kind="stable")
            keys = [own]
            for k in range(probes):  # beyond ``blocks`` probes, two blocks move at once
                step = np.take_along_axis(change, order[:, k % blocks, None], 1)[:, 0]
                if k >= blocks:
                    step = step + np.take_along_axis(change, order[:, (k + 1) % blocks, None], 1)[:, 0]
                keys.append(own + step)
            out[:, t] = np.stack([mix(x, 200 + t).view(np.int64) for x in keys], 1)
    return out


def _units(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    flat, length = column.flatten(), np.diff(np.asarray(column.offsets))
    if len(column) and not column.null_count and not flat.null_count and length[0] and (length == length[0]).all():
        x = np.asarray(flat).reshape(len(column), -1)
        top = np.abs(x).max(1, keepdims=True)
        if np.isfinite(top).all() and (top > 0).all():
            x = x / top
            return list(x / np.sqrt((x * x).sum(1, keepdims=True)))
    out: list[np.ndarray | None] = []
    for x in column.to_pylist():
        v = None
        if x and None not in x:
            v = np.array(x, np.float64)
            top = np.abs(v).max()
            v = v / top if np.isfinite(top) and top > 0 else None
        out.append(None if v is None else v / np.sqrt((v * v).sum()))
    return out


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, class): equal vectors have one class."""
    for batch in batches:
        found = []
        for v, x in zip(_units(batch.column(1)), batch.column(1).to_pylist(), strict=True):
            if v is None:
                found.append(None)
            else:
                bits = np.array(x, np.float64) + 0.0
                with np.errstate(over="ignore"):
                    total = (mix(bits.view(np.uint64), 51) * (mix(np.arange(len(bits), dtype=np.uint64), 53) | np.uint64(1))).sum(dtype=np.uint64)
                found.append(int(mix(np.array([total], np.uint64), len(bits)).view(np.int64)[0]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(1)], names=["id", "class", "vec"])


def _cell_rows(settings: tuple):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1))
            name = np.asarray(batch.column(0))
            for dim in sorted({len(u) for u in units}):
                at = np.array([i for i, u in enumerate(units) if len(u) == dim])
                keys = cells(np.stack([units[i] for i in at]), *settings).reshape(len(at), -1)
                keys.sort(axis=1)
                new = np.ones(keys.shape, bool)
                new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(np.repeat(name[at], new.sum(1)))], names=["cell", "class"])

    return rows


def _pair_rows(settings: tuple, cosine: float):
    """Rows sorted by (cell, i, j); each such group is compared and sent as counts (class, links, null) and edges (class, null, to)."""

    def group(cell: int, i: int, j: int, name: np.ndarray, part: np.ndarray, times: np.ndarray, vec: list) -> tuple:
        unit = np.stack(vec)
        cos = unit @ unit.T
        hit = cos >= cosine
        np.fill_diagonal(hit, False)
        if i != j:
            hit &= part[:, None] != part[None, :]
        if not hit.any():
            return [], []
        label = np.arange(len(name))
        while True:
            low = np.minimum(label, np.where(hit, label[None, :], len(name)).min(1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        a, b = np.nonzero(np.triu(hit))
        key = cells(unit, *settings)
        earlier = np.zeros(len(a), bool)
        open_ = np.ones(len(a), bool)
        for t in range(settings[0]):
            same = key[a, t, :, None] == key[b, t, None, :]
            here = open_ & (key[a, t] == cell).any(1) & (key[b, t] == cell).any(1)
            earlier |= here & ((np.where(same, key[a, t, :, None], cell)) < cell).any((1, 2))
            open_ &= ~here
            earlier |= open_ & same.any((1, 2))
        a, b = a[~earlier], b[~earlier]
        links = np.bincount(a, times[b], minlength=len(name)) + np.bincount(b, times[a], minlength=len(name))
        return [(int(name[k]), int(links[k]), None) for k in np.flatnonzero(links)], [(int(name[k]), None, int(name[label[k]])) for k in np.flatnonzero(label != np.arange(len(name)))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, out = [], None, []

        def flush() -> None:
            by: dict[int, list] = {}
            for r in held:
                by.setdefault(len(r[3]), []).append(r)
            for same in by.values():
                if len(same) > 1:
                    name, part, times, vec = zip(*same, strict=True)
                    for found in group(*now, np.array(name), np.array(part), np.array(times, np.float64), list(vec)):
                        out.extend(found)

        for batch in batches:
            cell, i, j, name, part, times = (np.asarray(batch.column(k)) for k in range(6))
            for k, vec in enumerate(_units(batch.column(6))):
                key = (int(cell[k]), int(i[k]), int(j[k]))
                if key != now:
                    flush()
                    held, now = [], key
                held.append((int(name[k]), int(part[k]), int(times[k]), vec))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], []))], names=["class", "links", "to"])
            out = []
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], []))], names=["class", "links", "to"])

    return rows


def lattice_dedup(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
    tables: int = TABLES, blocks: int = BLOCKS, cell: float = CELL, probes: int = PROBES, block: int = BLOCK,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of ``embeddings``."""
    stage = Stage(embeddings.sparkSession, "lattice")
    settings = (tables, blocks, cell, probes)
    source = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    named = source.mapInArrow(_class_rows, "id long, class long, vec array<double>")
    base = stage.keep(named.select("id", "class"))
    classes = stage.keep(named.where("class is not null").groupBy("class").agg(F.count("*").alias("times"), F.first("vec").cast("array<float>").alias("vec32"), F.max(F.transform("vec", lambda x: x.cast("float").cast("double")) != F.col("vec")).alias("wide"), F.first("vec").alias("vec64")).select("class", "times", F.when(F.col("wide"), F.col("vec64")).alias("vec64"), F.when(~F.col("wide"), F.col("vec32")).alias("vec32")))
    vector = F.coalesce("vec64", F.col("vec32").cast("array<double>"))
    filed = stage.keep(classes.select("class", vector.alias("vec")).mapInArrow(_cell_rows(settings), "cell long, class long"))
    crowd = filed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block)
    member = filed.join(crowd, "cell").select("cell", "class", parts.alias("parts"), F.pmod(F.xxhash64("class", "cell"), parts).alias("part"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    member = member.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "class", "part")
    found = stage.keep(
        member.join(classes, "class").select("cell", "i", "j", "class", "part", "times", vector.alias("vec"))
        .repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
        .mapInArrow(_pair_rows(settings, cosine), "class long, links long, to long")
    )
    stage.drop(filed)
    links = found.where("links is not null").groupBy("class").agg(F.sum("links").alias("links"))
    comp = components(stage, found.where("to is not null").select(F.col("class").alias("a"), F.col("to").alias("b")))
    per = classes.select("class", "times").join(links, "class", "left").join(comp.withColumnRenamed("id", "class"), "class", "left")
    per = per.select("class", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "class").alias("node"))
    out = base.join(per, "class", "left")
    low = out.where("node is not null").groupBy("node").agg(F.min("id").alias("low"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("low", "id"))
    return out.join(low, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept")
    )
