"""Near-duplicate vectors by a PCA-ordered tiled comparison.

Vectors are compared only within their label. Exact copies are folded into one class with a count. Classes are cut into tiles
along the first principal component; two tiles meet only if intervals of their leading components and the norms of the rest
allow the threshold. Inside a pair of tiles the product is accumulated over the leading components first; what is left is
bounded by the product of the suffix norms, and a pair stops as soon as it cannot reach the threshold. Pairs that come
through are decided on the original components in double precision.

A pair of tiles returns counts per vector and a spanning forest of its links, never the links themselves.

Defined results: vectors or labels that are null, vectors without components, of zero length or with null or non-finite
components link with nothing and stand alone; vectors of different lengths are not compared; repeated rows count as vectors of
their own; a null vec_id has a null component unless linked; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import connected_components, materialize, whole_runs

THRESHOLD = 0.93
#: Classes in one tile; a pair of tiles is one step of one task.
TILE = 2048
#: Leading components used to keep tiles apart.
LEADING = 4
#: Rounding of rotated products; the decision itself is made on the original components.
SLACK = 1e-9


def _rotation(classes: DataFrame, dims: int) -> np.ndarray:
    """The principal axes of vectors with ``dims`` components, by falling variance, over all classes."""
    vectors = classes.where(F.col("dims") == dims).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return PCA(k=dims, inputCol="v", outputCol="p").fit(vectors).pc.toArray()


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def linked(a: np.ndarray, b: np.ndarray, threshold: float, rotation: np.ndarray | None) -> np.ndarray:
    """Boolean matrix of cosine >= threshold between the rows of two matrices of unit vectors."""
    ra, rb = (a, b) if rotation is None else (a @ rotation, b @ rotation)
    left, right = (np.sqrt(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]) for m in (ra, rb))
    rows, columns = np.arange(len(a)), np.arange(len(b))
    total = np.zeros((len(a), len(b)))
    out = np.zeros((len(a), len(b)), dtype=bool)
    at, dims, step = 0, a.shape[1], 8
    while at < dims:
        end = min(dims, at + step)
        total += ra[rows, at:end] @ rb[columns, at:end].T
        at, step = end, step * 2
        bound = total if at == dims else total + np.outer(left[rows, at], right[columns, at])
        alive = bound >= threshold - SLACK
        r, c = alive.any(1), alive.any(0)
        if not r.any():
            return out
        rows, columns, total, alive = rows[r], columns[c], total[np.ix_(r, c)], alive[np.ix_(r, c)]
    i, j = np.nonzero(alive)
    for s in range(0, len(i), 1 << 17):
        x, y = rows[i[s : s + (1 << 17)]], columns[j[s : s + (1 << 17)]]
        hit = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
        out[x[hit], y[hit]] = True
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Star edges that connect what ``links`` connects; rows are nodes 0.., columns continue the numbering."""
    n, m = links.shape
    edges = []
    left, right = links.any(1), links.any(0)
    for start in np.flatnonzero(left):
        if not left[start]:
            continue
        new = np.zeros(n, dtype=bool)
        new[start] = True
        while new.any():
            left &= ~new
            near = links[new].any(0) & right
            right &= ~near
            edges += [(int(start), n + int(k)) for k in np.flatnonzero(near)]
            new = links[:, near].any(1) & left if near.any() else np.zeros(n, dtype=bool)
            edges += [(int(start), int(k)) for k in np.flatnonzero(new)]
    return edges


def compare(tiles: DataFrame, rotations: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(a, b, links): for b null, vectors linked with class a in one pair of tiles; else an edge of its spanning forest.

    ``tiles`` has pair, side, dims, cls, n, embedding; rows of one pair are compared by one step of one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "pair"):
            pair, side = (table.column(c).to_numpy() for c in ("pair", "side"))
            cls, n, dims = (table.column(c).to_numpy() for c in ("cls", "n", "dims"))
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            found: list[tuple[int, int | None, int]] = []
            for s, e in zip(starts, [*starts[1:], len(pair)]):
                unit = _unit(_matrix(table.column("embedding").slice(s, e - s)))
                cut = s + int((side[s:e] == 0).sum())
                a, b = unit[: cut - s], unit[cut - s :]
                own = cut == e
                hits = linked(a, a if own else b, threshold, rotations.get(int(dims[s])))
                ids = cls[s:e]
                if own:
                    np.fill_diagonal(hits, False)
                    hits |= hits.T  # one order of summation decides for both
                counts = [(ids[: cut - s], hits @ n[s : cut] if own else hits @ n[cut:e])]
                if not own:
                    counts.append((ids[cut - s :], n[s:cut] @ hits))
                for who, many in counts:
                    found += [(int(k), None, int(v)) for k, v in zip(who[many > 0], many[many > 0])]
                size = len(a)
                found += [
                    (int(ids[x]), int(ids[y - size if own and y >= size else y]), 0)
                    for x, y in forest(hits) if not (own and y >= size and y - size == x)
                ]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "links"])

    return tiles.mapInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label)."""
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists(
        "embedding", lambda x: x != 0
    )
    rows, _ = materialize(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"),
            F.when(valid, F.md5(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(
                F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string")), ",")).cast("binary"))).alias("digest"),
        ),
        "vectors",
    )
    classes, _ = materialize(
        rows.where("digest is not null").groupBy("digest").agg(
            F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
        ).select("*", F.size("embedding").alias("dims"), F.monotonically_increasing_id().alias("cls")),
        "vector-classes",
    )
    common = classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    rotations = {common["dims"]: _rotation(classes, common["dims"])}

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            out = np.zeros((batch.num_rows, LEADING + 1))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                unit = _unit(_matrix(batch.column("embedding").take(pa.array(at))))
                turned = unit @ rotations[d] if d in rotations else unit
                out[at, : min(LEADING, d)] = turned[:, :LEADING]
                out[at, LEADING] = np.sqrt((turned[:, LEADING:] ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(c) for c in out.T)], [*names, *leads, "rest"]
            )

    names = ["cls", "n", "label", "dims", "embedding"]
    leads = [f"c{k}" for k in range(LEADING)]
    turned, _ = materialize(
        classes.select(*names).mapInArrow(
            lead, "cls long, n long, label long, dims int, embedding array<float>, " + "".join(f"{c} double, " for c in leads) + "rest double"
        ) if dict(classes.dtypes)["embedding"] == "array<float>" else
        classes.select(*[F.col(c).cast("array<double>") if c == "embedding" else c for c in names]).mapInArrow(
            lead, "cls long, n long, label long, dims int, embedding array<double>, " + "".join(f"{c} double, " for c in leads) + "rest double"
        ),
        "vector-leads",
    )
    group = ["label", "dims"]
    sizes = turned.groupBy(*group).agg(F.count("*").alias("m"), F.percentile_approx("c0", [i / 256 for i in range(1, 256)], 10_000).alias("q"))
    strip = F.least(F.ceil(F.col("m") / tile), F.lit(256))
    low = F.size(F.filter("q", lambda x: x < F.col("c0")))
    placed = turned.join(sizes, group).withColumn("strip", F.floor(low * strip / 256).cast("int")).drop("q", "m")
    parts = placed.groupBy(*group, "strip").agg(F.ceil(F.count("*") / tile).alias("parts"))
    tiled, _ = materialize(
        placed.join(parts, [*group, "strip"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("parts"),
        "vector-tiles",
    )
    tiles = tiled.groupBy(*group, "strip", "part").agg(
        *[f(c).alias(f"{n}_{c}") for c in leads for f, n in ((F.min, "lo"), (F.max, "hi"))], F.max("rest").alias("rest")
    )
    x, y = tiles.alias("x"), tiles.alias("y")
    reach = F.col("x.rest") * F.col("y.rest")
    for c in leads:
        reach = reach + F.greatest(*[F.col(f"x.{p}_{c}") * F.col(f"y.{q}_{c}") for p in ("lo", "hi") for q in ("lo", "hi")])
    order = (F.col("x.strip") < F.col("y.strip")) | ((F.col("x.strip") == F.col("y.strip")) & (F.col("x.part") <= F.col("y.part")))
    pairs, _ = materialize(
        x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.dims") == F.col("y.dims")) & order & (reach >= threshold - SLACK))
        .select(*[F.col(f"x.{c}").alias(c) for c in group], *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in ("strip", "part")])
        .withColumn("pair", F.monotonically_increasing_id()),
        "tile-pairs",
    )
    twin = (F.col("strip_x") == F.col("strip_y")) & (F.col("part_x") == F.col("part_y"))
    sides = pairs.select(*group, F.col("strip_x").alias("strip"), F.col("part_x").alias("part"), "pair", F.lit(0).alias("side")).unionAll(
        pairs.where(~twin).select(*group, F.col("strip_y").alias("strip"), F.col("part_y").alias("part"), "pair", F.lit(1).alias("side"))
    )
    met = tiled.join(sides, [*group, "strip", "part"]).select("pair", "side", "dims", "cls", "n", "embedding")
    steps = max(8, min(20_000, pairs.count()))
    result, _ = materialize(
        compare(met.repartition(steps, "pair").sortWithinPartitions("pair", "side"), rotations, threshold), "tile-links"
    )
    links = result.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    parts = connected_components(result.where("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    firsts = classes.join(parts, "cls").groupBy("component").agg(F.min("first").alias("component_id"))
    state = (
        classes.select("digest", "cls", "n", "first").join(links, "cls", "left").join(parts, "cls", "left")
        .join(firsts, "component", "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    )
    joined = rows.select("vec_id", "digest").join(state, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         (F.col("vec_id") == component).alias("kept"))
