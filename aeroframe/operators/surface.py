"""A triangle mesh out of a sparse table of signed distances.

Cells between eight neighbouring voxels are cut into six tetrahedra along their main
diagonal, the same in every cell, so surfaces of neighbouring cells meet edge to edge
without ambiguous cases. A vertex is known by the grid edge it lies on: tiles that share
an edge compute the same vertex under the same number, and no stitching is needed.

Voxels go to tiles of fixed size, those on a tile's lower sides to the tile before as
well. Tiles are sorted and meshed some thousand voxels at a time, so that small tiles
cost no call each and a task holds a few of them only."""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import face_components, large_components
from .joins import dealt

#: Voxel numbers lie within this distance of 0 on each axis, so that a cell, a corner and a face fit in 64 bits.
REACH = 2**18
TILE = 16
#: Voxels meshed at a time, but for the last tile's.
VOXELS = 50_000
_CORNERS = np.array([[m & 1, m >> 1 & 1, m >> 2 & 1] for m in range(8)])
#: Corners of the six tetrahedra: from a cell's low corner to its high one, an axis at a time.
TETRAHEDRA = np.array([[0, a, a | b, 7] for a, b, _ in permutations((1, 2, 4))])


def _triangles() -> np.ndarray:
    """By tetrahedron and set of positive corners (a bit each): up to two triangles of grid edges, numbered 8 * low corner + direction; -1 for none. Normals point to the positive side."""
    table = np.full((6, 16, 2, 3), -1)
    for t, corner in enumerate(TETRAHEDRA):
        edge = lambda a, b: 8 * (corner[a] & corner[b]) + (corner[a] ^ corner[b])  # noqa: B023, E731
        middle = lambda e: _CORNERS[e >> 3] + _CORNERS[e & 7] / 2
        for n in (1, 2, 3):
            for pos in combinations(range(4), n):
                neg = [k for k in range(4) if k not in pos]
                ring = [edge(p, q) for p in pos for q in neg]
                if n == 2:
                    ring = [ring[0], ring[1], ring[3], ring[2]]
                up = _CORNERS[corner[list(pos)]].mean(axis=0) - _CORNERS[corner[neg]].mean(axis=0)
                for k in range(1, len(ring) - 1):
                    a, b, c = ring[0], ring[k], ring[k + 1]
                    if np.cross(middle(b) - middle(a), middle(c) - middle(a)) @ up < 0:
                        b, c = c, b
                    table[t, sum(1 << p for p in pos), k - 1] = a, b, c
    return table


TRIANGLES = _triangles()


def _pack(at: np.ndarray) -> np.ndarray:
    at = at + REACH
    return (at[..., 0] << 38) | (at[..., 1] << 19) | at[..., 2]


def tiles_mesh(of: np.ndarray, at: np.ndarray, tsdf: np.ndarray, rgb: np.ndarray, voxel: float, tile: int):
    """(tiles of faces, face numbers, their vertices' numbers, tiles of vertices, vertex numbers, positions, colours) of the whole cells among the voxels ``at`` of each tile ``of``.

    Tiles are numbered from 0; a tile's voxels span ``tile`` + 1 places an axis at most."""
    side = tile + 1
    low = np.floor_divide(at, tile) * tile
    first = np.full((of[-1] + 1, 3), np.iinfo(np.int64).max)
    np.minimum.at(first, of, low)
    local = at - first[of]
    step = np.array([side * side, side, 1])
    code = of * side**3 + local @ step
    order = np.argsort(code, kind="stable")
    ranked = code[order]

    def place(wanted):
        k = np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1)
        return np.where(ranked[k] == wanted, order[k], -1)

    cells = np.flatnonzero((local < tile).all(axis=1))
    corner = np.stack([place(code[cells] + c @ step) for c in _CORNERS], axis=1)
    whole = (corner >= 0).all(axis=1)
    cells, corner = cells[whole], corner[whole]
    positive = tsdf[corner] > 0
    mixed = positive.any(axis=1) & ~positive.all(axis=1)
    cells, corner, positive = cells[mixed], corner[mixed], positive[mixed]
    case = (positive[:, TETRAHEDRA] * (1 << np.arange(4))).sum(axis=2)
    edges = TRIANGLES[np.arange(6)[None], case].reshape(len(cells), 12, 3)
    cell, k = np.nonzero(edges[:, :, 0] >= 0)
    edges = edges[cell, k]
    faces = (_pack(at[cells[cell]]) << 4) | k
    ids = (_pack(at[cells[cell]][:, None, :] + _CORNERS[edges >> 3]) << 3) | (edges & 7)
    owner, flat = np.repeat(of[cells[cell]], 3), ids.reshape(-1)
    order = np.lexsort((flat, owner))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(flat[order]) != 0) | (np.diff(owner[order]) != 0)
    one = order[new]
    edge, where = edges.reshape(-1)[one], np.repeat(cell, 3)[one]
    a, b = corner[where, edge >> 3], corner[where, (edge >> 3) + (edge & 7)]
    f = (tsdf[a] / (tsdf[a] - tsdf[b]))[:, None]
    return of[cells[cell]], faces, ids, owner[one], flat[one], (at[a] + 0.5 + f * _CORNERS[edge & 7]) * voxel, rgb[a] + f * (rgb[b] - rgb[a])


def surface_mesh(voxels: DataFrame, voxel: float, least_weight: float = 1.5, keys: tuple[str, ...] = (), tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(vertices keys, vid, x, y, z, r, g, b; faces keys, fid, v0, v1, v2) where the distance changes sign.

    Voxels: keys, vx, vy, vz, tsdf, weight, r, g, b, one a place. Faces lie in cells whose
    eight voxels all have the weight, so the mesh ends where the distance is unknown; a
    distance of 0 counts as inside. Seen from the positive side faces turn
    counter-clockwise. Vertex and face numbers are unique within ``keys``; they tell
    the place, so any tiling gives the same. Voxel numbers beyond REACH are refused."""
    v = voxels.where(F.col("weight") >= least_weight).select(*keys, *[F.col(f"v{c}").cast("long").alias(f"v{c}") for c in "xyz"], *[F.col(c).cast("double").alias(c) for c in ("tsdf", "r", "g", "b")])
    for c in "xyz":
        here = F.floor(F.col(f"v{c}") / tile)
        v = v.withColumn(f"t{c}", F.explode(F.when(F.pmod(f"v{c}", F.lit(tile)) == 0, F.array(here - 1, here)).otherwise(F.array(here))))
    kinds = ", ".join(f"`{k}` {voxels.schema[k].dataType.simpleString()}" for k in keys)
    schema = (kinds and kinds + ", ") + "number long, v0 long, v1 long, v2 long, x double, y double, z double, r double, g double, b double"

    names = [*keys, "tx", "ty", "tz"]

    def mesh(rows, of):
        column = lambda c: rows.column(c).to_numpy()
        at = np.column_stack([column(f"v{c}") for c in "xyz"])
        if (np.abs(at) >= REACH - 1).any():
            raise ValueError("a voxel's number is out of reach: move the origin or take larger voxels")
        face_of, faces, ids, vertex_of, vids, xyz, rgb = tiles_mesh(of, at, column("tsdf"), np.column_stack([column(c) for c in "rgb"]), voxel, tile)
        n, m = len(faces), len(vids)
        columns = [pa.concat_arrays([pa.array(faces), pa.array(vids)])]
        columns += [pa.concat_arrays([pa.array(ids[:, k]), pa.nulls(m, pa.int64())]) for k in range(3)]
        columns += [pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(a[:, k])]) for a in (xyz, rgb) for k in range(3)]
        start = np.searchsorted(of, np.concatenate([face_of, vertex_of]))
        own = [rows.column(c).combine_chunks().take(pa.array(start)) for c in keys]
        return pa.Table.from_arrays([*own, *columns], [*keys, "number", "v0", "v1", "v2", *"xyz", *"rgb"]).combine_chunks().to_batches()

    def numbers(rows):
        """Numbers of the tiles, whose rows follow each other."""
        new = np.zeros(len(rows), bool)
        for c in names:
            ids = pc.fill_null(rows.column(c).combine_chunks().dictionary_encode().indices, -1).to_numpy()
            new[1:] |= np.diff(ids) != 0
        return np.cumsum(new)

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= VOXELS:
                table = pa.Table.from_batches(held)
                of = numbers(table)
                cut = int(np.searchsorted(of, of[-1]))  # the last tile may go on
                if cut:
                    yield from mesh(table.slice(0, cut), of[:cut])
                held = table.slice(cut).combine_chunks().to_batches()
                rows -= cut
        if rows:
            table = pa.Table.from_batches(held)
            yield from mesh(table, numbers(table))

    found = materialise(dealt(v, *names).sortWithinPartitions(*names).mapInArrow(run, schema))
    faces = found.where("v0 IS NOT NULL").select(*keys, F.col("number").alias("fid"), "v0", "v1", "v2")
    vertices = found.where("v0 IS NULL").dropDuplicates([*keys, "number"]).select(*keys, F.col("number").alias("vid"), *"xyz", *"rgb")
    return vertices, faces


def used_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices that a face has."""
    used = faces.select(F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return vertices.join(used, "vid", "left_semi")


def large_parts(vertices: DataFrame, faces: DataFrame, least_share: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """A mesh without its small parts: connected faces of less than a share of all, and vertices that no face has any more."""
    parts = face_components(faces)
    faces = materialise(faces.join(large_components(parts, least_share).select("fid"), "fid", "left_semi"))
    return used_vertices(vertices, faces), faces


def fused_mesh(voxels: DataFrame, voxel: float, least_weight: float = 1.5, least_share: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """The surface of a voxel table without its small parts."""
    return large_parts(*surface_mesh(voxels, voxel, least_weight), least_share)


def mesh_report(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: faces, vertices, area, edges, and how many of those one face has (the surface's rim) and more than two have (none in a fused surface)."""
    from .mesh import corners, face_area

    edge = F.explode(F.array(*[F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])).alias("e")
    n = faces.select(edge).groupBy("e.p", "e.q").agg(F.count(F.lit(1)).alias("n"))
    edges = n.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("n") == 1).alias("rim_edges"), F.count_if(F.col("n") > 2).alias("odd_edges"))
    sides = corners(faces, vertices).agg(F.count(F.lit(1)).alias("faces"), F.coalesce(F.sum(face_area()), F.lit(0.0)).alias("area_m2"))
    return sides.crossJoin(vertices.agg(F.count(F.lit(1)).alias("vertices"))).crossJoin(edges)
