"""The engine's calls on datasets of meshes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import distance, edges, grid, joins, objects
from .runtime import tune
from .sources import readers


@dataclass
class MeshDataset:
    """Triangles, and what is derived from them when asked for."""

    triangles: DataFrame
    frame: grid.Grid | None = None
    _kept: dict = field(default_factory=dict, repr=False)

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def objects(self) -> DataFrame:
        return self._once("objects", lambda: objects.features(self.triangles))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: edges.unique_edges(self.triangles))

    @property
    def cells(self) -> DataFrame:
        if self.frame is None:
            raise ValueError("the dataset has no grid; give preprocess a frame")
        return self._once("cells", lambda: grid.cells_of(self.objects, self.frame))

    def persist(self) -> MeshDataset:
        """Keep triangles, and edges and objects once they are asked for, so that each query does not derive them anew."""
        self.triangles = self.triangles.persist()
        self._kept = {"objects": objects.features(self.triangles).persist(), "edges": edges.unique_edges(self.triangles).persist()}
        return self


def preprocess(spark: SparkSession, path: str, mode: str = "mesh", shuffle_seed: int | None = None, resolution: int | None = None, world: float | None = None) -> MeshDataset:
    """Read a dataset; shuffle its objects by a seed and give it a grid if asked to."""
    triangles = readers.read_mesh(tune(spark), path, mode)
    if shuffle_seed is not None:
        triangles = objects.shuffle_objects(triangles, shuffle_seed)
    frame = None
    if resolution:
        frame = grid.Grid.world(world, resolution) if world else grid.Grid.around(triangles, resolution)
    return MeshDataset(triangles, frame)


def point_in_mesh(points: DataFrame, mesh: MeshDataset, parity: str = "global") -> DataFrame:
    return joins.point_in_mesh(points, mesh.triangles, parity)


def filter_refine(points: DataFrame, mesh: MeshDataset) -> DataFrame:
    return joins.filter_refine(points, mesh.triangles)


def overlap(a: MeshDataset, b: MeshDataset, direction: str = "both") -> DataFrame:
    return joins.overlap(a, b, direction)


def intersection(a: MeshDataset, b: MeshDataset, direction: str = "both") -> DataFrame:
    return joins.intersection(a, b, direction)


def containment(a: MeshDataset, b: MeshDataset, include_overlap_pairs: bool = False) -> DataFrame:
    return joins.containment(a, b, include_overlap_pairs)


def pair_hits(a: MeshDataset, b: MeshDataset) -> DataFrame:
    return joins.pair_hits(a.triangles, b.triangles)


def containment_tracking(a: MeshDataset, b: MeshDataset) -> DataFrame:
    return joins.containment_tracking(a.triangles, b.triangles)


def estimate(a: MeshDataset, b: MeshDataset, gamma: float = 0.8, epsilon: float = 0.001, alpha: bool = True) -> DataFrame:
    if a.frame is None or a.frame != b.frame:
        raise ValueError("both datasets need the same grid")
    return grid.estimate(a.cells, b.cells, a.frame, b.frame, gamma, epsilon, alpha)


def within(a: MeshDataset, b: MeshDataset, reach: float) -> DataFrame:
    return distance.within_distance_join(a.triangles, b.triangles, reach)


def nearest(a: MeshDataset, b: MeshDataset, k: int) -> DataFrame:
    return distance.knn_join(a.triangles, b.triangles, k)


def point_tasks(spark: SparkSession, geometries: str, points: str) -> dict[tuple[str, str], DataFrame]:
    """Point queries over comma-separated lists of files; each file is read once, a task that fails to read is left out with a warning."""
    import warnings

    meshes: dict[str, MeshDataset] = {}
    out = {}
    for geometry, path in readers.tasks(geometries, points):
        try:
            if geometry not in meshes:
                meshes[geometry] = preprocess(spark, geometry).persist()
            out[geometry, path] = point_in_mesh(readers.read_points(spark, path), meshes[geometry])
        except Exception as error:  # noqa: BLE001
            warnings.warn(f"{geometry} with {path}: {error}", stacklevel=2)
    return out
