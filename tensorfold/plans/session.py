"""Facade over a set of archives: names, shapes, tensors, slices, shards, pushes and joined columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorfold.errors import ReleasedTensor, UnknownTensor
from tensorfold.functions.dtypes import AUTO
from tensorfold.functions.shapes import Frame, shard_bounds, unravel
from tensorfold.operators import catalog as C
from tensorfold.operators import exchange as X
from tensorfold.operators import tensors as T
from tensorfold.plans import placement as P
from tensorfold.plans.config import Config, load_config, logger, source
from tensorfold.sources.archive import discover, read_any_catalog


class Tensors:
    """Tensors of files, each placed on a rank. Results are lazy element rows (name, pos, value, raw, and rank where it matters).

    What names one tensor, slice or shard reads only the blocks that hold it. :meth:`keys` and :meth:`metadata` gather their answer on
    the driver; ``catalog`` has the same as a DataFrame.
    """

    def __init__(self, spark: SparkSession, files: dict[int, list[str]], world_size: int = 1, config: Config | None = None):
        self.spark, self.world, self.config = spark, world_size, config or Config()
        self._catalog: DataFrame | None = None
        self.reset(files)
        logger(self.config).debug(self.config.summary())

    def __enter__(self) -> Tensors:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def reset(self, files: dict[int, list[str]]) -> None:
        """Other files in place of those at hand."""
        self.files = files
        self.paths = [p for _, _, p in P.interleave(files)]
        self._catalog = C.require_unique(read_any_catalog(self.spark, self.paths))

    def close(self) -> None:
        self._catalog = None

    @property
    def catalog(self) -> DataFrame:
        if self._catalog is None:
            raise ReleasedTensor("these tensors were closed")
        return self._catalog

    def placed(self) -> DataFrame:
        """The catalog with each file's rank and place among the rank's files."""
        at = P.local_index(self.files)
        where = self.spark.createDataFrame([(p, r, k) for p, (r, k) in at.items()], "path string, rank bigint, lidx bigint")
        return self.catalog.join(where, "path")

    def keys(self) -> list[str]:
        return [r[0] for r in self.placed().orderBy("rank", "lidx", "off_start", "off_end").select("name").collect()]

    def shape(self, name: str) -> list[int]:
        return C.shape_of(self.catalog, name)

    def frame(self, name: str) -> Frame:
        return Frame.of(self.shape(name))

    def filename(self, name: str) -> str:
        found = self.catalog.where(F.col("name") == name).select("path").first()
        return found[0] if found else ""

    def metadata(self) -> dict[str, dict]:
        return {r[0]: dict(r[1] or {}) for r in self.catalog.groupBy("path").agg(F.first("metadata")).collect()}

    def blocks(self, *names: str, index: list | None = None) -> DataFrame:
        known = {r["name"]: r["path"] for r in self.catalog.where(F.col("name").isin(*names)).select("name", "path").collect()}
        if missing := set(names) - known.keys():
            raise UnknownTensor(f"no tensor is named {', '.join(sorted(missing))}")
        return source(self.config.source)(self.spark, sorted(set(known.values())), self.config, list(names), index)

    def tensor(self, name: str, dtype: str = AUTO) -> DataFrame:
        return T.elements(self.blocks(name), dtype, "free")

    def item(self, name: str) -> float:
        """The value of a tensor with one element."""
        found = self.tensor(name).limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{name} has shape {self.shape(name)}; one element was wanted")
        return found[0]["value"]

    def slice(self, name: str, index, dtype: str = AUTO) -> DataFrame:
        """The elements of an n-d slice (slices and integers, as for a list; an integer keeps its dimension with extent 1), with places in the slice. Rows outside it are not read."""
        index = index if isinstance(index, tuple) else (index,)
        shape = self.frame(name)[index].shape  # refuses what does not fit
        if 0 in shape:
            return self.tensor(name, dtype).where(F.lit(False))
        cuts = []
        for i, n in zip(index, self.shape(name), strict=False):
            if isinstance(i, int):
                cuts.append([i % n, i % n + 1, None])
            else:
                r = range(n)[i]  # a backward slice to the front ends before 0, which only None says
                cuts.append([r.start, r.stop if r.stop >= 0 else None, r.step])
        return T.elements(self.blocks(name, index=cuts), dtype, "free")

    def shard(self, name: str, dim: int, rank: int, dtype: str = AUTO) -> DataFrame:
        """One rank's part along a dimension, with places in that part; of the other ranks' rows nothing is read. Dimension -1 is the whole tensor."""
        if dim < 0 or self.world == 1:
            return self.tensor(name, dtype)
        lo, hi = shard_bounds(self.shape(name)[dim], self.world)[rank]
        return self.slice(name, (*[slice(None)] * dim, slice(lo, hi)), dtype)

    def sharded(self, name: str, dim: int, dtype: str = AUTO) -> DataFrame:
        """Element rows of all ranks, with their rank; dim -1 puts all on every rank. Places count in the whole tensor."""
        found = self.tensor(name, dtype)
        if dim < 0 or self.world == 1:
            return X.broadcast(found, self.world)
        shape = self.shape(name)
        at = F.element_at(unravel(F.col("pos"), F.array(*[F.lit(n).cast("bigint") for n in shape])), dim + 1)
        return X.shard(found, at, shape[dim], self.world)

    def pushed(self, name: str, dst: int, dtype: str = AUTO) -> DataFrame:
        return X.push(self.tensor(name, dtype), F.lit(dst), self.world)

    def as_dict(self, dims: dict[str, int]) -> dict[str, DataFrame]:
        return {n: self.sharded(n, d) for n, d in dims.items()}

    def multi_cols(self, names: list[str], dim: int, dtype: str = AUTO) -> DataFrame:
        """Each tensor's shard, joined along ``dim`` in the order (rank of its file, file, request): ``pos`` is the place in the rank's joined tensor, ``part`` the tensor's in that order."""
        shapes = {n: self.shape(n) for n in names}
        X.require_same_extents(list(shapes.values()), dim)
        at = {r["name"]: (r["rank"], r["lidx"]) for r in self.placed().where(F.col("name").isin(*names)).collect()}
        order = sorted(names, key=lambda n: (at[n], names.index(n)))
        return X.joined([(self.tensor(n, dtype), shapes[n]) for n in order], dim, self.world)


def open_tensors(spark: SparkSession, files: str | list[str] | dict[int, list[str]], world_size: int = 1, config: Config | None = None) -> Tensors:
    """Opens files (a path, folder or pattern, a list of them, or lists by rank). Without a configuration the one that the environment or folder has is taken."""
    if not isinstance(files, dict):
        files = P.round_robin(discover(files), world_size)
    return Tensors(spark, files, world_size, config or load_config())
