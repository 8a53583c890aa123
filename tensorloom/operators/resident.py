"""Tensors kept in the order of their contract key: tables that a join reads without an exchange."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import functions as F

from tensorloom.functions.storage import shared_dir
from tensorloom.operators.contract import _sides
from tensorloom.tensor import SparseTensor


@dataclass(frozen=True)
class Resident:
    """A tensor in a table of buckets of ``modes``, sorted by them within; ``tensor`` reads it, for any operator."""

    tensor: SparseTensor
    modes: tuple[int, ...]
    buckets: int
    table: str

    def drop(self) -> None:
        self.tensor.df.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def keep(x: SparseTensor, modes: Sequence[int], buckets: int | None = None, pre_sum: bool = False) -> Resident:
    """Write x once, dealt to buckets by its contract modes and sorted by them.

    Every later contraction over just these modes reads it as it lies: only the other side moves, and
    neither does if both are kept in as many buckets. ``pre_sum`` adds up repeated coordinates
    first. The table is one of the session; its files lie in the shared folder.
    """
    x.check_modes(*modes)
    spark = x.df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = x.coalesce() if pre_sum else x
    cols = [f"i{m}" for m in modes]
    name = f"resident_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
    x.df.repartition(n, *cols).write.bucketBy(n, *cols).sortBy(*cols).option("path", path).format("parquet").saveAsTable(name)
    return Resident(SparseTensor(spark.table(name), x.order, x.known_dims, x.unique), tuple(modes), n, name)


def contract_resident(x: Resident | SparseTensor, y: Resident | SparseTensor, x_modes: Sequence[int] | None = None, y_modes: Sequence[int] | None = None, drop_zeros: bool = False) -> SparseTensor:
    """``contract`` with one or both sides kept; modes of a kept side default to its own, in its order.

    The join is told to merge, since a broadcast would move what lies in place, and the other side is
    dealt to as many buckets by Spark. A side kept by other modes raises.
    """
    if not isinstance(x, Resident) and not isinstance(y, Resident):
        raise ValueError("neither side is kept")
    for side, modes in ((x, x_modes), (y, y_modes)):
        if isinstance(side, Resident) and modes is not None and tuple(modes) != side.modes:
            raise ValueError(f"kept by modes {side.modes}, not by {tuple(modes)}")
        if not isinstance(side, Resident) and modes is None:
            raise ValueError("name the modes of the side that isn't kept")
    x_modes, y_modes = (side.modes if isinstance(side, Resident) else tuple(modes) for side, modes in ((x, x_modes), (y, y_modes)))
    a, b = (side.tensor if isinstance(side, Resident) else side for side in (x, y))
    left, right, fx, fy = _sides(a, b, x_modes, y_modes, None)
    keys, out = [f"k{k}" for k in range(len(x_modes))], [f"z{k}" for k in range(len(fx) + len(fy))]
    joined = left.hint("merge").join(right, keys)
    summed = joined.groupBy(*out).agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    if not out:
        summed = summed.select(F.coalesce("v", F.lit(0.0)).alias("v"))
    summed = summed.where("v <> 0") if drop_zeros else summed
    dims = (*(a.known_dims[m] for m in fx), *(b.known_dims[m] for m in fy)) if a.known_dims and b.known_dims else None
    return SparseTensor(summed.select(*(F.col(z).alias(f"i{k}") for k, z in enumerate(out)), "v"), len(out), dims)
