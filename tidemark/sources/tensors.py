"""Sequence tables (one tensor a row) with a contract beside them (SRC15, SNK5)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
#: The two target names of a horizon in an envelope lane, in their order (fixed values).
ENVELOPE = ("future_range_high_bps_h", "future_range_low_bps_h")


@dataclass(frozen=True)
class Contract:
    """What a row holds: `steps` vectors of the features in x, and the targets in y, each named with its horizon (..._h5).

    lane: path (one target a horizon), envelope (high and low of each horizon side by side), or any (no rule).
    """

    features: tuple[str, ...]
    targets: tuple[str, ...]
    steps: int
    lane: str = "any"
    horizons: tuple[int, ...] = field(default=())

    def __post_init__(self) -> None:
        named = [re.search(r"_h(\d+)$", x) for x in self.targets]
        if not all(named):
            raise ValueError(f"targets without a horizon: {[x for x, m in zip(self.targets, named) if not m]}")
        found = tuple(int(m[1]) for m in named)
        if self.horizons and tuple(self.horizons) != found:
            raise ValueError(f"horizons {self.horizons} do not match the names of the targets: {found}")
        for names, kind in ((self.features, "features"), (self.targets, "targets")):
            if len(set(names)) != len(names) or not names:
                raise ValueError(f"{kind} are empty or repeat")
        once = sorted(set(found))
        if self.lane == "envelope" and list(self.targets) != [f"{x}{h}" for h in once for x in ENVELOPE]:
            raise ValueError("an envelope holds high and low of each horizon side by side, horizons ascending")
        if self.lane == "path" and list(found) != once:
            raise ValueError("a path holds one target a horizon, ascending")
        object.__setattr__(self, "horizons", found)

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def differs(self, other: Contract) -> list[str]:
        """The parts in which two contracts differ; the order of names counts."""
        mine, theirs = asdict(self), asdict(other)
        return [k for k in mine if list_or_value(mine[k]) != list_or_value(theirs[k])]


def list_or_value(x: object) -> object:
    return list(x) if isinstance(x, (list, tuple)) else x


def write_tensors(df: DataFrame, path: str, contract: Contract, sort_by: Sequence[str] = ()) -> None:
    """Overwrite rows and contract; the contract comes last, so a write that broke off is refused by readers (SNK5)."""
    spark = df.sparkSession
    text = lambda lines: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")
    text([])
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode("overwrite").parquet(f"{path}/rows")
    text([json.dumps(asdict(contract) | {"digest": contract.digest()})])


def read_tensors(spark: SparkSession, path: str, expected: Contract | None = None) -> tuple[DataFrame, Contract]:
    """Rows and contract of a sequence table (SRC15).

    ValueError where the contract is missing, contradicts itself, was changed after it was written, or is not the expected one.
    """
    lines = [r.value for r in spark.read.text(f"{path}/contract").limit(2).collect()]
    if len(lines) != 1:
        raise ValueError(f"{path} holds {len(lines)} contracts")
    held = json.loads(lines[0])
    digest = held.pop("digest", None)
    contract = Contract(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})
    if digest != contract.digest():
        raise ValueError(f"{path}: the contract does not match its digest")
    if expected is not None and expected.differs(contract):
        raise ValueError(f"{path}: the contract differs in {expected.differs(contract)}")
    return spark.read.parquet(f"{path}/rows"), contract


def tensor_faults(df: DataFrame, contract: Contract, x: str = "x", y: str = "y") -> DataFrame:
    """One row: n, and how many rows break the contract, each counted once a fault (SRC15).

    wrong_steps: x is NULL or has another number of steps; wrong_width: a step is NULL or has another number of values;
    wrong_targets: the same for y; missing: a value of x or y is NULL, NaN or infinite; faulty: rows with any fault.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    some = lambda col, test: F.coalesce(F.exists(col, test), F.lit(False))
    faults = {
        "wrong_steps": F.coalesce(F.size(x), F.lit(-1)) != contract.steps,
        "wrong_width": some(c(x), lambda s: F.coalesce(F.size(s), F.lit(-1)) != len(contract.features)),
        "wrong_targets": F.coalesce(F.size(y), F.lit(-1)) != len(contract.targets),
        "missing": some(c(x), lambda s: some(s, bad)) | some(c(y), bad),
    }
    any_fault = F.lit(False)
    for fault in faults.values():
        any_fault = any_fault | fault
    return df.agg(F.count("*").alias("n"), *[F.count_if(v).alias(k) for k, v in faults.items()], F.count_if(any_fault).alias("faulty"))
