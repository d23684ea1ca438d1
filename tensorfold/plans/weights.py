"""Weights of layers that are split over ranks: column and row parts, plain or quantised to groups of few bits."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorfold.errors import UnequalTensors, UnknownTensor
from tensorfold.operators import tensors as T
from tensorfold.plans.session import Tensors

QUANTIZE_FILE = "quantize_config.json"


@dataclass
class Quantised:
    """A quantised weight's parts by rank; ``g_idx`` may be absent where groups follow the rows' order."""

    qweight: DataFrame
    qzeros: DataFrame
    scales: DataFrame
    g_idx: DataFrame | None
    bits: int
    groupsize: int
    in_order: bool


class Weights:
    """Layer-wise lookups over opened tensors, by prefix; names that no file has are sought under their aliases."""

    def __init__(self, tensors: Tensors, aliases: dict[str, list[str]] | None = None):
        self.tensors, self.aliases = tensors, aliases or {}
        self.params: tuple[int, int] | None = None

    def name(self, name: str) -> str:
        for n in (name, *self.aliases.get(name, [])):
            if self.tensors.filename(n):
                return n
        raise UnknownTensor(f"no tensor is named {name} or has an alias of it")

    def shape(self, name: str) -> list[int]:
        return self.tensors.shape(self.name(name))

    def tensor(self, name: str) -> DataFrame:
        return self.tensors.tensor(self.name(name))

    def push(self, name: str, rank: int) -> DataFrame:
        return self.tensors.pushed(self.name(name), rank)

    def sharded(self, name: str, dim: int = 1) -> DataFrame:
        return self.tensors.sharded(self.name(name), dim)

    def read_params(self, config: dict, folder: str = "") -> None:
        """Bits and group size from a model's configuration, else from the file beside the model."""
        found = config.get("quantization_config")
        if found is None and os.path.exists(path := os.path.join(folder, QUANTIZE_FILE)):
            with open(path) as f:
                found = json.load(f)
        if found is not None:
            self.params = int(found["bits"]), int(found["group_size"])

    def gptq_params(self) -> tuple[int, int]:
        """Bits and group size: those that the archives hold as tensors, else those that were read from a configuration."""
        try:
            return int(self.tensors.item(self.name("gptq_bits"))), int(self.tensors.item(self.name("gptq_groupsize")))
        except UnknownTensor:
            if self.params is None:
                raise
            return self.params

    def columns(self, prefixes: list[str], quantize: str = "", dim: int = 0) -> DataFrame | Quantised:
        """Several layers' weights, each rank's parts joined. Quantised ones are joined along dimension 1 and must agree in the groups of their rows."""
        if quantize != "gptq":
            return self.tensors.multi_cols([self.name(f"{p}.weight") for p in prefixes], dim)
        parts = {k: self.tensors.multi_cols([self.name(f"{p}.{k}") for p in prefixes], 1) for k in ("qweight", "qzeros", "scales")}
        groups = [self.tensor(f"{p}.g_idx").withColumn("name", F.lit("g_idx")) for p in prefixes]
        for p, other in zip(prefixes[1:], groups[1:], strict=True):
            if not T.is_equal(groups[0], other):
                raise UnequalTensors(f"{prefixes[0]}.g_idx and {p}.g_idx differ")
        return Quantised(**parts, g_idx=groups[0], bits=(params := self.gptq_params())[0], groupsize=params[1], in_order=False)

    def rows(self, prefix: str, quantize: str = "") -> DataFrame | Quantised:
        """One layer's weight by rows. Quantised: groups that follow the rows' order are split with the rows; otherwise every rank has all scales and zeros, and its part of the group numbers."""
        if quantize != "gptq":
            return self.sharded(f"{prefix}.weight", 1)
        bits, size = self.gptq_params()
        in_order = bits == 4 and (self.tensors.world == 1 or self._in_order(prefix, size))
        qweight = self.sharded(f"{prefix}.qweight", 0)
        if in_order:
            dim = 0 if size >= 0 else -1
            g_idx = self.tensor(f"{prefix}.g_idx") if self.tensors.world == 1 else None
            return Quantised(qweight, self.sharded(f"{prefix}.qzeros", dim), self.sharded(f"{prefix}.scales", dim), g_idx, bits, size, True)
        return Quantised(qweight, self.sharded(f"{prefix}.qzeros", -1), self.sharded(f"{prefix}.scales", -1), self.sharded(f"{prefix}.g_idx", 0), bits, size, False)

    def _in_order(self, prefix: str, size: int) -> bool:
        """Whether rows belong to groups in turn, or all to the first."""
        due = F.floor(F.col("pos") / size) if size > 0 else F.lit(0)
        found = self.tensor(f"{prefix}.g_idx").agg(F.count_if(F.col("value") != due).alias("odd"), F.count_if(F.col("value") != 0).alias("some")).first()
        return not found["odd"] or not found["some"]
