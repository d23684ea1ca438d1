"""Layered JSON configuration and the registry of sources."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from tensorfold.errors import InvalidConfig, UnknownSource

ENV = "TENSORFOLD_CONFIG"
DEFAULT_FILE = "tensorfold.json"
GROUPS = ("parallel", "debug")


@dataclass
class Config:
    """Scalars come from the top level or from the groups ``parallel`` and ``debug``; any other object is the section of a source."""

    source: str = "base"
    block_bytes: int = 8 << 20
    use_pipeline: bool = True
    max_concurrent_producers: int = 1
    queue_size: int = 0
    show_progress: bool = True
    debug_log: bool = False
    sections: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.max_concurrent_producers != 1:
            raise InvalidConfig(f"max_concurrent_producers is {self.max_concurrent_producers}; it must be 1")

    @classmethod
    def from_dict(cls, given: dict) -> Config:
        known = {f.name for f in fields(cls)} - {"sections"}
        flat = {k: v for k, v in given.items() if not isinstance(v, dict)}
        for g in GROUPS:
            flat |= given.get(g) or {}
        sections = {k: v for k, v in given.items() if isinstance(v, dict) and k not in GROUPS}
        return cls(**{k: v for k, v in flat.items() if k in known}, sections=sections)

    @classmethod
    def from_file(cls, path: str) -> Config:
        with open(path) as f:
            return cls.from_dict(json.load(f))

    def section(self, name: str) -> dict:
        """A source's own options, without those that belong to the top level."""
        own = {f.name for f in fields(self)}
        return {k: v for k, v in self.sections.get(name, {}).items() if k not in own}

    def pipeline_options(self) -> dict:
        queue = self.queue_size if self.use_pipeline else -1
        return {"queue_size": queue, "show_progress": self.show_progress, "max_concurrent_producers": self.max_concurrent_producers}

    def summary(self) -> str:
        return f"source={self.source} block_bytes={self.block_bytes} " + " ".join(f"{k}={v}" for k, v in self.pipeline_options().items())


def load_config() -> Config:
    """The file that the environment names, else ./tensorfold.json, else defaults."""
    if path := os.environ.get(ENV):
        if not os.path.exists(path):
            raise FileNotFoundError(f"{ENV} names {path}, which is not there")
        return Config.from_file(path)
    return Config.from_file(DEFAULT_FILE) if os.path.exists(DEFAULT_FILE) else Config()


SOURCES: dict[str, Callable] = {}


def register_source(name: str) -> Callable:
    """Decorator: makes a function (spark, paths, config, names, index) -> blocks known under a name."""

    def keep(f: Callable) -> Callable:
        SOURCES[name] = f
        return f

    return keep


def source(name: str) -> Callable:
    if name not in SOURCES:
        raise UnknownSource(f"source {name!r} is unknown; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[name]


@register_source("base")
def _files(spark, paths, config: Config, names=None, index=None):
    """Files that ``open`` reaches on every executor; paths with another scheme are left to the source ``spark``."""
    from tensorfold.sources.archive import is_remote, read_blocks

    if is_remote(paths):
        return _by_spark(spark, paths, config, names, index)
    return read_blocks(spark, paths, block_bytes=config.block_bytes, names=names, index=index, mapped=bool(config.section("base").get("mapped")))


@register_source("mapped")
def _mapped(spark, paths, config: Config, names=None, index=None):
    """Files mapped into the tasks' memory instead of read."""
    from tensorfold.sources.archive import read_blocks

    return read_blocks(spark, paths, block_bytes=config.block_bytes, names=names, index=index, mapped=True)


@register_source("mount")
def _mount(spark, paths, config: Config, names=None, index=None):
    """Files under a mount point: the section's ``mount_point`` goes before relative paths and in place of its ``scheme`` (such as ``store://``)."""
    own = config.section("mount")
    return _files(spark, [under_mount(p, own.get("mount_point", "/"), own.get("scheme", "")) for p in ([paths] if isinstance(paths, str) else paths)], config, names, index)


def under_mount(path: str, top: str, scheme: str = "") -> str:
    if scheme and path.startswith(scheme):
        return os.path.join(top, path.removeprefix(scheme).lstrip("/"))
    return path if path.startswith("/") or "://" in path else os.path.join(top, path)


@register_source("spark")
def _by_spark(spark, paths, config: Config, names=None, index=None):
    """Files of a store that only Spark reads, a whole file a row."""
    from tensorfold.sources.archive import blocks_of_binary

    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else paths)
    return blocks_of_binary(files, block_bytes=config.block_bytes, names=names, index=index)


def logger(config: Config | None = None) -> logging.Logger:
    log = logging.getLogger("tensorfold")
    if config and config.debug_log:
        log.setLevel(logging.DEBUG)
    return log
