"""Embedding plugins: numpy models run over tiles in Arrow batches.

Foundation models need weights that are not shipped; a seeded projection of mean-pooled
patches stands in for each, with its real shapes, behind the same contract.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmbeddingModel(ABC):
    """Batches (N, bands, size, size) to (N, dim); ``load`` is called once in each Python worker."""

    name: str
    bands: int
    size: int
    dim: int

    def __init__(self):
        self.loaded = False

    def load(self) -> None:
        self.build()
        self.loaded = True

    @abstractmethod
    def build(self) -> None: ...

    @abstractmethod
    def extract(self, batch: np.ndarray) -> np.ndarray: ...

    def embed(self, batch: np.ndarray) -> np.ndarray:
        if not self.loaded:
            raise RuntimeError("load the model first")
        batch = np.asarray(batch, np.float32)
        out = self.extract(batch[None] if batch.ndim == 3 else batch)
        return out.astype(np.float32)


class PatchProjection(EmbeddingModel):
    """Means of square patches through a seeded random matrix, averaged over patches."""

    def __init__(self, name: str, bands: int, size: int, dim: int, patch: int, seed: int):
        super().__init__()
        self.name, self.bands, self.size, self.dim, self.patch, self.seed = name, bands, size, dim, patch, seed

    def build(self) -> None:
        self.matrix = np.random.default_rng(self.seed).normal(size=(self.bands * 4, self.dim)) / np.sqrt(self.bands * 4)

    def extract(self, batch: np.ndarray) -> np.ndarray:
        n, c, h, w = batch.shape
        half = max(1, self.patch // 2)
        h, w = max(half * 2, h // (half * 2) * half * 2), max(half * 2, w // (half * 2) * half * 2)
        cells = batch[:, :, :h, :w].reshape(n, c, -1, 2, half, w // (2 * half), 2, half).mean(axis=(4, 7))
        tokens = np.tanh(cells.transpose(0, 2, 4, 1, 3, 5).reshape(n, -1, c * 4) @ self.matrix)
        return tokens.mean(axis=1)


# Name, bands, input size, dimension and patch of each model.
SHAPES = {"prithvi": (6, 224, 768, 16), "satlas": (3, 256, 1024, 32), "ssl4eo": (6, 224, 768, 32)}
_factories: dict[str, Callable[[], EmbeddingModel]] = {name: (lambda name=name, s=s, i=i: PatchProjection(name, s[0], s[1], s[2], s[3], 42 + i)) for i, (name, s) in enumerate(SHAPES.items())}


def register(name: str, factory: Callable[[], EmbeddingModel]) -> None:
    _factories[name] = factory


def available() -> list[str]:
    return sorted(_factories)


def create(name: str) -> EmbeddingModel:
    if name not in _factories:
        raise KeyError(f"unknown model {name!r}; one of {', '.join(available())}")
    return _factories[name]()


def info(name: str) -> dict:
    m = create(name)
    return {"name": name, "bands": m.bands, "size": m.size, "dim": m.dim}


def embed(tiles: DataFrame, model: str | EmbeddingModel, bands: int, height: int, width: int) -> DataFrame:
    """(tile_id, embedding, error) of tiles (tile_id, data array<float> of bands x height x width).

    A tile that fails is reported with its error; the others of its batch are not touched.
    """
    m = create(model) if isinstance(model, str) else model

    def run(batches):
        import pandas as pd

        m.load()
        for pdf in batches:
            out, errors = [], []
            for data in pdf["data"]:
                try:
                    out.append(m.embed(np.asarray(data, np.float32).reshape(bands, height, width))[0])
                    errors.append(None)
                except Exception as e:  # the tile's own trouble
                    out.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"tile_id": pdf["tile_id"], "embedding": out, "error": errors})

    return tiles.select("tile_id", F.col("data")).mapInPandas(run, "tile_id string, embedding array<float>, error string")
