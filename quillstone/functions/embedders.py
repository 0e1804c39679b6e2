"""Embedders by name: texts in, vectors out; which one is a parameter of all that needs vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import similarity
from ..ship import ship

#: A factory makes, once in each worker, the function from a list of texts to an array of a row a text.
Factory = Callable[[], Callable[[list[str]], np.ndarray]]
_made: dict[str, Factory] = {}


def register(name: str, factory: Factory) -> None:
    """Offer an embedder, such as a local model or a remote service, under a name.  The factory goes to the workers, so it must pickle."""
    _made[name] = factory


def names() -> list[str]:
    return sorted({"hash", *_made})


def embed(texts: DataFrame, provider: str = "hash", id_col: str = "id", text_col: str = "text", id_type: str = "string") -> DataFrame:
    """(id, v): a vector of unit length for each row; null texts count as empty, and what embeds to nothing is all zeros.

    ``hash`` is made of native expressions; others run over Arrow batches, their model made once for each task.
    """
    rows = texts.select(F.col(id_col).cast(id_type).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if provider == "hash":
        made = similarity.dense(similarity.hash_embedding(rows, "id", "text"))
        zero = F.array_repeat(F.lit(0.0), similarity.DIM)
        return rows.select("id").join(made, "id", "left").select("id", F.coalesce("v", zero).alias("v"))
    if provider not in _made:
        raise ValueError(f"no embedder {provider!r}; there are {', '.join(names())}")
    factory = _made[provider]
    ship(texts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(model(batch.column(1).to_pylist()), np.float64)
                size = np.sqrt((v * v).sum(1, keepdims=True))
                v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v.tolist(), pa.list_(pa.float64()))], ["id", "v"])

    return rows.mapInArrow(run, f"id {id_type}, v array<double>")
