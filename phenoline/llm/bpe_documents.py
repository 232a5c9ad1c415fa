"""Operator 7: encode documents by the streaming transducer in `bpe`, and decode the ids again.

Each task streams its rows through one `Codec` per Python worker: no shuffle, and memory is bounded by the batch, the
remembered chunks and the lookahead. Only ``PART`` characters of a batch are Python strings at a time, and a longer text. Results: null and empty texts have no tokens and decode to ''. Repeated rows stay
repeated rows. Columns of the input with a name of a result column are replaced; all others pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from phenoline.llm.bpe import codec
from phenoline.llm.common import sub_columns, tidied

KINDS = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


# Characters encoded together (fixed value).
PART = 500_000


def encode_decode(
    docs: DataFrame,
    vocabulary: str,
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    text: str = "text",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Add the asked-for columns of ``KINDS``: ids of the whole text by the vocabulary file, and the text they decode to.

    Of the other columns those in ``keep`` pass through, all unless it is given; what isn't kept isn't sent back by the workers.
    """
    kept = [f for f in docs.schema.fields if f.name not in outputs and (keep is None or f.name in keep)]
    schema = T.StructType(kept + [T.StructField(n, KINDS[n][0]) for n in outputs])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(vocabulary, "<u4", any(n.startswith("decoded") for n in outputs), streamed=True)
        for batch in batches:
            for start, part in sub_columns(batch.column(text), PART):
                made: dict[str, list] = {n: [] for n in outputs}
                for ids, shown in machine.encode(part):
                    for n, column in made.items():
                        if n == "n_tokens":
                            column.append(len(ids) // 4)
                        elif n == "ids":
                            column.append(np.frombuffer(ids, "<u4").astype(np.int32))
                        elif n == "decoded":
                            column.append(shown.decode())
                        else:
                            column.append(hashlib.sha256(ids if n == "ids_sha256" else shown).hexdigest())
                old = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [old.column(n) for n in names] + [pa.array(made[n], KINDS[n][1]) for n in outputs],
                    names=names + list(outputs),
                )

    return docs.mapInArrow(tidied(run), schema)
