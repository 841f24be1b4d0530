"""Token counts by a separator scan of flat token files.

`write_tokens` makes token files: a document's ids follow one another without any index, each document closed by the
end-of-document id, cut into blocks of equal length wherever that falls. `scan` counts tokens from such files alone: a
vectorised search finds the separators of each block, which gives the counts of the documents that lie in one block; a
prefix scan over the blocks of a file stitches those that run over several. The identifiers of the documents that end in
a block stand beside it, in order.

Defined cases: a null or empty text has no token (its separator is there); rows that repeat an identifier count each for
themselves; text that spells out the separator is ordinary text; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlab.llm._common import fresh_path

_encodings: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    """From a file of ranks, once a worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def _flat(path: str, pattern: str, separator: int, block: int, kind: pa.DataType):
    names = ["file", "block", "ids", "closed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        file, at = TaskContext.get().partitionId(), 0
        held, size, closed = [], 0, []

        def row(ids: np.ndarray, closed: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([at], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([closed], pa.list_(kind))], names)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.array([*encode(text.as_py() or ""), separator], "<u4"))
                size += len(held[-1])
                full, last = size // block, (size - 1) // block  # whole blocks, and the block that its separator is in
                if not full:
                    closed.append(key)
                    continue
                flat = np.concatenate(held)
                for k in range(full):
                    yield row(flat[k * block : (k + 1) * block], (closed if k == 0 else []) + ([key] if k == last else []))
                    at += 1
                held, size, closed = [flat[full * block :]], size - full * block, [key] if last == full else []
        if size:
            yield row(np.concatenate(held), closed)

    return run


def write_tokens(docs: DataFrame, folder: str, ranks_path: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 18) -> DataFrame:
    """Writes the token files of docs, one for each partition: rows (file, block, ids, closed). Returns them as read again."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    flat = rows.mapInArrow(_flat(ranks_path, pattern, separator, block, to_arrow_type(kind)), f"file bigint, block bigint, ids binary, closed array<{kind.simpleString()}>")
    flat.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(flat.schema).parquet(folder)


def _separators(separator: int):
    names = ["file", "block", "size", "head", "inner", "tail", "closed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, heads, inners, tails = [], [], [], []
            for ids in batch.column(2):
                flat = np.frombuffer(ids.as_py(), "<u4")
                ends = np.flatnonzero(flat == separator)
                sizes.append(len(flat))
                heads.append(int(ends[0]) if len(ends) else None)
                inners.append((np.diff(ends) - 1).tolist())
                tails.append(int(len(flat) - 1 - ends[-1]) if len(ends) else len(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(heads, pa.int64()), pa.array(inners, pa.list_(pa.int64())), pa.array(tails, pa.int64()), batch.column(3)], names)

    return run


def scan(tokens: DataFrame, separator: int, id_col: str = "doc_id") -> DataFrame:
    """One row for each document: identifier, n_tokens, and the file and block where it ends."""
    kind = tokens.schema["closed"].dataType.simpleString()
    found = tokens.select("file", "block", "ids", "closed").mapInArrow(_separators(separator), f"file bigint, block bigint, size bigint, head bigint, inner array<bigint>, tail bigint, closed {kind}")
    order = Window.partitionBy("file").orderBy("block")
    # What is open at the start of a block: the tails of the blocks since the last separator.
    found = found.withColumn("since", F.count("head").over(order))
    open_ = F.coalesce(F.sum("tail").over(Window.partitionBy("file", "since").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    found = found.withColumn("open", open_).withColumn("carried", F.coalesce(F.lag("open").over(order), F.lit(0)))
    ended = found.where("head is not null")
    counts = F.concat(F.array(F.col("head") + F.col("carried")), F.col("inner"))
    pairs = ended.select("file", "block", F.explode(F.arrays_zip(F.col("closed").alias("id"), counts.alias("n"))).alias("x"))
    return pairs.select(F.col("x.id").alias(id_col), F.col("x.n").alias("n_tokens"), "file", "block")


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, separator: int = 50256, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 18) -> DataFrame:
    """Writes docs as flat token files in the shared folder and counts from those."""
    return scan(write_tokens(docs, fresh_path(docs.sparkSession, "tokens"), ranks_path, pattern, separator, id_col, text_col, block), separator, id_col)
