"""Token counts by separator scan over flat, unindexed token files."""

from __future__ import annotations

import base64
import posixpath
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenrank.llm.common import shared_path

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of that vocabulary: how it splits text, and the free id that ends a document.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
DTYPE = "<u2"
#: Tokens in a file at most (a document more), documents in a file, and tokens in a block of the scan.
FILE_TOKENS, FILE_DOCS, BLOCK_TOKENS = 64 << 20, 1 << 20, 1 << 20
#: Blocks that one task scans at most.
TASK_BLOCKS = 64
#: White space as PATTERN knows it, in runs too long for its look-ahead, which needs stack for every character.
_LONG_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def encoder(ranks: bytes) -> tiktoken.Encoding:
    """A tokenizer from the content of a rank file."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_ids(enc: tiktoken.Encoding, text: str | None) -> Iterator[list[int]]:
    """The ids of a text, piece by piece: those that the pattern gives, found without it for long runs of white space.

    Of a run that ends the text the pattern makes one piece; of any other the last character begins what follows.
    """
    text, at = text or "", 0
    for m in _LONG_WHITE.finditer(text):
        yield enc.encode_ordinary(text[at : m.start()])
        at = m.end() - (m.end() < len(text))
        yield enc._encode_single_piece(text[m.start() : at])
    yield enc.encode_ordinary(text[at:])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int = END, dtype: str = DTYPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every row of docs into flat files; returns (uri, tokens, doc_ids in order).

    A file is ids of dtype, each document followed by end: no header, no index. Null texts are empty documents; repeated
    rows and null ids are documents like any other; an empty table gives no files; other columns are not read. A text
    may be of any length: it is written piece by piece. Files bear names that no other task attempt uses, so only those
    that the returned rows list count. The vocabulary goes to the executors by broadcast (its file is of fixed size).
    """
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        enc, kind = encoder(ranks.value), np.dtype(dtype)
        out, name, size, ids = None, "", 0, []

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([posixpath.join(folder, name)]), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["uri", "tokens", "doc_ids"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.tokens"
                    out, size, ids = fs.open_output_stream(posixpath.join(root, name), compression=None), 0, []
                for tokens in token_ids(enc, text):
                    out.write(np.array(tokens, kind).tobytes())
                    size += len(tokens)
                out.write(np.array([end], kind).tobytes())
                size += 1
                ids.append(doc_id)
                if size >= FILE_TOKENS or len(ids) >= FILE_DOCS:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "uri string, tokens long, doc_ids array<long>")


def scan_blocks(files: DataFrame, end: int = END, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(uri, block, size, ends): for each block of each file of files (uri, tokens) the places, counted from the start of the file, that hold end.

    Files without tokens have no blocks. Blocks are dealt to as many tasks as the session runs at once, more if a task
    would get over TASK_BLOCKS; the number is given, so Spark doesn't fold the short list into one task.
    """
    spark = files.sparkSession
    n_blocks = files.where("tokens > 0").agg(F.sum(F.expr(f"(tokens - 1) div {block_tokens} + 1"))).first()[0] or 1
    tasks = max(min(n_blocks, spark.sparkContext.defaultParallelism), -(-n_blocks // TASK_BLOCKS))
    blocks = files.select("uri", F.col("tokens").cast("long").alias("tokens")).where("tokens > 0").select("uri", "tokens", F.explode(F.expr(f"sequence(0L, (tokens - 1) div {block_tokens})")).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(dtype)
        for b in batches:
            for uri, tokens, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first = block * block_tokens
                n = min(block_tokens, tokens - first)
                fs, path = pa.fs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    f.seek(first * kind.itemsize)
                    data = f.read(n * kind.itemsize)
                ids = np.frombuffer(data, kind)
                if len(ids) != n:
                    raise ValueError(f"{uri} is shorter than {tokens} tokens")
                ends = np.flatnonzero(ids == end).astype(np.int64) + first
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["uri", "block", "size", "ends"])

    return blocks.repartition(int(tasks)).mapInArrow(run, "uri string, block long, size long, ends array<long>")


def stitch(blocks: DataFrame) -> DataFrame:
    """(uri, ordinal, n_tokens) of every document, in the order of its file, from the blocks of scan_blocks().

    A prefix scan over the blocks of a file carries two numbers: how many documents have ended before the block, and
    where the last of them did. With these each block finishes its documents alone, those that began in earlier blocks
    too. Tokens after the last separator are one more document. Only block summaries of one file meet in a task.
    """
    before = W.partitionBy("uri").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    last = W.partitionBy("uri").orderBy(F.col("block").desc())
    ready = blocks.select(
        "uri",
        "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long").alias("done"),
        F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1)).cast("long").alias("from"),
        (F.row_number().over(last) == 1).alias("is_last"),
        (F.sum("size").over(before.rowsBetween(W.unboundedPreceding, 0))).alias("total"),
    )
    # a file that ends without a separator ends its last document at its end
    stop = F.coalesce(F.array_max("ends"), F.col("from"))
    ready = ready.withColumn("ends", F.when(F.col("is_last") & (stop < F.col("total") - 1), F.concat("ends", F.array(F.col("total")))).otherwise(F.col("ends")))
    starts = F.expr("concat(array(`from`), slice(ends, 1, greatest(size(ends) - 1, 0)))")
    counts = F.zip_with("ends", starts, lambda e, s: e - s - 1)
    return ready.where("size(ends) > 0").select("uri", "done", F.posexplode(counts).alias("i", "n_tokens")).select("uri", (F.col("done") + F.col("i")).alias("ordinal"), "n_tokens")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    listed = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{folder}/files")
    listed.write.parquet(f"{folder}/manifest")
    files = spark.read.schema(listed.schema).parquet(f"{folder}/manifest")
    # The list of files is small, what it unfolds to is not: Spark must not take it for a side to broadcast.
    ids = files.select("uri", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
    counts = stitch(scan_blocks(files))
    return ids.select("uri", F.col("ordinal").cast("long").alias("ordinal"), "doc_id").join(counts.hint("merge"), ["uri", "ordinal"], "left").select("doc_id", "n_tokens")
