"""Token counts against the tokenizer itself, and separators at block ends."""

import random

import numpy as np
import pytest

from lumenrank.llm import tokens as tk


def plain(ids, end):
    out, n = [], 0
    for x in ids:
        if x == end:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + ([n] if n else [])


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_stitching(spark, tmp_path, block):
    rng = random.Random(block)
    files, want = [], {}
    shapes = [[9] * 5, [1] * 12, [9], [1], [1, 9] * 4, [1] * 20 + [9] + [2] * 20, [9, 9, 1, 9], [1, 2, 3, 9, 4]] + [[rng.choice([1, 2, 3, 9]) for _ in range(30)] for _ in range(6)]
    for i, ids in enumerate(shapes):
        np.array(ids, "<u2").tofile(tmp_path / f"{i}.tokens")
        files.append((f"file://{tmp_path}/{i}.tokens", len(ids)))
        want[files[-1][0]] = plain(ids, 9)
    files.append((f"file://{tmp_path}/none", 0))
    df = spark.createDataFrame(files, "uri string, tokens long")
    got = {}
    for r in tk.stitch(tk.scan_blocks(df, 9, block_tokens=block)).orderBy("uri", "ordinal").collect():
        got.setdefault(r.uri, []).append(r.n_tokens)
        assert r.ordinal == len(got[r.uri]) - 1
    assert got == want


def test_cut_file_is_an_error(spark, tmp_path):
    np.array([1, 9], "<u2").tofile(tmp_path / "a")
    df = spark.createDataFrame([(f"file://{tmp_path}/a", 3)], "uri string, tokens long")
    with pytest.raises(Exception, match="shorter"):
        tk.scan_blocks(df, 9).collect()


def test_documents(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(tk, "FILE_TOKENS", 50)
    texts = ["", None, "hello world", "<|endoftext|>", "é ß 漢字", "a" * 3000, "x y z " * 50]
    rows = list(enumerate(texts)) + [(3, "again"), (None, "no id")]
    listed = tk.write_token_files(docs_of(rows), f"file://{tmp_path}/t")
    listed.write.parquet(f"{tmp_path}/m")
    files = spark.read.parquet(f"{tmp_path}/m").collect()
    enc = tk.encoder(open(tk.TOKENIZER, "rb").read())
    counts = {(r.uri, r.ordinal): r.n_tokens for r in tk.stitch(tk.scan_blocks(spark.read.parquet(f"{tmp_path}/m"), block_tokens=37)).collect()}
    got = sorted(((d, counts[f.uri, i]) for f in files for i, d in enumerate(f.doc_ids)), key=repr)
    assert got == sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t in rows), key=repr)
    assert len(files) > 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    enc = tk.encoder(open(tk.TOKENIZER, "rb").read())
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in tk.op10_tokens(spark, sf).collect()} == want


def test_long_white_space(monkeypatch):
    """Runs that the pattern's look-ahead can't pass, and the plain encoder's ids wherever it can."""
    enc = tk.encoder(open(tk.TOKENIZER, "rb").read())
    ids = lambda t: [i for part in tk.token_ids(enc, t) for i in part]
    for run in (" " * 10_000_000, "\n" * 2_000_000):
        assert enc.decode(ids("a" + run + "x")) == "a" + run + "x"
        assert enc.decode(ids(run)) == run
    assert enc.decode(ids("b" * 2_000_000)) == "b" * 2_000_000
    rng = random.Random(3)
    monkeypatch.setattr(tk, "_LONG_WHITE", tk.re.compile(tk._LONG_WHITE.pattern.replace("1000", "3")))
    for _ in range(500):
        t = "".join(rng.choice(["a", "é", "7", "!", " ", "  ", "   ", "\n", "\n\n\n", "\t", "\u00a0", "\u2003\u2003\u2003", "\x1c\x1c\x1c", "'s", "\x85"]) for _ in range(rng.randrange(12)))
        assert ids(t) == enc.encode_ordinary(t), repr(t)


def test_many_tasks(spark, tmp_path):
    """A hundred files and their blocks are read by more than one task."""
    np.array([1, 9] * 30, "<u2").tofile(tmp_path / "a")
    df = spark.createDataFrame([(f"file://{tmp_path}/a", 60)] * 100, "uri string, tokens long").coalesce(1)
    blocks = tk.scan_blocks(df, 9, block_tokens=10)
    assert blocks.count() == 600
    assert blocks.select(tk.F.spark_partition_id()).distinct().count() > 1


def test_empty_table(spark, docs_of, tmp_path):
    listed = tk.write_token_files(docs_of([]), f"file://{tmp_path}/t")
    assert tk.stitch(tk.scan_blocks(listed)).count() == 0
