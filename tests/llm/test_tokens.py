"""Token encoding, packing, token files: exact round trips."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthlight.llm import packing, tokenfile, tokens
from hearthlight.session import new_folder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_tokenizer())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_parts_encode_as_whole_texts(tokenizer):
    rng = random.Random(8)
    pieces = ["a", " ", "  ", "\n", "\n\n", "\t", ".", "é", " ", " ", "1", "'s", "<|endoftext|>", "字", "\x1c", "😀", " the", "The"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(16))) for _ in range(4000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.encoded(tokens.default_tokenizer(), [*texts, None])]
    want = [[*x.ids, 0] for x in tokenizer.encode_batch([*texts, ""], add_special_tokens=False)]
    assert got == want


def check_packed(packed, rows, tokenizer, capacity):
    pieces = packed.toPandas()
    want = []
    for doc, text, *_ in rows:
        ids = ids_of(tokenizer, text)
        head = len(ids) % capacity
        starts = [0, *range(head, len(ids), capacity)] if head else list(range(0, len(ids), capacity))
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, pieces[columns].to_numpy().tolist())) == sorted(want)
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.length.sum() <= capacity
    return pieces


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack(docs, rows, tokenizer, capacity):
    pieces = check_packed(packing.pack(docs, capacity=capacity), rows, tokenizer, capacity)
    least = -(-pieces.length.sum() // capacity)
    assert pieces.sequence_id.nunique() <= least * 1.02 + 1


def test_pack_in_small_tasks_with_few_bins(docs, rows, tokenizer):
    packed = packing.pack(docs, capacity=256, open_bins=3, block=10, task_pieces=20)
    check_packed(packed, rows, tokenizer, 256)


def test_pack_repeated_rows_and_empty(repeated, nothing, rows, tokenizer):
    check_packed(packing.pack(repeated), rows + rows, tokenizer, 2048)
    assert packing.pack(nothing).count() == 0


def test_open_bins_take_the_best_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # fits both; the fuller one is best
    assert bins.place(5) == (2, 0)
    assert bins.place(8) == (3, 0)  # none fits: bin 0, with four free, was the fullest and is closed
    assert bins.place(4) == (2, 5)


def test_token_files(spark, docs, rows, tokenizer):
    folder = new_folder(spark, "tokens")
    tokenfile.write_tokens(docs, folder)
    got = {r.doc_id: r for r in tokenfile.read_tokens(spark, folder).collect()}
    before = 0
    for doc, text, *_ in sorted(rows):
        ids = ids_of(tokenizer, text)
        r = got.pop(doc)
        assert (r.start, r.n_tokens, r.ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(r.ids) == ids.tobytes()
        before += len(ids)
    assert not got
    some = [rows[3][0], rows[11][0]]
    short = {r.doc_id: bytes(r.ids) for r in tokenfile.read_documents(spark, folder, some).collect()}
    assert short == {d: ids_of(tokenizer, t).tobytes() for d, t, *_ in rows if d in some}


def test_token_files_need_their_dictionary(spark, docs):
    folder, other = new_folder(spark, "tokens"), new_folder(spark, "tokens")
    tokenfile.write_tokens(docs, folder)
    tokenfile.write_tokens(docs.where("doc_id < 100"), other, sample=3)
    segments = spark.read.parquet(f"{folder}/segments").withColumn("dictionary", F.lit("0"))
    with pytest.raises(Exception, match="another dictionary"):
        tokenfile.read_segments(spark, folder, segments).count()
    assert tokenfile.read_tokens(spark, other).count() == docs.where("doc_id < 100").count()


def test_token_files_repeated_rows_and_empty(spark, repeated, nothing, rows):
    folder, empty = new_folder(spark, "tokens"), new_folder(spark, "tokens")
    tokenfile.write_tokens(repeated, folder)
    got = tokenfile.read_tokens(spark, folder).select("start", "n_tokens").collect()
    assert len(got) == 2 * len(rows)
    got.sort()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]) if b.start != a.start)  # noqa: B905
    tokenfile.write_tokens(nothing, empty)
    assert tokenfile.read_tokens(spark, empty).count() == 0
