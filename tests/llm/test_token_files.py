import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from zonewise.llm import common, encoding, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, docs, tmp_path):
    rows = [(i * 7 % 101, f"text number {i} " * (i % 9)) for i in range(101)]
    rows += [(3, "twice"), (3, "again"), (None, "no id"), (500, None), (501, ""), (502, "long words " * 20_000)]
    store = token_files.write(docs(rows).repartition(5), f"file://{tmp_path}/store", PATH)
    got = sorted(map(tuple, token_files.read(spark, store).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    plain = Tokenizer.from_file(PATH).encode("long words " * 20_000, add_special_tokens=False).ids
    assert store.ids(spark, 502).tolist() == [*plain, 1]
    assert store.ids(spark, 12_345) is None


def test_an_empty_table(spark, docs, tmp_path):
    store = token_files.write(docs([]), f"file://{tmp_path}/empty", PATH)
    assert token_files.read(spark, store).collect() == []
    assert store.ids(spark, 1) is None


def test_files_know_their_dictionary(tmp_path):
    samples = [bytes(f"sample {i % 13} of the words {i % 7}" * 5, "ascii") for i in range(200)]
    dictionary = token_files.train_dictionary(samples)
    assert dictionary
    path = str(tmp_path / "one.ids")
    with token_files._open(path, write=True) as stream:
        writer = token_files.Writer(stream, dictionary, "<u2")
        writer.add(7, np.arange(50))
        writer.add(9, np.zeros(0, int))
        writer.finish()
    with token_files._open(path) as stream:
        reader = token_files.Reader(stream, dictionary, "<u2")
        assert reader.get(7).tolist() == list(range(50)) and reader.get(9).tolist() == [] and reader.get(8) is None
        with pytest.raises(ValueError, match="another dictionary"):
            token_files.Reader(stream, b"", "<u2")


def test_words_are_remembered_once_whatever_their_case_and_marks():
    made = encoding.Encoder(PATH, False)
    asked = []
    encode = made._encode
    made._encode = lambda strings: asked.extend(strings) or encode(strings)
    texts = ["The the, THE. née Straße! НЕТ", "née, the\nThe", "", None]
    got = [ids.tolist() for ids in made.ids(pa.array(texts))]
    assert got == [Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert set(made.code) == {"the", "née", "straße", "НЕТ", ",", ".", "!", ""}
    # Words of letters need the library's model alone.
    assert set(asked) == {",", ".", "!", ""}


def test_letters_that_end_in_a_mark_keep_the_marks_behind_them():
    plain, made = Tokenizer.from_file(PATH), encoding.Encoder(PATH, False)
    for text in ("x\u0130. y", "\u0958, z", "H\u0331 h\u0331.", "T\u0308x T\u0308x", "\ufb2a-"):
        assert made.ids([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids, ascii(text)


def test_small_batches_are_encoded_together():
    batches = [pa.RecordBatch.from_pydict({"x": pa.array(x, pa.int64())}) for x in ([1], [2, 3], [], [*range(100)], [4], [5])]
    got = [b.column(0).to_pylist() for b in common.gathered(iter(batches), 200)]
    assert got == [[1, 2, 3], [*range(100)], [4, 5]]
    assert list(common.gathered(iter([]), 200)) == []
