import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from volpanel.llm import encoding, token_store as T
from volpanel.llm.common import vocabulary

from llm_rows import SCHEMA, odd_rows, prose


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, T.END_ID]


def expected(tokenizer, rows):
    """Per row (doc_id, n_tokens, crc32), and for ids that one row has its place among all ids."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for r in order:
        ids = plain_ids(tokenizer, r[1])
        out.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_store_gives_back_what_the_tokenizer_says(spark, odd, tokenizer):
    want = expected(tokenizer, odd_rows())
    got = [tuple(r) for r in T.written_and_read(spark, odd, vocabulary()).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted((repr(r[0]), *r[2:]) for r in got) == sorted((repr(r[0]), *r[2:]) for r in want)
    ids = [r[0] for r in odd_rows()]
    alone = {i for i in ids if ids.count(i) == 1}
    assert {r for r in got if r[0] in alone} == {r for r in want if r[0] in alone}
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in by_start] == [r[0] for r in want]
    at = 0
    for _, start, n, _ in by_start:
        assert start == at
        at += n


def test_single_documents_by_index(spark, odd, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/store"
    files = T.write_store(odd, vocabulary(), folder, ranges=3).collect()
    dictionary = (tmp_path / "store" / T.DICTIONARY_NAME).read_bytes()
    texts = {}
    for row in odd_rows():
        texts.setdefault(row[0], []).append(plain_ids(tokenizer, row[1]))
    seen = 0
    for f in files:
        file = T.TokenFile(f.path, dictionary)
        assert len(file) == f.documents
        for i in reversed(range(len(file))):
            assert file.ids(i).tolist() in texts[file.doc_id(i)]
            seen += 1
        file.close()
    assert seen == len(odd_rows()) == sum(f.documents for f in files)


def test_trained_dictionary_is_needed_and_helps(tmp_path):
    rng = random.Random(2)
    arrays = [T.coded(np.array([rng.choice((11, 500, 501, 9000, 40000)) for _ in range(40)] + list(range(300, 340)), "<u4").tobytes(), 2, 2) for _ in range(400)]
    dictionary = T.train(arrays, 4096)
    assert dictionary and T.train(arrays[:3]) == b""
    sizes = {}
    for name, own in (("with", dictionary), ("without", b"")):
        writer = T.FileWriter(str(tmp_path / name), 2, own)
        for i, ids in enumerate(arrays):
            writer.add(i, ids)
        writer.close()
        sizes[name] = writer.at
        file = T.TokenFile(str(tmp_path / name), own)
        assert file.ids(17).tolist() == np.frombuffer(arrays[17], "<u2").tolist()
        assert [d[0] for d in file.documents(at_once=100)] == list(range(400))
    assert sizes["with"] < 0.8 * sizes["without"]
    with pytest.raises(ValueError, match="another dictionary"):
        T.TokenFile(str(tmp_path / "with"), b"")
    header = (tmp_path / "with").read_bytes()[: T.HEADER_BYTES]
    assert hashlib.sha256(dictionary).digest() in header


def test_many_copies_spread_over_ranges_and_files(spark, tokenizer, monkeypatch):
    rows = [(None, "same text", "en", "a", 9)] * 300 + [(7, prose(3, 40), "en", "a", 0)] * 300 + [(i, prose(i, 30), "en", "a", 0) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    folder = T.scratch_path(spark, "copies")
    files = T.write_store(frame, vocabulary(), folder, ranges=6)
    assert max(f.documents for f in files.collect()) < 450
    got = sorted((tuple(r) for r in T.read_store(files, folder).collect()), key=lambda r: r[1])
    want = expected(tokenizer, rows)
    assert [(r[0], r[2]) for r in got[:300]] == [(r[0], r[2]) for r in want[:300]]
    assert sorted(map(repr, ((r[0], r[2], r[3]) for r in got))) == sorted(map(repr, ((r[0], r[2], r[3]) for r in want)))
    assert got[-1][1] + got[-1][2] == want[-1][1] + want[-1][2]


def test_empty_table_and_clashing_columns(spark, none, crowded):
    assert T.written_and_read(spark, none, vocabulary()).count() == 0
    more = crowded.withColumns({c: F.lit(1) for c in ("id", "salt", "path", "ids")})
    assert T.written_and_read(spark, more, vocabulary()).count() == len(odd_rows())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aB'stre.,!? \t\n\r\x0b\x1c\x85\xa0 éİΣσ中文ß<|>end0٣½ﬁÅͅōœ“”", max_size=60)))
def test_encoder_equals_the_tokenizer(text):
    own = encoding.encoder(vocabulary())
    assert own(text) == own.whole(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aB'stremdvl.,!? \t\n\rÉàſœž12 ", max_size=40)), max_size=6))
def test_texts_together_get_the_ids_of_each(texts):
    own = encoding.encoder(vocabulary())
    assert list(own.each(texts)) == [own.whole(text) for text in texts]


def test_texts_together_look_each_word_up_once(monkeypatch):
    class Counted(encoding.Store):
        asked = 0

        def __getitem__(self, name):
            self.asked += 1
            return super().__getitem__(name)

    own = encoding.Encoder(vocabulary())
    own.words = Counted(own.alone)
    texts = ["one two, three " * 50, "", "two\n three"] * 20
    assert list(own.each(texts)) == [own.whole(text) for text in texts]
    assert own.words.asked == 4
    monkeypatch.setattr(encoding, "TOGETHER", 100)  # several lots
    assert list(own.each(texts)) == [own.whole(text) for text in texts]


def test_encoder_with_small_store(monkeypatch):
    monkeypatch.setattr(encoding, "GENERATION", 5)
    own = encoding.Encoder(vocabulary())
    for seed in range(30):
        text = prose(seed, 60) + " " + "x" * 100
        assert own(text) == own.whole(text)
