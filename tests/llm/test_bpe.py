import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tillwatch.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def compare(spark, texts):
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(2)
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    for r in bpe.round_trip(table, PATH).collect():
        want = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want, texts[r.doc_id]
        assert r.n_tokens == len(want) and r.decoded == t.decode(want, skip_special_tokens=False)


def test_same_as_the_library(spark):
    rnd = random.Random(8)
    letters = "aeiouthrsnéßñ中🙂 \n\t'sd.,!?0123٣  -\x1c　AB"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["".join(rnd.choice("etaoin shrdlu") for _ in range(300)) for _ in range(100)]
    texts += [None, "", " ", "\n\n ", "a  b", "a \n b", "it's they'll <|endoftext|> x<|endoftext|>", "e" * 5000, " " * 300, "don''t"]
    compare(spark, texts)


def test_every_letter_and_space_is_cut_alike():
    t = Tokenizer.from_file(PATH)
    encoder = bpe.Encoder(PATH)
    points = [chr(c) for c in list(range(0, 0x3100)) + list(range(0xA000, 0xB000)) + list(range(0xFB00, 0x10000))]
    for c in points:
        text = f"a{c} {c}1 \n{c}b"
        assert encoder.encode_text(text) == t.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(spark, [r.text for r in docs.collect()])


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
