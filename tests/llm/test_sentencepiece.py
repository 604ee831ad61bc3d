import hashlib
import random

import pytest
import sentencepiece

from keyloom.llm import sentencepiece_bpe as S

ALPHABET = "ab e\n\tthe ing ▁  é梦😀\x00�1234567890.,<s>ÀÉ한글"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.default_model())


@pytest.fixture(scope="module")
def coder():
    return S.Encoder(S.model(S.default_model()))


def agree(library, coder, texts):
    ids, ends = coder.encode(texts)
    back = coder.bpe.decode(ids, ends)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_eos=True)
        assert ids[ends[i] : ends[i + 1]].tolist() == want, text
        assert back[i] == library.decode(want), text


def test_odd_texts(library, coder):
    agree(library, coder, ["", None, " ", "  ", "▁", " " * 40, "a" * 5000, "abc" * 3000, "12" * 2000, " " * 700 + "x" + " " * 33, "\n" * 50, "the" * 2000])


@pytest.mark.parametrize("alphabet", [ALPHABET, "ab ", "▁ x", "thein "])
def test_random_texts(library, coder, alphabet):
    rnd = random.Random(len(alphabet))
    agree(library, coder, ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)])


def test_random_ids(library, coder):
    rnd = random.Random(3)
    rows = [[rnd.choice([0, 1, 2, 3, 60, 130, 200, 230, 258, 259, 300, 400, 29871, 31999]) for _ in range(rnd.randint(0, 8))] for _ in range(1500)]
    flat = S.np.array([x for r in rows for x in r], S.np.int64)
    ends = S.np.cumsum([0, *map(len, rows)])
    assert coder.bpe.decode(flat, ends) == [library.decode(r) for r in rows]


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in S.op2_sentencepiece(spark, sf).collect():
        ids = library.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, "x"), (1, "a b", "y"), (None, "a b", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = S.decode(S.encode(frame, S.default_model()), S.default_model()).collect()
    assert sorted(r.decoded for r in out) == ["", "a b", "a b"]
    assert S.encode(frame.where("false"), S.default_model()).count() == 0
