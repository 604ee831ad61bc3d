import hashlib

from keyloom.llm import pii

from . import brute_pii

ODD = [
    "", None, "a@b.c.@d.e x", "1.2.3.4.5.6.7.8", "0001.2.3.255 999.1.1.1", "9" * 3000, "a" * 50_000, "+1" * 50, "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "é😀 a@b.co 😀 +49 (30) 1234567 x", "x@y", "@a.b", "+1 2 3", "1-2-3 4 5" * 200, "99999999999999999999.1.1.1", "a.b@c-d.e-f.g- +44 20 7946 0958.", "a@b.c,a@b.c;;a@b.c",
]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        counts, digest, told = brute_pii.base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == digest
        assert set(told) <= set(r.spans.split(",")) or not told


def test_odd_texts(spark):
    frame = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    check(pii.find_pii(frame).collect(), dict(enumerate(ODD)))


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(pii.op4_pii(spark, sf).collect(), texts)


def test_labelers_add_spans(spark):
    rows = [(i, f"contact mail: user{i}@site{i}.com ok") for i in range(200)] + [(1000 + i, f"contact mail: user{i}(at)site{i}.com ok") for i in range(20)]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].n_email == 1 and out[i].n_spans == 1 for i in range(200))
    for i in range(20):
        start, end = 14, 14 + len(f"user{i}(at)site{i}.com")
        assert out[1000 + i].n_email == 0 and out[1000 + i].spans == f"email:{start}:{end}"


def test_secrets_are_told_from_long_words(spark):
    rows = [(i, f'settings token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end') for i in range(40)]
    rows += [(100 + i, "a path/of/long/words/without/end and Donaudampfschifffahrtsgesellschaft " + "x" * i) for i in range(40)]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].spans == "secret:18:58" and out[i].n_added == 1 for i in range(40))
    assert all(out[100 + i].spans == "" and out[100 + i].n_spans == 0 for i in range(40))


def test_em_tells_good_labelers_from_bad():
    counts = [((1, 1, 1, 1, 1), 90), ((1, 0, 1, 1, 1), 10), ((0, 0, 0, 1, 0), 80), ((0, 1, 0, 0, 0), 20)]
    prior, hit, false = pii.reliabilities(counts)
    assert hit[2] > 0.9 and false[2] < 0.1 and 0.3 < prior < 0.7
    assert pii.posterior((1, 1, 1, 1, 1), prior, hit, false) > 0.9 > 0.1 > pii.posterior((0, 0, 0, 1, 0), prior, hit, false)


def test_empty_table_and_repeats(spark):
    frame = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co")], "doc_id long, text string")
    assert [r.n_email for r in pii.find_pii(frame).collect()] == [1, 1, 1]
    assert pii.find_pii(frame.where("false")).count() == 0
