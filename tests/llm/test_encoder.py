import public_tokenizers

from scholargraph.llm import packing


def test_each_distinct_part_is_looked_up_once():
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["red fox fox\nfox, red", "fox", "\nred fox"] * 50
    parts, which, ends = encoder._parts(texts)
    assert len(which) == 9 * 50 and ends.tolist()[:3] == [5, 6, 9]
    assert len(set(which.tolist())) <= 5 + len(texts)  # a first word is a part of its own
    assert encoder.encode(texts) == [encoder.bytes(t) for t in texts]
    odd = [None, "", " ", "\n", "a b\nc\n", "a\n\nb", "x  y", " a b", "a ", "\n \n", "word,\nNext. one", "<|endoftext|> a", "a\tb c", "日本語テキスト\nです"]
    assert encoder.encode(odd) == [encoder.bytes(t) if t else b"" for t in odd]


def test_batches_are_encoded_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("long " * i + "end") if i % 3 else None) for i in range(40)], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = sorted(map(tuple, packing.tokenise(docs, path, 16).collect()))
    monkeypatch.setattr(packing, "AT_ONCE", 100)
    assert sorted(map(tuple, packing.tokenise(docs, path, 16).collect())) == whole
    assert {r[0] for r in whole} == set(range(40))
