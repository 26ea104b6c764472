import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from songsift.llm.word_bpe import Encoder, Words, encode_texts, pack_places, unpack_places

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello  World's foo123 ñandú <|endoftext|> bar", "<|startoftext|><|endoftext|>", "<|EndOfText|> x", "a'S 'll",
    "ΑΣ ΟΔΟΣ Σ", "İstanbul K ﬁ ² ½ Ⅷ", "日本語 テスト 123", "x\x1cy\x85z\xa0w", "😀👍🏽 !!!'s", "é क़ ẛ̣", "", " \n ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_each_latin_letter_splits_as_in_the_library(library):
    words, encoder = Words(PATH), Encoder(PATH)
    for c in map(chr, range(0x250)):
        text = f"a{c}B {c}{c}'{c}'S 1{c}"
        ids = [i for own in encoder.ids(words.of(text)) for i in own]
        assert ids == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


@pytest.mark.parametrize("block", [1 << 10, 32 << 20])
def test_ids_and_decoded_text_are_those_of_the_library(spark, docs, odd, library, block):
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    df = docs.limit(60).select("doc_id", "text").union(odd.select("doc_id", "text")).union(more)
    for r in encode_texts(df, ["doc_id", "text"], PATH, block=block).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_digests(odd, none, library):
    found = encode_texts(odd, ["doc_id", "text"], PATH, digests=True).collect()
    assert len(found) == odd.count()
    for r in found:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert encode_texts(none, ["doc_id"], PATH).count() == 0


def test_clashing_names_are_refused(odd):
    with pytest.raises(ValueError):
        encode_texts(odd, ["doc_id", "kind"], PATH)


def test_places_survive_packing():
    places = np.array([0, 223, 224, 225, 8159, 8160, 8161, 70_000, 1 << 24, 5, 300])
    assert unpack_places(pack_places(places)).tolist() == places.tolist()
    assert unpack_places(pack_places(places[:0])).tolist() == []
