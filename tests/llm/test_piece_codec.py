import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as spm
from sentencepiece import sentencepiece_model_pb2 as pb

from anontext.llm.piece_codec import CharMap, PieceCodec, encode_texts, piece_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = list("ab  \n\t▁éß漢字🙂'\"<s>0x0A.,the ́\x00\xa0　")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return PieceCodec(f.read(), cache_words=50)


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=PATH)


def texts():
    r = random.Random(1)
    yield from ("", " ", "   ", "a", " a ", "<s></s>", "\n\n", "x" * 3000, "a b " * 500)
    for _ in range(1500):
        yield "".join(r.choice(LETTERS) for _ in range(r.randint(0, 30)))
    for _ in range(5):
        yield "".join(r.choice("abcdeéthn") for _ in range(2000))


def test_ids_spans_and_text_equal_the_library(codec, library):
    for t in texts():
        ids, begins, ends = codec.encode(t.encode())
        assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True), t
        spans = [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]
        assert list(zip(begins[1:-1].tolist(), ends[1:-1].tolist(), strict=True)) == spans, t
        assert codec.decode(ids).decode() == library.decode(ids.tolist()) == t.replace("▁", " "), t


def test_decoding_any_ids_equals_the_library(codec, library):
    r = random.Random(2)
    for _ in range(3000):
        ids = [r.randrange(0, 400) for _ in range(r.randint(0, 8))]
        assert codec.decode(ids).decode() == library.decode(ids), ids


def test_compiled_map_normalises_like_the_library():
    made = spm.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True,
                                       escape_whitespaces=True)
    proto = pb.ModelProto()
    proto.ParseFromString(made.serialized_model_proto())
    with open(PATH, "rb") as f:
        model = pb.ModelProto()
        model.ParseFromString(f.read())
    model.normalizer_spec.CopyFrom(proto.normalizer_spec)
    codec = PieceCodec(model.SerializeToString())
    for t in ("ｆｕｌｌ ｗｉｄｔｈ", "ﬁne  ①②  Å", " a　b\tc ", "한글 ㍿", "x​y", "é é", "", "  "):
        normal, where = codec.normalise(t.encode())
        assert normal.decode() == made.normalize(t), t
        assert len(where) == len(normal) + 1 and (np.diff(where) >= 0).all()
    assert CharMap(b"").longest(b"abc", 0) is None


def test_frames(make, library):
    rows = ["hello world", None, "", "naïve\ncafé", "hello world", "long " * 20_000]
    got = {r.doc_id: r for r in piece_digests(make(rows), PATH).collect()}
    for i, t in enumerate(rows):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece_digests(make([]), PATH).count() == 0
    spans = encode_texts(make(["ab cd"]), PATH, ("ids", "begins", "ends", "decoded")).first()
    assert spans.decoded == "ab cd" and spans.ends[-1] == 5 and len(spans.ids) == len(spans.begins)
