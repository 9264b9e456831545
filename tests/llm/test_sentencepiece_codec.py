import hashlib
import random
import struct

import pytest
from lexweave.llm import sentencepiece_codec as codec
from lexweave.llm.queries import model_path

ODD = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "é", "あ", "😀", "\x00", "\x01", "ﬁ", "①", " ", "<s>", "</s>", "<unk>", "<0x41>", "the ", "12", "�"]


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path()), codec.Codec(codec.read_model(model_path()))


def texts(spark, sf):
    rng = random.Random(1)
    own = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    return own + ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", " ", "word " * 20000, "x" * 20000]


def test_ids_text_and_spans_match_the_library(spark, sf, both):
    sp, mine = both
    for text in texts(spark, sf):
        ids, begins, ends, pieces = mine.encode(text)
        want = sp.encode(text, add_eos=True)
        assert ids == want
        assert mine.decode(ids) == sp.decode(ids)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins, ends, strict=True)) == raw
        digest = hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert mine.digest(text)[:3] == (len(want), digest, hashlib.sha256(sp.decode(want).encode()).hexdigest())


def test_spans_digest_is_of_the_spans(spark, sf, both):
    import struct

    _, mine = both
    for text in texts(spark, sf):
        ids, begins, ends, _ = mine.encode(text)
        pairs = b"".join(struct.pack("<II", a, b) for a, b in zip(begins, ends, strict=True))
        assert mine.digest(text)[3] == hashlib.sha256(pairs).hexdigest()
        assert begins[0] == 0 and ends[-1] == len(text.encode()) and all(a == b for a, b in zip(begins[1:], ends))


def mapped_model(rule, prefix=True, trims=True, byte_fallback=True):
    """The public model with the library's own character map of a rule; a model file and the library's processor for it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    normaliser = sentencepiece_model_pb2.ModelProto()
    normaliser.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(codec.read_model(model_path()))
    proto.normalizer_spec.precompiled_charsmap = normaliser.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = prefix, trims
    if not byte_fallback:
        proto.trainer_spec.byte_fallback = False
        for p in proto.pieces:
            p.type = 1 if p.type == 6 else p.type
    made = proto.SerializeToString()
    return made, sentencepiece.SentencePieceProcessor(model_proto=made)


@pytest.mark.parametrize(("rule", "prefix", "trims", "byte_fallback"), [("nfkc", True, True, True), ("nmt_nfkc_cf", True, False, True), ("nmt_nfkc", False, True, False), ("nfkc", True, False, False)])
def test_full_character_maps_match_the_library(spark, sf, rule, prefix, trims, byte_fallback):
    model, sp = mapped_model(rule, prefix, trims, byte_fallback)
    mine = codec.Codec(model)
    rng = random.Random(6)
    odd = [*[x for x in ODD if x != "\x00"], "A\u030a", "e\u0301", "\u1100\u1161\u11a8", "\u3000", "\u00a0", "㍿", "ｶﾞ", "Ⅷ", "ǅ", "½", "\u200b", "ﷺ", "𝔸", "𓀀𓀁", "ឃ"]
    some = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    some += ["".join(rng.choice(odd) for _ in range(rng.randrange(25))) for _ in range(2000)]
    for text in some:
        ids, begins, ends, _ = mine.encode(text)
        proto = sp.encode(text, return_type="proto")
        assert ids[:-1] == [p.id for p in proto.pieces]
        raw = text.encode()
        for i, a, b, p in zip(ids, begins, ends, proto.pieces):
            if i not in mine.bytes_of:
                assert (a, b) == (p.begin, p.end) and raw[a:b].decode() == p.surface
        if byte_fallback:
            assert mine.decode(ids) == sp.decode(ids)


def test_long_texts_are_merged_in_parts(spark, sf, both, monkeypatch):
    sp, _ = both
    for part in (1, 7, 100):
        monkeypatch.setattr(codec, "PART", part)
        mine = codec.Codec(codec.read_model(model_path()))
        for text in texts(spark, sf)[:: 3 * part // 2 + 1]:
            ids, begins, ends, _ = mine.encode(text)
            assert ids == sp.encode(text, add_eos=True) and mine.decode(ids) == sp.decode(ids)
            assert begins[0] == 0 and ends[-1] == len(text.encode()) and all(a == b for a, b in zip(begins[1:], ends))


def test_decodes_any_ids(both):
    sp, mine = both
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randrange(12))]
        if 0 not in ids:
            assert mine.decode(ids) == sp.decode(ids)


def tiny_map(first: str, to: str) -> bytes:
    """A compiled map with the single entry ``first`` (one byte) -> ``to``, laid out as a double array."""
    units = [0] * 512
    units[0] = 256 << 10  # the root's children stand at 256 ^ byte
    child = 256 ^ ord(first)
    leaf = child ^ 1
    units[child] = ord(first) | 1 << 8 | 1 << 10
    units[leaf] = 1 << 31 | 0
    return struct.pack("<I", 4 * len(units)) + struct.pack("<512I", *units) + to.encode() + b"\0"


def test_character_map_records_source_bytes(both):
    mapping = codec.CharMap(tiny_map("A", "ae"))
    assert mapping.longest(b"xA", 1) == (1, b"ae") and mapping.longest(b"xA", 0) is None
    mine = codec.Codec(codec.read_model(model_path()))
    mine.map = mapping
    normal, align = mine.normalise("xA y")
    assert normal == "▁xae▁y" and align.tolist() == [0, 0, 0, 0, 1, 1, 2, 2, 2, 3, 4]
    ids, begins, ends, pieces = mine.encode("xA y")
    assert "".join(pieces[:-1]) == normal and ends[-2] == 4 and begins[0] == 0


def test_frame_edges(spark):
    df = spark.createDataFrame([(1, None, "c"), (None, "a b", "c"), (1, None, "c"), (2, "", "c")], "doc_id long, text string, ids string")
    assert codec.digests(df, model_path()).count() == 4
    encoded = codec.encode(df, model_path())
    rows = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    assert rows[1] == [2] and rows[2] == [2]
    assert {r["text"] for r in codec.decode(encoded, model_path()).collect()} == {"", "a b"}
    assert codec.digests(df.limit(0), model_path()).count() == 0
