"""The piece transducer against the library, on models put together by hand."""

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from millrace.llm.sentence_pieces import BYTE, BYTE_PAIR, CONTROL, NORMAL, SPACE, UNIGRAM, UNKNOWN, PieceTransducer, character_map

WORDS = "a b c d e ab bc cd abc bcd ▁ ▁a ▁b ▁ab ▁abc ▁the the he in ing ▁in t h i n g é ü fi ▁fi 1 2 12".split()


def make(kind, rule, fallback, **spec):
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    model = pb.ModelProto()
    model.ParseFromString(normaliser.serialized_model_proto())
    for name, value in spec.items():
        setattr(model.normalizer_spec, name, value)
    model.trainer_spec.model_type = kind
    model.trainer_spec.byte_fallback = fallback
    rng = random.Random(3)
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL)]
    pieces += [(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)] if fallback else []
    pieces += [(w, -rng.uniform(1, 9) if kind == UNIGRAM else -float(i), NORMAL) for i, w in enumerate(sorted(WORDS, key=len, reverse=kind == BYTE_PAIR))]
    for piece, score, type_ in pieces:
        model.pieces.add(piece=piece, score=score, type=type_)
    return model


@pytest.mark.parametrize("kind", [UNIGRAM, BYTE_PAIR])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_encoding(kind, rule, fallback, squeeze):
    model = make(kind, rule, fallback, remove_extra_whitespaces=squeeze, add_dummy_prefix=squeeze or fallback)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    machine = PieceTransducer(model)
    rng = random.Random(5)
    parts = [*WORDS, " ", "  ", "\n", "\t", "ﬁ", "Ａ", "　", "１２", "é", "é", "ü", "​", "▁", "語", "語字", "😀", "½", "İ", "x", "THE", " the"]
    texts = ["", " ", "   ", "a", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]]
    for text in texts:
        want = library.encode(text)
        got = [int.from_bytes(machine.encode(text)[i : i + 4], "little") for i in range(0, len(machine.encode(text)), 4)]
        assert got == want, text
        assert machine.decode(got) == library.decode(want), text


def test_character_map():
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    model = pb.ModelProto()
    model.ParseFromString(normaliser.serialized_model_proto())
    found = character_map(model.normalizer_spec.precompiled_charsmap)
    assert found["ﬁ"] == "fi" and found["　"] == " " and len(found) > 5000
    assert character_map(b"") == {}


def test_refusals():
    model = make(UNIGRAM, "identity", False)
    model.pieces.add(piece="<mask>", score=0.0, type=4)
    with pytest.raises(ValueError):
        PieceTransducer(model)
    assert SPACE == "▁"


def test_the_report_is_one_pass(spark):
    from public_tokenizers import path

    from millrace.llm.sentence_pieces import piece_report

    d = spark.createDataFrame([(1, "a▁b  c \U0001f600 naïve"), (2, ""), (3, None), (None, "x")], "doc_id long, text string")
    got = piece_report(d, path("piece_bpe_32k.model"))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[3].ids is None and (rows[3].n_pieces, rows[3].round_trip, rows[2].ids, rows[2].round_trip) == (0, True, [], True)
    assert all(r.n_pieces == len(r.ids or []) for r in rows.values()) and rows[1].round_trip and len(rows) == 4
