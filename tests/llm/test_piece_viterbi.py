import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from imgframe.llm.piece_viterbi import SPACE, PieceModel, decode_pieces, encode_pieces, piece_model

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return piece_model(PATH)


@pytest.fixture(scope="module")
def scores():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}


def brute(text, scores):
    """The best score over all segmentations of the whole text, without cuts: every piece tried at every place."""
    unknown = min(scores.values()) - 10
    best = [0.0] + [float("-inf")] * len(text)
    longest = max(map(len, scores))
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + longest) + 1):
            if text[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[text[i:j]])
        if text[i] not in scores:
            best[i + 1] = max(best[i + 1], best[i] + unknown)
    return best[-1]


@settings(max_examples=80, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("aeinrst .,\n\té1中😀\u0000" + SPACE), min_size=1, max_size=40))
def test_best_score_and_round_trip(model, scores, text):
    ids = model.encode(text)
    assert model.decode(ids.tolist()) == text
    if SPACE in text:
        return  # own marks are written as bytes, outside of the search
    unknown, total, spelled = min(scores.values()) - 10, 0.0, b""
    for i in ids.tolist():
        if i in model.bytes_ids.values():
            spelled += model.spelt[i]
            try:
                spelled.decode()
                total, spelled = total + unknown, b""
            except UnicodeDecodeError:
                pass
        else:
            total += scores[model.pieces[i]]
    assert total == pytest.approx(brute(SPACE + text.replace(" ", SPACE), scores))


def test_frames(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "Hello  world ", 0), (3, "Hello  world ", 0), (None, "x" * 100_000 + " word" * 50_000, 0), (5, SPACE + " a" + SPACE, 0)]
    both = decode_pieces(encode_pieces(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH), PATH).collect()
    assert sorted(str((r.doc_id, r.decoded)) for r in both) == sorted(str((d, t or "")) for d, t, _ in rows)
    assert all(r.n_pieces == len(r.ids) for r in both)
    assert decode_pieces(encode_pieces(spark.createDataFrame([], "text string"), PATH), PATH).count() == 0
    nulls = decode_pieces(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH)
    assert sorted(str(r.decoded) for r in nulls.collect()) == ["", "None"]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.none() | st.text(alphabet=st.sampled_from("ab é▂\n\t\r中😀" + SPACE), max_size=12), min_size=1, max_size=6))
def test_cuts_of_many_texts(model, texts):
    """Texts encoded together give what one search over each whole text, between its own marks, gives."""
    flat, place = model.encode_all(pa.array(["left out", *texts], pa.string()).slice(1))
    whole = [[] if not t else model.viterbi(SPACE + t.split(SPACE)[0].replace(" ", SPACE)) for t in texts]
    for ids, t in zip(whole, texts, strict=True):
        for part in (t or "").split(SPACE)[1:]:
            ids += [model.bytes_ids[b] for b in SPACE.encode()] + model.viterbi(part.replace(" ", SPACE))
    assert [flat[a:b].tolist() for a, b in zip(place[:-1], place[1:], strict=True)] == whole


def test_cuts_are_encoded_once(monkeypatch):
    """120,000 words and more are searched once by a worker, not once for each step; long ones are not kept."""
    held, seen = PieceModel(PATH), []
    monkeypatch.setattr(held, "viterbi", lambda text, own=held.viterbi: (seen.append(text), own(text))[1])
    text = " ".join(map(str, range(120_000)))
    first, again = held.encode(text), held.encode(text)
    assert len(seen) == len(set(seen)) == 120_000 and first.tolist() == again.tolist()
    assert held.decode(again.tolist()) == text
    held.encode("x" * 100)
    assert not any(len(w) > 64 for w in held.known)
