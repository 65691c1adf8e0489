import random

import numpy as np
import pyarrow as pa
import pytest

from impactrec.llm import unigram
from impactrec.llm.queries import PIECES


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load(PIECES)


def test_trie_holds_its_keys_and_nothing_else():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choices(b"abc\x00\xff", k=rng.randint(1, 6))) for _ in range(300)})
    trie = unigram.DoubleArray(keys)
    known = {k: i for i, k in enumerate(keys)}
    for _ in range(3000):
        word, state = bytes(rng.choices(b"abcd\x00\xff", k=rng.randint(1, 7))), 0
        for byte in word:
            step = trie.base[state] + byte
            state = step if trie.check[step] == state else None
            if state is None:
                break
        found = -1 if state is None else trie.value[state]
        assert found == known.get(word, -1)


def best_score(text: str, scores: dict, unknown: float) -> float:
    """The best sum of scores over all ways to cut a text into pieces and unknown characters."""
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            value = scores.get(text[start:end])
            if value is None and end - start == 1:
                value = unknown
            if value is not None:
                best[end] = max(best[end], best[start] + value)
    return best[-1]


def test_paths_have_the_best_score(vocabulary):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    scores = {
        model.id_to_piece(i).replace("▁", " "): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    }
    by_id = {i: model.get_score(int(i)) for i in vocabulary.ids}
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefghi stuon éß", k=rng.randint(1, 60))) for _ in range(60)]
    texts += ["the quick brown fox " * 3, "x" * 200, "unbelievable" * 12]
    encoder = unigram.Encoder(vocabulary)
    ids, at = encoder.encode(pa.array(texts))
    byte_ids = set(vocabulary.byte_ids.tolist())
    for text, a, b in zip(texts, at, at[1:]):
        found, unknown = 0.0, 0
        for i in ids[a:b].tolist():
            if i in byte_ids:
                unknown += 1
            else:
                found += by_id[i]
        wanted = best_score(" " + text, scores, vocabulary.unknown_score)
        if not unknown:
            assert found == pytest.approx(wanted)
        else:
            assert wanted <= vocabulary.unknown_score / 2


def test_round_trip_of_anything(vocabulary):
    texts = [
        "", None, " ", "  a  b ", "a▁b▁", "日本語 💩 x\n\n y", "x" * 3000 + " " + "é" * 100, "\n", "\x00\x01", "tab\tx", "ﷺ",
        "\r\n   ", "<0x41> <s> </s> <unk>",
    ]
    encoder = unigram.Encoder(vocabulary)
    ids, at = encoder.encode(pa.array(texts))
    assert encoder.decode(ids, at).to_pylist() == [t or "" for t in texts]
    assert at[1] == 0 and at[2] == 0


def test_encode_then_decode(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    tokens = unigram.encode(docs, PIECES)
    assert tokens.where("not exact").isEmpty()
    back = unigram.decode(tokens.where("doc_id < 6"), PIECES)
    found = {r["doc_id"]: r["text"] for r in back.collect()}
    wanted = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id < 6").collect()}
    assert found == wanted
    nothing = unigram.decode(spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>"), PIECES)
    assert {r["k"]: r["text"] for r in nothing.collect()} == {1: None, 2: ""}
