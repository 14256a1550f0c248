"""Unigram segmentation against all segmentations, and decoding against the texts."""

import math
import random

import pytest
import sentencepiece

from tracemill.llm import pieces


def tiny():
    body = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -3.2, "aab": -6.5, "▁▁": -2.5, "é": -4.0, "ba": -6.0, "éa": -6.9}
    names = ["<unk>", *(f"<0x{i:02X}>" for i in range(256)), *body]
    scores = [-math.inf] * 257 + list(body.values())
    v = pieces.Vocabulary(names, scores, list(range(1, 257)), 0)
    return v, pieces.Codec(v, pieces.DoubleArray.build((p.encode(), i) for i, p in enumerate(names) if scores[i] > -math.inf))


def all_scores(v, text):
    """Scores of all segmentations."""
    known = {p: s for p, s in zip(v.pieces, v.scores) if s > -math.inf}
    if not text:
        return [0.0]
    out = []
    for k in range(1, len(text) + 1):
        s = known.get(text[:k], min(known.values()) - 10 if k == 1 else None)
        if s is not None:
            out += [s + r for r in all_scores(v, text[k:])]
    return out


def test_best_of_all_segmentations():
    v, codec = tiny()
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice("aab▁éx") for _ in range(rnd.randrange(1, 9)))
        ids = codec.viterbi(text)
        got = total(v, ids)
        assert got == pytest.approx(max(all_scores(v, text)))
        assert b"".join(codec.bytes_of[i] for i in ids).decode() == text.replace("▁", " ")


def total(v, ids):
    """Sum of scores; a character in byte pieces counts once."""
    worst, out, left = min(s for s in v.scores if s > -math.inf) - 10, 0.0, 0
    for i in ids:
        if v.scores[i] > -math.inf:
            out += v.scores[i]
        elif left:
            left -= 1
        else:
            b = v.byte_ids.index(i)
            left = 0 if b < 128 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            out += worst
    return out


def test_trie_holds_every_piece_and_no_other():
    v, trie = pieces.tables()
    keys = {p.encode(): i for i, p in enumerate(v.pieces) if v.scores[i] > -math.inf}
    base, check, value = trie.base, trie.check, trie.value

    def find(key):
        node = 0
        for c in key:
            nxt = base[node] + c + 1
            if check[nxt] != node:
                return -1
            node = nxt
        return value[node]

    assert all(find(k) == i for k, i in keys.items())
    rnd = random.Random(2)
    for k in rnd.sample(list(keys), 2000):
        other = k + bytes([rnd.randrange(256)])
        assert find(other) == keys.get(other, -1)


def test_chunks_change_nothing_and_texts_come_back():
    codec = pieces.Codec(*pieces.tables())
    rnd = random.Random(4)
    texts = ["", " ", "  two  spaces ", "\n\na\n b", "naïve — 漢字 \U0001f600\u0000\x7f", "x" * 5000, "Éé, ü! 12 345", " lead"]
    texts += ["".join(rnd.choice("ab é\nß漢 ") for _ in range(200)) for _ in range(20)]
    for t in texts:
        import numpy as np

        ids = np.frombuffer(codec.encode(t), "<i4").tolist()
        assert codec.decode(ids) == t
        if t:
            assert sum(map(codec.scores.__getitem__, [i for i in ids if codec.scores[i] > -math.inf])) == pytest.approx(sum(codec.scores[i] for i in codec.viterbi("▁" + t.replace(" ", "▁")) if codec.scores[i] > -math.inf))


def test_scores_as_the_library_has_them(tmp_path):
    """The same pieces and scores as a unigram model of the library: its best segmentation has our score."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    model.ParseFromString(open(pieces.default_model(), "rb").read())
    v, trie = pieces.tables()
    codec = pieces.Codec(v, trie)
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if v.scores[i] > -math.inf:
            p.score, p.type = v.scores[i], 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    import numpy as np

    for t in ("Hello world, this is a test of the thing", "Étion dans çouelle\nun éonierç", "abc 漢字 zz  q", "keitungach üb 2024"):
        ours, theirs = np.frombuffer(codec.encode(t), "<i4").tolist(), library.encode(t)
        assert total(v, ours) == pytest.approx(total(v, theirs), abs=1e-3)
        assert library.decode(ours) == t


def test_odd_rows_and_decoding(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "long word " * 20_000), (3, "long word " * 20_000), (4, "x▁y")]
    df = spark.createDataFrame([(i, t, "z", 7) for i, t in rows], "doc_id long, text string, ids string, n_ids int")
    out = pieces.encode(df)
    got = out.collect()
    assert len(got) == 6 and all(r["n_ids"] == len(r["ids"]) for r in got)
    assert [r["round_trip"] for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"]))] == [True, True, True, True, False, True]
    assert {(r["doc_id"], r["text"]) for r in pieces.decode(out).collect()} == {(i, {None: "", "x▁y": "x y"}.get(t, t)) for i, t in rows}
    assert pieces.encode(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = pieces.op1_sentencepiece(spark, sf).collect()
    v, trie = pieces.tables()
    codec = pieces.Codec(v, trie)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows)
    for r in rows[:40]:
        text = texts[r["doc_id"]][:2000]
        assert codec.decode(r["ids"]) == texts[r["doc_id"]]
        assert total(v, codec.viterbi("▁" + text.replace(" ", "▁"))) == pytest.approx(total(v, __import__("numpy").frombuffer(codec.encode(text), "<i4").tolist()))
