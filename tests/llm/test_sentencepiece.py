import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm import sentencepiece_viterbi as S


@pytest.fixture(scope="module")
def v():
    return S.vocabulary(open(S.MODEL, "rb").read())


V = None


def voc():
    return S.vocabulary(open(S.MODEL, "rb").read())


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_round_trip_and_stream_agree(text):
    v = voc()
    ids = S.encode_batch(v, [text])[0].tolist()
    assert S.decode(v, ids) == text
    if text:
        for step in (1, 5, 1000):
            assert S.stream_ids(v, [S.normal_bytes(text)], step)[0].tolist() == ids


def char_len(lead):
    return 1 if lead < 0x80 or lead >= 0xF8 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def full_viterbi(v, data):
    """The whole lattice at once."""
    best = [(0.0, -1, -1)] + [None] * len(data)
    piece_of = {}
    for i, b in enumerate(v.bytes):
        piece_of.setdefault(b, i)
    for s in range(len(data)):
        if best[s] is None or (data[s] & 0xC0) == 0x80:
            continue
        n, single = char_len(data[s]), False
        node = 0
        for e in range(s, min(len(data), s + v.longest)):
            node = v.children[node].get(data[e])
            if node is None:
                break
            if v.final[node] >= 0:
                single |= e + 1 - s == n
                c = best[s][0] + v.scores[v.final[node]]
                if best[e + 1] is None or c > best[e + 1][0]:
                    best[e + 1] = (c, s, int(v.final[node]))
        if not single:
            c = best[s][0] + v.unknown
            if best[s + n] is None or c > best[s + n][0]:
                best[s + n] = (c, s, -2)
    out, p = [], len(data)
    while p > 0:
        _, s, i = best[p]
        out.append(v.spell(bytes(data[s:p])) if i == -2 else [i])
        p = s
    return [i for ids in reversed(out) for i in ids]


@pytest.mark.parametrize("text", ["Hello world", "  two  spaces ", "aaaa" * 50, "naïve été 漢字 😀\n\ttab", "▁ own mark▁", "x" * 5000, " " * 300 + "y", "anderththor thtionbleon"])
def test_equals_full_lattice(v, text):
    assert S.encode_batch(v, [text])[0].tolist() == full_viterbi(v, S.normal_bytes(text))


def test_equals_library_on_known_characters(v):
    """The library, told that the vocabulary is a unigram one, by its exact best-path search, on texts whose characters all are pieces."""
    import sentencepiece

    model = open(S.MODEL, "rb").read()
    at = model.index(b"tok_v0\x18\x02")
    lib = sentencepiece.SentencePieceProcessor()
    lib.LoadFromSerializedProto(model[: at + 7] + b"\x01" + model[at + 8 :])
    for t in ("hello there friend", "Of the and that from", "une maison dans la ville", "thwherstion andering"):
        assert S.encode_batch(v, [t])[0].tolist() == lib.nbest_encode_as_ids(t, 2)[0]


def test_window_stays_bounded(v):
    s, most, ids = S.StreamingViterbi(v), 0, []
    text = b"".join(S.words_of("thing and other words " * 200))
    for at in range(0, len(text), 50):
        ids += s.feed(text[at : at + 50])[0].tolist()
        most = max(most, len(s.held))
    assert most <= 64 + 2 * v.longest
    assert ids + s.finish()[0].tolist() == full_viterbi(v, text)


def test_commits_only_what_all_paths_share(v):
    """Whatever follows, ids that were committed are those of the whole stream."""
    head = S.normal_bytes("an unbelievable misunderstanding of internationalisation")
    for cut in (c for c in range(20, len(head)) if head[c] & 0xC0 != 0x80):
        for tail in (b"s", b"able thing", b"\xe2\x96\x81x", b"zzz"):
            s = S.StreamingViterbi(v)
            early = s.feed(head[:cut])[0].tolist()
            s.feed(tail * 10)
            whole = full_viterbi(v, head[:cut] + tail * 10)
            assert whole[: len(early)] == early


def test_long_words_take_the_same_path(v):
    for n in (4095, 4097, 20_000):
        text = ("anderthtion" * 2000)[:n]
        assert S.encode_batch(v, [text])[0].tolist() == S.stream_ids(v, [S.normal_bytes(text)], 512)[0].tolist()


def test_odd_rows(spark, odd_docs, no_docs):
    got = S.encode_documents(odd_docs, S.load_model(spark)).collect()
    assert len(got) == odd_docs.count() and all(r["exact"] for r in got) and {r["n_ids"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert S.encode_documents(no_docs, S.load_model(spark)).count() == 0


def test_whole_table_round_trips(spark, sf):
    got = S.op6_sentencepiece(spark, sf)
    assert got.where("not exact").count() == 0 and got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
