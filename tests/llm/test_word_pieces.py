from hypothesis import given
from hypothesis import strategies as st

from dialogprep.llm import word_pieces
from dialogprep.llm.queries import QUERIES
from tests.conftest import SF


def greedy(word, begins, continues):
    at, n, pieces = 0, 0, begins
    while at < len(word) or n == 0:
        ends = [e for e in range(len(word), at - 1, -1)
                if word[at:e] in pieces and (e > at or n == 0)]
        if not ends:
            return 1, 1
        at, n, pieces = ends[0], n + 1, continues
    return n, 0


PIECES = st.sets(st.text("abc", max_size=4), max_size=12)


@given(PIECES, PIECES, st.lists(st.text("abcd", min_size=1, max_size=9), max_size=6))
def test_equals_greedy_matching(begins, continues, words):
    automaton = word_pieces.Automaton(begins, continues)
    want = [greedy(w, begins, continues - {""}) for w in words]
    got = automaton.total(" ".join(words).encode())
    assert got == (len(words), sum(n for n, _ in want), sum(u for _, u in want))


def test_query_equals_greedy_matching(spark, con):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [model.id_to_piece(i) for i in range(3, model.get_piece_size()) if not model.is_byte(i)]
    begins, continues = map(set, word_pieces.marked_pieces(pieces))
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op2_word_piece_counts"](spark, SF).collect()}
    texts = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(rows) == len(texts)
    for doc_id, text in texts[:40]:
        want = [greedy(w.decode(), begins, continues) for w in text.encode().split()]
        assert rows[doc_id] == (len(want), sum(n for n, _ in want), sum(u for _, u in want))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(word_pieces, "MAX_REMEMBERED", 2)
    rows = [(1, None, 0), (2, "", 0), (3, " ab\nabc  x ", 0), (3, " ab\nabc  x ", 0), (None, "ab", 1),
            (4, "ab" * 500_000 + " " + "ab abc " * 300_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = word_pieces.count(docs, ["a", "ab"], ["b", "ab", "c"]).collect()
    assert sorted((r.doc_id or 0, *tuple(r)[1:]) for r in got) == [
        (0, 1, 1, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 3, 4, 1), (3, 3, 4, 1),
        (4, 600_001, 500_000 + 300_000 * 3, 0)]
    assert word_pieces.count(docs.limit(0), ["a"], ["b"]).count() == 0
