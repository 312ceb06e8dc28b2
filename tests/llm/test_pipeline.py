import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from dialogprep.llm import byte_bpe, languages, pipeline
from tests.conftest import SF
from tests.llm.test_decontaminate import brute as passage
from tests.llm.test_jaccard import brute as joined
from tests.llm.test_languages import best_set, features
from tests.llm.test_suffix_dedup import brute as repeats

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, function, rows, sf=SF):
    docs = spark.createDataFrame(rows, COLUMNS)
    out = function(spark, docs, sf)
    assert out.schema == docs.schema
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_every_stage_equals_brute_force(spark, con):
    rows = con.execute("SELECT * FROM documents").fetchall()
    rows += [(9000, None, None, None, None), (9001, "12 34 !", "en", "s", 7), (None, rows[0][1], "en", "s", 1)]
    counts = {}
    for _, text, lang, *_ in rows:
        if text and lang:
            own = counts.setdefault(lang, np.zeros(languages.BUCKETS, np.int64))
            for bucket, n in features(text).items():
                own[bucket] += n
    model = languages.Model(counts)

    def good(text):
        if not text or not re.search(r"[^\W\d_]", text):
            return False
        return best_set(model, text)[1].max() >= pipeline.LEAST_SHARE

    got = stage(spark, pipeline.identify_languages, rows)
    assert {9000, 9001}.isdisjoint(r[0] for r in got)
    some = rows[:60] + rows[-3:]
    assert [r in got for r in some] == [good(r[1]) for r in some]
    rows = got

    got = stage(spark, pipeline.drop_near_duplicates, rows)
    component = {d: c for d, _, c in joined([(d, t) for d, t, *_ in rows], 5, 8, 10)}
    assert got == [r for r in rows if component[r[0]] == r[0]] and len(got) < len(rows)
    rows = got

    got = stage(spark, pipeline.cut_repeats, rows)
    ordered = sorted(rows, key=lambda r: r[0])
    want = repeats([r[1].encode() for r in ordered], 100)
    left = {r[0]: r for r in got}
    for row, (size, removed, _, kept) in zip(ordered, want):
        if not removed:
            assert left[row[0]] == row
        elif row[0] in left:  # characters at the edges of a cut may stay
            text = left[row[0]][1].encode()
            assert len(kept) <= len(text) <= len(kept) + 6 * (size - removed + 1)
            assert left[row[0]][4] == len(left[row[0]][1])
    assert any(removed for _, removed, _, _ in want)
    rows = got

    got = stage(spark, pipeline.drop_benchmark_passages, rows)
    items = con.execute("SELECT text FROM benchmark").fetchall()
    gone = {r[0] for r in rows} - {r[0] for r in got}
    texts = {r[0]: r[1] for r in rows}
    assert all(any(passage(texts[d], item) for (item,) in items) for d in gone)
    assert all(d in gone for d, t in texts.items() if any(item in t for (item,) in items))
    assert got == [r for r in rows if r[0] not in gone]

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=byte_bpe.read_ranks(
                                None, public_tokenizers.path(pipeline.RANKS)))
    out = pipeline.encode_bytes(spark, spark.createDataFrame(got, COLUMNS), SF).collect()
    assert {r.doc_id: r.ids for r in out} == {r[0]: own.encode_ordinary(r[1]) for r in got}


def test_run_chains_the_stages(spark, con):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "jaccard_join", "suffix_dedup", "decontamination", "byte_bpe"]
    out = corpus_pipeline.run(spark, SF)
    (rows,) = con.execute("SELECT count(*) FROM documents").fetchone()
    assert 0.5 * rows < out.count() < rows
    assert out.columns == ["doc_id", "n_tokens", "ids"]


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, SF).count() == 0


def test_near_duplicates_keep_repeats_once(spark):
    rows = [(5, "a b c d e f g", "en", "s", 1)] * 2 + [(3, "a b c d e f g", "en", "s", 1)]
    rows += [(None, "a b c d e f g", "en", "s", 1), (7, None, None, None, None), (8, "", "en", "s", 0)]
    rows += [(None, "h i j k l m", "en", "s", 1), (None, "n o p q r s", "en", "s", 1)]
    got = stage(spark, pipeline.drop_near_duplicates, rows)
    assert sorted((r[0] or 0, r[1] or "") for r in got) == [
        (0, "h i j k l m"), (0, "n o p q r s"), (3, "a b c d e f g"), (7, ""), (8, "")]
