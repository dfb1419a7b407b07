"""Language ID, n-gram scoring, top-k, sharding and the pipeline on hard rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from footlog.llm import langid, ngrams, sharding, topk
from tests.llm import corpus


def _fold(doc):
    return None if doc is None else zlib.crc32(str(doc).encode()) % 5


def test_language_id_of_hard_rows(spark):
    got = langid.identify(corpus.clashing(corpus.frame(spark)).drop("lang_pred", "score")).collect()
    assert len(got) == len(corpus.rows())
    texts = Counter((r[0], r[1]) for r in corpus.rows())
    for r in got:
        assert r.held_out == (_fold(r.doc_id) == 0) and 0 <= r.score <= 1
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {d for d, t in texts if not any(c.isalpha() for c in t or "")}
    assert {r.lang_pred for r in got} == {"en", "fr", "und"}
    nothing = langid.identify(corpus.frame(spark, [(1, "some words", None, None, 1), (2, None, None, None, 1)])).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.identify(corpus.frame(spark, [])).count() == 0


def test_language_id_on_held_out_texts(spark):
    data = [(i, corpus.prose(i, 60, corpus.FR if i % 2 else corpus.EN), "fr" if i % 2 else "en", None, 0) for i in range(200)]
    got = langid.identify(corpus.frame(spark, data)).where("held_out").collect()
    assert len(got) > 20 and all(r.lang_pred == ("fr" if r.doc_id % 2 else "en") for r in got)


def test_unseen_words_back_off():
    model = langid.Model(["a", "b"], {"": {"a": 10, "b": 10}, "1": {"a": 40, "b": 40}, "2": {"a": 30, "b": 30}}, {"": [("a", "xyz", 9)], "1": [("b", "q", 9), ("a", "z", 3)], "2": [("b", "qu", 5)]})
    assert np.argmax(model.word("xyz")) == 0  # known word first
    assert np.argmax(model.word("quz")) == 1  # its known pair speaks, not the single z
    assert np.argmax(model.word("zz")) == 0  # then single characters
    assert model.word("ww") is None


def test_what_is_broadcast_is_bounded(spark):
    data = [(i, corpus.prose(i, 300), "en", None, 0) for i in range(30)]
    model = langid.train(corpus.frame(spark, data), words=20, grams=10)
    assert len(model.logs[""]) <= 20 and all(len(model.logs[str(n)]) <= 10 for n in range(1, 5))


def test_long_runs_count_whole(spark):
    for word in ("ab", "x" * 64, "".join(chr(97 + i % 26) for i in range(65)), corpus.prose(1, 60).replace("\n", " ").replace(" ", "")):
        for n in range(1, 5):
            marked = f" {word} " if n > 1 else word
            made = [g for start in langid.pieces_of(word) for g in langid.grams_of(word, n, start)]
            assert made == [marked[i : i + n] for i in range(len(marked) - n + 1)]
    same = "kokoro" * 11  # two languages that differ only after their first 66 letters
    data = [(i, same + ("vavuvi" if i % 2 else "zezozu") * 40, "ab"[i % 2], None, 0) for i in range(60)]
    got = langid.identify(corpus.frame(spark, data)).where("held_out").collect()
    assert len(got) > 5 and all(r.lang_pred == "ab"[r.doc_id % 2] and r.score > 0.9 for r in got)
    model = langid.Model(["a", "b"], {"": {"a": 9, "b": 9}, "1": {"a": 9, "b": 9}}, {"": [("b", "w", 9)], "1": [("a", "q", 9)]})
    assert model.scorer()("w " * 5 + "q" * 64 * 9)[0] == "a"  # a run weighs by its length


def test_every_label_is_learned(spark):
    def text(lang, i):
        own = "bcdfghjklm"[lang % 10] + "aeiouyrs"[lang // 10]
        return " ".join(own * 2 + "abcdefgh"[(i + k) % 8] for k in range(20 if lang < 70 else 5))

    data = [(100 * i + lang, text(lang, i), f"l{lang}", None, 0) for lang in range(75) for i in range(8)]
    got = langid.identify(corpus.frame(spark, data)).collect()
    assert len(got) == 600 and all(r.lang_pred == f"l{r.doc_id % 100}" for r in got)


def test_a_small_table_of_words_changes_no_score(monkeypatch):
    rows = [("ab"[i % 2], f"w{chr(97 + i)}", 1 + i) for i in range(20)]
    model = langid.Model(["a", "b"], {"": {"a": 100, "b": 110}, "1": {}}, {"": rows, "1": []})
    text = " ".join(w for _, w, _ in rows[:11]) + " unknown"
    want = model.scorer()(text)
    monkeypatch.setattr(langid, "_CELLS", 4)
    assert model.scorer()(text)[0] == want[0] and math.isclose(model.scorer()(text)[1], want[1], rel_tol=1e-6)


def _tokens(text):
    return [*(text or "").encode().lower().split(), b""]


@pytest.mark.parametrize(("head", "segment", "per_block"), [(200_000, 128 << 20, 400_000), (30, 128 << 20, 400_000), (200_000, 1500, 300)])
def test_scores_of_hard_rows(spark, head, segment, per_block):
    data = corpus.rows()
    counts = Counter(t for r in data if r[0] is not None and _fold(r[0]) != 1 for t in _tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for doc, text, *_ in data:
        t = _tokens(text)
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        want.append((doc, _fold(doc) == 1, len(t), sum(counts[x] > 0 for x in t), n, round(base, 6)))
    got = ngrams.score(corpus.clashing(corpus.frame(spark)), head=head, segment=segment, per_block=per_block).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == Counter(want)
    assert all(r.score < 0 for r in got)
    if head == 30:
        whole = {(r.doc_id, r.n_tokens): r.score for r in ngrams.score(corpus.frame(spark)).collect()}
        assert all(math.isclose(whole[r.doc_id, r.n_tokens], r.score) for r in got)


def test_no_text_is_dealt_to_meet_the_levels_of_other_segments(spark):
    """Several segments and words outside the head give the scores of one segment, and no text goes through a shuffle."""
    one = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in ngrams.score(corpus.frame(spark), per_block=300).collect())
    whole = {(r.doc_id, r.n_tokens): r.score for r in ngrams.score(corpus.frame(spark), per_block=300).collect()}
    made = ngrams.score(corpus.frame(spark), per_block=300, segment=1500, head=30)
    got = made.collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == one
    assert all(math.isclose(whole[r.doc_id, r.n_tokens], r.score) for r in got)
    assert "text#" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_read_once_whatever_the_size_of_the_filter(spark, monkeypatch):
    """A filter of many blocks stages the same tables as one of a single block, and portions of any size give the same scores."""
    documents, names, staged = corpus.frame(spark), [], ngrams.staged
    monkeypatch.setattr(ngrams, "staged", lambda frame, name: names.append((name, "text#" in frame._jdf.queryExecution().optimizedPlan().toString())) or staged(frame, name))
    want = sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in ngrams.score(documents, per_block=300).collect())
    one = list(names)
    names.clear()
    got = ngrams.score(documents, per_block=300, segment=1500)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got.collect()) == want
    assert names == one and sum(text for _, text in names) == 1
    for portion, head in ((1, 30), (500, 200_000)):
        small = ngrams.score(documents, per_block=300, portion=portion, head=head).collect()
        assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in small) == want


def test_score_of_nothing(spark):
    assert ngrams.score(corpus.frame(spark, [])).count() == 0
    row = ngrams.score(corpus.frame(spark, [(None, "a b", None, None, 0)])).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0)


def test_filter_holds_every_count_and_little_else():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    grams, counts = rng.integers(0, 2**63, 5000), rng.geometric(0.02, 5000) + 1
    parts = [x for g, n in ((grams, counts), (grams[:100], counts[:100])) for x in ngrams._blobs(g.view(np.uint64), n, 1, False)]
    table = pa.Table.from_batches(parts)
    row = ngrams._filled(table).to_pylist()[0]
    segment = ngrams.Segment([row], 1)
    true = ngrams.level_of(np.r_[counts[:100] * 2, counts[100:]])
    found = segment.levels(grams.view(np.uint64)).astype(int)
    assert (found >= true).all() and (found > true).mean() < 0.03
    absent = segment.levels(rng.integers(0, 2**63, 20_000).view(np.uint64))
    assert (absent > 0).mean() < 0.03 and (absent > 1).mean() < 0.002


def test_pairs_met_once_are_held(spark):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    grams = rng.integers(0, 2**63, 20_000).view(np.uint64)
    row = ngrams._filled(pa.Table.from_batches(list(ngrams._blobs(grams, np.ones(len(grams), int), 1, False)))).to_pylist()[0]
    segment = ngrams.Segment([row], 1)
    assert (segment.levels(grams) >= 1).all()
    assert (segment.levels(rng.integers(0, 2**63, 200_000).view(np.uint64)) > 0).mean() < 0.001
    # All words are frequent, each pair of neighbours is met once; one held-out text has that order, one the reverse.
    names = [f"n{i}" for i in range(400)]
    text = " ".join(names)
    others = [(100 + i, " x ".join(names[i:] + names[:i]), None, None, 0) for i in range(30)]
    held, learned = [i for i in range(50) if _fold(i) == 1][:2], [i for i in range(50) if _fold(i) != 1][0]
    data = [*others, (learned, text, None, None, 0), (held[0], text, None, None, 0), (held[1], " ".join(names[::-1]), None, None, 0)]
    got = {r.doc_id: r.score for r in ngrams.score(corpus.frame(spark, data)).collect() if r.doc_id < 100}
    assert got[held[0]] > got[held[1]] + 100


def test_model_beats_the_base_where_words_depend_on_each_other(spark):
    import random

    rng, data = random.Random(3), []
    for i in range(150):
        words = [w for _ in range(80) for k in [rng.randrange(30)] for w in (f"a{k}", f"b{k}")]
        data.append((i, " ".join(words), None, None, 0))
    got = [r for r in ngrams.score(corpus.frame(spark, data)).collect() if r.held_out]
    assert len(got) > 10 and sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


def _vectors(spark, n=400, size=6):
    rng = np.random.default_rng(5)
    made = [(int(i), [float(x) for x in rng.normal(0, 0.3, size)]) for i in range(n)]
    made += [(n + i, made[3][1]) for i in range(40)]  # ties
    made += [(900, None), (901, [None] * size), (950, [float("nan")] * size), (1000, [float("inf")] * size), (None, [0.1] * size)]
    made += [(1050, [0.0] * size), (1100, [0.5]), (1101, [0.25]), (1150, []), (1200, [1e30] * size), made[7], (50, [9.0] * size)]
    return made, spark.createDataFrame(made, "vec_id long, embedding array<float>")


def test_top_k_is_brute_force(spark):
    made, frame = _vectors(spark)
    rows = []
    for vec, e in made:
        if vec is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            rows.append((vec, [int(math.floor(256 * float(np.float32(x)))) for x in e]))
    want = []
    for n, (q, e) in enumerate(rows):
        if q % 50 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(e, c, strict=True)))), v) for m, (v, c) in enumerate(rows) if m != n and len(c) == len(e))[:5]
            want += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scored)]
    for block, queries in ((8192, 4096), (60, 3)):
        got = topk.top_k(frame.withColumn("score", F.lit("x")), block=block, queries=queries)
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)
    assert topk.top_k(frame.limit(0)).count() == 0


def test_search_ends_early_on_telling_lists():
    values = np.zeros((5000, 8))
    values[:, 0] = np.arange(5000)
    lists = topk.Lists(np.arange(5000), np.arange(5000), values)
    ids, scores, scored = lists.best(-1, np.array([3.0, 1, 0, 0, 0, 0, 0, 0]), 5)
    assert ids.tolist() == [4999, 4998, 4997, 4996, 4995] and scored < 300


def test_shards_are_even_and_steady(spark):
    table = sharding.filled()
    shares = Counter(table)
    assert set(shares) == set(range(64)) and max(shares.values()) - min(shares.values()) <= 1
    fewer = sharding.filled(sharding.SHARDS[:-1])
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 63) < 0.1 * len(table)
    with pytest.raises(ValueError):
        sharding.filled(("a", "a"))
    with pytest.raises(ValueError):
        sharding.filled(("a", "b"), 100)


def test_shards_of_hard_rows(spark):
    documents = corpus.clashing(corpus.frame(spark))
    got = sharding.assign(documents, "doc_id").select("doc_id", "shard").collect()
    table = sharding.filled()
    for r in got:
        slot = sharding._hash("" if r.doc_id is None else str(r.doc_id)) % sharding.SLOTS
        assert r.shard == sharding.SHARDS[table[slot]]
    assert len(got) == len(corpus.rows())
    assert sharding.assign(corpus.frame(spark, []), "doc_id").count() == 0
    assert sharding.sizes(sharding.assign(documents, "doc_id")).agg(F.sum("rows")).first()[0] == len(got)


def test_pipeline_stages(spark):
    docs = corpus.clashing(corpus.frame(spark)).select("doc_id", "text", "lang", "source", "n_chars", "fingerprint", "label")
    shapes = docs.columns
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "/nowhere").collect(), docs.schema)
        assert docs.columns == shapes
        counts.append(docs.count())
    letters = sum(any(c.isalpha() for c in r[1] or "") for r in corpus.rows())
    assert counts[1] == letters  # every text in a known language stays, the others go
    assert counts[2] == counts[1] and counts[3] < counts[2]
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/nowhere").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in docs.collect())


def test_pipeline_of_nothing(spark):
    docs = corpus.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/nowhere")
        assert docs.count() == 0
