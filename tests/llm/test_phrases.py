"""Collocations and fill-in-middle against brute force: hard rows, tiny tries that burst and spill, long texts in portions."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from footlog.llm import infill, phrases
from tests.llm import corpus

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_counts(rows, longest=4):
    counts = Counter()
    for _, text, lang, *_ in rows:
        for piece in PIECE.split((text or "").translate(LOWER)):
            words = WORD.findall(piece)
            for size in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return counts


def brute_phrases(rows, least, most, longest=4):
    counts, out = brute_counts(rows, longest), []
    totals = Counter()
    for (lang, words), n in counts.items():
        totals[lang] += n if len(words) == 1 else 0
    candidates = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= least}
    for (lang, words), a in candidates.items():
        cuts = [(int(Fraction(2000000 * a, counts[lang, words[:k]] + counts[lang, words[k:]])), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = [n for (other, longer), n in candidates.items() if other == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))]
        if not any(100 * n >= 80 * a for n in inside):
            out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(mine[:most])]
    return sorted(ranked)


def found(frame, **settings):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.top_phrases(frame, **settings).collect())


def repeated(seed=3):
    """Words of a small vocabulary, some of them set phrases, in two languages."""
    rng, rows = random.Random(seed), []
    pool = ["New", "york", "city", "é", "漢字", "of", "THE", "the", "a", "İx", "in the end", "at. the, end", "x y", "one\ttwo", "a b c d e f"]
    for i in range(150):
        rows.append((i, " ".join(rng.choices(pool, k=rng.randrange(60))) + rng.choice(["", ".", "\n", "  "]), ["en", "fr", None][i % 3], None, None))
    return [*rows, (None, None, None, None, None), (1, "", "en", None, None)]


@pytest.mark.parametrize("longest,least,most", [(4, 30, 2000), (4, 12, 9), (3, 20, 50), (2, 20, 2000)])
def test_phrases_are_those_of_brute_force(spark, longest, least, most):
    rows = repeated()
    frame = corpus.clashing(corpus.frame(spark, rows))
    assert found(frame, least=least, most=most, longest=longest) == brute_phrases(rows, least, most, longest)


def test_hard_rows(spark):
    rows = corpus.rows()
    assert found(corpus.clashing(corpus.frame(spark)), least=5) == brute_phrases(rows, 5, 2000)
    assert found(corpus.frame(spark, []), least=1) == []


def collected(rows, low, high, monkeypatch, **limits):
    """The runs of one task, merged, with the trie's limits set low."""
    import pyarrow as pa

    for name, value in limits.items():
        monkeypatch.setattr(phrases, name, value)
    made = {}

    class Frame:
        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in rows]), pa.array([(r[1] or "").encode() for r in rows], pa.binary())], names=["lang", "text"])
            made["runs"] = [list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in run(iter([batch, batch.slice(0, 0)]))]
            return self

        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return None

    phrases.counted(Frame(), low, high)
    merged = Counter()
    for run in made["runs"]:
        assert run == sorted(run, key=lambda r: [w.encode() for w in r[1].split(" ")]) or len({r[0] for r in run}) > 1
        for lang, phrase, n in run:
            merged[lang, phrase] += n
    return merged, len(made["runs"])


@pytest.mark.parametrize("low,high", [(1, 1), (2, 2), (3, 4)])
def test_bursts_spills_and_portions_change_no_count(monkeypatch, low, high):
    rows = [*corpus.rows(), (1, "ab cd. " * 900 + "ef gh ij " * 700, "fr", None, None)]
    want = Counter({(lang, " ".join(words)): n for (lang, words), n in brute_counts(rows).items() if low <= len(words) <= high})
    if low == 1:
        for _, text, lang, *_ in rows:
            want[lang or "und", ""] += sum(len(WORD.findall(p)) for p in PIECE.split(text or ""))
    small, runs = collected(rows, low, high, monkeypatch, PORTION=500, MOST_WORDS=300, MOST_WINDOWS=200, BURST=5)
    assert small == want and runs > 20
    monkeypatch.undo()
    assert collected(rows, low, high, monkeypatch)[0] == want


def test_a_portion_is_read_in_few_bytes_and_hashes_are_kept_for_links_only(monkeypatch):
    import tracemalloc

    portion = (b"some words of, a portion\n" * 90_000)[: phrases.PORTION]
    tracemalloc.start()
    phrases._words(portion)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 19 * len(portion)
    made, whole = [], phrases.Trie
    monkeypatch.setattr(phrases, "Trie", lambda: made.append(whole()) or made[-1])
    assert collected([(1, "a b c, d e", "en", None, None)], 2, 2, monkeypatch)[0]["en", "d e"] == 1
    assert [len(t.hashes) for t in made] == [1] and len(made[0].words) == 6


def test_runs_are_dealt_before_they_are_added_up_again(spark):
    """A task that holds a trie keeps no second table of its phrases; counts of several runs still meet."""
    rows = corpus.rows()
    texts = corpus.frame(spark, rows).selectExpr("coalesce(lang, 'und') as lang", "cast(coalesce(text, '') as binary) as text")
    want = {(lang, " ".join(words)): n for (lang, words), n in brute_counts(rows).items() if len(words) == 2}
    for common in (None, [], ["the", "same", "one"]):
        made = phrases.merged(phrases.counted(texts, 2, 2), common)
        assert made.columns == ["lang", "phrase", "n"] and {(r.lang, r.phrase): r.n for r in made.collect()} == want
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 1
        below = plan[plan.rindex("Exchange hashpartitioning") :]
        assert "MapInArrow" in below and "Aggregate" not in below


def test_repeated_parts_are_never_sized_small_enough_to_broadcast(spark, monkeypatch):
    """Spark takes rows repeated once per salt, and windows inside longer phrases, for as few as the stored phrases are."""
    monkeypatch.setattr(phrases, "SALTS", 300)
    made = phrases.collocations(phrases.frequent_phrases(corpus.frame(spark), least=3))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan
    assert made.count() > 0 and "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_common_words_are_few(spark):
    rows = [("en", "", 3000), ("fr", "", 1000), ("en", "the", 400), ("fr", "le", 90), ("en", "a", 3), ("fr", "a", 2), ("en", "rare", 4), ("fr", "peu", 3)]
    assert sorted(phrases.common_words(spark.createDataFrame(rows, phrases.RUN))) == ["a", "le", "the"]
    assert phrases.common_words(spark.createDataFrame([], phrases.RUN)) == []


def test_the_filter_keeps_every_frequent_part_and_few_others(spark):
    frequent = spark.createDataFrame([("en", f"w{i} v{i}") for i in range(5000)], "lang string, phrase string")
    held = phrases.part_filter(frequent, 20)
    import numpy as np

    def passes(a, b, lang=b"en"):
        return bool(phrases._in_filter(held, phrases._pair_hash(*(np.array([phrases._word_hash(lang, w)], np.uint64) for w in (a, b))))[0])

    assert all(passes(f"w{i}".encode(), f"v{i}".encode()) for i in range(5000))
    assert sum(passes(f"w{i}".encode(), f"v{i + 1}".encode()) for i in range(5000)) < 50
    assert sum(passes(f"w{i}".encode(), f"v{i}".encode(), b"fr") for i in range(5000)) < 50


def test_scores_beyond_64_bits(spark):
    big = 5 * 10**15
    rows = [("en", "", 0, 3 * big), ("en", "a", 1, big + 2), ("en", "b", 1, big + 1), ("en", "a b", 2, big)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, phrase string, words int, n long")).collect()
    assert [(r.a, r.l, r.r, r.score) for r in got] == [(big, big + 2, big + 1, 2000000 * big // (2 * big + 3))]


# Fill-in-middle


def brute_fill(key, text, rate=50, suffix_first=80):
    units = UNIT.findall(text)
    h = [int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in infill.MARKERS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    before, middle, after = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(before), len(middle), f"<S>{after}<P>{before}<M>{middle}"
    return len(units), "psm", len(before), len(middle), f"<P>{before}<S>{after}<M>{middle}"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("aé漢🙂 \n\t\x1c\x85<PSM>", max_size=60), st.sampled_from([1, 2, 3, 7, 64]))
def test_cuts_of_every_unit(text, block):
    tree, units = infill.UnitTree(text.encode(), block), UNIT.findall(text)
    assert tree.n == len(units)
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert tree.cut(k) == (len(before.encode()), len(before))


def test_long_text_over_many_blocks():
    text = "".join(random.Random(2).choices(["word", "é", "漢字", " ", "\n", "🙂 "], k=300_000))
    tree, units = infill.UnitTree(text.encode()), UNIT.findall(text)
    for k in (0, 1, 2, 4095, 4096, len(units) // 2, len(units) - 1, len(units)):
        before = "".join(units[:k])
        assert tree.cut(k) == (len(before.encode()), len(before))


@pytest.mark.parametrize("rate,suffix_first", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_rearranged_rows_and_round_trip(spark, rate, suffix_first):
    marked = [(i, f"a <{m}> b {'<' * (i % 3)}", "en", None, None) for i, m in enumerate("PSMQ" * 5)]
    edges = [(i, "x<" * (i % 4) + "S><P" + " y" * i, "en", None, None) for i in range(60)]
    rows = [*corpus.rows(), *marked, *edges]
    made = infill.fill_in_middle(corpus.clashing(corpus.frame(spark, rows)), rate=rate, suffix_first=suffix_first)
    from pyspark.sql import functions as F

    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((r[0], *brute_fill(r[0], r[1] or "", rate, suffix_first), r[1] or "") for r in rows)
    assert Counter(tuple(r) for r in got) == want
    assert infill.fill_in_middle(corpus.frame(spark, [])).count() == 0
