"""SimHash, MinHash and line dedup against brute force, on hard rows and on crowded buckets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from footlog.llm import linededup, minhash, neartexts, simhash
from tests.llm import corpus


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints, radius=3):
    """The smallest index each index reaches over pairs within the radius."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_near_duplicates_of_hard_rows(spark):
    data = corpus.rows()
    found = simhash.near_duplicates(corpus.clashing(corpus.frame(spark)))
    got = Counter((r.doc_id, r.digits, r.component_id) for r in found.withColumn("digits", simhash.hex_of(F.col("fp"))).collect())
    prints = [_fingerprint(r[1]) for r in data]
    label = _classes(prints)
    least = {c: min((data[i][0] for i in range(len(data)) if label[i] == c and data[i][0] is not None), default=None) for c in set(label)}
    assert got == Counter((data[i][0], f"{prints[i]:016x}", least[label[i]]) for i in range(len(data)))
    assert simhash.near_duplicates(corpus.frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [4, 512])
def test_crowded_buckets_lose_no_link(spark, most):
    """Hundreds of fingerprints around one centre: buckets are divided again and again, and the classes stay the same."""
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 250:
        near = rng.choice(list(prints)) if rng.random() < 0.3 else centre
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            near ^= 1 << b
        prints.add(near)
    prints |= {rng.getrandbits(64) for _ in range(150)}
    prints = sorted(prints)
    signed = {p: simhash._signed(p) for p in prints}
    links = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), most=most)
    rows = links.collect()
    assert all((r.a % 2**64 ^ r.b % 2**64).bit_count() >= 1 for r in rows)
    found = {r.node: r.label for r in simhash.components(links).collect()}
    label = _classes(prints)
    groups = Counter(frozenset(signed[prints[i]] for i in range(len(prints)) if label[i] == c) for c in set(label))
    ours = {}
    for p in signed.values():
        ours.setdefault(found.get(p, p), set()).add(p)
    assert Counter(map(frozenset, ours.values())) == groups
    assert all(lab == min(members) for lab, members in ours.items())


def test_forest_is_no_list_of_all_pairs():
    fps = np.array([1 << i for i in range(60)] + [0], dtype=np.uint64)
    a, _ = simhash.links_in_buckets(fps, np.zeros(len(fps), int))
    assert len(a) == len(fps) - 1


def test_long_chains_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001)], "a long, b long")
    found = {r.node: r.label for r in simhash.components(edges).collect()}
    assert {found[i] for i in range(1, 301)} == {0}
    assert found[2001] == 2000


def _shingles(text):
    words = text.replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_minhash_of_hard_rows(spark):
    data = sorted((r for r in corpus.rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in data]
    want, exact = Counter(), {}
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want[data[i][0], len(text), digest] += 1
        exact.setdefault((data[i][0], digest), []).append((_likeness(_shingles(text), _shingles(edited)), _likeness(_shingles(text), _shingles(after))))
    got = minhash.compare_edits(corpus.clashing(corpus.frame(spark))).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    for r in got:
        assert any(abs(r.near_edited - edited) < 0.2 and abs(r.near_next - after) < 0.2 for edited, after in exact[r.doc_id, r.edited_sha256])
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 2 * minhash.BINS
    assert minhash.compare_edits(corpus.frame(spark, [])).count() == 0
    assert minhash.compare_edits(corpus.frame(spark, [(5, "a b", None, None, 3)])).first().near_next == 1.0


def test_minhash_estimates_are_unbiased(spark):
    pairs, errors = [], []
    for i in range(150):
        words = [f"w{i}x{k}" for k in range(20 + 3 * i)]
        other = words[: len(words) * 2 // 3] + [f"z{i}x{k}" for k in range(len(words) // 3)]
        pairs.append((i, " ".join(words), " ".join(other)))
    frame = spark.createDataFrame(pairs, "i int, a string, b string")
    marked = minhash.with_fingerprint(minhash.with_fingerprint(frame, "a", "fa"), "b", "fb")
    for r in marked.withColumn("near", minhash.likeness(F.col("fa"), F.col("fb"))).collect():
        errors.append(r.near - _likeness(_shingles(r.a), _shingles(r.b)))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def _deduped(data, least=50):
    """Brute force over all windows of whole lines: what stays of every text."""
    docs = {}
    for r in data:
        if r[1] is not None:
            docs[r[0] is not None, r[0] or 0, r[1]] = r
    # Order of documents: id (null first), then the text's hash, which Spark computes.
    from pyspark.sql import SparkSession

    hashes = {r.t: r.h for r in SparkSession.active().createDataFrame([(k[2],) for k in docs], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    order = {k: (k[0], k[1], hashes[k[2]]) for k in docs}
    windows, first = {}, {}
    for k in docs:
        lines = k[2].split("\n")
        sizes = [len(x.encode().split()) for x in lines]
        used = [i for i, n in enumerate(sizes) if n]
        found = set()
        for step in (1, -1):
            for a in range(len(used)):
                held, b = 0, a
                while 0 <= b < len(used) and held < least:
                    held += sizes[used[b]]
                    b += step
                if held >= least:
                    low, high = sorted((a, b - step))
                    found.add((used[low], used[high], tuple(lines[i] for i in used[low : high + 1])))
        windows[k] = found
        for low, high, content in found:
            at = (*order[k], low, high)
            first[content] = min(first.get(content, at), at)
    out = {}
    for k, found in windows.items():
        gone = set()
        for low, high, content in found:
            at = first[content]
            if (*order[k], low, high) > at:
                gone |= set(range(max(low, at[4] + 1) if at[:3] == order[k] else low, high + 1))
        out[k] = "\n".join(x for i, x in enumerate(k[2].split("\n")) if i not in gone)
    return out


def test_line_dedup_of_hard_rows(spark):
    data = corpus.rows()
    kept = _deduped(data)
    found = linededup.dedup(corpus.clashing(corpus.frame(spark)))
    assert found.columns.count("lines_removed") == 1
    want = Counter((r[0], kept[r[0] is not None, r[0] or 0, r[1]] if r[1] is not None else None) for r in data)
    assert Counter((r.doc_id, r.text) for r in found.collect()) == want
    assert any(k != v[2] for v, k in kept.items())
    assert linededup.dedup(corpus.frame(spark, [])).count() == 0


def test_line_dedup_catches_planted_passages_and_leaves_the_rest(spark):
    passage = corpus.prose(1000, 55, line=55)
    clean = [corpus.prose(2000 + i, 200) for i in range(20)]
    short = "this work is licensed under some licence"
    texts = [short + "\n" + clean[i] + ("\n" + passage if i % 4 == 0 else "") + f"\nthe end of {i}" for i in range(20)]
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    for r in linededup.dedup(corpus.frame(spark, data)).collect():
        planted = r.doc_id % 4 == 0 and r.doc_id > 0
        assert r.text == (texts[r.doc_id].replace("\n" + passage, "") if planted else texts[r.doc_id])
        assert list(r.copied_from) == ([0] if planted else [])


def _five(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_pipeline_drops_every_text_alike_by_five_words(spark):
    rng, data = random.Random(11), list(corpus.rows())
    for i in range(40):  # copies with one to twelve words changed or added: 0.6 to 0.98 alike
        words = corpus.prose(1000 + i, 30 + 12 * i).split(" ")
        for k in range(3):
            copy = list(words)
            for _ in range(1 + (i + k) % 12):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            data.append((10_000 + 10 * i + k, " ".join(copy + ["more"] * k), "en", None, 0))
        data.append((10_000 + 10 * i + 9, " ".join(words), "en", None, 0))
    sets = [_five(r[1]) for r in data]
    label, likeness = list(range(len(data))), []
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                likeness.append(both / max(1, len(x | sets[j])))
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if c == old else c for c in label]
    assert sum(0.8 <= x < 0.95 for x in likeness) > 30
    want = Counter(min(((data[i][0] is None, data[i][0] or 0) for i in range(len(data)) if label[i] == c)) for c in set(label))
    kept = corpus_pipeline.drop_near_duplicates(spark, corpus.frame(spark, data), "/nowhere").collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept) == want


def test_pipeline_links_by_fingerprints_and_loses_no_pair_beyond_their_radius(spark):
    rows = [(i, corpus.prose(40, 120 + i // 8) + (f" end{i}" if i % 2 else ""), "en", None, None) for i in range(24)] + [(90, corpus.prose(41, 200), "en", None, None)]
    documents = corpus.frame(spark, rows)
    pairs = neartexts.nominated(documents).collect()
    fps, sets = {}, {}
    for r in rows:
        grams = neartexts.shingles(r[1].encode())
        fps.setdefault(neartexts.node_of(grams), set()).add(simhash.simhash(r[1].encode(), 5))
        sets[neartexts.node_of(grams)] = set(grams.tolist())
    assert len({(r.a, r.b) for r in pairs}) == len(pairs)
    assert any(r.near for r in pairs)
    for r in pairs:
        assert r.near == any((x ^ y).bit_count() <= neartexts.RADIUS for x in fps[r.a] for y in fps[r.b])
    alike = {(min(a, b), max(a, b)) for a in sets for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert alike <= {(r.a, r.b) for r in pairs}
    labels = [{(r.doc_id, r.label) for r in neartexts.near_duplicates(documents, radius=radius).collect()} for radius in (neartexts.RADIUS, 0, 64)]
    assert labels[0] == labels[1] == labels[2]


def test_near_duplicates_mark_and_count_texts_in_one_pass(spark, monkeypatch):
    documents, names, staged = corpus.frame(spark), [], neartexts.staged
    monkeypatch.setattr(neartexts, "staged", lambda frame, name: names.append((name, staged(frame, name))) or names[-1][1])
    assert neartexts.near_duplicates(documents).count() == documents.count()
    made = dict(names)["neartexts"]
    want = np.zeros(neartexts.SLOTS, np.int64)
    for r in documents.collect():
        np.add.at(want, (neartexts.shingles((r.text or "").encode()) % np.uint64(neartexts.SLOTS)).astype(np.int64), 1)
    assert "chunk" in made.columns and (neartexts.slot_counts(made) == want).all()
