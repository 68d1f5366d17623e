"""Divergence audit, quality classifier and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.helpers import LOWER, ODD_TEXTS, SCHEMA, corpus, prose
from pyspark.sql import functions as F

from corvid.llm import boosting
from corvid.llm import divergence as D
from corvid.llm import quality_classifier as QC
from corvid.llm import resampling as R

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def audit(rows, min_docs, top):
    """Rows of (lang, source, text) -> {(lang, source, part, item): (value, rank)}."""
    rows = [tuple(x or "" for x in r) for r in rows]
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), {(a, b) for a, b, _ in rows}
    for lang, source, text in rows:
        w = TERM.findall(text.translate(LOWER))
        n[lang, source].update(w)
        docs[lang].update(set(w))
    out = {}
    for lang, source in groups:
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        p = {}
        for g in [x for x in groups if x[0] == lang] + [lang]:
            c = sum((n[x] for x in groups if x[0] == lang), Counter()) if g == lang else n[g]
            total = sum(c[t] for t in kept)
            p[g] = {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        own = p[lang, source]
        pairs = [(x[1], sum(f(own[t], p[x][t]) for t in kept)) for x in groups if x[0] == lang and x[1] != source]
        terms = [(t, f(own[t], p[lang][t])) for t in kept if n[lang, source][t] and own[t] > p[lang][t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out[lang, source, part, item] = (value, rank)
    return out


def languages(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0, "x", None, "y", "z") for i, (lang, source, t) in enumerate(rows)], SCHEMA)


def uneven_rows():
    r = random.Random(5)
    words = [w for w in prose(3, 60).split()]
    rows = [(r.choice(["en", "en", "de", None]), r.choice(["a", "b", "ä", None]),
             " ".join(r.choice(words[:r.choice([3, 20, 60])]) for _ in range(r.randint(0, 60))).title()) for _ in range(120)]
    # ties, repeated rows, odd texts, a language without kept terms, a group without terms
    return rows + rows[:9] + [("en", "a", t) for t in ODD_TEXTS] + [("xx", "a", "solo"), ("xx", "b", None), ("de", "blank", "1 2 3")]


def test_divergence_matches_brute_force(spark):
    rows = uneven_rows()
    got = D.audit_divergence(languages(spark, rows), min_docs=4, top_terms=5).collect()
    want = audit(rows, 4, 5)
    assert {(x.lang, x.source, x.part, x.item): (x.value, x.rank) for x in got} == want and len(got) == len(want)


def test_divergence_of_empty_and_hot_tables(spark):
    assert D.audit_divergence(languages(spark, []).limit(0)).count() == 0
    rows = [("en", "a", "same words again " * 500)] * 12 + [("en", "b", "same " * 3)]
    got = D.audit_divergence(languages(spark, rows)).collect()
    assert {(x.lang, x.source, x.part, x.item): (x.value, x.rank) for x in got} == audit(rows, 10, 10)


def test_joint_tables_count_pairs_of_levels(spark):
    rows = uneven_rows()
    levels = D.Levels(languages(spark, rows), min_docs=4, block_terms=7)
    got = {tuple(r[:-1]): r.terms for r in D.joint_tables(levels).collect()}
    counts = defaultdict(Counter)
    for r in levels.kept.collect():
        counts[r.lang, r.source][r.term] = r.n
    want, terms = Counter(), defaultdict(set)
    for (lang, _), c in counts.items():
        terms[lang] |= set(c)
    groups = {(lang or "", source or "") for lang, source, _ in rows}
    for lang, a in groups:
        for other, b in groups:
            if lang == other and a < b:
                for t in terms[lang]:
                    want[lang, a, counts[lang, a][t], b, counts[lang, b][t]] += 1
    assert got == dict(want)


@pytest.mark.parametrize("tile", [1, 3, 4096])
def test_tiles_of_the_product_agree(tile):
    counts = np.random.default_rng(1).integers(0, 4, (5, 40))
    got = Counter()
    for a, x, b, y, n in D.one_hot_product(counts, tile):
        for cell in zip(a, x, b, y, n):
            got[tuple(int(v) for v in cell[:4])] += int(cell[4])
    want = Counter((a, int(counts[a, t]), b, int(counts[b, t])) for a in range(5) for b in range(a + 1, 5) for t in range(40))
    assert got == want


# ---------------------------------------------------------------- resampling
def resampled(rows, targets, percent, min_words, most, buckets=50, seed=2024):
    """Rows of (id, text) -> sorted (id, n_features, weight, score, rank)."""
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [" ".join(w[i:i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, t in rows for f in features(t)[1])
    t = Counter(of(f) for x in targets for f in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        n, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[of(x)] for x in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= min_words])
    able = sorted((x for x in out if x[5]), key=lambda x: (-x[3], math.inf if x[0] is None else x[0]))
    for rank, x in enumerate(able[:percent * len(able) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("percent,most", [(10, 1), (33, 2), (100, 1), (0, 1)])
def test_resampling_matches_brute_force(spark, percent, most):
    rows = [(i, prose(i % 40, 5 + i % 50) + (" éa B7" if i % 3 else "")) for i in range(150)]
    rows += [(200 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, prose(9, 40)), (300, "long " * 30000)]
    targets = [prose(4, 60), None, "", "éa b7 B7"]
    got = R.resample(corpus(spark, rows), corpus(spark, list(enumerate(targets))), percent, 20, buckets=50, most=most)
    got = sorted(((x.doc_id, x.n_features, x.weight, x.score, x["rank"]) for x in got.collect()), key=repr)
    assert got == resampled(rows, targets, percent, 20, most)


def test_resampling_draws_equal_rows_in_part_and_ties_by_id(spark):
    scored = spark.createDataFrame([(i, 7, True) for i in [5, 3, 9, 3, 3, None]] + [(1, 9, True), (2, 1, True), (0, 99, False)],
                                   "doc_id long, score long, drawable boolean")
    for wanted in range(10):
        got = R.draw(scored, wanted).collect()
        assert len(got) == 9
        drawn = sorted((x["rank"], x.doc_id) for x in got if x["rank"])
        assert drawn == list(enumerate([1, 3, 3, 3, 5, 9, None, 2], 1))[:wanted]


def test_resampling_of_empty_tables(spark):
    docs, none = corpus(spark, [(1, prose(1, 30)), (2, prose(2, 30))]), corpus(spark, [(1, "x")]).limit(0)
    assert R.resample(none, docs).count() == 0
    assert sorted(x["rank"] for x in R.resample(docs, none, percent=100).collect()) == [1, 2]


# ---------------------------------------------------------------- classifier
def junk(seed):
    r = random.Random(seed)
    text = prose(seed, r.randint(30, 80))
    return [text.upper() + "!!", text.replace(" ", "### "), (text[:60] + "\n") * 20][seed % 3]


def labelled(spark, n=240):
    rows = [(i, junk(i) if i % 4 == 1 else prose(i, 30 + i % 50)) for i in range(n)]
    return rows, spark.createDataFrame([(i, int(i % 4 != 1)) for i, _ in rows], "doc_id long, quality int")


def test_classifier_is_right_on_rows_that_taught_nothing(spark):
    rows, labels = labelled(spark)
    rows += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(2000, "x " * 200000), (3, rows[3][1])]
    docs = corpus(spark, rows)
    got = QC.classify_quality(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    of = [(r.predicted, int(r.doc_id % 4 != 1)) for r in got if r.held_out and r.doc_id < 240]
    assert sum(a == b for a, b in of) >= 0.95 * len(of) > 0
    # held-out labels, other columns and ids have no influence
    flipped = labels.withColumn("quality", F.when(QC.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = QC.classify_quality(docs.withColumn("lang", F.lit("zz")), flipped).collect()
    assert sorted((r.doc_id, r.score) for r in got) == sorted((r.doc_id, r.score) for r in again)


def test_classifier_without_labels_or_rows(spark):
    rows, labels = labelled(spark, 12)
    docs = corpus(spark, rows)
    assert {r.score for r in QC.classify_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert len({r.score for r in QC.classify_quality(docs, labels.withColumn("quality", F.lit(1))).collect()}) == 1
    assert QC.classify_quality(docs, labels.withColumn("quality", F.lit(None).cast("int"))).count() == 12
    assert QC.classify_quality(docs.limit(0), labels).count() == 0


def test_statistics_are_those_of_each_text_alone():
    import pyarrow as pa
    texts = [None, "", "Ab cd. EF!!\nab cd. 7", "Größe x", "x", "end.", "Next word"] + ODD_TEXTS
    whole = QC.text_statistics(pa.array(texts))
    for text, row in zip(texts, whole):
        assert np.array_equal(QC.text_statistics(pa.array([text], pa.string()))[0], row)
    at = {n: i for i, n in enumerate(QC.STATISTICS)}
    row = whole[2]
    assert row[at["log_words"]] == pytest.approx(math.log(7)) and row[at["capital_words"]] == pytest.approx(2 / 6)
    assert row[at["marked_words"]] == pytest.approx(3 / 6) and row[at["distinct_words"]] == pytest.approx(4 / 6)
    assert row[at["digit"]] == pytest.approx(1 / 20) and row[at["line_end"]] == pytest.approx(1 / 20)


def test_trees_split_where_a_plain_search_does():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(400, 3))
    labels = ((rows[:, 1] > 0.3) ^ (rng.random(400) < 0.05)).astype(float)
    one = boosting.fit(rows, labels, trees=1, depth=1, bins=64)
    slope, curve = labels - labels.mean(), np.full(400, labels.mean() * (1 - labels.mean()))
    part = lambda m: slope[m].sum() ** 2 / (curve[m].sum() + 1)
    gains = {(f, b): part(rows[:, f] <= b) + part(rows[:, f] > b) for f in range(3) for b in boosting.bin_borders(rows, 64)[f]}
    assert (one.feature[0, 0], one.border[0, 0]) == max(gains, key=gains.get)
    many = boosting.fit(rows, labels)
    assert ((many.chance(rows) > 0.5) == labels).mean() > 0.95
    walked = []
    for row in rows[:20]:
        margin = many.base
        for f, b, leaf in zip(many.feature, many.border, many.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > b[node])
            margin += leaf[node - len(f)]
        walked.append(1 / (1 + math.exp(-margin)))
    assert np.allclose(many.chance(rows[:20]), walked)
