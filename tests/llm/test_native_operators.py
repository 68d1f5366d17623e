"""Operators made of DataFrame functions only: brute force, and odd input."""

import hashlib
import zlib

import pytest
from llm.helpers import ODD_TEXTS, contamination, corpus, dedup, prose, quality_base, words
from pyspark.sql import functions as F

from corvid.llm import line_dedup as LD
from corvid.llm import quality, sharding
from corvid.llm.chat import ChatTemplate, conversations_from, segments, turn_order
from corvid.llm.decontamination import PositionalIndex, contamination as contaminated_rows, drop_contaminated
from corvid.llm.mixing import mix_sources, mixed_rows, water_fill
from corvid.llm.quality import features, filter_quality, judge
from corvid.llm.sharding import DIMS, kd_shards, shard_rows

LONG = prose(1, 30_000)


def odd_rows(start=100):
    return [(start + i, t) for i, t in enumerate(ODD_TEXTS)]


# -- mixing -------------------------------------------------------------------

def test_water_filling_clamps_and_reshares(spark):
    rows = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 100, 1.0), ("z", 0, 1.0)], "_src string, _size long, _weight double")
    got = {r["_src"]: r["_target"] for r in water_fill(rows, 210.0, 3.0).collect()}
    # a is clamped at 30; the other 180 go 2 : 1 : 1 until z is clamped at 0
    assert got == {"a": 30.0, "b": 120.0, "c": 60.0, "z": 0.0}


def test_documents_without_words_are_repeated_as_their_source(spark):
    """A source clamped at three epochs has no rest: nothing of it is taken a fourth time."""
    rows = [(i, "word " * 3, "a") for i in range(4)] + [(10 + i, t, "a") for i, t in enumerate([None, "", " \n"] * 30)]
    rows += [(200 + i, "other " * 50, "b") for i in range(40)]
    copies = {r["doc_id"]: r["mix_copies"] for r in mix_sources(corpus(spark, rows)).collect()}
    assert {copies[i] for i, _, s in rows if s == "a"} == {3} and max(copies.values()) <= 3


def test_mix_comes_near_its_targets(spark):
    rows = [(i, prose(i, 20 + i % 60), f"s{i % 5}") for i in range(600)]
    rows += [(1000 + i, prose(i, 5), None) for i in range(20)] + [(2000, None, "s0"), (2001, "", "s1"), (2002, LONG, "s2")]
    docs = corpus(spark, rows)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], [0, 0, r["mix_target"], r["mix_source_size"]])
        s[0] += r["mix_size"]
        s[1] += r["mix_size"] * r["mix_copies"]
        assert 0 <= r["mix_copies"] <= 3
        assert r["mix_size"] == len(words(r["text"]))
    total = sum(s[0] for s in by.values())
    assert sum(s[2] for s in by.values()) == pytest.approx(total)
    for source, (size, taken, target, source_size) in by.items():
        assert size == source_size and target <= 3 * size + 1e-9
        if source != "s2":  # one document is nearly all of s2
            assert abs(taken - target) <= max(40, 0.02 * target), source
    again = {r["doc_id"]: r["mix_copies"] for r in mix_sources(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["mix_copies"] for r in got}
    mixed = mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["mix_copies"] for r in got)


def test_mix_given_weights_ties_and_empty(spark):
    docs = corpus(spark, [(1, "a b", "x"), (1, "a b", "x"), (2, "c d", "y"), (None, "e f", None)])
    weights = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "source string, weight double")
    got = mix_sources(docs, weights=weights).collect()
    copies = sorted((r["source"] or "", r["mix_copies"]) for r in got)
    assert [c for s, c in copies if s == ""] == [0]  # a source without a weight
    assert len({r["mix_copies"] for r in got if r["source"] == "x"}) == 1  # repeated rows share their fate
    assert mix_sources(corpus(spark, [])).collect() == [] and mixed_rows(corpus(spark, [])).collect() == []


# -- chat ---------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "<s>\\[INST]\\\\</s>", "[", "[/INST", "<\\s>", "", None, "a\nb\r\n", "$1 \\1 \\", "[INST][INST]</s></s>", "[[/INST]</s>"]


def test_chat_round_trip_and_loss(spark):
    rows = []
    for c, text in enumerate(NASTY):
        rows += [(c, 0, "user", text), (c, 1, "assistant", NASTY[-c]), (c, 2, "user\n[INST] %", text), (c, None, None, "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash"))
    t = ChatTemplate()
    out = conversations_from(segments(df, t)).withColumn("turns", t.turns_of(F.col("formatted")))
    out = out.withColumn("said", F.transform("loss_spans", t.unescape))
    for r in out.collect():
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: -1 if x[1] is None else x[1])
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["said"] == [x[3] or "" for x in own if x[2] == "assistant"]
    assert conversations_from(segments(df.limit(0), t)).collect() == []


def test_repeated_turns_stay_turns(spark):
    turns = [(1, 0, "user", "body"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (2, None, "user", "[INST]")]
    rows = [r for r in turns for _ in range(3)] + [(1, 1, "assistant", "no")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment_row", F.lit("clash"))
    for parts in (1, 5):
        t = ChatTemplate()
        out = conversations_from(segments(df.repartition(parts), t))
        got = {r["conv_id"]: r for r in out.withColumn("turns", t.turns_of(F.col("formatted"))).collect()}
        said = [(x["role"], x["text"]) for x in got[1]["turns"]]
        assert said[:3] == [("user", "body")] * 3 and said[7:] == [("user", "")] * 3
        assert sorted(said[3:7]) == [("assistant", "no")] + [("assistant", "yes")] * 3
        assert sorted(got[1]["loss_spans"]) == ["no", "yes", "yes", "yes"]
        assert [(x["role"], x["text"]) for x in got[2]["turns"]] == [("user", "[INST]")] * 3


def test_turn_order_runs_the_automaton_over_blocks(spark):
    good = [(1, i, ("user", "assistant")[i % 2], "t") for i in range(1000)]
    bad = [(2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "assistant", "a"), (4, 0, "tool", "x"), (4, 1, None, "x"), (None, 0, "system", "s"), (None, 1, "user", "s")]
    wrong = [(5, i, "assistant" if i == 256 else ("user", "assistant")[i % 2], "t") for i in range(300)]  # at a block's start
    df = spark.createDataFrame(good + bad + wrong, "conv_id long, turn long, role string, text string")
    got = {r["_conv"]: (r["n_turns"], r["n_bad_turns"]) for r in turn_order(df).collect()}
    assert got == {1: (1000, 0), 2: (2, 1), 3: (1, 1), 4: (2, 2), None: (2, 0), 5: (300, 2)}


# -- sharding -----------------------------------------------------------------

def test_shards_are_near_equal_and_gapless(spark):
    rows = [(i, "x" * (50 + i * 7 % 400), ("hot" if i % 3 else f"s{i % 7}")) for i in range(3000)] + odd_rows(5000)
    got = kd_shards(shard_rows(corpus(spark, rows)), DIMS, shards=24).collect()
    assert len(got) == len(rows)
    sizes, slots = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["_size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sizes) == list(range(24))
    mean = sum(sizes.values()) / 24
    assert max(abs(s - mean) for s in sizes.values()) < 0.06 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def tree(rows, leaves, first=0):
    """{row number: shard} of (number, size, tie, dimensions): each split by sorting."""
    if leaves == 1 or not rows:
        return {r[0]: first for r in rows}
    widths = [max(r[3][i] for r in rows) - min(r[3][i] for r in rows) for i in range(len(DIMS))]
    dim = max(range(len(DIMS)), key=lambda i: (widths[i], -i))
    key = lambda r: (r[3][dim], r[2])
    goal, before = sum(r[1] for r in rows) * (leaves // 2) // leaves, 0
    for at in sorted({key(r) for r in rows}):
        n = sum(r[1] for r in rows if key(r) == at)
        if before + n >= goal:
            left = [r for r in rows if key(r) < at or (key(r) == at and before + n / 2 <= goal)]
            break
        before += n
    right = [r for r in rows if r not in left]
    return tree(left, leaves // 2, first) | tree(right, leaves - leaves // 2, first + leaves // 2)


@pytest.mark.parametrize("plan_nodes", [0, 256])
def test_shards_are_those_of_a_sorted_tree(spark, plan_nodes, monkeypatch):
    monkeypatch.setattr(sharding, "PLAN_NODES", plan_nodes)
    sources = ["https://site0.example/a", "https://site1.example/a", "https://site1.example/b", None, "", "ä"]
    rows = [(i, "x" * (i * 37 % 211), sources[i % 7 % 6]) for i in range(150)] + [(500, "y" * 20000, "ä"), (501, None, None)]
    flat = shard_rows(corpus(spark, rows))
    ranks = {s: r["_rank"] for s, r in ((r["_value"], r) for r in sharding.value_ranks(corpus(spark, rows), "source").collect())}
    assert ranks == {s: i for i, s in enumerate(sorted((s for s in sources if s is not None), key=str.encode))}
    plain = [(r["doc_id"], r["_size"], r["_tie"], tuple(r[d] for d in DIMS)) for r in sharding.scaled(flat, DIMS).collect()]
    for leaves in (2, 5, 8):
        got = {r["doc_id"]: r["shard"] for r in kd_shards(flat, DIMS, shards=leaves).collect()}
        assert got == tree(plain, leaves)


def test_query_of_shards_gives_checksums_and_gapless_slots(spark):
    from corvid.llm.queries import QUERIES
    rows = QUERIES["op4_sharding"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]))
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_shards_by_target_bytes_ties_and_empty(spark):
    same = corpus(spark, [(7, "abc", None)] * 20 + [(None, None)])
    got = kd_shards(shard_rows(same), DIMS, target_bytes=50).collect()
    assert len(got) == 21 and len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    assert kd_shards(shard_rows(corpus(spark, [])), DIMS, shards=4).collect() == []


# -- decontamination ----------------------------------------------------------

def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_contamination_matches_brute_force(spark):
    a, b = prose(10, 40), prose(11, 20)
    items = [(0, a), (1, b), (2, "Short item, here!"), (3, None), (4, "..."), (5, "the the the the the the the the the the the the the the"),
             (6, a), (None, prose(12, 13))]
    w = a.split()
    texts = [prose(20, 100) + " " + " ".join(w[5:18]) + " " + prose(21, 50), " ".join(w[3:15]), a.upper() if a.isascii() else a, "short, ITEM: here. short item here",
             "the " * 200, " ".join(w[0:13] + w[14:30]), prose(22, 60) + "\n" + b + "\n" + a, "-".join(w[10:24]), prose(12, 13), LONG + " " + b, "item here short"] + ODD_TEXTS
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, b)]
    got = contaminated_rows(corpus(spark, rows), bench(spark, items)).collect()
    named = [(str(i) if i is not None else None, t) for i, t in items]
    seen = sorted((r["_id"] if r["_id"] is not None else -1, r["n_words"], r["n_hit"], sorted(r["items"])) for r in got)
    want = []
    for i, t in rows:
        n, hit, found = contamination(t, [x for x in named if x[0] is not None])
        n2, hit2, _ = contamination(t, named)
        want.append((i if i is not None else -1, n, hit2, found))
    assert [x[:3] for x in seen] == [x[:3] for x in sorted(want)]
    assert [x[3] for x in seen] == [x[3] for x in sorted(want)]


def test_long_texts_of_equal_words(spark):
    """What a document holds of occurrences is bounded by its words."""
    same = "again " * 20000
    items = [(0, "again " * 13), (1, "again " * 500), (2, "again " * 3), (3, "again again end"), (4, prose(1, 20))]
    rows = [(1, same), (2, same + "end " + prose(1, 20)), (3, "again " * 12), (4, "x " * 20000)]
    got = {r["_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"])
           for r in contaminated_rows(corpus(spark, rows), bench(spark, items)).collect()}
    assert got == {1: (20000, 20000, ["0", "1", "2"], True), 2: (20021, 20021, ["0", "1", "2", "3", "4"], True),
                   3: (12, 12, ["2"], True), 4: (20000, 0, [], False)}
    index = PositionalIndex(corpus(spark, rows), bench(spark, items))
    spans = index.phrases().filter("_item = 3").collect()
    assert [(r["_id"], r["_start"], r["_len"]) for r in spans] == [(2, 19998, 3)]


def test_contaminated_documents_go_and_proximity(spark):
    a = prose(30, 30)
    w = a.split()
    docs = corpus(spark, [(1, a), (2, prose(31, 80)), (3, " ".join(w[:10] + ["between"] + w[10:])), (4, None), (5, a + " " + prose(32, 1000))])
    kept = drop_contaminated(docs, bench(spark, [(0, a)]))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5]
    near = PositionalIndex(docs, bench(spark, [(0, a)])).proximity(2)
    assert {r["_id"] for r in near.collect()} <= {1, 3, 5}
    assert drop_contaminated(corpus(spark, []), bench(spark, [(0, a)])).collect() == []
    assert drop_contaminated(docs, bench(spark, [])).count() == 5


# -- quality ------------------------------------------------------------------

def test_features_match_brute_force(spark):
    texts = ODD_TEXTS + [LONG, LONG + " " + LONG, "a b c a b c", "x y z\nx y z\n\n \nx y z", "#*$ %&| <>", "a a a a", "a b a b a b c d e f a b c d"]
    rows = features(corpus(spark, list(enumerate(texts)))).collect()
    for r in rows:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == quality_base(r["text"]), r["doc_id"]


def sentences(seed, n):
    w = prose(seed, n).split()
    return "\n".join(" ".join(w[i:i + 10]).capitalize() + "." for i in range(0, n, 10))


def test_votes_part_good_from_bad(spark):
    good = [(i, sentences(i, 120)) for i in range(160)]
    bad = [(1000 + i, " ".join(x + "###" for x in prose(i, 100).split())) for i in range(10)]
    bad += [(1100 + i, " ".join(x.upper() + "!!" for x in prose(50 + i, 100).split())) for i in range(10)]
    bad += [(1200 + i, "\n".join([prose(i, 6)] * 30)) for i in range(10)]
    docs = corpus(spark, good + bad + odd_rows(2000))
    rows = judge(features(docs.drop("n_words"))).collect()
    assert all(r["kept"] for r in rows if r["doc_id"] < 1000)
    assert not any(r["kept"] for r in rows if r["doc_id"] >= 1000)
    assert all(0 <= r["quality"] <= 1 for r in rows)
    kept = filter_quality(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(160))
    assert filter_quality(corpus(spark, [])).collect() == []


# -- line dedup ---------------------------------------------------------------

def dedup_rows():
    line, other = "This line is longer than forty characters, É.", "Another line that is quite long enough to count"
    rows = [(i, f"{prose(i, 12)}\n  {line.upper() if i % 2 else line}\t\n{line}") for i in range(12)]
    rows += [(20 + i, f"{other}\nshort\n{'é' * 40}") for i in range(4)] + [(30 + i, "short\nshort") for i in range(9)]
    rows += [(50, "\n\n"), (51, None), (52, ""), (53, LONG), (54, line.replace("É", "é")), (55, "x" * 39)]
    return rows


@pytest.mark.parametrize("hot", [LD.HOT_LINES, 3])
def test_line_dedup_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(LD, "HOT_LINES", hot)
    rows = dedup_rows()
    docs = corpus(spark, rows)
    got = LD.dedup_lines(docs).collect()
    want = dedup(rows)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got} == want
    for r in got:  # the bitmap says the same
        lines = (r["text"] or "").split("\n")
        assert "\n".join(x for run in r["keep_runs"] for x in lines[run["start"]:run["start"] + run["len"]]) == r["kept_text"]


def test_a_round_of_votes_is_one_job(spark):
    votes = spark.createDataFrame([([i % 3, i % 2, (i // 3) % 3],) for i in range(60)], "votes array<int>")
    spark.sparkContext.setJobGroup("fit-votes", "rounds of one job")
    model = quality.fit_votes(votes, 3)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit-votes")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.rounds >= 10
    assert len(jobs) <= model.rounds + 8


def test_line_dedup_odd_rows(spark):
    line = "A line that is longer than forty characters by far"
    docs = corpus(spark, [(None, line)] * 2 + [(i, line) for i in range(4)] + [(3, line)])
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_dropped"]) for r in LD.dedup_lines(docs).collect())
    assert got == [(-1, 1), (-1, 1), (0, 1), (1, 1), (2, 1), (3, 0), (3, 0)]  # equal ids are one document
    assert LD.dedup_lines(corpus(spark, [])).collect() == []
    assert hashlib.sha256(b"").hexdigest()  # all lines lost gives the empty text


# -- the verdict of the quality rules -----------------------------------------

def rule_votes(text):
    """Votes of the default rules, from the text alone."""
    import regex
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = quality_base(text)
    joined, t = "".join(words(text)), text or ""
    known = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
        "n_lines": sum(bool(words(x)) for x in t.split("\n")), "n_other": len(regex.sub(r"[\p{L}\p{M}]", "", joined)),
        "n_capitals": len(regex.findall(r"\p{Lu}", joined)), "n_exclaims": joined.count("!"),
        "n_marks": len(regex.findall(r"[^\p{L}\p{M}\p{N} \t-\r]{2,}", t)),
        "n_plain": len(regex.findall(r"(?<![^ \t-\r])[\p{L}\p{M}]+[.,;:?!]?(?![^ \t-\r])", t)), "n_distinct": len(set(words(text)))}

    def holds(condition):
        condition = regex.sub(r"(\w+) BETWEEN (.+?) AND (.+)$", r"(\2) <= \1 <= (\3)", condition)
        return eval(condition.replace(" AND ", " and ").replace(" OR ", " or "), {}, known)

    return tuple(1 if holds(r.bad) else 0 if holds(r.good) else 2 for r in quality.DEFAULT_RULES)


def maximise(votes):
    """Posterior of each document's votes after the estimation has come to rest."""
    import math
    rules, total = len(votes[0]), len(votes)
    weight, prior = max(1.0, total / 20), 0.8
    rates = [[list(start) for _ in range(rules)] for start in (quality.GOOD_RATES, quality.BAD_RATES)]
    post = lambda v: 1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(
        math.log(rates[0][j][x] / rates[1][j][x]) for j, x in enumerate(v))))
    for _ in range(100):
        p = [post(v) for v in votes]
        mass = (sum(p), total - sum(p))
        new = [[[(sum(w for v, w in zip(votes, part) if v[j] == x) + weight * start[x]) / (m + weight) for x in range(3)]
                for j in range(rules)] for part, m, start in ((p, mass[0], quality.GOOD_RATES), ([1 - x for x in p], mass[1], quality.BAD_RATES))]
        new_prior = (mass[0] + 0.8 * weight) / (total + weight)
        gap = max([abs(new_prior - prior)] + [abs(x - y) for a, b in zip(new, rates) for s, t in zip(a, b) for x, y in zip(s, t)])
        rates, prior = new, new_prior
        if gap < 1e-5:
            break
    return [post(v) for v in votes]


def test_verdicts_match_brute_force_estimation(spark):
    texts = [sentences(i, 60 + i % 90) for i in range(90)] + [" ".join(x + "###" for x in prose(i, 90).split()) for i in range(12)]
    texts += [" ".join(x.upper() + "!!" for x in prose(i, 40 + i * 6).split()) for i in range(12)] + ["\n".join([prose(i, 6)] * 30) for i in range(8)]
    texts += [prose(i, 70) + " " + "É!!! $$ x1 " * (i % 9) for i in range(25)] + ODD_TEXTS + texts[:3]
    rows = judge(features(corpus(spark, list(enumerate(texts))))).collect()
    votes = [rule_votes(t) for t in texts]
    assert {r["doc_id"]: tuple(r["votes"]) for r in rows} == dict(enumerate(votes))
    want = maximise(votes)
    for r in rows:
        base = quality_base(r["text"])
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert abs(r["quality"] - want[r["doc_id"]]) < 1e-9 and r["base_failed"] == failed
        assert r["kept"] == (not failed and want[r["doc_id"]] >= 0.5)
    assert 0 < sum(r["kept"] for r in rows) < len(rows)
