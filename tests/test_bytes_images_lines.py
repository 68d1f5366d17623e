"""Unit checks: checksums, deflate symbol math, back-references, PNG bytes,
colour profiles and cat-style line transforms."""

import os
import random
import tempfile
import zlib

from pyspark.sql import functions as F

from corvid.functions import bytes as BF
from corvid.operators import bytes as Z
from corvid.operators import images as P
from corvid.operators import lines as L
from corvid.plans import queries_z
from corvid.sources import files as S

SAMPLES = [b"hello", b"", b"compressthis" + b"_foobar" * 1000 + b"$", bytes(random.Random(7).getrandbits(8) for _ in range(3000))]


def _blobs(spark):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(SAMPLES)], "id long, data binary")


def test_checksums_match_zlib(spark):
    got = {r.id: (r.crc, r.adler, r.adler_v) for r in _blobs(spark).select(
        "id", BF.crc32(F.col("data")).alias("crc"), BF.adler32(F.col("data")).alias("adler"),
        BF.adler32_vectorized(F.col("data")).alias("adler_v")).collect()}
    assert got[0] == (907060870, 103547413, 103547413)
    for i, b in enumerate(SAMPLES):
        assert got[i] == (zlib.crc32(b), zlib.adler32(b), zlib.adler32(b))
    big = bytes(random.Random(3).getrandbits(8) for _ in range(3 * BF.ADLER_CHUNK + 17))
    assert BF._adler32_np(big) == zlib.adler32(big)


def test_byte_values_and_bucket(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\x7f\xff A"),)], "b binary")
    assert df.select(BF.byte_values(F.col("b")).alias("v")).first().v == [0, 127, 255, 32, 65]
    dists = [1, 2, 4, 5, 6, 7, 9, 13, 17, 24577, 32768]
    want = []
    for d in dists:                     # reference formula, written out
        if d < 5:
            want.append((d - 1, 0))
        else:
            lvl = (d - 1).bit_length() - 1
            want.append((2 * lvl + (((d - 1) >> (lvl - 1)) & 1), lvl - 1))
    dd = spark.createDataFrame([(d,) for d in dists], "d long")
    got = [(r.b, r.e) for r in dd.select(BF.distance_bucket(F.col("d")).alias("b"),
                                         BF.distance_extra_bits(F.col("d")).alias("e")).collect()]
    assert got == want and max(b for b, _ in got) == 29


def test_previous_occurrence_and_spans(spark):
    docs = spark.createDataFrame([(1, "abcabcabcX"), (2, "ab")], "doc_id long, text string")
    g = Z.kgrams(docs, ["doc_id"], F.col("text"))
    m = Z.previous_occurrence(g, ["doc_id"]).orderBy("pos")
    assert [(r.pos, r.dist) for r in m.collect()] == [(3, 3), (4, 3), (5, 3), (6, 3)]
    s = Z.repeated_spans(m, ["doc_id"]).collect()
    assert [(r.start, r.dist, r.length) for r in s] == [(3, 3, 6)]
    long = spark.createDataFrame([(1, "a" * 600)], "doc_id long, text string")
    sp = Z.repeated_spans(Z.previous_occurrence(Z.kgrams(long, ["doc_id"], F.col("text")), ["doc_id"]), ["doc_id"])
    assert [r.length for r in sp.collect()] == [599]
    cut = Z.repeated_spans(Z.previous_occurrence(Z.kgrams(long, ["doc_id"], F.col("text")), ["doc_id"]), ["doc_id"], max_len=258)
    lengths = sorted(r.length for r in cut.collect())
    assert max(lengths) == 258 and sum(x - 2 for x in lengths) == 598 - 1
    far = spark.createDataFrame([(1, "xyzwv" + "".join(chr(0x4E00 + i % 20000) for i in range(40000)) + "xyzwv")], "doc_id long, text string")
    m = far.select(Z.previous_occurrence_in_row(F.col("text"), 5).alias("m")).first().m
    assert m.dist[-1] == 40005 and far.select(Z.repeated_spans_in_row(F.col("text"), 5).alias("s")).first().s.length[0] > 258


def test_entropy_runs_and_pick(spark):
    h = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "z", 4)], "g long, symbol string, count long")
    per, tot = Z.entropy_bits(h, ["g"])
    t = {r.g: round(r.total_bits, 6) for r in tot.collect()}
    assert t[2] == 0.0 and abs(t[1] - (3 * 0.415037 + 1 * 2.0)) < 1e-5
    seq = spark.createDataFrame([(1, i, c) for i, c in enumerate([0] * 6 + [3] * 7 + [3, 0, 0])],
                                "g long, symbol int, count long")
    runs = {(r.start, r["count"]): (r.run_length, r.collapsible) for r in Z.run_lengths(seq, ["g"]).collect()}
    assert runs[(0, 0)] == (6, True) and runs[(6, 3)] == (8, True) and runs[(14, 0)] == (2, False)
    v = spark.createDataFrame([(1, 0, "a", 10, True), (1, 1, "b", 10, True), (1, 2, "c", 5, False)],
                              "k long, ordinal int, name string, size long, auto boolean")
    assert Z.pick_smallest(v, ["k"]).first().name == "a"


def test_chunk(spark):
    docs = spark.createDataFrame([(1, "abcdefg"), (2, "")], "doc_id long, text string")
    c = {(r.doc_id, r.chunk_no): r.piece for r in Z.chunk(docs, ["doc_id"], "text", 3).collect()}
    assert c == {(1, 0): "abc", (1, 1): "def", (1, 2): "g", (2, 0): ""}


def test_png_header_errors(spark):
    df = spark.range(1).select(P.png_bytes(F.lit(4), F.lit(1)).alias("png"))
    good = df.first().png
    cases = {"ok": good, "sig": b"\x00" + good[1:], "short": good[:20], "empty": b"",
             "crc": good[:29] + b"\x00\x00\x00\x00" + good[33:], "zero": None}
    zero = spark.range(1).select(P.png_bytes(F.lit(0), F.lit(1)).alias("p")).first().p
    cases["zero"] = zero
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "k string, b binary")
    got = {r.k: r.h for r in rows.select("k", P.image_header(F.col("b")).alias("h")).collect()}
    assert (got["ok"].width, got["ok"].height, got["ok"].depth, got["ok"].colour_type, got["ok"].error) == (4, 1, 8, 6, 0)
    assert {k: got[k].error for k in ["sig", "short", "empty", "crc", "zero"]} == {
        "sig": 28, "short": 27, "empty": 48, "crc": 57, "zero": 93}


def test_png_chunks(spark):
    extra = P.png_chunk("tEXt", F.encode(F.lit("k\u0000v"), "UTF-8"))
    df = spark.range(1).select(F.lit(7).alias("image_id"), P.png_bytes(F.lit(2), F.lit(2), extra).alias("data"))
    ch = P.image_chunks(df).orderBy("ordinal").collect()
    assert [c.name for c in ch] == ["IHDR", "tEXt", "IDAT", "IEND"]
    assert ch[1].ancillary and not ch[0].ancillary and all(c.crc_ok for c in ch)
    assert [c.location for c in ch] == [0, 0, 2, 2]
    trunc = spark.createDataFrame([(8, bytearray(df.first().data[:40]))], "image_id long, data binary")
    assert P.image_chunks(trunc).where("error = 'truncated'").count() == 1


def _pixels(spark, rows):
    return spark.createDataFrame([(1, x, 0, *p) for x, p in enumerate(rows)],
                                 "image_id long, x int, y int, r int, g int, b int, a int")


def test_colour_profile_and_cleaning(spark):
    grey = _pixels(spark, [(10, 10, 10, 255), (0, 0, 0, 255), (255, 255, 255, 255), (17, 17, 17, 255)])
    pr = P.colour_profile(grey).first()
    assert (pr.coloured, pr.key_possible, pr.alpha_needed, pr.bits, pr.colours) == (False, False, False, 8, 4)
    assert P.minimal_colour_mode(P.colour_profile(grey)).first().mode == "grey"
    keyed = _pixels(spark, [(1, 2, 3, 255), (9, 9, 9, 0), (9, 9, 9, 0), (4, 5, 6, 255)])
    assert P.colour_profile(keyed).first().key_possible
    clash = _pixels(spark, [(9, 9, 9, 255), (9, 9, 9, 0)])
    assert not P.colour_profile(clash).first().key_possible
    mixed = _pixels(spark, [(1, 2, 3, 255), (7, 7, 7, 0), (4, 5, 6, 128), (8, 8, 8, 0)])
    cl = P.clean_transparent(mixed).orderBy("x").collect()
    assert [(r.r, r.g, r.b) for r in cl] == [(1, 2, 3), (7, 7, 7), (4, 5, 6), (7, 7, 7)]
    ok = {r.image_id: r.ok for r in P.verify_pairs(mixed, P.clean_transparent(mixed),
                                                     lossy=True).collect()}
    strict = P.verify_pairs(mixed, P.clean_transparent(mixed), lossy=False).first().ok
    assert ok == {1: True} and strict is False
    assert P.colour_counts(mixed, transparent_as_one=True).first().colours == 3


def test_cleaning_with_many_colours_and_partly_transparent(spark):
    opaque = [(i % 256, i // 256, 7, 255) for i in range(300)]
    keyed = _pixels(spark, opaque + [(1, 1, 1, 0), (2, 2, 2, 0)])
    out = P.clean_transparent(keyed).orderBy("x").collect()
    assert [(r.r, r.g, r.b) for r in out[-2:]] == [(1, 1, 1), (1, 1, 1)]     # no pixel is partly transparent
    rows = [(1, x, y, *p) for y, line in enumerate([opaque + [(5, 5, 5, 9)], [(1, 1, 1, 0), (3, 3, 3, 128), (2, 2, 2, 0)]]) for x, p in enumerate(line)]
    both = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")
    out = P.clean_transparent(both).where("y = 1").orderBy("x").collect()
    assert [(r.r, r.g, r.b) for r in out] == [(5, 5, 5), (3, 3, 3), (3, 3, 3)]  # the last before, also in the row above
    assert P.colour_counts(keyed).first().colours == 302 and not P.colour_counts(keyed).first().fits_palette


def test_profile_bits_and_modes(spark):
    red = _pixels(spark, [(255, 0, 0, 255), (0, 0, 255, 255)] * 20)
    pr = P.colour_profile(red).first()
    assert (pr.coloured, pr.alpha_needed, pr.bits, pr.n_pixels) == (True, False, 8, 40)
    assert (P.minimal_colour_mode(P.colour_profile(red)).first().mode, P.minimal_colour_mode(P.colour_profile(red)).first().mode_bits) == ("palette", 1)
    few = P.minimal_colour_mode(P.colour_profile(_pixels(spark, [(0, 0, 0, 0), (255, 255, 255, 255)]))).first()
    assert (few.mode, few.mode_bits) == ("grey+alpha", 8)                    # a key does not pay here
    grey = P.minimal_colour_mode(P.colour_profile(_pixels(spark, [(0, 0, 0, 255), (255, 255, 255, 255)] * 20))).first()
    assert (grey.mode, grey.mode_bits) == ("grey", 1)                        # as narrow as a palette
    key = P.minimal_colour_mode(P.colour_profile(_pixels(spark, [(i, i, i, 255) for i in range(200)] + [(201, 201, 201, 0)]))).first()
    assert (key.mode, key.mode_bits) == ("grey+key", 8)


def test_empty_inputs_and_bad_images(spark):
    one = spark.createDataFrame([("a.png", "a.png", 0, 0, None, True)], "name string, out_name string, in_size long, out_size long, old_size long, error boolean")
    assert P.size_report(one).first().percent is None
    assert spark.range(1).select(BF.percent_removed(F.lit(0), F.lit(0)).alias("p")).first().p is None
    old = spark.createDataFrame([("a", "a", 9, 5), ("b", "out_b", 9, 5)], "name string, out_name string, out_size long, old_size long")
    assert [r.kept for r in P.keep_better(old).orderBy("name").collect()] == ["old", "new"]
    assert [r.kept for r in P.keep_better(old, use_prefix=True).collect()] == ["old", "old"]
    files = spark.createDataFrame([("d/opt_a.png",)], "path string")
    assert P.skip_outputs(files, "opt_").count() == 1 and P.skip_outputs(files.union(files), "opt_").count() == 0
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"12345678"))], "image_id long, data binary")
    assert [r.error for r in P.image_chunks(bad).collect()] == ["truncated"] * 3
    good = spark.range(1).select(F.lit(7).alias("image_id"), F.concat(P.png_bytes(F.lit(2), F.lit(2)), F.unhex(F.lit("0A0B"))).alias("data"))
    assert [r.name for r in P.image_chunks(good).orderBy("ordinal").collect()][-1] == "IEND"


def test_line_transforms(spark):
    files = spark.createDataFrame([(0, "a\tb\r\n\n\n"), (1, "\nx\x7f\x01é"), (2, "")],
                                  "file_ord int, content string")
    lines = L.file_lines(files)
    assert lines.count() == 5
    sq = L.number_lines(L.squeeze_blank(lines)).orderBy("file_ord", "idx").collect()
    assert [r.out for r in sq] == ["     1\ta\tb\r", "     2\t", "     3\tx\x7f\x01é"]
    nb = L.number_lines(lines, nonblank=True).orderBy("file_ord", "idx").collect()
    assert [r.n for r in nb] == [1, None, None, None, 2]
    row = spark.createDataFrame([("a\tb\r",), ("x\x7f\x01é",)], "l string")
    got = [(r.e, r.t, r.v, r.a) for r in row.select(L.show_ends(F.col("l")).alias("e"), L.show_tabs(F.col("l")).alias("t"),
                                                     L.show_nonprinting(F.col("l")).alias("v"),
                                                     L.show_all(F.col("l")).alias("a")).collect()]
    assert got[0] == ("a\tb^M$", "a^Ib\r", "a\tb^M", "a^Ib^M$")
    assert got[1][2] == "x^?^AM-CM-)"


def test_concat_files_keeps_order_across_splits(spark):
    d = tempfile.mkdtemp(prefix="cat-", dir="/tmp")
    paths = []
    for k in range(2):
        p = os.path.join(d, f"f{k}.txt")
        with open(p, "w") as fh:
            fh.write("".join(f"{k}-{i:05d}\n" for i in range(3000)))
        paths.append(p)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = S.concat_files(spark, list(reversed(paths)))
        got = [r.line for r in df.orderBy("file_ord", "split_start", "mid").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"1-{i:05d}" for i in range(3000)] + [f"0-{i:05d}" for i in range(3000)]


def test_file_sources(spark):
    d = tempfile.mkdtemp(prefix="src-", dir="/tmp")
    with open(f"{d}/s.csv", "w") as fh:
        fh.write("FuncName, Length, Result\nfoo, 20, Success\nbar, 120, Failure\n")
    s = S.read_samples(spark, f"{d}/s.csv").collect()
    assert [(r.func_name, r.length, r.result) for r in s] == [("foo", 20, "Success"), ("bar", 120, "Failure")]
    os.makedirs(f"{d}/proj")
    with open(f"{d}/proj/inventory.json", "w") as fh:
        fh.write('[{"name": "a", "filename": "x/a.c", "startLine": 1, "endLine": 3, "calledFunctions": []},\n'
                 ' {"name": "b", "filename": "b.c", "startLine": 2, "endLine": 2}]')
    f = {r.name: (r.calledFunctions, r.project) for r in S.read_functions(spark, f"{d}/proj/inventory.json").collect()}
    assert f == {"a": ([], "proj"), "b": (None, "proj")}
    with open(f"{d}/sets.json", "w") as fh:
        fh.write('{"toy": {"description": "d", "code_dir": "c", "test_dir": "t", "setup_script": "s", '
                 '"test_scripts": ["a.sh"]}}')
    assert S.read_datasets(spark, f"{d}/sets.json", "toy").first().test_scripts == ["a.sh"]
    import pytest
    with pytest.raises(KeyError):
        S.read_datasets(spark, f"{d}/sets.json", "nope")
    with open(f"{d}/cc.json", "w") as fh:
        fh.write('[{"directory": "/w", "file": "a.c", "arguments": ["cc", "-Iinc", "-I  sp"]}]')
    assert S.read_compile_commands(spark, f"{d}/cc.json").first().arguments[1] == "-Iinc"
    with open(f"{d}/log.json", "w") as fh:
        fh.write('{"date": "2024", "attempts": 2, "model": "m", "results": []}')
    from corvid.operators import translate as X
    assert X.result_summary(S.read_run_logs(spark, f"{d}/log.json")).first().functions == 0
    blobs = S.read_blobs(spark, f"{d}/*.csv").collect()
    assert blobs[0].length == len(blobs[0].content)
    S.write_compressed(spark.createDataFrame([("x",)], "value string"), f"{d}/gz", "gzip")
    assert any(n.endswith(".gz") for n in os.listdir(f"{d}/gz"))


def test_scan_scenarios(spark):
    d = tempfile.mkdtemp(prefix="scn-", dir="/tmp")
    for cat, task, src in [("creation", "task1", False), ("debugging", "task2", True)]:
        os.makedirs(f"{d}/{cat}/{task}")
        with open(f"{d}/{cat}/{task}/README.md", "w") as fh:
            fh.write("Correctness:\n- Works: 20\n")
        with open(f"{d}/{cat}/{task}/prompt.txt", "w") as fh:
            fh.write(f"do {task}")
        if src:
            os.makedirs(f"{d}/{cat}/{task}/source")
            with open(f"{d}/{cat}/{task}/source/main.c", "w") as fh:
                fh.write("int main(){}")
    got = {(r.category, r.task): (r.prompt, r.has_source) for r in S.scan_scenarios(spark, d).collect()}
    assert got == {("creation", "task1"): ("do task1", False), ("debugging", "task2"): ("do task2", True)}


def test_in_row_and_window_back_references_agree(spark):
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    docs = docs.union(spark.createDataFrame([(10**6, "aaaaaa" * 100 + "é€𝄞" * 50)], "doc_id long, text string"))
    win = Z.previous_occurrence(Z.kgrams(docs, ["doc_id"], F.col("text")), ["doc_id"]).select("doc_id", "pos", "dist")
    row = Z.explode_struct_arrays(docs.select("doc_id", Z.previous_occurrence_in_row(F.col("text")).alias("m")),
                                  ["doc_id"], "m", ["pos", "dist"])
    assert win.exceptAll(row).count() == 0 and row.exceptAll(win).count() == 0
    sw = Z.repeated_spans(win, ["doc_id"]).select("doc_id", "start", "dist", "length")
    sr = Z.explode_struct_arrays(docs.select("doc_id", Z.repeated_spans_in_row(F.col("text")).alias("s")),
                                 ["doc_id"], "s", ["start", "dist", "length"])
    assert sw.exceptAll(sr).count() == 0 and sr.exceptAll(sw).count() == 0


def test_row_summaries_run_once_and_agree_with_the_arrays(spark, tmp_path):
    docs = [(1, "abcabcabcabc, abc"), (2, "aaaaaaa"), (3, "ab"), (4, ""), (5, None), (6, "été été été 😀😀😀😀")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    x = spark.read.parquet(str(tmp_path / "documents.parquet")).select(
        "doc_id", Z.previous_occurrence_in_row(F.col("text")).dist.alias("dist"),
        Z.repeated_spans_in_row(F.col("text")).length.alias("length")).collect()
    for query, column in ((queries_z.z7, "dist"), (queries_z.z8, "length")):
        df = query(spark, str(tmp_path))
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        want = sorted((r.doc_id, len(r[column]), sum(r[column]), max(r[column])) for r in x if r[column])
        assert sorted(map(tuple, df.collect())) == want and len(want) == 3
